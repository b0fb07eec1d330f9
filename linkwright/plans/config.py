"""Linkage configurations: two JSON dialects, overlays, and batch runs."""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from hashlib import md5
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators.linkage import LinkageConfig, LinkageResult, find_matches
from ..operators.scoring import Algorithm, FieldMapping
from ..sources.files import load
from ..sources.sinks import read_text, save, save_report
from ..storage import stored

CARDINALITY = {"one-to-one": "one_to_one", "one-to-many": "one_to_many", "many-to-one": "many_to_one", "many-to-many": "many_to_many"}
#: Environment variables that overlay a configuration: where they go and as what.
ENVIRONMENT = {"LINK_THRESHOLD": (("matching", "confidence_threshold"), float), "LINK_BLOCKING": (("matching", "use_blocking"), lambda v: v.lower() in ("1", "true", "yes")), "LINK_OUTPUT": (("output", "path"), str), "LINK_FORMAT": (("output", "format"), str)}


@dataclass
class Job:
    file1: str
    file2: str
    config: LinkageConfig
    id1: str | None = None
    id2: str | None = None
    output: str | None = None
    format: str = "json"
    output_columns: list[str] = field(default_factory=list)
    prefixes: tuple[str, str] = ("", "")
    #: Matches below this confidence go to a file of their own, too.
    sure: float | None = None


def merged(base: dict, over: dict) -> dict:
    """over laid on base, key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def with_environment(config: dict, environment: dict | None = None) -> dict:
    for name, (path, kind) in ENVIRONMENT.items():
        if (value := (os.environ if environment is None else environment).get(name)) is not None:
            over: dict = {path[-1]: kind(value)}
            for key in reversed(path[:-1]):
                over = {key: over}
            config = merged(config, over)
    return config


def config_hash(config: dict) -> str:
    return md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def parse(config: dict) -> Job:
    """A job from the application dialect (matching) or the command-line dialect (mapping_fields)."""
    return _application(config) if "matching" in config else _command_line(config)


def _path(x) -> str:
    return x["path"] if isinstance(x, dict) else x


def _application(c: dict) -> Job:
    m, out = c["matching"], c.get("output", {})
    mappings = tuple(FieldMapping(x["source_field"], x["target_field"], x.get("weight", 1.0)) for x in m["mappings"])
    algorithms = tuple(Algorithm(x.get("name") or x.get("type") or x.get("algorithm_type"), x.get("parameters", {}), x.get("enabled", True)) for x in m.get("algorithms", []))
    kind = CARDINALITY.get(m.get("matching_type", "many-to-many").replace("_", "-"), "many_to_many")
    config = LinkageConfig(mappings, algorithms, float(m.get("confidence_threshold", 75.0)), m.get("use_blocking", True), cardinality=kind if m.get("enforce_cardinality") else "many_to_many")
    return Job(_path(c["file1"]), _path(c["file2"]), config, c.get("id1"), c.get("id2"), out.get("path"), out.get("format", "json"), sure=out.get("low_confidence_below"))


def _command_line(c: dict) -> Job:
    s = c.get("settings", {})
    kinds = sorted({x.get("match_type", "fuzzy") for x in c["mapping_fields"]} & {"exact", "fuzzy", "phonetic"})
    mappings = tuple(FieldMapping(x["file1_col"], x["file2_col"], x.get("weight", 1.0)) for x in c["mapping_fields"])
    config = LinkageConfig(mappings, tuple(Algorithm(k) for k in kinds), float(s.get("confidence_threshold", 75.0)), s.get("use_blocking", True))
    prefixes = (s.get("file1_output_prefix", ""), s.get("file2_output_prefix", ""))
    return Job(_path(c["file1"]), _path(c["file2"]), config, c.get("id1"), c.get("id2"), s.get("output_path"), s.get("output_format", "json"), c.get("output_columns", []), prefixes, s.get("low_confidence_below"))


def with_id(df, name: str | None):
    """The table and its id column; without one, every row of the stored table gets a number of its own."""
    from pyspark.sql import functions as F

    return (df, name) if name else (stored(df.withColumn("__id", F.monotonically_increasing_id()), "numbered"), "__id")


def run(spark: SparkSession, job: Job) -> LinkageResult:
    """Load both files, link them, and write the result where the job names a place."""
    d1, id1 = with_id(load(spark, job.file1), job.id1)
    d2, id2 = with_id(load(spark, job.file2), job.id2)
    result = find_matches(d1, d2, id1, id2, job.config)
    if job.output:
        from ..operators.results import low_confidence, main_flat

        save(main_flat(result.matched, job.output_columns or None, job.prefixes), job.output, job.format)
        for name in ("unmatched_1", "unmatched_2"):
            save(getattr(result, name), f"{job.output}_{name}", job.format)
        if job.sure is not None:
            save(low_confidence(result.matched, job.sure), f"{job.output}_low_confidence", job.format)
    return result


@dataclass
class Outcome:
    path: str
    status: str
    matches: int = 0
    error: str = ""


def discover(folder: str, pattern: str = "*.json") -> list[str]:
    return sorted({str(p) for p in Path(folder).rglob(pattern)})


def run_batch(spark: SparkSession, paths: list[str], parallel: int = 1) -> list[Outcome]:
    """Every configuration file as a job; a failed one is reported and doesn't stop the others."""

    def one(path: str) -> Outcome:
        try:
            with open(path, encoding="utf-8") as f:
                return Outcome(path, "completed", run(spark, parse(json.load(f))).matched.count())
        except Exception as e:  # noqa: BLE001  the batch reports it
            return Outcome(path, "failed", error=str(e)[:500])

    if parallel <= 1:
        return [one(p) for p in paths]
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(one, paths))


def batch_summary(spark: SparkSession, outcomes: list[Outcome]):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(o.path, o.status, o.matches) for o in outcomes], "path string, status string, matches long")
    done = F.count_if(F.col("status") == "completed")
    return rows.agg(F.count("*").alias("jobs"), done.alias("completed"), F.sum("matches").alias("matches"), (done / F.count("*")).alias("success_rate"))


def save_batch_report(spark: SparkSession, outcomes: list[Outcome], path: str) -> str:
    """Summary and jobs of a batch as one JSON document."""
    summary = batch_summary(spark, outcomes).first().asDict() if outcomes else {"jobs": 0, "completed": 0, "matches": 0, "success_rate": 0.0}
    return save_report(spark, {"summary": summary, "jobs": [vars(o) for o in outcomes]}, path)


def save_session(spark: SparkSession, config: dict, folder: str, name: str) -> str:
    """A configuration kept for later, with its hash."""
    return save_report(spark, {"name": name, "hash": config_hash(config), "config": config}, f"{folder}/{name}.session.json")


def load_session(spark: SparkSession, folder: str, name: str) -> dict:
    """A kept configuration; refuses one that was changed by hand."""
    document = json.loads(read_text(spark, f"{folder}/{name}.session.json"))
    if config_hash(document["config"]) != document["hash"]:
        raise ValueError(f"session {name} differs from its hash")
    return document["config"]
