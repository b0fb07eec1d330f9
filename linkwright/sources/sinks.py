"""Sinks: results to CSV, JSON, Parquet, Excel, and a table of stored results."""

from __future__ import annotations

import csv
import io
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import results as R
from ..storage import delete, new_path

#: Bytes of a file that is read as one document.
SMALL = 1 << 30
FORMATS = ("csv", "json", "excel", "parquet")


def _write_text(spark: SparkSession, path: str, data: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A whole small file (a report, a session document) from any store; one above SMALL bytes is refused, not cut."""
    from .files import head

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() > SMALL:
        raise ValueError(f"{path} is larger than {SMALL} bytes")
    return head(spark, path, SMALL).decode("utf-8-sig")


def _written_rows(df: DataFrame, write) -> int:
    """Write df and count its rows on the way."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def save(df: DataFrame, path: str, kind: str = "csv") -> list[str]:
    """A folder of part files for each format ('both': csv and json); an empty table leaves nothing behind."""
    out, writers = [], {
        "csv": lambda d, to: d.write.mode("overwrite").option("header", True).csv(to),
        "json": lambda d, to: d.write.mode("overwrite").json(to),
        "parquet": lambda d, to: d.write.mode("overwrite").option("compression", "zstd").parquet(to),
    }
    for k in {"both": ["csv", "json"]}.get(kind, [kind]):
        if k == "excel":
            if not df.isEmpty():
                save_excel({"Matched": df}, f"{path}.xlsx")
                out.append(f"{path}.xlsx")
        elif k not in writers:
            raise ValueError(f"no format {k}")
        elif _written_rows(df, lambda d, k=k: writers[k](d, f"{path}.{k}")):
            out.append(f"{path}.{k}")
        else:
            delete(df.sparkSession, f"{path}.{k}")
            break
    return out


def save_chunked(df: DataFrame, path: str, rows: int = 10_000) -> str:
    """Parquet files of at most so many rows each."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)
    return path


def save_report(spark: SparkSession, report: dict, path: str) -> str:
    """A small document, as of a batch: one JSON file."""
    _write_text(spark, path, json.dumps(report, indent=2, ensure_ascii=False, default=str))
    return path


def save_pretty_json(df: DataFrame, path: str, limit: int = 100_000) -> int:
    """An indented array in one file, written by the driver; refuses tables above the limit."""
    rows = df.limit(limit + 1).toJSON().collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write part files with save()")
    _write_text(df.sparkSession, path, json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False))
    return len(rows)


def save_excel(sheets: dict[str, DataFrame], path: str, limit: int = 1_000_000) -> None:
    """Sheets of one workbook (needs openpyxl); names are cut to 31 characters; refuses tables above the limit before writing."""
    import pandas as pd

    frames = {name: df.limit(limit + 1).toPandas() for name, df in sheets.items()}
    for name, frame in frames.items():
        if len(frame) > limit:
            raise ValueError(f"more than {limit} rows for sheet {name}; write part files with save()")
    try:
        with pd.ExcelWriter(path) as writer:
            for name, frame in frames.items():
                frame.to_excel(writer, sheet_name=name[:31], index=False)
    except ImportError as e:
        raise RuntimeError("writing Excel needs the package openpyxl") from e


def _dated(matched: DataFrame) -> DataFrame:
    """Flattened matches with the time of the export or, where there is one, of the match."""
    when = F.date_format(F.col("created_at") if "created_at" in matched.columns else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return R.flat(matched, created_at=when)


def export_csv(matched: DataFrame, path: str) -> str:
    """Flattened matches; without matches a header alone."""
    out = _dated(matched)
    if out.isEmpty():
        out = out.select("confidence_score", "matching_fields", "created_at").limit(0)
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_json(result, path: str) -> str:
    """matched, unmatched_1, unmatched_2 and statistics, a folder of JSON lines each, with their metadata."""
    for name in ("matched", "unmatched_1", "unmatched_2", "statistics"):
        if (df := getattr(result, name)) is not None:
            df.write.mode("overwrite").json(f"{path}/{name}")
    save_report(result.matched.sparkSession, {"export_info": {"format": "json"}, "metadata": result.metadata}, f"{path}/metadata.json")
    return path


def export_excel(result, path: str, limit: int = 1_000_000) -> str:
    """Sheets of matches, unmatched records of either table (where there are any) and statistics (needs openpyxl)."""
    sheets = {"Matched Records": _dated(result.matched)}
    for name in ("unmatched_1", "unmatched_2"):
        if (df := getattr(result, name)) is not None:
            sheets[f"Unmatched {name[-1]}"] = df
    if result.statistics is not None:
        columns = [F.struct(F.lit(c).alias("Metric"), F.col(c).cast("string").alias("Value")) for c in result.statistics.columns]
        sheets["Statistics"] = result.statistics.select(F.explode(F.array(*columns)).alias("r")).select("r.*")
    save_excel({k: df for k, df in sheets.items() if not df.isEmpty()}, path, limit)
    return path


def save_result(result, path: str) -> str:
    """The whole result with its types, to be read again by load_result: Parquet tables and metadata."""
    for name in ("matched", "unmatched_1", "unmatched_2", "statistics"):
        if (df := getattr(result, name)) is not None:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    save_report(result.matched.sparkSession, result.metadata, f"{path}/metadata.json")
    return path


def load_result(spark: SparkSession, path: str):
    from ..operators.linkage import LinkageResult

    tables = [spark.read.parquet(f"{path}/{name}") for name in ("matched", "unmatched_1", "unmatched_2", "statistics")]
    return LinkageResult(*tables, json.loads(read_text(spark, f"{path}/metadata.json")))


@dataclass(frozen=True)
class Export:
    """What of a result to export, and how."""

    format: str = "csv"
    least: float | None = None
    most: float | None = None
    fields: tuple[str, ...] = ()
    sort: str | None = "confidence"
    descending: bool = True
    page: int = 1
    page_size: int | None = None
    unmatched: bool = True
    statistics: bool = True

    def __post_init__(self):
        if self.format not in FORMATS:
            raise ValueError(f"the format is one of {FORMATS}")


def selected(matched: DataFrame, export: Export) -> DataFrame:
    """Matches within the bounds and on the fields, in order, and of them the page."""
    out = R.by_fields(R.by_confidence(matched, export.least, export.most), list(export.fields))
    out = R.sorted_by(out, export.sort, export.descending) if export.sort else out
    return R.page(out, export.page, export.page_size)


def export_result(result, export: Export, folder: str, name: str | None = None) -> str:
    """Filter, sort, page and write a result; gives the path."""
    from ..operators.linkage import LinkageResult

    left = [result.unmatched_1, result.unmatched_2] if export.unmatched else [None, None]
    some = LinkageResult(selected(result.matched, export), *left, result.statistics if export.statistics else None, result.metadata)
    path = f"{folder}/export_{name or uuid.uuid4().hex}"
    if export.format == "csv":
        return export_csv(some.matched, f"{path}.csv")
    if export.format == "excel":
        return export_excel(some, f"{path}.xlsx")
    return export_json(some, f"{path}.json") if export.format == "json" else save_result(some, path)


def export_stored(store: ResultStore, result_id: str, user: str, export: Export, folder: str) -> str:
    """The matches of a stored result, exported; refuses users who may not read it."""
    from ..operators.linkage import LinkageResult

    return export_result(LinkageResult(store.retrieve(result_id, user), None, None, None, {"result_id": result_id}), export, folder, result_id)


#: What a spreadsheet takes as the sign of UTF-8.
BOM = "\ufeff"


def download_csv(df: DataFrame, path: str) -> int:
    """One file with a byte order mark, quoted fields and numbers to two places; rows pass through the driver a partition at a time."""
    spark, places = df.sparkSession, [f.dataType.simpleString() in ("double", "float") for f in df.schema.fields]
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    text, n = io.StringIO(), 0
    lines = csv.writer(text, quoting=csv.QUOTE_ALL, lineterminator="\n")
    text.write(BOM)
    lines.writerow(df.columns)
    try:
        for row in df.toLocalIterator():
            lines.writerow(["" if v is None else f"{v:.2f}" if two else v for v, two in zip(row, places, strict=True)])
            n += 1
            if text.tell() > 1 << 20:
                out.write(bytearray(text.getvalue().encode()))
                text.seek(0)
                text.truncate()
        out.write(bytearray(text.getvalue().encode()))
    finally:
        out.close()
    return n


def download(spark: SparkSession, source: str, to: str, kind: str) -> str:
    """A CSV or JSON file in the other format (or its own)."""
    from .files import load

    df = load(spark, source)
    if kind == "csv":
        download_csv(df, to)
    elif kind == "json":
        df.write.mode("overwrite").json(to)
    else:
        raise ValueError(f"no format {kind}")
    return to


def best_codec(df: DataFrame, codecs: tuple[str, ...] = ("zstd", "gzip", "snappy"), rows: int = 10_000) -> str:
    """The Parquet codec with the least share of the plain size plus a tenth of the seconds, on some rows."""
    spark, some, cost = df.sparkSession, df.limit(rows), {}
    for codec in ("uncompressed", *codecs):
        path, began = new_path(spark, "codec"), time.perf_counter()
        some.coalesce(1).write.option("compression", codec).parquet(path)
        took, p = time.perf_counter() - began, spark._jvm.org.apache.hadoop.fs.Path(path)
        cost[codec] = (p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength(), took)
        delete(spark, path)
    plain = max(1, cost.pop("uncompressed")[0])
    return min(codecs, key=lambda c: (cost[c][0] / plain + 0.1 * cost[c][1], codecs.index(c)))


class LogTable:
    """A small table of its own (jobs, progress) as an append-only folder: the last row of a key counts."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key

    def rows(self) -> DataFrame:
        names = self.spark.createDataFrame([], self.schema).columns
        try:
            log = self.spark.read.schema(self.schema + ", __removed boolean, __at timestamp").parquet(self.folder)
        except Exception as e:  # nothing has been written
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)
        last = log.groupBy(self.key).agg(F.max_by(F.struct(*log.columns), "__at").alias("r"))
        return last.where("NOT r.__removed").select(*[F.col(f"r.`{n}`").alias(n) for n in names])

    def _append(self, rows: DataFrame, removed: bool) -> None:
        rows.withColumns({"__removed": F.lit(removed), "__at": F.current_timestamp()}).write.mode("append").parquet(self.folder)

    def put(self, rows: DataFrame) -> None:
        self._append(rows, False)

    def remove(self, keys: DataFrame) -> None:
        self._append(self.rows().join(keys.select(self.key).distinct(), self.key, "left_semi"), True)

    def newest(self, column: str, n: int) -> DataFrame:
        return R.newest(self.rows(), column, n, (self.key,))


class ResultStore:
    """Results as Parquet folders with an index table of owners, versions and sharing."""

    SCHEMA = "result_id string, owner string, version int, size long, checksum string, is_public boolean, shared_with array<string>, expires_at timestamp, created_at timestamp, last_accessed timestamp"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def index(self) -> DataFrame:
        """The newest row of each result."""
        try:
            rows = self.spark.read.schema(self.SCHEMA + ", removed boolean, at timestamp").parquet(f"{self.folder}/index")
        except Exception as e:  # before the first result there is no index
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)
        names = [c.split()[0] for c in self.SCHEMA.split(", ")]
        last = rows.groupBy("result_id").agg(F.max_by(F.struct(*rows.columns), "at").alias("r"))
        return last.where("NOT r.removed").select(*[F.col(f"r.{n}").alias(n) for n in names])

    def _log(self, rows: DataFrame, removed: bool = False) -> None:
        rows.withColumns({"removed": F.lit(removed), "at": F.current_timestamp()}).write.mode("append").parquet(f"{self.folder}/index")

    def store(self, df: DataFrame, owner: str, result_id: str | None = None, public: bool = False) -> str:
        result_id = result_id or uuid.uuid4().hex
        known = self.index().where(F.col("result_id") == result_id).select("version").first()
        version = known["version"] + 1 if known else 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/data/{result_id}/v{version}")
        stored = self.spark.read.parquet(f"{self.folder}/data/{result_id}/v{version}")
        facts = stored.agg(F.count("*").alias("size"), F.sha2(F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")).cast("string"), F.lit("")), 256).alias("checksum"))
        now = F.current_timestamp()
        row = facts.select(F.lit(result_id).alias("result_id"), F.lit(owner).alias("owner"), F.lit(version).alias("version"), "size", "checksum", F.lit(public).alias("is_public"), F.array().cast("array<string>").alias("shared_with"), F.lit(None).cast("timestamp").alias("expires_at"), now.alias("created_at"), now.alias("last_accessed"))
        self._log(row)
        return result_id

    def _row(self, result_id: str) -> DataFrame:
        return self.index().where(F.col("result_id") == result_id)

    def retrieve(self, result_id: str, user: str) -> DataFrame:
        row = self._row(result_id).where(R.accessible(user, F.current_timestamp())).first()
        if row is None:
            raise PermissionError(f"{user} cannot read {result_id}")
        self._log(self._row(result_id).withColumn("last_accessed", F.current_timestamp()))
        return self.spark.read.parquet(f"{self.folder}/data/{result_id}/v{row['version']}")

    def share(self, result_id: str, users: list[str]) -> None:
        self._log(self._row(result_id).withColumn("shared_with", F.array_union("shared_with", F.array(*map(F.lit, users)))))

    def publish(self, result_id: str) -> None:
        self._log(self._row(result_id).withColumn("is_public", F.lit(True)))

    def delete(self, result_id: str) -> None:
        self._log(self._row(result_id), removed=True)

    def list(self, user: str | None = None, limit: int = 50) -> DataFrame:
        """The newest results that a user may read."""
        rows = self.index() if user is None else self.index().where(R.accessible(user, F.current_timestamp()))
        return R.newest(rows, "created_at", limit, ("result_id",))

    def compress(self, result_id: str, codec: str | None = None) -> str:
        """Write a result's data anew with a codec, or with the one that suits it; gives the codec."""
        row = self._row(result_id).first()
        df = self.spark.read.parquet(f"{self.folder}/data/{result_id}/v{row['version']}")
        codec = codec or best_codec(df)
        df.write.mode("overwrite").option("compression", codec).parquet(f"{self.folder}/data/{result_id}/v{row['version'] + 1}")
        self._log(self._row(result_id).withColumn("version", F.col("version") + 1))
        return codec

    def cleanup(self, days: int) -> int:
        old = self.index().where(F.col("created_at") < F.current_timestamp() - F.make_dt_interval(F.lit(days)))
        n = old.count()
        if n:
            self._log(old, removed=True)
        return n
