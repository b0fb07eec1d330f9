"""Finding and anonymizing personal data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import numbered
from .results import text_columns

# The detectors (Java and Python read them alike) and the default rules.
PATTERNS = {
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.9),
    "phone": (r"(\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})", 0.8),
    "ssn": (r"\b\d{3}-?\d{2}-?\d{4}\b", 0.95),
    "credit_card": (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", 0.85),
    "ip_address": (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.7),
    "date_of_birth": (r"\b(?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12][0-9]|3[01])[/-](?:19|20)\d{2}\b", 0.6),
}
RULES = {
    "email": ("mask", {"preserve_domain": True}), "phone": ("mask", {"preserve_last_digits": 4}), "ssn": ("mask", {"preserve_last_digits": 4}), "credit_card": ("mask", {"preserve_last_digits": 4}),
    "ip_address": ("generalize", {"level": 2}), "name": ("pseudonymize", {}), "address": ("generalize", {"level": 1}), "date_of_birth": ("generalize", {"level": 1}),
}


@dataclass
class Policy:
    """Patterns by type (one each; a custom one replaces the default) and rules by type."""

    patterns: dict = field(default_factory=lambda: dict(PATTERNS))
    rules: dict = field(default_factory=lambda: dict(RULES))

    def add(self, kind: str, pattern: str, confidence: float, rule: tuple[str, dict] | None = None) -> None:
        self.patterns[kind] = (pattern, confidence)
        if rule:
            self.rules[kind] = rule


def values(c: Column, kind: str, policy: Policy | None = None) -> Column:
    """All matches of a type's pattern in a text."""
    pattern = (policy or Policy()).patterns[kind][0]
    return F.regexp_extract_all(c, F.lit(f"(?i){pattern}"), F.lit(0))


def _finding(column: str, kind: str, confidence: float):
    return lambda v, i: F.struct(F.lit(column).alias("field"), F.lit(kind).alias("pii_type"), v.alias("value"), F.lit(confidence).alias("confidence"), (i + 1).alias("number"))


def _replacing(method: str, params: dict):
    return lambda v: apply_rule(v, method, params)


def findings(df: DataFrame, id_column: str, policy: Policy | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row a match: id, column, type, value, confidence, number of the match.  Native."""
    policy = policy or Policy()
    each = []
    for c in columns or text_columns(df):
        for kind, (_, confidence) in policy.patterns.items():
            each.append(F.transform(F.coalesce(values(F.col(f"`{c}`"), kind, policy), F.array().cast("array<string>")), _finding(c, kind, confidence)))
    return df.select(F.col(id_column).alias("id"), F.explode(F.flatten(F.array(*each))).alias("f")).select("id", "f.*")


def positions(df: DataFrame, id_column: str, column: str, policy: Policy | None = None) -> DataFrame:
    """Matches with their start and end (from 0, in characters); overlapping types all count.  Native.

    The text is cut at the matches of a type: a match begins after the lengths of
    the pieces and matches before it.
    """
    policy, each, c = policy or Policy(), [], F.col(f"`{column}`")
    for kind, (pattern, confidence) in policy.patterns.items():
        found, pieces = values(c, kind, policy), F.split(c, f"(?i){pattern}", -1)
        gone = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value:string,start:int>>").alias("out")), _placed(pieces))
        each.append(F.when(F.size(found) > 0, F.transform(gone["out"], _named(kind, confidence))).otherwise(F.array().cast("array<struct<pii_type:string,value:string,confidence:double,start:int,end:int>>")))
    rows = df.where(c.isNotNull()).select(F.col(id_column).alias("id"), F.explode(F.flatten(F.array(*each))).alias("f"))
    return rows.select("id", "f.*")


def _placed(pieces: Column):
    """Adds a match after the piece before it."""

    def step(acc: Column, value: Column) -> Column:
        start = acc["at"] + F.length(F.element_at(pieces, F.size(acc["out"]) + 1))
        return F.struct((start + F.length(value)).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(value.alias("value"), start.cast("int").alias("start")))).alias("out"))

    return step


def _named(kind: str, confidence: float):
    return lambda x: F.struct(F.lit(kind).alias("pii_type"), x["value"].alias("value"), F.lit(confidence).alias("confidence"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).cast("int").alias("end"))


def mask(v: Column, preserve_domain: bool = False, preserve_last_digits: int = 0, mask_char: str = "*") -> Column:
    full = F.repeat(F.lit(mask_char), F.length(v))
    if preserve_last_digits:
        n = preserve_last_digits
        full = F.when(F.length(v) > n, F.concat(F.repeat(F.lit(mask_char), F.length(v) - n), F.right(v, F.lit(n)))).otherwise(full)
    if preserve_domain:
        at = F.instr(v, "@")
        full = F.when(at > 0, F.concat(F.repeat(F.lit(mask_char), at - 1), v.substr(at, F.length(v)))).otherwise(full)
    return full


def hashed(v: Column, salt: str = "default_salt", length: int = 8, algorithm: str = "sha256") -> Column:
    bits = {"sha256": 256, "sha224": 224, "sha384": 384, "sha512": 512}
    digest = F.md5(F.concat(v, F.lit(salt))) if algorithm == "md5" else F.sha2(F.concat(v, F.lit(salt)), bits[algorithm])
    return F.substring(digest, 1, length)


def generalize(v: Column, level: int = 1) -> Column:
    ip = {1: r"$1.$2.$3.xxx", 2: r"$1.$2.xxx.xxx"}.get(level, "xxx.xxx.xxx.xxx")
    date = F.concat(F.substring(v, 1, 7), F.lit("xxxx")) if level == 1 else F.lit("xx/xx/xxxx")
    keep = F.greatest(F.lit(1), F.length(v) - level)
    other = F.concat(F.substring(v, F.lit(1), keep), F.repeat(F.lit("x"), F.least(F.lit(level), F.length(v))))
    is_ip = v.rlike(r"^\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b")
    return F.when(is_ip, F.regexp_replace(v, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\..*$", ip)).when(v.rlike(r"^\d{2}/\d{2}/\d{4}"), date).otherwise(other)


def noisy(v: Column, factor: float = 0.1, seed: int | None = None) -> Column:
    """A number moved by up to factor of itself, to two places; other values stay."""
    n = v.try_cast("double")
    return F.when(n.isNull(), v).otherwise(F.round(n + (F.rand(seed) * 2 - 1) * factor * n, 2).cast("string"))


def apply_rule(v: Column, method: str, params: dict) -> Column:
    if method == "mask":
        return mask(v, **params)
    if method == "hash":
        return hashed(v, **params)
    if method == "remove":
        return F.lit("")
    if method == "replace":
        return F.lit(params.get("replacement", "[REDACTED]"))
    if method == "generalize":
        return generalize(v, **params)
    if method == "noise":
        return noisy(v, **params)
    raise ValueError(f"no method {method}; pseudonyms need pseudonymize()")


def anonymize_kind(c: Column, kind: str, policy: Policy) -> Column:
    """The text with the matches of one type replaced by its rule.

    The text is cut at the matches and put together again: parts and replaced
    values alternate, all in the JVM.  A type without a rule is masked; one that
    gets pseudonyms is left to pseudonymize().
    """
    method, params = policy.rules.get(kind, ("mask", {}))
    if method == "pseudonymize":
        return c
    found = values(c, kind, policy)
    parts = F.split(c, f"(?i){policy.patterns[kind][0]}", -1)
    replaced = F.concat(F.transform(found, _replacing(method, params)), F.array(F.lit("")))
    glued = F.array_join(F.flatten(F.zip_with(parts, replaced, lambda p, r: F.array(p, r))), "")
    return F.when(F.size(found) > 0, glued).otherwise(c)


def anonymize(df: DataFrame, policy: Policy | None = None, columns: list[str] | None = None) -> DataFrame:
    """Text columns with all types replaced, type after type in the order of the patterns."""
    policy = policy or Policy()
    for kind in policy.patterns:
        df = df.withColumns({c: anonymize_kind(F.col(f"`{c}`"), kind, policy) for c in columns or text_columns(df)})
    return df


def pseudonymize(df: DataFrame, column: str, order: str, prefix: str = "ANON") -> DataFrame:
    """Values replaced by prefix_000001.. in the order in which they first appear; numbers of ranges of the distinct values, see numbered()."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.min(order).alias("__o"))
    names = numbered(firsts, ["__o", "__v"], "__k").select("__v", F.format_string(f"{prefix}_%06d", F.col("__k") + 1).alias("__name"))
    joined = df.join(names, df[column] == names["__v"], "left")
    return joined.withColumn(column, F.col("__name")).select(*df.columns)


def summary(found: DataFrame) -> DataFrame:
    """Totals overall, by type and by column."""
    grouped = found.cube("pii_type", "field").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return grouped.where("g IN (1, 2, 3)").select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "type").otherwise("field").alias("kind"), F.coalesce("pii_type", "field", F.lit("all")).alias("name"), "n")


def scan_and_protect(df: DataFrame, id_column: str, policy: Policy | None = None, retention_days: int = 90) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The anonymized table, the summary of what was found, and the retention record."""
    found = findings(df, id_column, policy)
    record = found.agg(F.count("*").alias("n_findings"), F.countDistinct("id").alias("n_rows")).withColumns({"created_at": F.current_timestamp(), "expires_at": F.current_timestamp() + F.make_dt_interval(F.lit(retention_days))})
    return anonymize(df, policy), summary(found), record


def expired(df: DataFrame, now: Column, column: str = "expires_at") -> DataFrame:
    return df.where(F.col(column) < now)


def protection_statistics(df: DataFrame, now: Column) -> DataFrame:
    return df.agg(F.count("*").alias("tracked"), F.count_if(F.col("expires_at") < now).alias("expired"))


def audit_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


AUDIT = "event_id string, ts timestamp, event_type string, user string, details string"


def log_audit(spark: SparkSession, path: str, event_type: str, user: str, details: str = "") -> None:
    """Append an event to the audit log, a folder of JSON lines."""
    row = spark.range(1).select(F.expr("uuid()").alias("event_id"), F.current_timestamp().alias("ts"), F.lit(event_type).alias("event_type"), F.lit(user).alias("user"), F.lit(details).alias("details"))
    row.write.mode("append").json(path)


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)
