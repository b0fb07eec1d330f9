"""Queries over match results: filter, search, sort, page, flatten, JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType


def by_confidence(df: DataFrame, least: float | None = None, most: float | None = None, column: str = "confidence") -> DataFrame:
    """Rows within a closed range."""
    df = df if least is None else df.where(F.col(column) >= least)
    return df if most is None else df.where(F.col(column) <= most)


def by_fields(df: DataFrame, fields: list[str], column: str = "matched_fields") -> DataFrame:
    """Rows that matched on any of the fields."""
    return df.where(F.arrays_overlap(F.col(column), F.array(*map(F.lit, fields)))) if fields else df


def high(df: DataFrame, threshold: float = 75.0) -> DataFrame:
    return df.where(F.col("confidence") >= threshold)


def low(df: DataFrame, threshold: float = 75.0) -> DataFrame:
    return df.where(F.col("confidence") < threshold)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def search(df: DataFrame, pattern: str) -> DataFrame:
    """Rows in which a text column matches a regular expression, in any case."""
    hits = [F.coalesce(F.col(f"`{c}`").rlike(f"(?i){pattern}"), F.lit(False)) for c in text_columns(df)]
    return df.where(reduce(Column.__or__, hits, F.lit(False)))


def search_literal(df: DataFrame, text: str, column: str | None = None) -> DataFrame:
    """Rows that hold a literal in one column, or in any if the column is unknown."""
    names = [column] if column in df.columns else df.columns
    hits = [F.coalesce(F.col(f"`{c}`").cast("string").contains(text), F.lit(False)) for c in names]
    return df.where(reduce(Column.__or__, hits, F.lit(False)))


def number(c: Column) -> Column:
    """A value as a number; what isn't one counts as 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def sorted_by(df: DataFrame, column: str, descending: bool = True, ties: tuple[str, ...] = ("id1", "id2")) -> DataFrame:
    first = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(first, *ties)


def split_sorted(df: DataFrame, column: str = "confidence", threshold: float = 80.0, ties: tuple[str, ...] = ("id1", "id2")) -> DataFrame:
    """Rows from the threshold up in rising order, then the others in falling order."""
    s = number(F.col(column))
    return df.orderBy(F.when(s >= threshold, 0).otherwise(1), F.when(s >= threshold, s).otherwise(-s), *ties)


def page(df: DataFrame, number: int, size: int | None) -> DataFrame:
    """The rows of a page, counted from 1, of an ordered table."""
    return df if size is None else df.offset((max(1, number) - 1) * size).limit(size)


def web_page(df: DataFrame, number: int = 1, size: int = 50) -> tuple[DataFrame, dict]:
    """A page within bounds and the totals."""
    size, number = min(1000, max(1, size)), max(1, number)
    total = df.count()
    return page(df, number, size), {"page": number, "per_page": size, "total": total, "total_pages": -(-total // size)}


def flat(matched: DataFrame, **more: Column) -> DataFrame:
    """record1_*, record2_*, confidence and the matched fields joined by a comma; more: further columns."""
    side = lambda r: [F.col(r)[f].alias(f"{r}_{f}") for f in matched.schema[r].dataType.names]
    return matched.select(*side("record1"), *side("record2"), F.col("confidence").alias("confidence_score"), F.array_join("matched_fields", ", ").alias("matching_fields"), *[c.alias(n) for n, c in more.items()])


def web_flat(matched: DataFrame) -> DataFrame:
    """The score to two places, f1_*, f2_*, the algorithm."""
    side = lambda r, p: [F.col(r)[f].alias(f"{p}_{f}") for f in matched.schema[r].dataType.names]
    return matched.select(F.bround("confidence", 2).alias("confidence_score"), *side("record1", "f1"), *side("record2", "f2"), "algorithm")


def main_flat(matched: DataFrame, columns: list[str] | None = None, prefixes: tuple[str, str] = ("", "")) -> DataFrame:
    """match_score and the fields of both records with their prefixes; of equal names the second record's."""
    taken = {p + f: (f, F.col(r)[f]) for r, p in zip(("record1", "record2"), prefixes, strict=True) for f in matched.schema[r].dataType.names}
    return matched.select(F.col("confidence").alias("match_score"), *[c.alias(n) for n, (f, c) in taken.items() if columns is None or f in columns or n in columns])


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null."""
    fix = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, DoubleType | FloatType)}
    return df.withColumns(fix) if fix else df


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(column))


def from_json(df: DataFrame, column: str, schema: str, records: str = "matched_records") -> DataFrame:
    """Flat rows of the documents' list of records."""
    return df.select(F.explode(F.from_json(column, f"{records} array<struct<{schema}>>")[records]).alias("r")).select("r.*")


def low_confidence(matched: DataFrame, threshold: float) -> DataFrame:
    """Matches below a second threshold, flattened, least sure first: what a person should look at."""
    return main_flat(low(matched, threshold)).orderBy("match_score")


def newest(df: DataFrame, column: str, n: int, ties: tuple[str, ...]) -> DataFrame:
    return df.orderBy(F.col(column).desc(), *ties).limit(n)


def listed(df: DataFrame, user: str | None = None, status: str | None = None, limit: int | None = None, created: str = "created_at", ties: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """Jobs of a user and of a status, where given, newest first, then by id; all of them or the first."""
    for column, value in (("user", user), ("status", status)):
        if value is not None:
            df = df.where(F.col(column) == value)
    ordered = df.orderBy(F.col(created).desc_nulls_last(), *ties)
    return ordered if limit is None else ordered.limit(limit)


def accessible(user: str, now: Column) -> Column:
    """Whether a result can be read: no rule, or not expired and public, owned or shared."""
    open_ = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    allowed = F.coalesce(F.col("is_public"), F.lit(False)) | (F.col("owner") == user) | F.coalesce(F.array_contains("shared_with", user), F.lit(False))
    return F.col("owner").isNull() | (open_ & F.coalesce(allowed, F.lit(False)))
