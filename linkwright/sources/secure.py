"""Scans and sinks that protect personal data on the way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import privacy
from .files import load, map_chunks, validate
from .sinks import save


def load_protected(spark: SparkSession, path: str, policy: privacy.Policy | None = None, **options) -> DataFrame:
    """A validated file with its text columns anonymized."""
    checked = validate(spark, path)
    if not checked.is_valid:
        raise ValueError("; ".join(checked.errors))
    return privacy.anonymize(load(spark, path, **options), policy)


def save_protected(df: DataFrame, path: str, kind: str = "csv", policy: privacy.Policy | None = None) -> list[str]:
    return save(privacy.anonymize(df, policy), path, kind)


def map_chunks_protected(df: DataFrame, f: Callable, schema: str, policy: privacy.Policy | None = None, chunk_rows: int = 10_000) -> DataFrame:
    """f over chunks that hold no personal data any more."""
    return map_chunks(privacy.anonymize(df, policy), f, schema, chunk_rows)
