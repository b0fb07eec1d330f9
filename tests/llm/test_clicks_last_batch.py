"""All windows close within the last batch: no micro-batch without rows follows it, and a commit writes one file for each change log."""

import os

from linkwright.llm import op13_clicks


def test_twelve_starts_are_twelve_micro_batches(spark, sf, monkeypatch):
    kept = []
    monkeypatch.setattr(op13_clicks, "delete", lambda spark, path: kept.append(path))
    df = spark.read.parquet(f"{sf}/clicks.parquet")
    op13_clicks.deduplicate(df)
    state = next(p for p in kept if p.endswith("/state")).removeprefix("file:")
    commits = [f for f in os.listdir(f"{state}/commits") if f.isdigit()]
    files = [f for _, _, names in os.walk(f"{state}/state") for f in names if not f.endswith(".crc")]
    assert len(commits) == op13_clicks.BATCHES
    assert not [f for f in files if "checksum" in f.lower()]
