"""Scans: CSV, JSON, JSON lines, Excel, with detection, validation and chunked processing."""

from __future__ import annotations

import codecs
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELIMITERS = [",", ";", "\t", "|"]
HEAD_BYTES, SAMPLE_ROWS, MAX_MB = 10_000, 1000, 100
EXTENSIONS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".xlsx": "excel", ".xls": "excel", ".parquet": "parquet"}


@dataclass
class Validation:
    is_valid: bool = True
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)

    def fail(self, message: str) -> None:
        self.is_valid = False
        self.errors.append(message)


def head(spark: SparkSession, path: str, n: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file in any store; of a folder, those of its first part that isn't empty."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(p)
    if status.isDirectory():
        parts = sorted((x.getPath().getName(), x) for x in fs.listStatus(p) if x.isFile() and x.getLen() and x.getPath().getName()[0] not in "._")
        if not parts:
            return b""
        status = parts[0][1]
    stream = fs.open(status.getPath())
    try:
        return bytes(stream.readNBytes(min(n, status.getLen())))
    finally:
        stream.close()


def detect_encoding(data: bytes) -> str:
    """By byte order mark, else UTF-8 if the bytes are, else a Cyrillic or Western code page."""
    for mark, name in ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")):
        if data.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data)
        return "UTF-8"
    except UnicodeDecodeError:
        letters = sum(b >= 0xC0 for b in data)
        return "windows-1251" if letters > 0.2 * max(1, len(data)) else "ISO-8859-1"


def encoding_of(spark: SparkSession, path: str) -> str:
    """The encoding of whole files: by the head where that tells, else UTF-8 only if every line is.

    A head of plain ASCII says nothing of what follows, so all lines are checked, in
    one pass.  Of lines that aren't UTF-8, bytes above 127 that stand together are
    Cyrillic words, single ones are accented letters.
    """
    data = head(spark, path)
    named = detect_encoding(data)
    if named != "UTF-8" or data.startswith(codecs.BOM_UTF8):
        return named
    lines = spark.read.text(path).where("NOT is_valid_utf8(value)").select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("t"))
    high, runs = (F.sum(F.length("t") - F.length(F.regexp_replace("t", p, ""))) for p in ("[\u0080-\u00FF]", "[\u0080-\u00FF]{2,}"))
    found = lines.agg(F.count("*").alias("n"), high.alias("high"), runs.alias("runs")).first()
    if not found["n"]:
        return named
    return "windows-1251" if 2 * found["runs"] > found["high"] else "ISO-8859-1"


def detect_delimiter(line: str) -> str:
    """The first usual delimiter that parts the header; a comma for a single column."""
    return next((d for d in DELIMITERS if d in line), ",")


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, infer: bool = False) -> DataFrame:
    """Header and text columns; delimiter (by the header) and encoding (by all bytes, a pass of its own) are detected where not given."""
    if delimiter is None or encoding is None:
        data = head(spark, path)
        encoding = encoding or encoding_of(spark, path)
        delimiter = delimiter or detect_delimiter(data.decode(encoding, "replace").lstrip("﻿").split("\n", 1)[0])
    known = encoding.lower() != "windows-1251"  # which Spark doesn't read: bytes are read as they are and then translated
    df = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding if known else "ISO-8859-1").option("inferSchema", infer).csv(path)
    if known:
        return df
    raw = bytes(range(0x80, 0x100))
    text = raw.decode("cp1251", "replace")
    names = [c.encode("latin-1").decode("cp1251", "replace") for c in df.columns]
    cells = [F.translate(f"`{c}`", raw.decode("latin-1"), text) if k == "string" else F.col(f"`{c}`") for c, k in df.dtypes]
    return df.select(*[c.alias(n) for c, n in zip(cells, names, strict=True)])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array over any number of lines, else JSON lines; the first byte tells."""
    if head(spark, path, 64).lstrip(b"\xef\xbb\xbf \t\r\n")[:1] != b"[":
        return read_jsonl(spark, path)
    whole = spark.read.option("multiLine", True).json(path)
    return read_jsonl(spark, path) if "_corrupt_record" in whole.columns else whole


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def _workbook(spark: SparkSession, path: str):
    """A file's bytes for pandas, from any store."""
    import io

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return io.BytesIO(head(spark, path, p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()))


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """One sheet, read on the driver from any store (needs openpyxl)."""
    import pandas as pd

    try:
        frame = pd.read_excel(_workbook(spark, path), sheet_name=sheet)
    except ImportError as e:
        raise RuntimeError("reading Excel needs the package openpyxl") from e
    return spark.createDataFrame(frame)


def excel_sheets(spark: SparkSession, path: str) -> list[str]:
    import pandas as pd

    try:
        return list(pd.ExcelFile(_workbook(spark, path)).sheet_names)
    except ImportError as e:
        raise RuntimeError("reading Excel needs the package openpyxl") from e


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """By extension."""
    kind = EXTENSIONS.get(os.path.splitext(path)[1].lower())
    readers = {"csv": read_csv, "json": read_json, "jsonl": read_jsonl, "excel": read_excel, "parquet": lambda s, p: s.read.parquet(p)}
    if kind is None:
        raise ValueError(f"no reader for {path}")
    return readers[kind](spark, path, **options)


def read_lines_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """One record a line; blank lines don't count, short rows are filled with '', long ones are cut."""
    df = spark.read.option("header", True).option("sep", delimiter).option("multiLine", False).option("mode", "PERMISSIVE").csv(path)
    return df.na.fill("")


def count_lines_csv(spark: SparkSession, path: str, delimiter: str = ",") -> int:
    """Records, one a line, without the header and blank lines."""
    return read_lines_csv(spark, path, delimiter).count()


def find_bytes(spark: SparkSession, path: str, pattern: bytes) -> DataFrame:
    """(path, at, line): the lines of files that hold a byte pattern, with the place (in bytes, from 0) where it first begins in the line; bytes of any encoding."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    at = F.expr(f"instr(decode(cast(value AS binary), 'ISO-8859-1'), decode(unhex('{pattern.hex()}'), 'ISO-8859-1')) - 1")
    return lines.select("path", at.alias("at"), F.col("value").alias("line")).where("at >= 0")


def find_places(spark: SparkSession, path: str, pattern: bytes) -> DataFrame:
    """(path, at): every place, in bytes from 0, where a pattern begins in files of any bytes; places may overlap.

    Tasks read ranges of bytes.  Records end at a byte that the pattern doesn't have
    (the most frequent such ASCII byte of the head), so none crosses two of them, line
    ends or not.  A record's place is the bytes of earlier ranges, which are summed up
    by range, and those before it in its own.  A byte order mark, which the reader
    leaves out, is told by the file's size and put back.
    """
    if not pattern:
        raise ValueError("the pattern is empty")
    free = [b for b in range(128) if b not in pattern]
    if not free:
        raise ValueError("the pattern has every ASCII byte")
    data = head(spark, path)
    end = max(free, key=lambda b: (data.count(bytes([b])), b == 10))
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start", "file_size")]
    records = spark.read.option("lineSep", chr(end)).text(path).select(*meta, F.col("value").cast("binary").alias("data"))
    ranges = records.groupBy("file_path", "file_size", "file_block_start").agg(F.sum(F.length("data") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("n").over(Window.partitionBy("file_path"))
    mark = F.when(F.col("file_size") - F.col("whole") >= 2, len(codecs.BOM_UTF8)).otherwise(0)  # without one, all but the last record's end is there
    ranges = ranges.select("file_path", "file_block_start", F.coalesce(before, F.lit(0)).alias("before"), whole.alias("whole"), "file_size").withColumn("mark", mark)

    def run(batches):
        now, at = None, 0
        for batch in batches:
            out = []
            for name, start, record in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (name, start) != now:
                    now, at = (name, start), 0
                    if start == 0:  # places in a byte order mark, should there be one
                        marked = codecs.BOM_UTF8 + record
                        out += [(name, start, k - 3) for k in range(3) if marked.startswith(pattern, k)]
                k = record.find(pattern)
                while k >= 0:
                    out.append((name, start, at + k))
                    k = record.find(pattern, k + 1)
                at += len(record) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file_path", "file_block_start", "place"])

    found = records.mapInArrow(run, "file_path string, file_block_start long, place long")
    joined = found.join(ranges, ["file_path", "file_block_start"]).where("place >= 0 OR mark > 0")
    return joined.select(F.col("file_path").alias("path"), (F.col("before") + F.col("place") + F.col("mark")).alias("at"))


def read_line(spark: SparkSession, path: str, offset: int = 0, chunk: int = 1 << 16) -> tuple[bytes, int]:
    """The bytes from an offset to the end of its line, line feed included, and the offset behind them; nothing at or behind the end of the file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    size, line = fs.getFileStatus(p).getLen(), b""
    if offset >= size:
        return b"", offset
    stream = fs.open(p)
    try:
        stream.seek(offset)
        while offset + len(line) < size and not line.endswith(b"\n"):
            more = bytes(stream.readNBytes(min(chunk, size - offset - len(line))))
            line += more[: more.find(b"\n") + 1] if b"\n" in more else more
    finally:
        stream.close()
    return line, offset + len(line)


def map_chunks(df: DataFrame, f: Callable, schema: str, chunk_rows: int = 10_000) -> DataFrame:
    """f(pandas frame) over chunks of at most chunk_rows rows; None is left out."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), chunk_rows):
                out = f(batch.iloc[at : at + chunk_rows])
                if out is not None:
                    yield out

    return df.mapInPandas(run, schema)


def map_files(spark: SparkSession, paths: list[str], f: Callable, schema: str) -> DataFrame:
    """f(path) -> pandas frame, one task for each path."""

    def run(batches):
        for batch in batches:
            for path in batch["path"]:
                yield f(path)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInPandas(run, schema)


def stream(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """A stream of the CSV or JSON-lines files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return reader.option("header", True).csv(folder) if kind == "csv" else reader.json(folder)


def materialized(df: DataFrame, folder: str, key: str) -> DataFrame:
    """df from its stored copy under a key, written first if there is none."""
    from hashlib import sha256

    spark = df.sparkSession
    path = f"{folder}/{sha256(key.encode()).hexdigest()}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def validate(spark: SparkSession, path: str, max_mb: int = MAX_MB) -> Validation:
    """Existence, size, extension, whether the head can be read, and what each format has of its own."""
    out, kind = Validation(), EXTENSIONS.get(os.path.splitext(path)[1].lower())
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        out.fail("the file does not exist")
        return out
    size = fs.getContentSummary(p).getLength()
    out.metadata |= {"size": size, "type": kind}
    if kind is None:
        out.fail("the extension is not supported")
    elif size == 0:
        out.fail("the file is empty")
    elif size > max_mb << 20:
        out.fail(f"the file is larger than {max_mb} MB")
    elif kind == "excel":
        _validate_excel(spark, path, out)
    else:
        df = load(spark, path)
        out.metadata |= {"columns": df.columns, "sample_rows": df.limit(SAMPLE_ROWS).count()}
        if kind == "csv":
            data = head(spark, path)
            encoding = detect_encoding(data)
            out.metadata |= {"encoding": encoding, "delimiter": detect_delimiter(data.decode(encoding, "replace").split("\n", 1)[0])}
            if len(df.columns) == 1:
                out.warnings.append("only one column")
        if kind in ("json", "jsonl"):
            out.metadata["layout"] = "array" if kind == "json" and head(spark, path, 64).lstrip()[:1] == b"[" else "lines"
            if "_corrupt_record" in df.columns:
                broken = sum(r["_corrupt_record"] is not None for r in df.limit(SAMPLE_ROWS).collect())  # the reader wants another column beside it
                out.metadata["broken"] = broken
                out.fail(f"{broken} of the first records cannot be read as JSON")
        if not out.metadata["sample_rows"]:
            out.warnings.append("no rows")
    return out


def _validate_excel(spark: SparkSession, path: str, out: Validation) -> None:
    """Sheets, the first one's columns and rows; a warning if there are several."""
    try:
        sheets = excel_sheets(spark, path)
        first = read_excel(spark, path, sheets[0])
    except RuntimeError as e:
        out.warnings.append(str(e))
        return
    except Exception as e:  # noqa: BLE001  whatever the reader says of a broken file
        out.fail(f"the workbook cannot be read: {e}")
        return
    out.metadata |= {"sheets": sheets, "columns": first.columns, "sample_rows": first.limit(SAMPLE_ROWS).count()}
    if len(sheets) > 1:
        out.warnings.append(f"{len(sheets)} sheets; only the first is read")
    if not out.metadata["sample_rows"]:
        out.warnings.append("no rows")


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The names in a file's header, without a pass over its rows."""
    return load(spark, path).columns


def info(spark: SparkSession, path: str) -> dict:
    """Rows and columns of a result file or folder."""
    df = load(spark, path)
    return {"path": path, "rows": df.count(), "columns": df.columns}


# Heads of programs and scripts, which no data file has.
EXECUTABLE_HEADS = {"MZ": b"MZ", "ELF": b"\x7fELF", "Mach-O": b"\xcf\xfa\xed\xfe", "Java class": b"\xca\xfe\xba\xbe", "script": b"#!"}
#: Bytes of a file that the security checks read.
SCAN_BYTES = 1 << 20


def security(spark: SparkSession, path: str, max_mb: int = MAX_MB) -> Validation:
    """validate(), and of the file's first megabyte: program heads, suspicious content, whether it is text where it should be."""
    import re

    out = validate(spark, path, max_mb)
    if "size" not in out.metadata:
        return out
    data, kind = head(spark, path, SCAN_BYTES), out.metadata["type"]
    for name, first in EXECUTABLE_HEADS.items():
        if data.startswith(first):
            out.fail(f"the file begins like a program ({name})")
    if kind in ("csv", "json", "jsonl"):
        if b"\x00" in data and not data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
            out.fail("the file holds zero bytes but should be text")
        text = data.decode(detect_encoding(data), "replace")
        found = {k: n for k, patterns in SUSPICIOUS.items() if (n := sum(len(re.findall(x, text, re.IGNORECASE | re.DOTALL)) for x in patterns))}
        out.metadata["findings"] = found
        for k, n in found.items():
            out.fail(f"suspicious content: {k} ({n})")
    return out


def security_report(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row a file: whether it passes, its size, and what speaks against it."""
    rows = [(p, v.is_valid, v.metadata.get("size"), v.errors, v.warnings) for p in paths for v in [security(spark, p)]]
    return spark.createDataFrame(rows, "path string, is_valid boolean, size long, errors array<string>, warnings array<string>")


def profile(df: DataFrame) -> DataFrame:
    """One row a column: rows, filled rows, whether it is all null.  One pass."""
    n = len(df.columns)
    row = df.toDF(*[f"c{i}" for i in range(n)]).agg(F.count("*").alias("n"), *[F.count(f"c{i}").alias(f"k{i}") for i in range(n)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("rows"), F.col(f"k{i}").alias("filled"), (F.col(f"k{i}") == 0).alias("all_null")) for i, c in enumerate(df.columns)])
    return row.select(F.explode(each).alias("r")).select("r.*")


def structure(df: DataFrame) -> Validation:
    """Errors of an empty table or repeated names; warnings of empty columns."""
    out = Validation()
    if not df.columns:
        out.fail("no columns")
        return out
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if repeated:
        out.warnings.append("repeated names: " + ", ".join(repeated))
    rows = profile(df).collect()
    out.metadata |= {"rows": rows[0]["rows"], "columns": len(df.columns)}
    if not rows[0]["rows"]:
        out.fail("no rows")
    out.warnings += [f"column {r['column']} is empty" for r in rows if r["all_null"] and r["rows"]]
    return out


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    from ..operators.results import without_nan

    return without_nan(df.limit(min(100, max(1, n))))


# Words that relate two column names.
COMMON = ["name", "id", "code", "region", "district", "city"]


def suggest_mappings(columns1: list[str], columns2: list[str]) -> list[dict]:
    """For each column of the first table the most alike unused one of the second; by names only."""
    used, out = set(), []
    for a in columns1:
        def alike(b: str, a: str = a) -> float:
            x, y = a.lower(), b.lower()
            return SequenceMatcher(None, x, y).ratio() + 0.2 * any(w in x and w in y for w in COMMON)

        best = max((b for b in columns2 if b not in used), key=alike, default=None)
        if best is not None and alike(best) > 0.3:
            used.add(best)
            score = alike(best)
            out.append({"source": a, "target": best, "score": score, "algorithm": "fuzzy" if score < 0.9 else "exact", "weight": min(1.0, score + 0.1)})
    return out


# Content that a file should not hold, by kind.
SUSPICIOUS = {
    "script": [r"<script[^>]*>.*?</script>", r"javascript:", r"vbscript:", r"onload\s*=", r"onerror\s*="],
    "sql": [r"union\s+select", r"drop\s+table", r"delete\s+from", r"insert\s+into"],
    "command": [r";\s*rm\s+-rf", r";\s*cat\s+/etc/passwd", r";\s*wget\s+", r";\s*curl\s+"],
    "path": [r"\.\./", r"\.\.\\", r"/etc/passwd", r"/etc/shadow"],
    "executable": [r"#!/bin/", r"#!/usr/bin/", r"MZ\x90\x00", r"\x7fELF"],
}


def content_findings(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """One row for each document and kind of suspicious content, with the number of finds."""
    each = [F.struct(F.lit(kind).alias("kind"), sum(F.size(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(f"(?is){p}"), F.lit(0))) for p in patterns).cast("long").alias("n")) for kind, patterns in SUSPICIOUS.items()]
    return df.select(F.col(id_column).alias("id"), F.explode(F.array(*each)).alias("t")).select("id", "t.kind", "t.n").where("n > 0")


def threat_report(found: DataFrame) -> DataFrame:
    severity = F.when(F.col("kind").isin("executable", "command"), "high").when(F.col("kind").isin("script", "sql"), "medium").otherwise("low")
    return found.groupBy("kind", severity.alias("severity")).agg(F.count("*").alias("files"), F.sum("n").alias("finds"))
