"""Encodings beyond a file's head, byte patterns at any place, lines by offset."""

import random

import pytest

from linkwright.sources import files, sinks


def places(data, pattern):
    out, k = [], data.find(pattern)
    while k >= 0:
        out.append(k)
        k = data.find(pattern, k + 1)
    return out


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_places_in_any_bytes(spark, tmp_path, small_ranges):
    rng = random.Random(4)
    data = {
        "random": rng.randbytes(300_000),
        "lines": b"\n".join(rng.randbytes(5) + b"ab\r\nab" for _ in range(20_000)),
        "marked": b"\xef\xbb\xbfabab\n" + b"x" * 50_000 + b"\nab",
        "unmarked": b"abab\n" * 9_000,
        "nothing": b"",
    }
    folder = tmp_path / "d"
    folder.mkdir()
    for name, x in data.items():
        (folder / name).write_bytes(x)
    for pattern in (b"ab", b"aba", b"\r\nab", b"\n", b"\x00\xff", b"\xe0", b"\xef\xbb\xbf", b"\xbfab", b"\xbb\xbfabab\n", b"no such bytes"):
        got = {}
        for r in files.find_places(spark, str(folder), pattern).collect():
            got.setdefault(r["path"].rsplit("/", 1)[1], []).append(r["at"])
        assert {k: sorted(v) for k, v in got.items()} == {k: places(x, pattern) for k, x in data.items() if pattern in x}, pattern
    with pytest.raises(ValueError):
        files.find_places(spark, str(folder), b"")


def test_lines_with_bytes_that_are_not_utf_8(spark, tmp_path):
    word = "Ёлка".encode("cp1251")
    (tmp_path / "f").write_bytes(b"one\ntwo " + word + b"\n\xff\x00 three " + word + b"\n")
    assert sorted(r["at"] for r in files.find_bytes(spark, str(tmp_path / "f"), word).collect()) == [4, 9]
    assert [r["at"] for r in files.find_bytes(spark, str(tmp_path / "f"), b"\xff\x00").collect()] == [0]


def test_lines_by_offset(spark, tmp_path):
    data = b"first\n\n" + b"x" * 200_000 + b"\r\nlast"
    path = tmp_path / "f"
    path.write_bytes(data)
    at, lines = 0, []
    while True:
        line, after = files.read_line(spark, str(path), at)
        if not line:
            break
        lines.append(line)
        at = after
    assert lines == data.splitlines(keepends=True) and at == len(data)
    assert files.read_line(spark, str(path), 8) == (b"x" * 199_999 + b"\r\n", 200_009)
    assert files.read_line(spark, str(path), 10**9) == (b"", 10**9)


@pytest.mark.parametrize(("code", "name"), [("cp1251", "Ёлка мир"), ("latin-1", "café déjà"), ("utf-8", "Ёлка мир")])
def test_an_encoding_told_behind_the_head(spark, tmp_path, code, name):
    path = tmp_path / "f.csv"
    path.write_bytes(b"id,name\n" + b"".join(b"%d,plain\n" % i for i in range(3000)) + b"3000," + name.encode(code) + b"\n")
    assert path.stat().st_size > files.HEAD_BYTES
    assert files.read_csv(spark, str(path)).where("id = '3000'").first()["name"] == name


def test_a_large_document_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SMALL", 10)
    (tmp_path / "f").write_text("0123456789")
    assert sinks.read_text(spark, str(tmp_path / "f")) == "0123456789"
    (tmp_path / "f").write_text("0123456789a")
    with pytest.raises(ValueError):
        sinks.read_text(spark, str(tmp_path / "f"))
