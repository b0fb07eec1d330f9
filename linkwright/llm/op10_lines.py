"""Quality rules: line-first cleaning.

Every line of a document is judged on its own; failing lines are removed, and
a document that loses more than half of its words is rejected.  Base measures
of the whole text reject a document before that.

Defined results.  A null text has no words and no lines: all counts are 0,
base_failed is true, clean_text null.  A null doc_id stays null.  Repeated rows
are judged one by one; of equal lines the first is not a repeat.  Extra columns
pass through; one named like a result is replaced.  An empty table has no rows.
A very long text is one slice, read whole: its words and lines take up to twenty
bytes for each byte of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as tb

#: Fixed values of the rules.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3
SYMBOLS = b"#*$%&|<>"
NAV_MARKS, SYMBOL_PERCENT, BANG_PERCENT, LONG_LINE = 3, 10, 20, 20
STOPS = b".,;:!?"
BOILERPLATE = [
    "all rights reserved", "copyright (c)", "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service",
    "licensed under", "enable javascript", "click here", "sign up for our newsletter", "subscribe now", "skip to content", "lorem ipsum",
]

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("n_lost_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("clean_text", "string")]


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _STOP = _set(SYMBOLS), _set(STOPS)
_PHRASES = [x.encode() for x in BOILERPLATE]


def _marked_lines(low: bytes, bounds: np.ndarray) -> np.ndarray:
    """Lines with a phrase in them.  No phrase has a line end in it; one across two documents doesn't count."""
    out = np.zeros(len(bounds) - 1, bool)
    for phrase in _PHRASES:
        at = low.find(phrase)
        while at >= 0:
            k = int(np.searchsorted(bounds, at, "right")) - 1
            out[k] |= at + len(phrase) <= bounds[k + 1]
            at = low.find(phrase, at + 1)
    return out


def judge(part: pa.RecordBatch) -> list:
    buf, offsets = tb.text_bytes(part.column(part.schema.get_field_index("text")))
    w, n = tb.Words(buf, offsets, tb.PLAIN), len(offsets) - 1
    n_words, word_byte = w.counts.astype(np.int64), w.mask & ((buf & 0xC0) != 0x80)
    symbol = tb.look(_SYMBOL, buf)
    begin = w.windows(REPEAT_WINDOW)
    grams = tb.span_hashes(tb.prefix_hashes(w.hashes(), tb.WORD_BASE), begin, begin + REPEAT_WINDOW, tb.WORD_BASE)
    own = tb.mix64(grams ^ tb.mix64(w.rows()[begin].astype(np.uint64) + np.uint64(1)))
    n_repeat = w.per_row(w.covered(begin[tb.repeated(own)], REPEAT_WINDOW))

    # lines: [bounds[k], bounds[k + 1]), a line feed belongs to the line before it
    bounds = np.unique(np.concatenate([offsets, np.flatnonzero(buf == 0x0A) + 1]))
    row = np.searchsorted(offsets, bounds[:-1], "right") - 1
    line_words = np.diff(np.searchsorted(w.starts, bounds))
    line_chars, marks = tb.sums(word_byte, bounds), tb.sums(symbol, bounds)
    fails = (tb.sums(buf == 0x7C, bounds) >= NAV_MARKS) | (100 * marks > SYMBOL_PERCENT * line_chars)
    fails |= 100 * tb.sums(buf == 0x21, bounds) > BANG_PERCENT * line_words
    fails |= (line_words >= LONG_LINE) & (tb.sums(tb.look(_STOP, buf), bounds) == 0)
    fails |= _marked_lines(tb.lower_ascii(buf).tobytes(), bounds)
    raw, n_dup = buf.tobytes(), np.zeros(n, np.int64)
    seen: set[bytes] = set()
    of = -1
    for k in np.flatnonzero(line_words).tolist():
        if row[k] != of:
            of, seen = row[k], set()
        line = raw[bounds[k] : bounds[k + 1]].removesuffix(b"\n")
        if line in seen:
            n_dup[of] += 1
            fails[k] = True
        else:
            seen.add(line)
    fails &= line_words > 0
    lost = np.bincount(row[fails], weights=line_words[fails], minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
    base = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    clean, text = [], part.column(part.schema.get_field_index("text"))
    of_row = np.searchsorted(bounds[:-1], offsets)
    bad = np.bincount(row[fails], minlength=n) if len(row) else np.zeros(n)
    for i in range(n):
        if not bad[i]:
            clean.append(text[i].as_py())
        else:
            lines = [raw[bounds[k] : bounds[k + 1]] for k in range(of_row[i], of_row[i + 1]) if not fails[k]]
            clean.append(b"".join(lines).decode("utf-8", "replace"))
    return [n_words, tb.sums(word_byte, offsets), tb.sums(symbol, offsets), n_dup, n_repeat, lost, base, ~base & (2 * lost <= n_words), pa.array(clean, pa.string())]


def clean_lines(docs: DataFrame) -> DataFrame:
    """docs with the measures, the verdict kept, and clean_text without the failing lines."""
    return tb.with_columns(docs, FIELDS, judge)
