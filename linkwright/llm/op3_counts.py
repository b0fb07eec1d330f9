"""Token counts with a whole-token shortcut.

For a SentencePiece BPE model with identity normalization a text is cut where
no merge can cross: before a run of spaces (no piece has a space after another
character) and around line feeds (no piece holds one).  These facts and the
identity of the normalization are checked, and each vocabulary string is encoded
alone once, on the driver: those that come out as one token are proven whole.
Executors count a proven pre-token as one; only other pre-tokens are merged, by
the library, and the counts of those up to LONG characters remembered within a
bound.

Defined results.  A null text counts as empty: 0 bytes, 0 tokens.  Null
doc_ids, repeated rows and extra columns pass through; a column named like a
result is replaced.  An empty table has no rows.  A text of exactly limit tokens
isn't over it.  A very long text is counted line by line and in pieces cut before
spaces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbatch as tb

LIMIT, CACHE, LONG = 4096, 1_000_000, 64
SPACE = "▁"
FIELDS = [("n_bytes", "long"), ("n_tokens", "long"), ("over_limit", "boolean")]


#: Characters that usual normalizations change.
_PROBE = "\ufb01 \uff21\u00bd  e\u0301 \u3000x\u200b \u212b"


def cut_points(model) -> list[str]:
    """The pieces of a model; raises if merges can cross the places where texts are cut, or normalization changes texts."""
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) or model.encode("\nx", out_type=str)[:2] != [SPACE, "<0x0A>"]:
        raise ValueError("merges of this model can cross spaces or line feeds")
    if model.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
        raise ValueError("this model changes texts before it encodes them")
    return pieces


def whole_tokens(path: str) -> tuple[frozenset[str], frozenset[str]]:
    """Strings proven to be one token: after a space, and with nothing before."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = cut_points(model)
    spaced = [p[1:] for p in pieces if p.startswith(SPACE) and p.count(SPACE) == 1]
    bare = [p for p in pieces if SPACE not in p]
    a = {p for p, ids in zip(spaced, model.encode(spaced, num_threads=1), strict=True) if len(ids) == 1}
    b = {p for p, ids in zip(bare, model.encode(["\n" + p for p in bare], num_threads=1), strict=True) if len(ids) == 3}
    if len(model.encode("x ")) == 1 + len(model.encode("x")):
        a.add("")  # a space with nothing after it
    return frozenset(a), frozenset(b)


class Counter:
    def __init__(self, path: str, whole: tuple[frozenset[str], frozenset[str]]):
        import sentencepiece

        self.model, self.whole = sentencepiece.SentencePieceProcessor(model_file=path), whole
        self.reset()

    def reset(self) -> None:
        self.spaced, self.bare = (dict.fromkeys(x, 1) for x in self.whole)

    def learn(self, spaced: set[str], bare: set[str]) -> None:
        """Merge the pre-tokens that aren't known yet."""
        if len(self.spaced) + len(self.bare) > CACHE:
            self.reset()
        new = [w for w in spaced if w not in self.spaced]
        self.spaced.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
        new = [w for w in bare if w not in self.bare]
        self.bare.update((w, len(ids) - 2) for w, ids in zip(new, self.model.encode(["\n" + w for w in new], num_threads=1), strict=True))

    def forget(self, spaced: set[str], bare: set[str]) -> None:
        """Don't remember long ones."""
        for known, used in ((self.spaced, spaced), (self.bare, bare)):
            for w in [w for w in used if len(w) > LONG]:
                del known[w]

    def texts(self, texts: list[str]) -> list[int]:
        cut = [pretokens(t) for t in texts]
        spaced, bare = set().union(*(s for s, _, _ in cut)), set().union(*(b for _, b, _ in cut))
        self.learn(spaced, bare)
        s_count, b_count = self.spaced.__getitem__, self.bare.__getitem__
        out = [sum(map(s_count, s)) + sum(map(b_count, b)) + feeds for s, b, feeds in cut]
        self.forget(spaced, bare)
        return out

    def text(self, text: str) -> int:
        """One text of any length, in pieces."""
        total, at = 0, 0
        while at < len(text):
            to = cut_after(text, at + tb.PIECE)
            total += self.texts([text[at + (at > 0) : to]])[0]  # a later piece's space is the one that stands before a text
            at = to
        return total


def cut_after(text: str, at: int) -> int:
    """The next place from at on where a run of spaces begins that no line feed precedes; the end if there is none."""
    m = _BEGIN.search(text, at)
    return m.start() + 1 if m else len(text)


#: A character before a single space and a word; the space begins a pre-token of its own.
_BEGIN = re.compile(f"[^ {SPACE}\n] (?=[^ {SPACE}\n])")
#: A run of spaces with what follows; the run's last space goes without saying, as in the library's own prefix.
_RUN = re.compile(f"[ {SPACE}]([ {SPACE}]*[^ {SPACE}\n]*)|([^ {SPACE}\n]+)")


def pretokens(text: str) -> tuple[list[str], list[str], int]:
    """Pre-tokens after a space, those with none, and the number of line feeds."""
    if not text:
        return [], [], 0
    lines = (" " + text).split("\n")
    if "  " in lines[0] or "  " in text or SPACE in text or any(x[-1:] == " " for x in lines):
        spaced, bare = [], []
        for line in lines:
            for m in _RUN.finditer(line):
                (spaced if m[1] is not None else bare).append((m[1] if m[1] is not None else m[2]).replace(SPACE, " "))
        return spaced, bare, len(lines) - 1
    spaced, bare = [], []
    for line in lines:
        head, *rest = line.split(" ")
        if head:
            bare.append(head)
        spaced += rest
    return spaced, bare, len(lines) - 1


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    state: dict[str, Counter] = {}

    def count(part: pa.RecordBatch) -> list:
        if "c" not in state:
            state["c"] = Counter(path, whole.value)
        text = part.column(part.schema.get_field_index("text"))
        texts = [x.as_py() or "" for x in text]
        n = np.array([state["c"].text(t) for t in texts] if len(texts) == 1 else state["c"].texts(texts), np.int64)
        return [np.diff(tb.text_bytes(text)[1]), n, n > limit]

    return tb.with_columns(docs, FIELDS, count)
