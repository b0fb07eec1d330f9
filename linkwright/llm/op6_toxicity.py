"""Toxicity: a weighted finite-state pattern grammar over clauses.

Five small weighted transducers read the words of a clause as symbols.  Two write
matches: insults (at the insult word, and once more at a target soon after it)
and threats (an intention, a harmful verb and a target, or the target first).
Three write log weights onto the matches: a target near an insult adds to it;
negation, as long as it reaches, and reported speech, up to the end of the
clause, all but cancel it.  They are composed once into a single automaton; the
weight of a match is the sum of the weights on its arc.  A clause counts its best
match of each pattern, as the exponential of its weight, so a negated or reported
clause is worth about a fiftieth of a plain one.  A document's evidence for a
pattern that counts k in n words compares k with the rate r of that pattern in
clean text,
    k log(k / (n r)) - (k - n r)   where k > n r,
and the score is the logistic value of the sum over patterns.  So a stray word
in a long text, or one that clean texts use as well, says little.  A learned
pattern that clean texts hold once by chance has its first match or two free.

Insults are the fixed words below and words or word beginnings learned from
labels, on a bounded sample (ROWS): those whose evidence marks toxic rows that
no chosen one marks yet, and hardly any clean rows.  All terms of the sample with
SUPPORT toxic rows and a lift of LIFT are candidates, and as many are chosen as
mark SUPPORT new rows.

Defined results.  A null or empty text has no clause and the lowest score.  Null
doc_ids, repeated rows and extra columns pass; a column named like a result is
replaced.  An empty table has no rows.  Of equally good terms the shorter one and
then the first is chosen.  Without labels only the fixed words count.  A very
long text is read whole; its words, not its scores, are what takes memory (up to
twelve bytes for each byte of it).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .shared import forget, stored

#: Sample size, least support and lift of a candidate; words that a worker remembers and their greatest length.
ROWS, SUPPORT, LIFT, CACHE, LONG = 12_000, 3, 3.0, 300_000, 64
#: Evidence that marks a row, and how many toxic rows a clean one outweighs in the choice.
MARKS, AGAINST = 3.0, 3
#: Numbers of free matches that a learned pattern may have.
FREE = (0, 1, 2)
PREFIX = range(3, 9)
BIAS, BASE_RATE, THRESHOLD = -3.0, 1e-6, 0.5
FIELDS = [("score", "double"), ("predicted", "int")]

#: Fixed word lists.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown imbecile fool jerk bastard bitch asshole retard retarded vermin filth creep coward crap shit fuck fucking".split()
INTENTS = "will gonna going shall must should deserve deserves ought want let".split()
HARMS = "kill kills killed murder murdered hurt beat beaten shoot shot stab stabbed burn burned destroy destroyed hang hanged choke crush strangle slaughter".split()
TARGETS = "you your yours yourself he him his she her they them their these those people women men everyone".split()
NEGATIONS = "not no never nobody none without isn't aren't wasn't don't doesn't didn't won't nicht kein keine pas jamais nunca".split()
REPORTS = "said says say told wrote writes quoted quote reported claimed asked called allegedly according".split()
_TRIM, _STOPS = "\"'`.,;:!?()[]{}<>|/\\#$%&*~^_=+-", ".;:!?"

# ---- grammar

OTHER, INSULT, INTENT, HARM, TARGET, NEGATION, REPORT, STOP = range(8)
#: Words over which a negation, a target or an intention reaches.
REACH = 4
#: Log weights on a match: of a target near an insult, of negation, of reported speech.
AIMED, NEGATED, REPORTED = math.log(1.25), math.log(0.02), math.log(0.02)
#: What an arc may write: no match, an insult, a target after the last insult, a threat.
NOTHING, INSULTED, STRUCK, THREATENED = range(4)

#: A transducer: state and symbol -> next state, what is written, log weight.  Every one starts in its state 0 or (0, ..).
Step = Callable[[tuple, int], tuple[tuple, int, float]]
_MATCHING = (INSULT, HARM, TARGET)


def insult(state: tuple, x: int) -> tuple[tuple, int, float]:
    """Writes a match at an insult, and once more at a target up to REACH words after it."""
    (wait,) = state
    if x == INSULT:
        return (REACH,), INSULTED, 0.0
    if x == TARGET and wait:
        return (0,), STRUCK, AIMED
    return (0 if x == STOP else max(0, wait - 1),), NOTHING, 0.0


def threat(state: tuple, x: int) -> tuple[tuple, int, float]:
    """Writes a match at the last of intention, harm and target; the target may come first or last."""
    target, intent, harm = state  # words that each of them still reaches
    if x == STOP:
        return (0, 0, 0), NOTHING, 0.0
    target, intent, harm = max(0, target - 1), max(0, intent - 1), max(0, harm - 1)
    if x == INTENT:
        return (REACH if state[0] else 0, REACH, harm), NOTHING, 0.0
    if x == HARM and state[1]:
        return ((0, 0, 0), THREATENED, 0.0) if state[0] else ((target, 0, REACH), NOTHING, 0.0)
    if x == TARGET:
        return ((0, 0, 0), THREATENED, 0.0) if state[2] else ((REACH if not state[1] else target, intent, 0), NOTHING, 0.0)
    return (target, intent, harm), NOTHING, 0.0


def target(state: tuple, x: int) -> tuple[tuple, int, float]:
    """Adds weight to an insult up to REACH words after a target."""
    (near,) = state
    weight = AIMED if x == INSULT and near else 0.0
    return (REACH if x == TARGET else 0 if x == STOP else max(0, near - 1),), NOTHING, weight


def negation(state: tuple, x: int) -> tuple[tuple, int, float]:
    """Takes weight from matches up to REACH words after a negation; what it reaches carries it on."""
    (near,) = state
    weight = NEGATED if near and x in _MATCHING else 0.0
    carried = near and x in (INSULT, INTENT, HARM)
    return (REACH if x == NEGATION or carried else 0 if x == STOP else max(0, near - 1),), NOTHING, weight


def report(state: tuple, x: int) -> tuple[tuple, int, float]:
    """Takes weight from matches after a verb of speech, up to the end of the clause."""
    (on,) = state
    weight = REPORTED if on and x in _MATCHING else 0.0
    return (0 if x == STOP else int(on or x == REPORT),), NOTHING, weight


#: Transducers and their first states.
TRANSDUCERS: list[tuple[Step, tuple]] = [(insult, (0,)), (threat, (0, 0, 0)), (target, (0,)), (negation, (0,)), (report, (0,))]
THREAT = "threat"


class Grammar:
    """The composed automaton: its states are tuples of the transducers' states, reached from the first ones."""

    def __init__(self):
        start = tuple(first for _, first in TRANSDUCERS)
        number, todo = {start: 0}, [start]
        #: By state and symbol: the next state, the matches written, and the factor they count with.
        self.arcs: list[list[tuple[int, tuple[int, ...], float]]] = []
        for state in todo:
            row = []
            for x in range(8):
                steps = [step(s, x) for (step, _), s in zip(TRANSDUCERS, state, strict=True)]
                to = tuple(s for s, _, _ in steps)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                written = tuple(what for _, what, _ in steps if what)
                # a target that strikes back at an insult says nothing of a threat on the same arc
                plain = sum(w for _, what, w in steps if what != STRUCK)
                struck = sum(w for _, _, w in steps)
                row.append((number[to], written, math.exp(struck if STRUCK in written and THREATENED not in written else plain)))
            self.arcs.append(row)

    def matches(self, symbols: list[int], patterns: list[str]) -> dict[str, float]:
        """How often each pattern matched: for each clause its best match."""
        state, last, total, clause = 0, "", {}, {}
        for x, pattern in zip(symbols, patterns, strict=True):
            state, written, factor = self.arcs[state][x]
            for what in written:
                if what == INSULTED:
                    last = pattern
                name = THREAT if what == THREATENED else last
                clause[name] = max(clause.get(name, 0.0), factor)
            if x == STOP:
                for p, k in clause.items():
                    total[p] = total.get(p, 0.0) + k
                clause = {}
        for p, k in clause.items():
            total[p] = total.get(p, 0.0) + k
        return total


def evidence(k: float, n: int, rate: float, free: int = 0) -> float:
    """Log likelihood ratio of k matches, less the free ones, in n words against the rate in clean text."""
    k, expected = k - free, n * rate
    return k * math.log(k / expected) - (k - expected) if k > expected else 0.0


# ---- lexicon


def _trimmed(word: str) -> str:
    return word.strip(_TRIM)


def _words(text: str) -> list[str]:
    return text.lower().replace("\n", " . ").split()


def terms(word: str) -> list[str]:
    """The beginnings of a word, and the word itself with an end mark."""
    return [word[:n] for n in PREFIX if n <= len(word)] + [word + "$"]


class Lexicon:
    """Patterns with their rates in clean text, the fixed symbols, and what each seen word reads as."""

    def __init__(self, learned: dict[str, tuple[float, int]], rates: dict[str, float], base: float = BASE_RATE):
        self.rates = {w: (max(base, rates.get(w + "$", 0.0)), 0) for w in INSULTS} | {THREAT: (base, 0)} | learned
        self.learned = learned
        self.fixed: dict[str, int] = {}
        for symbol, words in ((INTENT, INTENTS), (HARM, HARMS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (INSULT, INSULTS)):
            self.fixed |= dict.fromkeys(words, symbol)
        self.known: dict[str, int] = {}
        self.patterns: dict[str, str] = {}

    def using(self, rates: dict[str, tuple[float, int]]) -> Lexicon:
        self.rates = rates
        return self

    def meaning(self, raw: str) -> tuple[int, str]:
        """A word's code (its symbol, and 8 more if it ends a clause) and its pattern if it is an insult."""
        word = _trimmed(raw)
        symbol, pattern = self.fixed.get(word, OTHER), word
        if symbol != INSULT and word:
            pattern = next((t for t in terms(word) if t in self.learned), "")  # the shortest
            symbol = INSULT if pattern else symbol
        tail = raw[len(raw.rstrip(_TRIM)) :] if word else raw
        return symbol + 8 * any(c in _STOPS for c in tail), pattern if symbol == INSULT else ""

    def learn(self, words: set[str]) -> None:
        """Remember the codes of new words, but for long ones."""
        words = {w for w in words if len(w) <= LONG and w not in self.known}
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
            self.patterns.clear()
        for raw in words:
            self.known[raw], pattern = self.meaning(raw)
            if pattern:
                self.patterns[raw] = pattern

    def read(self, words: list[str]) -> tuple[list[int], list[str]] | None:
        """Symbols and patterns; None if nothing in the text can match."""
        self.learn(set(words).difference(self.known))
        codes, odd = list(map(self.known.get, words)), {}
        if None in codes:  # long words
            for k in [k for k, c in enumerate(codes) if c is None]:
                codes[k], odd[k] = self.meaning(words[k])
        if not any((c & 7) in (INSULT, HARM) for c in set(codes)):
            return None
        symbols, patterns = [], []
        for k, code in enumerate(codes):
            symbols.append(code & 7)
            patterns.append((odd.get(k) or self.patterns.get(words[k], "")) if code & 7 == INSULT else "")
            if code & 8:
                symbols.append(STOP)
                patterns.append("")
        return symbols, patterns

    def evidence(self, grammar: Grammar, words: list[str]) -> float:
        read = self.read(words)
        n = len(words)
        return sum(evidence(k, n, *self.rates[p]) for p, k in grammar.matches(*read).items()) if read else 0.0


def _occurrences(text: str) -> tuple[int, dict[str, int]]:
    """Words of a text, and how often each term occurs in it."""
    words, out = _words(text), {}
    by: dict[str, int] = {}
    for w in words:
        by[w] = by.get(w, 0) + 1
    for w, n in by.items():
        if word := _trimmed(w):
            for t in terms(word):
                out[t] = out.get(t, 0) + n
    return len(words), out


def learn(rows: DataFrame) -> Lexicon:
    """A lexicon from text, y rows (see labelled.sample for their bound)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: dict[str, int] = {}
        clean: dict[str, int] = {}
        times: dict[str, int] = {}
        for part in tb.slices(batches):
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                n, found = _occurrences(text)
                found[""] = n
                into = toxic if y else clean
                for t, k in found.items():
                    into[t] = into.get(t, 0) + 1
                    if not y:
                        times[t] = times.get(t, 0) + k
        names = list(toxic.keys() | clean.keys())
        for at in range(0, len(names), 1 << 14):
            some = names[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([x.get(t, 0) for t in some], pa.int64()) for x in (toxic, clean, times))], names=["term", "toxic", "clean", "times"])

    rows = stored(rows.select("text", "y"), "sample")
    counts = stored(rows.mapInArrow(tb.tidy(count), "term string, toxic long, clean long, times long").groupBy("term").agg(*(F.sum(x).alias(x) for x in ("toxic", "clean", "times"))), "terms")
    top = counts.where("term = ''").first()
    n_toxic, n_clean, n_words = (top["toxic"], top["clean"], top["times"]) if top else (0, 0, 0)
    lift = (F.col("toxic") + 0.5) * (n_clean + 1) / ((F.col("clean") + 0.5) * (n_toxic + 1))
    seeds = [w + "$" for w in INSULTS]
    fixed = {r["term"]: r["times"] / max(1, n_words) for r in counts.where(F.col("term").isin(seeds)).collect()}
    base = max(BASE_RATE, 0.5 / max(1, n_words)) if n_words else BASE_RATE
    wanted = counts.where((F.col("toxic") >= SUPPORT) & (lift >= LIFT) & (F.col("term") != ""))
    found = wanted.collect()  # terms of the bounded sample
    names, rates = [r["term"] for r in found], [max(base, (r["times"] + 0.5) / max(1, n_words)) for r in found]
    sent = rows.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(names)}, rates))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rates = sent.value
        for part in tb.slices(batches):
            lists = []
            for text in part.column(0).to_pylist():
                n, have = _occurrences(text)
                lists.append([len(FREE) * at[t] + f for t, k in have.items() if t in at for f in FREE if evidence(k, n, rates[at[t]], f) >= MARKS])
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["y", "terms"])

    by: dict[int, set[int]] = {}
    against: dict[int, int] = {}
    for k, row in enumerate(rows.mapInArrow(tb.tidy(marked), "y int, terms array<int>").where("size(terms) > 0").collect()):
        for i in row["terms"]:
            if row["y"]:
                by.setdefault(i, set()).add(k)
            else:
                against[i] = against.get(i, 0) + 1
    forget(rows)
    forget(counts)
    chosen: dict[str, tuple[float, int]] = {}

    def rank(i: int) -> tuple:
        """Most toxic rows that nothing marks yet, less the clean ones; then the shorter and the first term."""
        name = names[i // len(FREE)]
        return AGAINST * against.get(i, 0) - len(by[i]), len(name), name, i

    # what a term gains only falls as others are chosen: the best one that is still as good as when it was ranked is next
    agenda, covered = [rank(i) for i in by], set()
    heapq.heapify(agenda)
    while agenda and -agenda[0][0] >= SUPPORT:
        was, *_, i = heapq.heappop(agenda)
        by[i] -= covered
        if rank(i)[0] != was:
            heapq.heappush(agenda, rank(i))
            continue
        covered |= by[i]
        chosen.setdefault(names[i // len(FREE)], (rates[i // len(FREE)], i % len(FREE)))
    return Lexicon(chosen, fixed, base)


def classify(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast((lexicon.learned, lexicon.rates))
    state: dict[str, tuple[Grammar, Lexicon]] = {}

    def run(part: pa.RecordBatch) -> list:
        if "s" not in state:  # a reader for each task: what it remembers goes with the task
            learned, rates = sent.value
            state["s"] = Grammar(), Lexicon(learned, {}).using(rates)
        (grammar, lex), scores = state["s"], []
        for text in part.column(part.schema.get_field_index("text")):
            scores.append(1 / (1 + math.exp(-min(30.0, BIAS + lex.evidence(grammar, _words(text.as_py() or ""))))))
        score = np.array(scores, np.float64)
        return [score, (score >= threshold).astype(np.int32)]

    return tb.with_columns(docs, FIELDS, run)
