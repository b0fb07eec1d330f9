"""Plain versions of the operators, one document or pair at a time."""

import math
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def fingerprint(text, n=4):
    ws = words((text or "").translate(LOWER))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, fps, bits=4):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= bits):
            a, b = sorted((root(ids[i]), root(ids[i + 1 + j])))
            parent[b] = a
    return {i: root(i) for i in ids}


def kept_words(rows, n=50):
    """rows: (doc_id, text); kept words in the order of the rows."""
    cut = [(i, words(t)) for i, t in rows]
    first = {}
    for i, ws in cut:
        if i is not None:
            for k in range(len(ws) - n + 1):
                w = tuple(ws[k : k + n])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in cut:
        gone = set()
        for k in range(len(ws) - n + 1 if i is not None else 0):
            if first[tuple(ws[k : k + n])] < i:
                gone.update(range(k, k + n))
        out.append([w for k, w in enumerate(ws) if k not in gone])
    return out


def contaminated(text, items, n=10):
    """items: (item_id, text); hit words and sorted ids."""
    ws, hit, ids = ALNUM.findall((text or "").translate(LOWER)), set(), set()
    for item, t in items:
        iw = ALNUM.findall((t or "").translate(LOWER))
        size = min(n, len(iw))
        wins = {tuple(iw[k : k + size]) for k in range(len(iw) - size + 1)} if size else set()
        for k in range(len(ws) - size + 1):
            if tuple(ws[k : k + size]) in wins:
                hit.update(range(k, k + size))
                ids.add(str(item))
    return len(ws), len(hit), sorted(ids)


def base_rules(text):
    ws, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = {t for t in tri if tri.count(t) > 1}
    rep = {i + k for i, t in enumerate(tri) if t in often for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(rep)


# ---- classifiers

MASK = (1 << 64) - 1


def mix64(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def word_hash(word, base=0x9E3779B97F4A7C15):
    """Of a word's bytes, by a polynomial modulo 2**64; XXH64 above 32 bytes."""
    if len(word) > 32:
        return xxhash.xxh64_intdigest(word, base & MASK)
    return mix64(sum(mix64((b + 1) * 0x9E3779B97F4A7C15 & MASK) * pow(base, t, 1 << 64) for t, b in enumerate(word)) & MASK)


def quality_features(text, dim=1 << 12):
    """number -> value of a text's sparse vector."""
    raw = (text or "").encode()
    low = raw.lower()
    ws, size = low.split(), max(1, len(raw))
    n = max(1, len(ws))
    out = {}
    for w in ws:
        bucket = word_hash(w) >> 52
        out[bucket] = out.get(bucket, 0) + 1
    out = {k: math.sqrt(v / n) for k, v in out.items()}
    tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    count = lambda chars, t=raw: sum(t.count(bytes([c])) for c in chars)
    share = lambda k, times: min(1, times * k / size)
    letters = count(range(0x61, 0x7B), low)
    stats = [
        math.log1p(len(raw)) / 12, math.log1p(count(b"\n")) / 8, share(count(b"#*$%&<>"), 5), share(count(b"|"), 10), share(count(b"!"), 10), count(range(0x41, 0x5B)) / max(1, letters),
        share(count(b"0123456789"), 5), share(count(b".,;:?"), 10), sum(len(w) > 15 for w in ws) / n, sum(len(w) < 3 for w in ws) / n, sum(b >= 0x80 for b in raw) / size,
        len({i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}) / n, sum(ws.count(w) > 1 for w in ws) / n, 1.0,
    ]
    return out | {dim + k: v for k, v in enumerate(stats)}


def machine_score(x, w, v):
    """Linear terms and all pairwise interactions, one by one."""
    items = sorted(x.items())
    margin = sum(w[i] * a for i, a in items) + sum(float(np.dot(v[i], v[j])) * a * b for k, (i, a) in enumerate(items) for j, b in items[:k])
    return 1 / (1 + math.exp(-margin))


def gram_buckets(text):
    marked = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower()))
    out = []
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            if marked[i : i + n].strip():
                h = n
                for c in marked[i : i + n]:
                    h = h * 0x1000193 + ord(c) & MASK
                out.append(mix64(h) >> 48)
    return out


def languages(training, texts, buckets=1 << 16, smoothing=0.5):
    """training: (text, lang); (lang, posterior) of each text."""
    counts, docs = {}, Counter(lang for _, lang in training)
    for text, lang in training:
        counts.setdefault(lang, Counter()).update(gram_buckets(text))
    out = []
    for text in texts:
        grams = gram_buckets(text)
        if not grams or not docs:
            out.append(("und", 0.0))
            continue
        logs = {}
        for lang, n in counts.items():
            total = sum(n.values()) + smoothing * buckets
            logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((n[g] + smoothing) / total) for g in grams)
        best = max(sorted(logs), key=logs.get)
        out.append((best, 1 / sum(math.exp(min(700, x - logs[best])) for x in logs.values())))
    return out


def toxic_clauses(text, words, learned):
    """Clauses as lists of (kind, pattern); words: kind -> list; learned: beginnings of words, or whole words with $."""
    clause, out = [], []
    for raw in (text or "").lower().replace("\n", " . ").split():
        word = raw.strip("\"'`.,;:!?()[]{}<>|/\\#$%&*~^_=+-")
        kind = next((k for k, ws in reversed(words.items()) if word in ws), "")
        pattern = word if kind == "insult" else ""
        if kind != "insult" and word:
            found = [p for p in [word[:n] for n in range(3, min(8, len(word)) + 1)] + [word + "$"] if p in learned]
            kind, pattern = ("insult", found[0]) if found else (kind, "")
        clause.append((kind, pattern))
        after = raw
        for k in range(len(raw), 0, -1):
            if word and raw[:k].endswith(word):
                after = raw[k:]
                break
        if any(c in after for c in ".;:!?"):
            out.append(clause)
            clause = []
    return [*out, clause], len((text or "").replace("\n", " . ").split())


def toxic_counts(clauses, reach=4, aimed=1.25, cut=0.02):
    """How often each pattern counts: positions of the words, no automaton."""
    total = Counter()
    for clause in clauses:
        best, until, said = {}, -1, False
        target = intent = harm = before = insult = None
        for p, (kind, pattern) in enumerate(clause):
            near = lambda at, p=p: at is not None and p - at <= reach
            found = []
            if kind == "insult":
                found, insult = [(pattern, aimed if near(target) else 1.0)], (p, pattern)
            elif kind == "target" and insult and near(insult[0]):
                found, insult = [(insult[1], aimed)], None
            threat = False
            if kind == "intent":
                before, intent = p if near(before) else None, p
            elif kind == "harm" and near(intent):
                threat = near(before)
                harm, intent = p, None
            elif kind == "target":
                threat = near(harm)
                if not near(intent):
                    before = p
            if threat:
                found = [(name, 1.0) for name, _ in found] + [("threat", 1.0)]
                before = intent = harm = None
            for name, k in found:
                best[name] = max(best.get(name, 0.0), k * (cut if p <= until else 1.0) * (cut if said else 1.0))
            if kind == "negation" or (p <= until and kind in ("insult", "intent", "harm")):
                until = p + reach
            said |= kind == "report"
            target = p if kind == "target" else target
        total.update(best)
    return total


def toxicity(text, words, learned, rates):
    """rates: pattern -> (rate in clean text, free matches)."""
    clauses, n = toxic_clauses(text, words, learned)
    evidence = 0.0
    for pattern, k in toxic_counts(clauses).items():
        rate, free = rates[pattern]
        k, expected = k - free, n * rate
        if k > expected:
            evidence += k * math.log(k / expected) - (k - expected)
    return 1 / (1 + math.exp(-min(30.0, evidence - 3.0)))
