import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkwright.llm import op1_rans, op2_simhash, op3_counts, op4_quality, op5_language, op6_toxicity, op7_substrings, op8_decontaminate, op9_dropout, op10_lines, queries, textbatch
from linkwright.llm.labelled import sample

from . import brute

PIECES, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n", "  a", "a\nb\r\n\t c", "don't STOP's we'LL 12a3 <|endoftext|>x", "a\x1cb c\x1dd", "é ́x İ ß", "x▁y ▁ z", "a \n b ", "日本語 テ", "\U0001f600 ok", "<s>x</s>", "word " * 400, "x" * 3000, " " * 50 + "x", "a\x00b", "a b", "Kelvin K"]
SCHEMA = "doc_id long, text string, n_words string, score string, extra int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and odd texts, a null doc_id, repeated rows, equal ids, extra columns with clashing names."""
    rows = [(i, t, "mine", None, i) for i, t in enumerate(ODD)] + [(3, ODD[3], "mine", None, 3), (4, "another text", None, "s", 4), (None, "no id here", None, None, 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"]) + str(rng.randrange(30)) for _ in range(n))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_rans_round_trip(spark, odd, empty, sf):
    model = Tokenizer.from_file(BPE)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd, empty):
        given = df.select("doc_id", "text").collect()
        got = op1_rans.read_documents(spark, op1_rans.encode_documents(df, BPE, 2)).collect()
        want = sorted((r[0] if r[0] is not None else -1, tuple(model.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in given)
        assert sorted((r[0] if r[0] is not None else -1, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        ids = [r[0] if r[0] is not None else -1 for r in sorted(got, key=lambda r: r["start"])]
        assert ids == sorted(ids)


def test_rans_blocks():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 1), (5, 3), (1000, 1), (70_000, 300), (200_001, 40_000)):
        ids = np.minimum(rng.zipf(1.3, n), kinds).astype(np.uint16)
        freq = op1_rans.Frequencies(dict(zip(*map(np.ndarray.tolist, np.unique(ids, return_counts=True)), strict=True)))
        assert int(freq.freq.sum()) == 1 << op1_rans.SCALE
        block = op1_rans.encode_block(ids, freq, b"index", 3, every=50)
        back, index = op1_rans.decode_block(block, freq)
        assert (back == ids).all() and index == b"index"
        broken = bytearray(block)
        broken[len(block) // 2] ^= 1
        with pytest.raises(ValueError):
            op1_rans.decode_block(bytes(broken), freq)


def test_golay_keys_meet():
    rng = random.Random(3)
    base = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    flips = np.array([sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(3000)], np.uint64)
    at, key = op2_simhash.keys(np.concatenate([base, base ^ flips]).view(np.int64))
    own = [set() for _ in range(6000)]
    for a, k in zip(at.tolist(), key.tolist(), strict=True):
        own[a].add(k)
    assert all(own[i] & own[i + 3000] for i in range(3000))


def test_near_duplicates(spark, odd, empty, sf):
    rng = random.Random(5)
    texts = [t for t in (prose(rng, rng.randrange(1, 300)) for _ in range(150))]
    for _ in range(150):  # near copies and copies
        ws = rng.choice(texts).split()
        if rng.random() < 0.8:
            ws[rng.randrange(len(ws))] = "changed"
        texts.append(" ".join(ws))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (made, spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")):
        given = sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect() if r["doc_id"] is not None) if df is made else sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda r: r[0])
        fps = [brute.fingerprint(t) for _, t in given]
        want = brute.components([i for i, _ in given], fps)
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op2_simhash.near_duplicates(df).collect()}
        assert got == {i: (f"{f:016x}", want[i]) for (i, _), f in zip(given, fps, strict=True)}
    assert op2_simhash.near_duplicates(odd).count() == odd.count()
    assert op2_simhash.near_duplicates(empty).count() == 0
    kept = op2_simhash.keep_one(made)
    assert {r["doc_id"] for r in kept.collect()} == set(brute.components(list(range(300)), [brute.fingerprint(t) for t in texts]).values())
    assert op2_simhash.keep_one(empty).count() == 0 and kept.columns == made.columns


def test_large_group_of_links():
    fps = np.array([1 << a | 1 << b for a in range(40) for b in range(a)], np.uint64)  # all within four bits
    assert len(op2_simhash._links(fps, 4)) == len(fps) - 1


def test_token_counts(spark, odd, empty, sf):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd.select("doc_id", "text"), empty.select("doc_id", "text")):
        want = sorted(((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in df.collect()), key=repr)
        assert rows(op3_counts.count_tokens(df, PIECES), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_long_texts_are_counted_in_pieces(monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter, rng = op3_counts.Counter(PIECES, op3_counts.whole_tokens(PIECES)), random.Random(3)
    parts = ["the", "idea", " ", "  ", "\n", "▁", "x" * 70, "é", "日", " of"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(200)]
    for piece in (1, 5, 40, textbatch.PIECE):
        monkeypatch.setattr(textbatch, "PIECE", piece)
        assert [counter.text(t) for t in texts] == [len(model.encode(t)) for t in texts]
    assert max(map(len, counter.spaced)) <= op3_counts.LONG


def test_factorisation_identity():
    machine = op4_quality.Machine()
    rng = np.random.default_rng(2)
    machine.w, machine.v = rng.normal(size=machine.w.shape), rng.normal(size=machine.v.shape)
    number, value = np.array([3, 10, 700, 4100]), np.array([0.5, 1.0, -2.0, 0.25])
    want = machine.w[number] @ value + sum(machine.v[number[i]] @ machine.v[number[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    assert math.isclose(machine.margin(np.array([0, 4]), number, value)[0][0], want)


@pytest.mark.parametrize(("name", "label", "least"), [("op4_quality", "quality", 0.95), ("op6_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    at = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, at).where("held_out").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    assert got.select(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least


def test_language_accuracy(spark):
    at = "/root/testdata/sf0.01"
    got = queries.op5_language(spark, at).where("held_out").join(spark.read.parquet(f"{at}/documents.parquet"), "doc_id")
    assert got.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.97


def test_language_defined_cases(spark, odd, empty):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "de"), (4, "text", None)], "doc_id long, text string, lang string")
    model = op5_language.learn(docs, F.lit(True))
    assert model[0] == ["de", "en"]
    got = {r["doc_id"]: r for r in op5_language.predict(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["en", "de", "und"]
    out = op5_language.predict(odd, model)
    assert out.where("text IS NULL OR text IN ('', ' ')").select("lang_pred").distinct().collect()[0][0] == "und"
    assert out.count() == odd.count() and op5_language.predict(empty, model).count() == 0
    nothing = op5_language.learn(empty.withColumn("lang", F.lit("x")), F.lit(True))
    assert {r["lang_pred"] for r in op5_language.predict(docs, nothing).collect()} == {"und"}


KINDS = {"intent": op6_toxicity.INTENTS, "harm": op6_toxicity.HARMS, "target": op6_toxicity.TARGETS, "negation": op6_toxicity.NEGATIONS, "report": op6_toxicity.REPORTS, "insult": op6_toxicity.INSULTS}


def toxic(text, lexicon):
    return 1 / (1 + math.exp(-min(30.0, op6_toxicity.BIAS + lexicon.evidence(op6_toxicity.Grammar(), op6_toxicity._words(text)))))


def test_grammar_contexts():
    """Negation and reported speech decide the verdict; targets count on either side."""
    lexicon = op6_toxicity.Lexicon({"grumbl": (1e-6, 0)}, {})
    clean = ["He is not an idiot.", "She said he is an idiot.", "The report quoted the word idiot as an insult.", "I will not kill you", "I would never hurt them", "kill the lights", "you will see them", "a calm and clean sentence", "He was told that you are scum", "nobody will kill you", "she said they will kill you"]
    bad = ["what an idiot that is", "You idiot!", "idiot like you", "i will kill you", "you deserve to be beaten", "people should be shot", "Not good. You idiot!", "they said no. you are scum", "a grumbling fellow", "x" * 100 + " idiot"]
    assert [t for t in clean if toxic(t, lexicon) >= op6_toxicity.THRESHOLD] == []
    assert [t for t in bad if toxic(t, lexicon) < op6_toxicity.THRESHOLD] == []
    plain = toxic("what an idiot that is to see on a walk there", lexicon)
    assert toxic("what an idiot that is to see you on walks there", lexicon) == plain < toxic("what an idiot you are to see that on a walk", lexicon) == toxic("you are an idiot to see that on a walk there", lexicon)


def test_grammar_equals_a_clause_walker():
    """Random word strings against a walker over positions."""
    rng = random.Random(13)
    learned = {"grumbl": (2e-6, 0), "zor$": (1e-4, 1), "blu": (1e-5, 2)}
    lexicon = op6_toxicity.Lexicon(learned, {"idiot$": 1e-3})
    words = [ws[0] for ws in KINDS.values()] + [ws[1] for ws in KINDS.values()] + ["grumbling", "zor", "zors", "bluish", "the", "of", "idiot!", "you,", "not;", "...", "\n", "x" * 80, "blu" + "y" * 80 + "."]
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(25)))
        assert math.isclose(toxic(text, lexicon), brute.toxicity(text, KINDS, learned, lexicon.rates), rel_tol=1e-9), text


def test_quality_scores_equal_plain_ones(spark, odd, sf):
    machine, rng = op4_quality.Machine(), np.random.default_rng(4)
    machine.w, machine.v, machine.fitted = rng.normal(size=machine.w.shape), rng.normal(0, 0.3, machine.v.shape), True
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 2500").select("doc_id", "text")
    for df in (docs, odd.select("doc_id", "text")):
        for r in op4_quality.classify(df, machine).collect():
            want = brute.machine_score(brute.quality_features(r["text"]), machine.w, machine.v)
            assert math.isclose(r["score"], want, rel_tol=1e-6, abs_tol=1e-9) and r["predicted"] == (r["score"] >= 0.7)


def test_languages_equal_plain_ones(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 2500").select("doc_id", "text", "lang")
    given = docs.collect()
    training = [(r["text"], r["lang"]) for r in given if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None]
    model = op5_language.learn(docs, queries.remainder("doc_id", 4) != 2)
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        got = op5_language.predict(df, model).collect()
        for r, (lang, score) in zip(got, brute.languages(training, [r["text"] for r in got]), strict=True):
            assert r["lang_pred"] == lang and math.isclose(r["score"], score, rel_tol=1e-3, abs_tol=1e-6)


def test_classifiers_without_labels(spark, odd, empty, sf):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    machine = op4_quality.learn(sample(odd, none, "quality", 4, 2, 10))
    assert {r["score"] for r in op4_quality.classify(odd, machine).collect()} == {0.5}
    lexicon = op6_toxicity.learn(sample(odd, none, "toxic", 5, 0, 10))
    assert {r["predicted"] for r in op6_toxicity.classify(odd, lexicon).collect()} == {0}
    labels = spark.createDataFrame([(i, i % 2, None if i == 5 else i % 2) for i in range(20)] + [(None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    machine = op4_quality.learn(sample(odd, labels, "quality", 4, 2, 50))
    for df in (odd, empty):
        out = op4_quality.classify(df, machine)
        assert out.count() == df.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
        out = op6_toxicity.classify(df, op6_toxicity.learn(sample(odd, labels, "toxic", 5, 0, 50)))
        assert out.count() == df.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert sample(odd, labels, "quality", 4, 2, 3).count() <= 4


def test_substring_dedup(spark, odd, empty, monkeypatch):
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (50, 51, 70, 120, 49)]
    texts = [" ".join(rng.choice([prose(rng, rng.randrange(0, 80)), rng.choice(passages)]) for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    texts += [texts[3], "line again " * 100, "line again " * 60]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    given = [*zip(ids, texts, strict=True), (ids[0], texts[0]), (ids[1], passages[3]), (None, passages[2])]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    got = rows(op7_substrings.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_text")
    want = sorted(((i, len(brute.words(t)), len(brute.words(t)) - len(k), " ".join(k)) for (i, t), k in zip(given, brute.kept_words(given), strict=True)), key=repr)
    assert got == want
    out = op7_substrings.remove_repeats(odd)
    assert out.count() == odd.count() and out.where("n_removed > 0").count() == 0 and "extra" in out.columns
    assert op7_substrings.remove_repeats(empty).count() == 0


def test_chunks_are_joined_right(monkeypatch, spark):
    """A document's windows may meet their copies in the same chunk, another one, or another task."""
    import pyarrow as pa

    chunk, rng = op7_substrings.Chunk(5, 100), random.Random(1)
    text = prose(rng, 12)
    chunk.add(pa.RecordBatch.from_arrays([pa.array([7, 2, None]), pa.array([text, "x " + text, text])], names=["doc_id", "text"]))
    out = [r for b in chunk.rows(0, 8) for r in b.to_pylist()]
    local = np.cumsum(op7_substrings.unpack(out[0]["b"], np.uint32))
    assert local.tolist() == list(range(8))  # all windows of doc 7
    assert sum(len(op7_substrings.unpack(r["b"], np.uint32)) for r in out[1:]) == 9  # of doc 2


def test_ranges_in_two_steps(monkeypatch, spark):
    """Coarse and then fine ranges, small chunks, texts in pieces: the same words go."""
    rng = random.Random(19)
    passages = [prose(rng, n) for n in (50, 60, 130)]
    texts = [" ".join(rng.choice([prose(rng, rng.randrange(0, 80)), rng.choice(passages)]) for _ in range(rng.randrange(1, 6))) for _ in range(90)]
    given = list(enumerate(texts))
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    want = sorted(((i, len(brute.words(t)), " ".join(k)) for (i, t), k in zip(given, brute.kept_words(given), strict=True)), key=repr)
    for first, chunk in ((3, 2000), (5, 300), (12, 100)):
        monkeypatch.setattr(op7_substrings, "FIRST", first)
        monkeypatch.setattr(op7_substrings, "CHUNK", chunk)
        assert rows(op7_substrings.remove_repeats(df), "doc_id", "n_words", "kept_text") == want


def test_packed_windows_come_back():
    rng = np.random.default_rng(3)
    h, more = rng.integers(0, 1 << 64, 500, np.uint64), rng.integers(0, 1 << 24, 500).astype(np.uint32)
    at, doc, of = rng.integers(0, 1 << 20, 500).astype(np.uint32), rng.integers(-9, 1 << 40, 500), rng.integers(0, 1 << 40, 500)
    for bits in (3, 8, 10, 16, 17):
        for chunk in (7, of):
            got = [op7_substrings.undealt([r], bits) for b in op7_substrings.dealt(h, more, at, doc, bits, chunk) for r in b.to_pylist()]
            back = sorted(zip(*(np.concatenate(x).tolist() for x in zip(*got, strict=True)), strict=True))
            assert back == sorted(zip(h.tolist(), more.tolist(), at.tolist(), doc.tolist(), (of if chunk is of else np.full(500, 7)).tolist(), strict=True))


def test_decontamination(spark, odd, empty, sf, monkeypatch):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.choice([0, 1, 2, 3, 9, 10, 11, 40]))) for i in range(25)] + [(30, None), (None, prose(rng, 15))]
    items += [(31, items[7][1]), (31, items[8][1])]
    texts = [" ".join(rng.choice([prose(rng, 30), rng.choice(items)[1] or "", "Alpha1, BETA2!"]) for _ in range(4)) for _ in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(((i, *brute.contaminated(t, [x for x in items if x[0] is not None])) for i, t in enumerate(texts)), key=repr)
    extra = {i: brute.contaminated(t, items)[1] for i, t in enumerate(texts)}
    for block in (1 << 18, 20):
        monkeypatch.setattr(op8_decontaminate, "BLOCK", block)
        got = op8_decontaminate.contamination(df, bench).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["items"]) for r in got), key=repr) == [(i, n, ids) for i, n, _, ids in want]
        assert {r["doc_id"]: r["n_hit"] for r in got} == extra
    assert op8_decontaminate.contamination(odd, bench).count() == odd.count()
    assert op8_decontaminate.contamination(empty, bench).count() == 0
    assert op8_decontaminate.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_merge_dropout(spark, odd, empty, sf):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plain = op9_dropout.encode(docs, PIECES, rate=0.0)
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == model.encode(r["text"]) for r in plain.collect())
    for df in (docs, odd, empty):
        out = op9_dropout.decode(op9_dropout.encode(df, PIECES, rate=0.3), PIECES)
        assert out.where("NOT (decoded <=> text)").count() == 0 and out.count() == df.count()
    again = [rows(op9_dropout.encode(docs, PIECES, seed=s), "doc_id", "ids") for s in (1, 1, 2)]
    assert again[0] == again[1] != again[2]


def naive_agenda(piece, model, skipped):
    """Symbols by looking at all neighbours again after each merge; skipped is asked once for a span and its middle."""
    parts, asked = [(c, k, k + 1) for k, c in enumerate(piece.replace(op9_dropout.SPACE, "\n").replace(" ", op9_dropout.SPACE))], {}
    while True:
        able = []
        for x, y in zip(parts, parts[1:], strict=False):
            if (rank := model.ranks.get(x[0] + y[0])) is not None and not asked.get((x[1], x[2], y[2])):
                able.append((rank, x[1], x, y))
        if not able:
            return [p for p, _, _ in parts]
        _, _, x, y = min(able)
        if skipped(x[1], x[2], y[2]):
            asked[x[1], x[2], y[2]] = True
            continue
        at = parts.index(x)
        parts[at : at + 2] = [(x[0] + y[0], x[1], y[2])]


def test_agenda_equals_a_naive_one(monkeypatch):
    """Ids for ids, through the tree, at several rates; short and long pieces, characters outside the vocabulary."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abenorst é▁語\U0001f600\n  ") for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    texts += ["the internationalization of  communications", "ab" * 60, "\n \n"]
    for rate in (0.0, 0.2, 0.8):
        tree = op9_dropout.Tree(PIECES, 7, rate)
        got = tree.encode_all(list(range(len(texts))), texts)
        for i, (text, ids) in enumerate(zip(texts, got, strict=True)):
            key, want = op9_dropout.xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 7), []
            for n, piece in enumerate(op9_dropout._CUT.findall(" " + text)):
                salt = int(textbatch.mix64(np.array([key + n & op9_dropout._ALL], np.uint64))[0]) + tree.hashed(piece) & op9_dropout._ALL
                want += [tree.model.byte_ids[10]] if piece == "\n" else tree.model.codes(naive_agenda(piece, tree.model, tree.skips(salt)))
            assert np.frombuffer(ids, "<u4").tolist() == want
    for piece in (1, 9, textbatch.PIECE):
        monkeypatch.setattr(textbatch, "PIECE", piece)
        assert [tree.encode(i, t) for i, t in enumerate(texts)] == got
    assert max(map(len, tree.roots)) <= op9_dropout.SHORT


def test_line_rules(spark, odd, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    made = spark.createDataFrame([(1, "Good words here, friend.\n" * 3 + prose(random.Random(1), 60) + "."), (2, prose(random.Random(2), 55) + ".\n" + prose(random.Random(3), 90).replace(" ", " | ")), (3, "one two three " * 40)], "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for df in (docs.where("length(text) < 4000"), odd.select("doc_id", "text"), made, empty.select("doc_id", "text")):
        got = op10_lines.clean_lines(df).collect()
        assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted((brute.base_rules(t) for _, t in df.collect()), key=repr)
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in op10_lines.clean_lines(made).collect()}
    assert kept == {1: (False, True), 2: (False, False), 3: (True, False)}


def test_pieces_give_the_same_words_and_sums(monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab \n,") for _ in range(n)) for n in (0, 1, 500, 3, 0)] + ["x" * 700 + " y " + "z" * 64]
    buf, offsets = textbatch.text_bytes(__import__("pyarrow").array(texts))
    w = textbatch.Words(buf, offsets, textbatch.PLAIN)
    want = w.hashes(), w.hashes(textbatch.BYTE_BASE_2), textbatch.sums(buf == 0x61, offsets)
    assert want[2].tolist() == [t.count("a") for t in texts] and w.counts.tolist() == [len(brute.words(t)) for t in texts]
    for piece in (1, 17, 64):
        monkeypatch.setattr(textbatch, "PIECE", piece)
        got = w.hashes(), w.hashes(textbatch.BYTE_BASE_2), textbatch.sums(buf == 0x61, offsets)
        assert all((a == b).all() for a, b in zip(want, got, strict=True))
        assert [x for part in textbatch.word_lists(buf.tobytes()) for x in part] == buf.tobytes().split()


def test_slices_and_lookups():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"])], names=["text"])
    assert [b.num_rows for b in textbatch.slices(iter([batch]), limit=12)] == [2, 1, 2]
    assert textbatch.repeated(np.array([3, 1, 3, 2, 1, 9], np.uint64)).tolist() == [True, True, True, False, True, False]


def test_crc_is_of_little_endian_ids(spark):
    df = spark.createDataFrame([(0, "the cat")], "doc_id long, text string")
    r = op1_rans.read_documents(spark, op1_rans.encode_documents(df, BPE, 2)).select("ids", F.crc32("ids").alias("c")).first()
    assert r["c"] == zlib.crc32(bytes(r["ids"]))


def test_places_of_many_files(spark, monkeypatch):
    sizes = [random.Random(i).randrange(1, 50) for i in range(60)]
    blocks = spark.createDataFrame([(i // 2 * 3, n) for i, n in enumerate(sizes)], "file long, n long")
    want, before = {}, 0
    for file in range(30):
        want[file * 3] = before
        before += sizes[2 * file] + sizes[2 * file + 1]
    for group in (op1_rans.GROUP, 7, 1):
        monkeypatch.setattr(op1_rans, "GROUP", group)
        assert dict(op1_rans._bases(blocks).collect()) == want


def test_token_words_in_pieces_and_long_words(monkeypatch):
    model, words = Tokenizer.from_file(BPE), op1_rans.WordTokens(BPE)
    text = " ".join(["Alpha,", "don't", "x" * 90, "beta\n\n", "日本語"] * 40)
    want = np.array(model.encode(text, add_special_tokens=False).ids, words.kind).tobytes()
    for piece in (textbatch.PIECE, 50, 1):
        monkeypatch.setattr(textbatch, "PIECE", piece)
        assert words.encode(text) == want
    assert max(map(len, words)) <= op1_rans.LONG
    with pytest.raises(ValueError, match="different ids"):
        op1_rans.Frequencies(dict.fromkeys(range((1 << op1_rans.SCALE) + 1), 1))
