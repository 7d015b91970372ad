"""Words that collide under sums over their bytes, forced collisions, scores by brute force, and recall figures."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from datagauge.llm import bloom_lm, chunktable, langid, minhash, pieces, quality, store, textkernel, wavelet

from .test_llm import brute_components, by_id, codecs, words


def morse(n):
    """The Thue-Morse word of n letters and its complement."""
    bits = np.array([bin(i).count("1") & 1 for i in range(n)])
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="module")
def rows():
    out = []
    for n in (1024, 4096, 65536):
        one, two = morse(n)
        filler = " ".join(f"w{n}x{i}" for i in range(60))
        out += [(len(out), f"{one} {filler}"), (len(out) + 1, f"{two} {filler}"), (len(out) + 2, one), (len(out) + 3, two), (len(out) + 4, f"{one}\n{two}\n{one} tail {filler}")]
    return [(i, t, "en", "s", len(t)) for i, t in out]


@pytest.fixture(scope="module")
def data(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("morse"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_hashes_tell_complements_apart():
    for n in (8, 16, 64, 65, 1024, 65536):
        data = np.frombuffer("".join(morse(n)).encode(), np.uint8)
        s = np.array([0, n])
        h = textkernel.hashes(data, s, s + n)
        assert h[0] != h[1] and (textkernel.hashes(data[n:], s[:1], s[:1] + n) == h[1]).all()
    data = np.frombuffer(b"Abc abc\x00 abc", np.uint8)
    s, e = np.array([0, 4, 9, 0]), np.array([3, 8, 12, 0])
    low, raw = textkernel.hashes(data, s, e), textkernel.hashes(data, s, e, lower=False)
    assert low[0] == low[2] != low[1] and raw[0] != raw[2] and raw[2] == low[2] and len(set(low.tolist())) == 3


def test_libraries_agree(spark, data, rows):
    word, piece = codecs()
    ids3, ids8 = by_id(wavelet.op3_wavelet_ids(spark, data)), by_id(pieces.op8_sentencepiece(spark, data))
    for r in rows:
        a = np.array([*word.encode(r[1], add_special_tokens=False).ids, 2], "<u4")
        assert ids3[r[0]]["ids_crc32"] == zlib.crc32(a.tobytes())
        b = [1, *piece.encode(r[1]), 2]
        assert ids8[r[0]]["ids_sha256"] == hashlib.sha256(np.array(b, "<u4").tobytes()).hexdigest() and ids8[r[0]]["decoded_sha256"] == hashlib.sha256(piece.decode(b).encode()).hexdigest()


def test_counts_and_sets_agree(spark, data, rows):
    got = by_id(bloom_lm.op2_bloom_lm(spark, data))
    counts = collections.Counter(w for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1 for w in [*words(r[1]), "\n"])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        text = [*words(r[1]), "\n"]
        assert got[r[0]]["n_known"] == sum(counts[w] > 0 for w in text) and got[r[0]]["train_tokens"] == n
        assert math.isclose(got[r[0]]["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in text), rel_tol=1e-9)
    sets, root = brute_components(rows)
    linked = by_id(minhash.op9_minhash_tensor(spark, data))
    assert {i: (linked[i]["n_shingles"], linked[i]["component_id"]) for i in sets} == {i: (len(sets[i]), root[i]) for i in sets}
    base = by_id(quality.op5_quality_llr(spark, data))
    assert [base[r[0]]["n_dup_lines"] for r in rows] == [0] * len(rows)



@pytest.mark.parametrize("codec", [pieces.load, wavelet.load])
def test_forced_collisions(monkeypatch, codec):
    real = textkernel.hashes
    monkeypatch.setattr(textkernel, "hashes", lambda *a, **k: real(*a, **k) & np.uint64(3))
    word, piece = codecs()
    fresh = type(codec())(__import__("public_tokenizers").path(pieces.MODEL if codec is pieces.load else wavelet.TOKENIZER))
    texts = ["one two three <|x|> One", "two\nthree  four " + "long" * 40, "", "three <|X|> one " + "long" * 41]
    for _ in range(2):
        data, at = textkernel.raw(pa.array(texts))
        ids, bounds = fresh.encode(data, at)
        for k, t in enumerate(texts):
            want = [1, *piece.encode(t), 2] if codec is pieces.load else [*word.encode(t, add_special_tokens=False).ids, 2]
            assert ids[bounds[k] : bounds[k + 1]].tolist() == want


def test_table_starts_anew():
    calls = []

    def encode(chunks, kinds):
        calls.append(len(chunks))
        parts = [np.frombuffer(c, np.uint8).astype(np.int32) + 1000 * k for c, k in zip(chunks, kinds, strict=True)]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    table = chunktable.ChunkTable(encode, entries=2)
    data = np.frombuffer(b"abcabcab", np.uint8)
    s, e = np.array([0, 3, 6, 0]), np.array([3, 6, 8, 3])
    h = textkernel.hashes(data, s, e)
    for _ in range(3):
        ids, n = table.ids(data, s, e, h, np.array([0, 0, 0, 1]))
        assert ids.tolist() == [97, 98, 99, 97, 98, 99, 97, 98, 1097, 1098, 1099] and n.tolist() == [3, 3, 2, 3]
    assert calls[0] >= 2 and len(calls) > 3


def test_score_by_brute_force(spark):
    """With so many bits that no probe is false, the score is that of the quantised counts."""
    texts = {i: t for i, t in enumerate(["a b a b c", "a b d", "c c c c a b", "", None, "x y", "B a b q"])}
    rows = [(i, t) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = bloom_lm.BloomModel.fit(docs.where("doc_id < 5"), bits=256.0)
    got = {r["doc_id"]: r["score"] for r in bloom_lm.score(docs, model, ["doc_id"]).collect()}
    train = [["<s>", *words(texts[i]), "</s>"] for i in range(5)]
    one, two = collections.Counter(w for d in train for w in d), collections.Counter(p for d in train for p in zip(d, d[1:], strict=False))
    real = {w: c for w, c in one.items() if w != "<s>"}
    q = lambda c: bloom_lm.MEANS[bloom_lm.levels(np.array([c]))[0]]
    tokens = sum(real.values())
    unknown = min(max(sum(c == 1 for c in real.values()) / tokens, 0.5 / (tokens + 1)), 0.5)
    mass = sum(c / max(q(c), 1) * q(c) for c in one.values())  # tokens by level, times the level's mean over it
    k = model.kappa[0]
    # k: the chance of a pair that is new after a context is that of the pairs seen once.
    share = sum(c == 1 for c in two.values()) / sum(two.values())
    assert math.isclose(sum(c * k / (q(c) + k) for c in one.values()), share * sum(one.values()), rel_tol=1e-6)
    for i, t in texts.items():
        total, before = 0.0, "<s>"
        for w in [*words(t), "</s>"]:
            p = (1 - unknown) * q(one[w]) / mass if one[w] else unknown
            if one[before]:
                p = (min(q(two[before, w]), q(one[before])) + k * p) / (q(one[before]) + k)
            total += math.log10(p)
            before = w
        assert math.isclose(got[i], total, rel_tol=1e-9, abs_tol=1e-9), i


def test_counts_read_back(spark):
    """N-grams that were put in are read at their level or above, the others mostly at none."""
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    counts = rng.geometric(0.3, len(keys)).astype(np.uint32)
    table = pa.table({"bucket": pa.array([0], pa.int32()), "order": pa.array([1], pa.int32()), "keys": [keys.tobytes()], "counts": [counts.tobytes()]})
    built = bloom_lm._builder(1, bloom_lm.BITS)(table)
    read = bloom_lm.Filter([built["segment"][0].as_py()]).levels(keys, 1)
    want = bloom_lm.levels(counts)
    assert (read >= want).all() and (read == want).mean() > 0.95
    assert (bloom_lm.Filter([built["segment"][0].as_py()]).levels(keys + np.uint64(1 << 30), 1) > 0).mean() < 0.04


def test_quality_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    good, bad = [f"good{i}" for i in range(30)], [f"junk{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(good if i < 150 else bad, 60)), 1 if i < 150 else 0) for i in range(200)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, quality int").select("doc_id", "text"), spark.createDataFrame(rows, "doc_id long, text string, quality int").select("doc_id", "quality")
    got = by_id(quality.score(docs, quality.QualityModel.fit(docs, labels)))
    half = {r["doc_id"]: r["h"] for r in docs.select("doc_id", (F.xxhash64("doc_id", F.lit(11)) % 2 == 0).alias("h")).collect()}

    def grams(text):
        data, at = textkernel.raw(pa.array([text]))
        s, e, b = textkernel.spans(data, at)
        h = textkernel.hashes(data, s, e, lower=False)
        one, two, _, _ = quality.ngram_buckets(h, b)
        assert len(one) == len(text.split()) and len(two) == max(0, len(one) - 1)
        return one.tolist() + two.tolist()

    raw = collections.Counter(g for _, t, _ in rows for g in grams(t))
    target = collections.Counter(g for i, t, k in rows if k and half[i] for g in grams(t))
    n, m, b = sum(raw.values()), sum(target.values()), quality.BUCKETS
    llr = {i: np.mean([math.log((target[g] + 0.5) / (m + 0.5 * b)) - math.log((raw[g] + 0.5) / (n + 0.5 * b)) for g in grams(t)]) for i, t, _ in rows}
    assert all(math.isclose(got[i]["llr"], llr[i], rel_tol=1e-9, abs_tol=1e-9) for i in llr)
    seen = sorted(llr[i] for i, _, k in rows if k and not half[i])
    width = 2 * quality.REACH / quality.BINS
    cut = math.floor((seen[int(quality.LOSS * len(seen))] + quality.REACH) / width) * width - quality.REACH
    assert {i: r["kept"] for i, r in got.items()} == {i: not got[i]["base_failed"] and v >= cut for i, v in llr.items()}
    assert not any(got[i]["kept"] for i in range(150, 200))


def test_ids_with_several_texts(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(5, text("a")), (5, text("b")), (2, text("a")), (3, text("b") + " more"), (9, text("c")), (9, text("c")), (9, text("d")), (7, text("d")), (1, text("e")), (5, None)]
    got = collections.defaultdict(set)
    for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert {k: {c for c, _ in v} for k, v in got.items()} == {5: {2, 5}, 2: {2}, 3: {2}, 9: {7}, 7: {7}, 1: {1}}  # the empty row of 5 is its own
    assert sum(len(v) for v in got.values()) == 7


def test_sketches_of_long_sets():
    rng = np.random.default_rng(1)
    for n in (300, 30_000, 150_000):
        sets = [np.sort(rng.integers(0, 1 << 52, n).astype(np.uint64)) for _ in range(2)]
        m = minhash.minhashes(np.concatenate(sets), np.array([0, n, 2 * n]))
        sketch = (textkernel.mix(m) >> np.uint64(48)).astype(np.uint16)
        assert (sketch[0] == sketch[1]).mean() < 0.05


@pytest.mark.parametrize("alike, least", [(0.80, 0.99), (0.85, 0.995), (0.95, 0.999)])
def test_recall_of_keys(alike, least):
    """Pairs of sets at a similarity share a half-key in either collection."""
    rng = np.random.default_rng(3)
    shared, own, n = round(600 * alike), round(600 * (1 - alike) / 2), 400
    values, before = [], [0]
    for _ in range(n):
        both = rng.integers(0, 1 << 52, shared)
        for _ in range(2):
            values.append(np.sort(np.concatenate((both, rng.integers(0, 1 << 52, own)))).astype(np.uint64))
            before.append(before[-1] + len(values[-1]))
    keys = minhash.half_keys(minhash.minhashes(np.concatenate(values), np.array(before)))
    a, b = keys[::2], keys[1::2]
    hit = lambda lo: (a[:, lo : lo + minhash.HALVES] == b[:, lo : lo + minhash.HALVES]).any(axis=1)
    assert (hit(0) & hit(minhash.HALVES)).mean() >= least


def test_long_texts_link(spark):
    """Long near copies are found in the second round too: a chain whose ends are not alike, beside a larger class."""
    base = [f"w{i}" for i in range(9000)]
    change = lambda lo, hi: " ".join([*base[:lo], *(f"n{lo}x{i}" for i in range(lo, hi)), *base[hi:]])
    rows = [(0, change(0, 0)), (1, change(0, 900)), (2, change(8100, 9000)), (3, " ".join(reversed(base))), (4, change(0, 900) + " end"), (6, "x " * 20_000)]
    sets, root = brute_components([(i, t) for i, t in rows])
    got = by_id(minhash.link(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: got[i]["component_id"] for i in root} == root and got[2]["component_id"] == got[4]["component_id"] == 0


def test_four_languages_in_a_text():
    langs, rng = "abcdef", np.random.default_rng(2)
    vocabulary = {x: ["".join(rng.choice(list(x + x.upper() + "xyz" + chr(103 + i)), 6)) for _ in range(60)] for i, x in enumerate(langs)}
    text = lambda x, n: " ".join(rng.choice(vocabulary[x], n))
    counts = []
    for x in langs:
        data, at = textkernel.raw(pa.array([text(x, 4000)]))
        counts.append(np.bincount(langid.trigrams(data, at)[1], minlength=langid.BUCKETS))
    table = np.array([np.log((c + langid.SMOOTH) / (c.sum() + langid.SMOOTH * langid.BUCKETS)) for c in counts], np.float32)
    mixed = [" ".join(text(x, n) for x, n in parts) for parts in ([("a", 400)], [("a", 240), ("b", 160), ("c", 120), ("d", 80)], [("e", 200), ("f", 200)], [("b", 160)] + [(x, 80) for x in "cdef"])]
    data, at = textkernel.raw(pa.array([*mixed, "", " ".join([mixed[1]] * 40)]))
    pred, score, shares = langid.infer(table, data, at)
    assert [set(np.flatnonzero(s > 0.01).tolist()) for s in shares[:4]] == [{0}, {0, 1, 2, 3}, {4, 5}, {1, 2, 3, 4, 5}]
    assert np.allclose(shares[1][:4], [0.4, 0.8 / 3, 0.2, 0.4 / 3], atol=0.03) and pred[:2].tolist() == [0, 0] and pred[3] == 1 and pred[4] == -1
    assert np.allclose(shares[5], shares[1], atol=0.02) and pred[5] == 0  # a text forty times as long
    same = np.stack([table[0], table[0]])
    assert langid.infer(same, data, at)[0][0] == 0  # a tie goes to the first


def test_many_languages_are_an_error(spark):
    rows = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(langid.LANGUAGES + 1)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.LanguageModel.fit(rows)


def test_wavelet_select_and_equal_ids(spark):
    x = np.random.default_rng(4).integers(0, 300, 40_000)
    f = wavelet.WaveletFile(wavelet.pack([1], np.array([len(x)]), x))
    for t in (0, 7, 299):
        at = np.flatnonzero(x == t)
        assert [f.select(t, k) for k in (0, 5, len(at) - 1, len(at))] == [at[0], at[5], at[-1], -1]
    rows = [(3, f"word{i}") for i in range(50)] + [(1, "first"), (None, "none"), (9, None)]
    files = wavelet.write(spark.createDataFrame(rows, "doc_id long, text string"))
    got = wavelet.read(files, wavelet.crc32).join(wavelet.offsets(files), ["shard", "seq"]).select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, *[3] * 50, 9] and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))


def test_scopes_delete_tables(spark):
    import os

    there = lambda df: os.path.exists(df._written_to.replace("file:", "").replace("//", "/"))
    with store.scope() as keep:
        a, b = store.materialize(spark.range(3), "a"), keep(store.materialize(spark.range(4), "b"))
        with store.scope() as inner:
            c, d = inner(store.materialize(spark.range(5), "c")), store.materialize(spark.range(6), "d")
        assert there(a) and there(c) and not there(d)
    assert not there(a) and there(b) and not there(c) and b.count() == 4


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_on_nothing_and_on_odd_ids(spark, tmp_path):
    import corpus_pipeline

    for name, rows in (("none", []), ("odd", [])):
        if name == "odd":
            t = lambda w, n: " ".join(f"{w}{i % 17}" for i in range(n))
            rows = [(1, t("alpha", 60), "en", "a", 1), (1, t("alpha", 60), "en", "a", 1), (1, t("beta", 60), "en", "b", 1), (None, t("gamma", 50), "en", None, 1), (None, t("delta", 9), "en", "a", 1), (4, None, None, None, None), (5, "", "en", "a", 0)]
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert (len(out) == 0) == (name == "none") and all(r["round_trip"] for r in out)
        if name == "odd":
            assert {r["doc_id"] for r in out} <= {1, None} and len({r["source"] for r in out if r["doc_id"] == 1}) == 1
