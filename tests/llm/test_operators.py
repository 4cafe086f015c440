"""The corpus operators against brute force, on fixtures with nulls, empties, ties, repeats and clashing columns."""

import fractions
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logweave.llm import chat, decontaminate, fixity, jaccard, language, licences, nearest, packing, pages, toxicity
from logweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, n int, spare string, label string, part int"


def docs_frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, 2, "x", "y", 3) for i, t, s in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that every operator on documents must take."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    long = " ".join(word() for _ in range(30_000))
    texts = [" ".join(base), " ".join(near), " ".join(base).upper(), None, "", "   ", "one", "one two", "one two", long, long + " tail", "é ü x \x1f y", "!!! ..."]
    rows = [(i, t, ["a", None, "b"][i % 3]) for i, t in enumerate(texts)] + [(None, "no id here at all", "a"), (0, " ".join(base), "a")]
    return docs_frame(spark, rows).cache()


def sets(text, size):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_join_is_exact(spark, size, percent):
    rng, texts = random.Random(size), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    passage = [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 12, 40, 150]))] + passage * (rng.random() < 0.6)
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    docs = docs_frame(spark, [(i, t, "s") for i, t in enumerate(texts + [None, ""])])
    own = [sets(t, size) for t in texts]
    root = list(range(len(texts) + 2))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard.near_duplicates(docs, size, percent).collect()}
    assert got == {i: (find(i), len(own[i]) if i < len(own) else 0) for i in range(len(texts) + 2)}


def test_what_regions_are_sent_is_small_and_loses_no_link():
    rng = np.random.default_rng(5)
    for n in (1, 40, 127, 128, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for changed in (0, n // 10, n // 2, n):
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed + n // 7, dtype=np.uint64)]))
            x, y = (jaccard.folded(jaccard.sketch(s, fine=True), len(s)) for s in (a, b))
            assert len(x) <= max(16, len(a) // 4) and len(y) <= max(16, len(b) // 4)
            assert jaccard.least_difference(x, y) <= len(np.setxor1d(a, b))


def test_sketch_and_regions_keep_every_link():
    rng = np.random.default_rng(2)
    for percent in (80, 90):
        rings = jaccard.Rings(percent)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)]))
            if not len(b):
                continue
            shared = len(np.intersect1d(a, b))
            assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= len(a) + len(b) - 2 * shared
            if 100 * shared >= percent * (len(a) + len(b) - shared) and not np.array_equal(a, b):
                common = {r for r, _, _ in rings.regions(a)} & {r for r, _, _ in rings.regions(b)}
                found = [(np.intersect1d(x, y), max(s, t)) for r, x, s in rings.regions(a) for q, y, t in rings.regions(b) if r == q]
                assert common and any(len(x) > spare for x, spare in found)


def test_join_on_odd_rows(odd):
    got = sorted(map(tuple, jaccard.near_duplicates(odd, 3, 90).collect()), key=str)
    by_id = {r[0]: r for r in got}
    assert len(got) == odd.count() and by_id[1][2] == 0 and by_id[2][2] == 0 and by_id[8][2] == 7 and by_id[10][2] == 9
    assert by_id[3] == (3, 0, 3) and by_id[5] == (5, 0, 5) and by_id[None][2] is None
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark, odd):
    words = [f"w{i}" for i in range(60)]
    base, near, other = " ".join(words), " ".join([*words[:59], "changed"]), "an unlike text that nothing else repeats anywhere here"
    texts = [(1, base), (1, base), (1, base.upper()), (2, near), (2, other), (3, near), (3, near), (4, other + " more"), (5, None), (5, ""), (5, None), (None, base), (6, "alone"), (1, "second text of one")]
    kept = jaccard.keep_one(docs_frame(spark, [(i, t, "s") for i, t in texts]))
    got = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()), key=str)
    want = [(1, base), (2, other), (5, ""), (5, ""), (5, ""), (None, base), (6, "alone"), (1, "second text of one")]
    assert got == sorted(want, key=str) and kept.columns == odd.columns
    assert jaccard.keep_one(odd).where("doc_id = 0").count() == 1
    unlike = docs_frame(spark, [(i, f"{t} text {i}", "s") for i, t in enumerate("abc")])
    assert jaccard.keep_one(unlike).count() == 3


def test_pivots_of_first_pairs_are_sent_once(spark):
    words = [f"w{i}" for i in range(120)]
    docs = docs_frame(spark, [(i, " ".join([*words[:60], f"own{i}", *words[61:]]), "s") for i in range(400)]).repartition(8)
    members = jaccard.regions(docs, 3, 90)
    pairs = jaccard.first_pairs(members)
    assert pairs.count() == pairs.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count() >= 399
    most = members.groupBy("node").count().agg(F.max("count")).first()[0]
    assert pairs.groupBy("a").count().agg(F.max("count")).first()[0] <= most


def test_sets_that_share_a_passage_alone_do_not_meet(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"d{n}x{i}" for i in range(300)) + " " + passage for n in range(40)]
    texts.append(texts[0] + " end")
    assert jaccard.regions(docs_frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), 3, 90).select("node").distinct().count() == 2


def test_packing_cuts_every_id_once(odd):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for weights in (None, {"a": 0.7, "b": 0.2}):
        p = packing.pack(odd, weights).toPandas()
        assert (p.groupby("sequence_id")["length"].sum() <= 2048).all()
        for _, g in p.groupby("sequence_id"):
            g = g.sort_values("offset")
            assert (g["offset"].to_numpy() == np.concatenate([[0], g["length"].cumsum().to_numpy()[:-1]])).all()
        for r in odd.where("doc_id > 0").collect():
            ids = coder.encode(r["text"] or "", add_special_tokens=False).ids + [1]
            own = p[p["doc_id"] == r["doc_id"]].sort_values("start")
            assert own["length"].sum() == len(ids) and (own["doc_tokens"] == len(ids)).all()
            for piece in own.itertuples():
                assert piece.ids_crc32 == zlib.crc32(np.array(ids[piece.start : piece.start + piece.length], "<u4").tobytes())
    assert packing.pack(odd.limit(0)).count() == 0


@pytest.mark.parametrize("given", [None, [0.5, 0.3, 0.2], [0.7, 0.2, 0.0], [0.7, None, None], [1.0, None, 0.0], [0.05, 0.9, 0.05]])
def test_windows_follow_the_target_mixture(given):
    totals, window = [5000, 9000, 700], 64
    weights = None if given is None else packing.shares_of(totals, given)
    layout, rng, placed = packing.Layout(totals, weights, window), random.Random(2), {}
    for queue, total in enumerate(totals):
        first = 0
        while first < total:  # documents of the queue, in order
            n = min(total - first, rng.randint(1, 300))
            for done, length, at in layout.pieces(queue, first, n, 16):
                assert at // 16 == (at + length - 1) // 16
                placed |= {at + i: (queue, first + done + i) for i in range(length)}
            first += n
    assert sorted(placed) == list(range(sum(totals)))
    for queue, total in enumerate(totals):
        assert [placed[at][1] for at in sorted(placed) if placed[at][0] == queue] == list(range(total))
    # turn by turn: each live queue's credit grows by its share, what a window gives is taken off, and nobody is ever a token off
    shares = [n / sum(totals) for n in totals] if weights is None else weights
    live = [i for i in range(3) if shares[i] > 0]
    dry, credit = min(totals[i] / shares[i] for i in live) * sum(shares[i] for i in live), [0.0] * 3
    for start in range(0, int(dry) - window, window):
        gave = [sum(placed[at][0] == i for at in range(start, start + window)) for i in range(3)]
        credit = [c + window * (shares[i] / sum(shares[j] for j in live) if i in live else 0) - gave[i] for i, c in enumerate(credit)]
        assert all(abs(c) < 1.5 for c in credit)
    last = {i: max(at for at in placed if placed[at][0] == i) for i in range(3)}
    for i in set(range(3)) - set(live):
        assert min(at for at in placed if placed[at][0] == i) > max(last[j] for j in live)


def test_packed_weights_and_many_sources(spark):
    rows = [(i, "word " * 40, f"s{i % 7}", "en", 0, 1, 2, "x", "y", 3) for i in range(300)]
    docs = spark.createDataFrame([(i, t, la, s, *r) for i, t, s, la, *r in rows], SCHEMA)
    p = packing.pack(docs, {"s0": 0.5, "s1": 0.3, "s6": 0.0, "none": 0.1}, sequence=64, window_sequences=4, max_queues=3).toPandas()
    assert p["length"].sum() == p.drop_duplicates("doc_id")["doc_tokens"].sum() and p["doc_id"].nunique() == 300
    early = p[p["sequence_id"] < 16].groupby("source")["length"].sum()
    assert abs(early["s0"] / early["s1"] - 5 / 3) < 0.05 and "s6" not in early and early.drop(["s0", "s1"]).sum() > 0


def test_decontamination_equals_brute_force(spark, odd):
    rows = [(1, " ".join(odd.where("doc_id = 0").first()["text"].split()[20:50])), (2, "one two"), (3, None), (4, ""), (5, "never seen words in this place"), (None, "no id here at all")]
    items = spark.createDataFrame(rows, "item_id long, text string")

    def shingles(text, k):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for d in odd.collect():
        for i, t in rows:
            k = min(5, len(re.findall(r"[^\W_]+", (t or "").lower())))
            item = shingles(t, k) if k else set()
            shared = len(item & shingles(d["text"], k)) if item else 0
            if item and 100 * shared >= 80 * len(item):
                want.add((d["doc_id"], i, len(item), shared))
    assert set(map(tuple, decontaminate.find_leaks(odd, items).collect())) == want
    assert odd.count() - decontaminate.clean(odd, items).count() >= 3
    assert decontaminate.find_leaks(odd, items.limit(0)).count() == 0


def test_nearest_finds_the_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(10, 16))[rng.integers(0, 10, 1500)] + rng.normal(size=(1500, 16)) * 0.4
    x[7:20] = x[6]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [1.0] * 3), (None, [1.0] * 16)]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>")
    got = nearest.search(vectors, vectors.where("id % 10 = 0")).toPandas()
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q, g in got.groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        hits += len(set(want) & set(g["vec_id"]))
        assert np.allclose(g["score"], s[g["vec_id"]]) and list(g.sort_values("rank")["rank"]) == [1, 2, 3, 4, 5]
    assert got["query_id"].nunique() == 150 and hits >= 0.9 * 750
    assert got[got["query_id"] == 10].sort_values("rank")["vec_id"].tolist() == [6, 7, 8, 9, 11]
    assert nearest.search(vectors.limit(0), vectors).count() == 0
    short = spark.createDataFrame([*rows, (3000, [2.0, 2.0, 2.0]), (3010, [1.0, 0.0, 1.0])], "id long, vec array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in nearest.search(short, short.where("id = 3010")).orderBy("rank").collect()] == [(3010, 2004), (3010, 3000)]


def test_ties_are_cut_by_id():
    ids, score = [[7], [2, 9], [1, 8], [4], [3, 5, 6]], np.array([0.5, 0.9, 0.9, 0.9, 0.2])
    firsts = np.array([v[0] for v in ids])
    assert [v for v, _ in nearest.best_of(score, firsts, ids, 1, 3, -2.0)] == [2, 4, 8]
    assert [v for v, _ in nearest.best_of(score, firsts, ids, 0, 9, -2.0)] == [1, 2, 4, 8, 9, 7, 3, 5, 6]
    assert nearest.best_of(score, firsts, ids, 0, 3, 0.95) == []


def test_nearest_query_on_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = nearest.unit(table["embedding"].tolist())
    got, hits = QUERIES["op1_nearest_neighbours"](spark, d).toPandas(), 0
    for q, g in got.groupby("query_id"):
        s = x @ x[int(np.flatnonzero(table["vec_id"] == q)[0])]
        want = [v for v in table["vec_id"].to_numpy()[np.lexsort((table["vec_id"], -np.round(s, 12)))] if v != q][:5]
        hits += len(set(want) & set(g["vec_id"]))
    asked = (table["vec_id"] % 50 == 0).sum()
    assert got["query_id"].nunique() == asked and len(got) == 5 * asked and hits >= 0.9 * len(got)


def test_models_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (6, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    assert toxicity.clean(odd, labels).columns == odd.columns
    assert toxicity.fit(odd, labels.limit(0)) is None and toxicity.fit(odd.limit(0), labels) is None
    model = toxicity.Model(np.random.default_rng(3).normal(size=toxicity.CLASSES**3 + 1).astype(np.float32), 1.0, 0.0)
    scores = odd.select("doc_id", toxicity.scored(spark, model, F.col("text")).alias("score")).collect()
    assert len(scores) == odd.count() and all(r["score"] == 0 for r in scores if r["doc_id"] in (3, 4, 5, 12)) and all(0 <= r["score"] <= 1 for r in scores)
    assert len({r["score"] for r in scores if r["doc_id"] in (7, 8)}) == 1 and len({r["score"] for r in scores if r["doc_id"] == 0}) == 1
    out = odd.select("doc_id", language.predicted(spark, language.fit(language.training_rows(odd)), F.col("text")).alias("p")).select("doc_id", "p.*").collect()
    assert {r["lang_pred"] for r in out if r["doc_id"] in (3, 4, 5, 12)} == {"und"} and {r["lang_pred"] for r in out if r["doc_id"] in (0, 9)} == {"en"}
    assert language.identified(odd.limit(0)).count() == 0


def test_stage_rejects_what_the_operator_calls_toxic(spark, odd, monkeypatch):
    model = toxicity.Model(np.zeros(toxicity.CLASSES**3 + 1, np.float32), 1.0, float(np.log(0.4 / 0.6)))  # 0.4 for every text with a window
    monkeypatch.setattr(toxicity, "fit", lambda *_: model)
    labels = spark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    scores = odd.select("doc_id", toxicity.scored(spark, model, F.col("text")).alias("score")).collect()
    kept = [r["doc_id"] for r in toxicity.clean(odd, labels).collect()]
    assert sorted(map(str, kept)) == sorted(str(r["doc_id"]) for r in scores if r["score"] < toxicity.THRESHOLD) and 3 in kept and 0 not in kept


def test_held_out_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").where("held_out and lang_pred <> 'und'").join(docs, "doc_id").toPandas()
    assert (found["lang"] == found["lang_pred"]).mean() > 0.97
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    found = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").toPandas()
    hits = ((found["predicted"] == 1) & (found["toxic"] == 1)).sum()
    assert hits >= 0.6 * found["toxic"].sum() and hits >= 0.7 * found["predicted"].sum()


def test_forward_sums_all_segmentations():
    path = public_tokenizers.path(language.VOCABULARY)
    lattice = language.Lattice.at(path)
    chances = np.random.default_rng(0).random((len(lattice.pieces), 2))
    known = dict(zip(lattice.pieces, chances))

    def whole(word):
        """Over all segmentations, by the last piece; kept as logarithms of exact fractions' floats for words of any length."""
        sums = [[fractions.Fraction(1)] * 2]
        for end in range(1, len(word) + 1):
            ways = [(start, known.get(word[start:end], [language.UNKNOWN] * 2 if start == end - 1 else None)) for start in range(end)]
            sums.append([sum((sums[s][k] * fractions.Fraction(float(c[k])) for s, c in ways if c is not None), fractions.Fraction(0)) for k in (0, 1)])
        return [math.log(x.numerator) - math.log(x.denominator) for x in sums[-1]]

    words = ["▁the", "▁house", "▁größe", "▁q", "▁internationalization", "▁" + "überhaupt" * 6, "▁" + "漢" * 50]
    model = language.Model(path, ["a", "b"], np.log([0.3, 0.7]), chances)
    assert np.allclose(lattice.log_chances(words[:5], model.chances), [whole(w) for w in words[:5]])
    assert all(np.allclose(lattice.log_chance(w, model.chances), whole(w)) for w in words)
    texts = ["The house, 12 größe q!", "überhaupt" * 6 + " internationalization", "漢" * 50, "", None, "12 !"]
    for text, (lang, score) in zip(texts, model.predict(texts)):
        runs = re.findall(r"[^\W\d_]+", (text or "").lower())
        logs = np.log([0.3, 0.7]) + sum((np.array(whole("▁" + r)) for r in runs), np.zeros(2))
        assert (lang, score) == ("und", 0.0) if not runs else lang == "ab"[int(logs.argmax())] and abs(score - 1 / np.exp(logs - logs.max()).sum()) < 1e-6


def subsequences(window):
    """Every subsequence of three classes with less than SPAN characters from first to last, with its summed weight."""
    out, squares = {}, 0.0
    for i, j, k in itertools.combinations(range(len(window)), 3):
        if k - i < toxicity.SPAN:
            w = toxicity.DECAY ** (k - i + 1)
            key = (window[i] << 12) | (window[j] << 6) | window[k]
            out[key], squares = out.get(key, 0.0) + w, squares + w * w
    return {key: w / squares**0.5 for key, w in out.items()}


def test_kernel_equals_enumerated_subsequences():
    windows, landmarks = [toxicity.encoded(w) for w in ("idiot", "id-iot", "i d i o t", "xidixotx", "house", "é9")], [toxicity.encoded(w) for w in ("idiot", "haus")]
    across, kept, own = toxicity.kernel(windows, landmarks)
    brute = [[sum(w * subsequences(b).get(key, 0.0) for key, w in subsequences(a).items()) for b in landmarks] for a in windows]
    assert np.allclose(across, brute, atol=1e-5)
    assert across[0, 0] > across[1, 0] > across[2, 0] > across[4, 0] and across[3, 0] > across[4, 0]
    table = np.zeros(toxicity.CLASSES**3, np.float32)
    table[kept] = np.array([0.5, -0.25]) @ own
    text = toxicity.Windows(["idiot"])
    assert np.allclose(text.margins(table)[0], across[:1] @ [0.5, -0.25], atol=1e-5)


@pytest.mark.parametrize("block", [40, 1 << 17])
def test_sums_along_a_text_equal_enumerated_windows(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    table = np.random.default_rng(1).normal(size=toxicity.CLASSES**3).astype(np.float32)
    texts = ["You st up id, i d i o t x!", "", "!!", "a" * 90, "Ünd \U0001f600 i-d-i-o-t b c d 1 2 e", "one"]
    own = toxicity.Windows(texts)
    for kind, values in enumerate(own.margins(table)):
        for i, value in enumerate(values):
            assert abs(sum(w * table[key] for key, w in subsequences(own.cut(kind, i)).items()) - value) < 1e-4
    words = {(own.kinds[0][2][i], own.cut(0, i)) for i in range(len(own.kinds[0][0]))}
    assert {(0, toxicity.encoded("st")), (5, toxicity.encoded("one"))} <= words and not any(t in (1, 2, 3) for t, _ in words)


def cuts(text):
    own = toxicity.Windows([text])
    return {own.cut(k, i) for k, (starts, _, _) in enumerate(own.kinds) for i in range(len(starts))}


def test_gapped_words_are_one_window():
    for text, window in (("you st up id", "st up id"), ("an i d iot there", "i d iot"), ("sc um", "sc um"), ("so I - d - i - o - t", "idiot"), ("plain words", "plain words")):
        assert toxicity.encoded(window) in cuts(text)
    coded = lambda words: [toxicity.encoded(w) for w in words]
    toxic, clean = coded(["stupid", "idiot", "scum"] * 5), coded(["house", "garden", "school", "number", "the", "and", "water", "plan of", "in it"] * 3)
    table = toxicity.fit_machine(toxic, clean, coded(["stupid", "idiot", "scum", "house", "water"]))
    model = toxicity.Model(table, 1.0, 0.0)
    gapped, inserted, plain = model.worst(["the st up id house", "the idxixot", "the water in a garden"])
    assert gapped > max(plain, *model.worst(["the", "st", "up", "id", "house"])) and inserted > plain


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    cols = sorted(theirs.columns)
    plain = lambda df: sorted(repr(tuple(None if pd.isna(v) else v for v in r)) for r in df[cols].astype(object).itertuples(index=False, name=None))
    assert sorted(ours.columns) == cols and plain(ours) == plain(theirs)


def test_chat_cases(spark):
    schema = "pair_id long, turn long, role string, text string, part string"
    chosen = [(1, 0, "user", "q", ""), (1, 1, "assistant", "good", ""), (2, 0, "user", "same", ""), (2, None, None, None, ""), (None, 0, "user", "x", ""), (3, 0, "user", "only", ""), (3, 0, "user", "only", "")]
    other = [(1, 0, "user", "q", ""), (1, 1, "assistant", "bad", ""), (1, 2, "user", "more", ""), (2, 0, "user", "same", ""), (2, None, None, None, "")]
    got = chat.preference_segments(spark.createDataFrame(chosen, schema), spark.createDataFrame(other, schema)).collect()
    seen = {(r["pair_id"], r["part"], r["turn"]): (r["start"], r["loss"]) for r in got}
    first = len("<|assistant|>\nbad\n<|end|>\n")
    assert seen == {(1, "prompt", 0): (0, 0), (1, "chosen", 1): (0, 1), (1, "rejected", 1): (0, 1), (1, "rejected", 2): (first, 0), (2, "prompt", 0): (0, 0), (2, "prompt", None): (len("<|user|>\nsame\n<|end|>\n"), 0), (3, "chosen", 0): (0, 0)}
    assert chat.preference_segments(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0


def test_fixity_finds_what_changed(spark):
    rows = [("f", i * 5000, 5000, f"{i:064x}") for i in range(400)] + [("g", 0, 10, "a" * 64), ("g", 0, 10, "a" * 64)]
    schema = "file string, offset long, length long, hash string"
    other = [r if r[1] != 35_000 else (*r[:3], "b" * 64) for r in rows if r[1] != 1_000_000] + [("h", 5, 1, "c" * 64)]
    found = fixity.audit(spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)).collect()
    assert {(r["file"], r["offset"], r["finding"]) for r in found} == {("f", 35_000, "changed"), ("f", 1_000_000, "missing"), ("h", 5, "unexpected")}
    assert fixity.audit(spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema)).count() == 0
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>"), (2, "u", "é")], "page_id long, url string, html string")
    placed = sorted(map(tuple, fixity.placed(odd).where("page_id = 1").select("offset", "length").collect()))
    assert fixity.placed(odd).count() == 4 and placed == [(0, placed[0][1]), (placed[0][1], placed[0][1])]


def test_licence_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n{}The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.\n"
    texts = [mit.format(""), mit.format("x.\n" * 20), "Licensed under CC BY-NC 4.0.\nReleased under the MIT License. Released under the MIT License.", None, "", "licensed by me"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["licence"], r["statements"], r["first_sentence"]) for r in licences.scan(docs).collect()}
    assert got == {(0, "MIT", 1, 0), (2, "CC-BY-NC-4.0", 1, 0), (2, "MIT", 2, 1)}


def test_licences_in_wrapped_texts(spark):
    mit = """MIT License

Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
    gpl = """
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
    apache = """
   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\n  License, v. 2.0. If a copy of the MPL was not distributed with this\n  file, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
    commented = "".join(f" * {line}\r\n" for line in gpl.strip().splitlines())
    parted = ["All rights\n\nreserved.", "All rights.\nReserved", "All rights\n- reserved", "All rights\n \t\nreserved", "All rights\r\n\r\nreserved"]
    texts = [mit, gpl, apache, bsd, mpl, mpl.replace("\n ", ""), commented, "This project is\nlicensed under the MIT license.", "x\x01y\x02\nAll rights\nreserved", *parted, mit.split("\n\n", 2)[2]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["licence"], r["statements"], r["first_sentence"]) for r in licences.scan(docs).collect()}
    want = {(0, "MIT", 2, 0), (1, "GPL-3.0", 1, 1), (2, "Apache-2.0", 2, 1), (3, "BSD-3-Clause", 1, 0), (3, "BSD-2-Clause", 1, 0), (4, "MPL-2.0", 1, 0), (5, "MPL-2.0", 1, 0), (6, "GPL-3.0", 1, 0)}
    assert got == want | {(7, "MIT", 1, 0), (8, "Proprietary", 1, 1), (14, "MIT", 1, 0)}


@pytest.fixture(scope="module")
def page_model():
    return pages.fit()


def test_pages_of_little_markup(page_model):
    two = "The council met on Monday evening to talk about the new bridge. It will be built next year, the mayor said."
    one = "Only one short paragraph is here, nothing else."
    head = "<html><head><title>x</title>"
    blog = f'<html><body><div class="post"><h2>A title</h2><p>{two}</p><p>{one}</p></div><div id=respond><h3>Leave a Reply</h3><form><label>Name</label><input><button>Send</button></form></div></body></html>'
    for html, want in [
        (f"<article><p>{two}</p></article>", two), (f"<main><p>{two}</p></main>", two), (f"<body><p>{two}</p><p>{one}</p><p>{two}</p></body>", f"{two}\n{one}\n{two}"),
        (two, two), (f"{head}<p>{two}</p><p>{one}</p>", f"{two}\n{one}"), (blog, f"A title\n{two}\n{one}"),
    ]:
        assert page_model.text(html) == want


def test_deep_pages_take_no_longer_than_wide_ones(page_model):
    start = time.perf_counter()
    page_model.text("<p>x</p>" * 20_000)
    wide, start = time.perf_counter() - start, time.perf_counter()
    page_model.text("".join(f"<div class=n{i}>x</q>" for i in range(20_000)))
    assert time.perf_counter() - start < 10 * wide + 2


def test_field_equals_enumerated_labellings():
    rng = np.random.default_rng(6)
    lengths = [1, 4, 6]
    score, live = rng.normal(size=(3, 6)), np.arange(6) < np.array(lengths)[:, None]
    pairs = rng.normal(size=(2, 2))
    chance, both, whole = pages.marginals(score * live, live, pairs)
    for row, n in enumerate(lengths):
        ways = list(itertools.product((0, 1), repeat=n))
        value = [sum(score[row, i] * y for i, y in enumerate(way)) + sum(pairs[a, b] for a, b in zip(way, way[1:])) for way in ways]
        z = np.exp(value)
        assert np.isclose(whole[row], np.log(z.sum()))
        assert np.allclose(chance[row, :n], [(z * [way[i] for way in ways]).sum() / z.sum() for i in range(n)])
        for a, b in itertools.product((0, 1), repeat=2):
            assert np.isclose(both[row, :, a, b].sum(), (z * [sum((x, y) == (a, b) for x, y in zip(way, way[1:])) for way in ways]).sum() / z.sum())
        blocks = pages.blocks_of("".join(f"<p>block {i}</p>" for i in range(n)))
        model = pages.Model(rng.normal(size=1 << pages.TABLE_BITS), pairs)
        own = [model.weights[f].sum() for f in pages.features(blocks)]
        best = max(ways, key=lambda way: sum(own[i] * y for i, y in enumerate(way)) + sum(pairs[a, b] for a, b in zip(way, way[1:])))
        assert [int(x) for x in model.content(blocks)] == list(best)
        assert model.content(pages.blocks_of("<p>block 0</p>" * n, model.listed)) == model.content(pages.blocks_of("<p>block 0</p>" * n))


def test_page_query_gives_the_articles(spark):
    found = QUERIES["op10_html_extraction"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in found:
        article = re.search(r"<article.*?</article>", r["html"], re.S)[0]
        assert r["text"] == "\n".join(b.text for b in pages.blocks_of(article)) and r["n_chars"] == len(r["text"])


def test_pages_hold_out_and_odd_rows(spark, page_model):
    model = page_model
    held = pages.training_pages(120, seed=77)
    good = sum(model.text(h) == "\n".join(re.sub(r"\s+", " ", t).strip() for t in truth) for h, truth in held)
    assert good >= 0.8 * len(held)
    rows = [(1, "u", None, 5), (2, None, "", 5), (3, "u", "<article><h1>A &amp; B</h1><p>This is one\n  long sentence, with words.<p>And another one that is &eacute;.</article><footer>© x</footer>", 5), (4, "u", "<p a='", 5), (5, "u", "<" * 2000, 5)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()}
    want = "A & B\nThis is one long sentence, with words.\nAnd another one that is é."
    assert got[1] == ("", 0) and got[2] == ("", 0) and got[3] == (want, len(want)) and len(got) == 5


def test_pages_without_head_end_and_body():
    texts = lambda html: [b.text for b in pages.blocks_of(html)]
    head = "<html><head><meta charset=utf-8><title>x</title><style>p {}</style><template><p>no</p></template><script>no()</script>"
    assert texts(head + "<p>One <b>text</b>.<p>Two.") == ["One text.", "Two."]
    assert texts(head + "\n bare text<p>Two.") == ["bare text", "Two."]
    assert texts(head + "<img src=a>\n<article><p>One.</article>") == ["One."]
    assert texts(head + "</head><body><p>One.</body>") == texts(head + "<body><p>One.") == ["One."]
    assert texts("<head>\n<!-- c --><title>only</title>\n") == []
    formula = '<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn><mspace/></mrow><annotation encoding="application/x-tex">x=2</annotation></semantics></math>'
    assert texts(f"<article><p>We have {formula} here.<p>End.</article>") == ["We have x=2 here.", "End."]


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns, name
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    ids = {r["doc_id"] for r in packed.select("doc_id").distinct().collect()}
    assert ids == {r["doc_id"] for r in kept.select("doc_id").collect()} and len(ids) >= 0.6 * docs.count()


def test_chunk_ids_equal_those_of_the_whole_text():
    coder = packing.Tokens(public_tokenizers.path(packing.TOKENIZER))
    texts = ["", " ", "It's they'LL 'S x!'s don''t", "Größe ÉCOLE niño ÿÞ æØ", "a×b÷c ²³ µ ª º", "école Å K Å İ", "œuvre „ja“ 中文 日本語 \U0001f600", "x" * 5000, "12a34 a_b\x00c\x7f", "a b c\x85d​e", "<|endoftext|> a <|b", "word, word. WORD\n\tword"]
    for text in texts:
        assert coder.encode(text) == coder.whole(text), text


def test_plain_texts_are_encoded_by_words_alone():
    coder = packing.Tokens(public_tokenizers.path(packing.TOKENIZER))
    marks = ["", ",", ".", "!", ";", ")", "?", ":"]
    text = " ".join(f"word{a} (Größe{b}" for a in marks for b in marks)
    assert coder.encode(text) == coder.whole(text)
    # 15 different chunks, but ten words; a chunk is kept for no text that words alone make up
    assert not coder.chunks and set(coder.words) == {"word", "größe", "("} | set(marks[1:])


@pytest.mark.parametrize(("block_bytes", "blocks"), [(16 << 20, 1), (20_000, 4)])
def test_dense_regions_give_fewer_rows_than_members(spark, monkeypatch, block_bytes, blocks):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", block_bytes)
    rng, texts = random.Random(5), []
    for i in range(70):  # with one word changed, 50 are all linked with one another; with two, few are linked
        own = [f"w{k}" for k in range(120)]
        for at in rng.sample(range(3, 115), 1 if i < 50 else 2):
            own[at] = f"x{i}"
        texts.append(" ".join(own))
    sets = [jaccard.shingle_set(t, 3) for t in texts]
    ids = [jaccard.node_of(x) for x in sets]
    docs = docs_frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    nodes = spark.createDataFrame([(n, i, len(x), bytearray(jaccard.sketch(x))) for i, (n, x) in enumerate(zip(ids, sets))], "node long, doc long, n long, sketch binary")
    members = spark.createDataFrame([(r, n, n) for r in (1, 2) for n in ids], "region long, node long, label long")
    pairs, links = jaccard.listed(docs, members, nodes, 3, 90)
    near = {(ids[i], ids[j]) for i in range(70) for j in range(70) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    found = [tuple(r) for r in links.collect()]
    assert pairs.count() + len(found) < len(ids) * blocks and set(found) <= near
    # every link is reached over those that are given and the pairs that are still to be measured
    edges = links.union(jaccard.linked(jaccard.measured(docs, nodes, jaccard.keep(pairs, "pairs"), 3), 90))
    labels = {r["node"]: r["label"] for r in jaccard.components(edges).collect()}
    assert all(labels.get(a, a) == labels.get(b, b) for a, b in near) and set(labels) == {a for a, b in near if a != b}


def test_prefix_trie_rows_equal_sql_without_pandas(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    theirs = con.sql(ORACLE_SQL["op12_prefix_trie"])
    ours = QUERIES["op12_prefix_trie"](spark, SF).select(*theirs.columns).collect()
    assert sorted(map(repr, map(tuple, ours))) == sorted(map(repr, theirs.fetchall()))
