"""The operators against brute force, round trips and held-out accuracy, and their defined results for odd rows."""

import hashlib
import itertools
import math
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import ann, decontam, lang_id, licenses, lm_score, mixing, pii, queries, simhash, token_file, toxicity
from tessera.llm._common import components, scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, __block int, t string"
ODD = [
    (1, None, None, None, None, "x", 1, "y"),
    (2, "", "en", "a", 0, "x", 1, "y"),
    (3, "... 123 !!!", None, "a", 3, None, None, None),
    (4, "the same words again and again", "en", "a", 30, None, None, None),
    (4, "the same words again and again", "en", "a", 30, None, None, None),
    (5, "the same words again and again", None, None, 30, None, None, None),
    (6, "wort " * 40_000, "de", "b", 200_000, None, None, None),
    (None, "no id here", "en", "b", 10, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


# --- 1 language ID


def phrases_by_hand(sample, text, longest=10**9):
    """Greedy parsing by substring search; phrases over ``longest`` count for each such piece."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        n, at = n + -(-size // longest), at + size
    return n


def test_phrases_are_those_of_greedy_parsing():
    samples = {"aa": "abracadabra abra cadabra", "bb": "banana bandana cabana"}
    model = lang_id.Model(samples)
    texts = ["abra", "banana abra", "cadabra", "xyz", "nanana banan dabra" * 3]
    count, kept, letters = lang_id.phrases(model, model.symbols(), texts)
    for k, name in enumerate(model.languages):
        for i, t in enumerate(texts):
            assert count[k, i] == phrases_by_hand(samples[name], t), (name, t)
    assert list(kept) == [len(t) for t in texts]


@pytest.mark.parametrize("dense", [62, 3])
def test_long_texts_and_rare_letters_are_parsed_from_their_start(monkeypatch, dense):
    """Texts of several blocks, alphabets beyond the table's columns, letters that a language or all samples lack."""
    monkeypatch.setattr(lang_id, "DENSE", dense)
    rng = np.random.default_rng(3)
    words = ["ala", "bal", "cada", "xyz", "über", "straße", "中文", "日本", "kot", "pies", "no", "я"]
    samples = {k: " ".join(rng.choice(words[i : i + 8], 500)) for i, k in enumerate("abc")}
    texts = [" ".join(rng.choice([*words, "q", "ж"], n)) for n in (0, 1, 5, 150, 600, 1500)] + ["中" * 1100, "ala " * 300, "a" * 1600]
    model = lang_id.Model(samples)
    count, _, _ = lang_id.phrases(model, model.symbols(), texts)
    for k, name in enumerate(model.languages):
        for i, t in enumerate(texts):
            assert count[k, i] == phrases_by_hand(samples[name], t), (name, i)
    pieces, _, _ = lang_id.phrases(model, model.symbols(), texts, 7)
    for k, name in enumerate(model.languages):
        for i, t in enumerate(texts):
            assert pieces[k, i] == phrases_by_hand(samples[name], t, 7), (name, i)


def test_sample_is_bounded_when_ids_repeat(spark, monkeypatch):
    rows = [(None, f"text number {i} of many", "en") for i in range(300)] + [(7, f"noch ein text {i}", "de") for i in range(300)] + [(i, f"ein wort {i}", "de") for i in range(300)]
    monkeypatch.setattr(lang_id, "SAMPLE_DOCS", 5)
    seen = {}
    monkeypatch.setattr(lang_id, "Model", lambda texts: seen.update(texts))
    lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(seen["en"].split()) == 5 and len(seen["de"].split()) <= 20


def test_mislabelled_documents_are_rejected_and_clean_ones_stay(spark):
    """Labels dealt anew on held-out documents, by length of text: what is rejected has a wrong label, and enough text to tell."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    rows = [r for r in docs.where(lang_id.held_out()).collect() if r["text"] and r["lang"] and any(c.isalpha() for c in r["text"])]
    texts, right = [r["text"] for r in rows], [r["lang"] for r in rows]
    assert all(lang_id._stays(model, model.symbols(), texts, right))
    wrong = [next(x for x in model.languages if x != lang) for lang in right]
    stays = lang_id._stays(model, model.symbols(), texts, wrong)
    long = [s for s, t in zip(stays, texts) if len(t) >= 200]
    assert len(long) > 200 and sum(long) <= 0.02 * len(long)
    ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 4 == 2]
    mixed = lang_id.keep_known(spark.createDataFrame([(i, t, w) for i, t, w in zip(ids, texts, wrong)] + [(10_000 + i, r["text"], r["lang"]) for i, r in enumerate(docs.where(~lang_id.held_out()).collect())], "doc_id long, text string, lang string"))
    assert mixed.where("doc_id < 10000").count() <= 0.1 * len(texts)


def test_languages_are_told_on_held_out_documents(spark):
    rows = queries.language_id(spark, SMALL).toPandas().merge(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(rows.doc_id, rows.held_out))
    held = rows[rows.held_out]
    assert len(held) and (held.lang == held.lang_pred).mean() >= 0.95
    assert rows.score.between(0, 1).all()


def test_language_of_odd_rows(docs, odd, none):
    model = lang_id.fit(docs)
    rows = lang_id.predict(odd, model).collect()
    assert len(rows) == len(ODD)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3}
    assert lang_id.predict(none, model).count() == 0
    nothing = lang_id.fit(none)
    assert {r["lang_pred"] for r in lang_id.predict(odd, nothing).collect()} == {"und"}
    kept = lang_id.keep_known(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({1, 2, 3})


# --- 2 toxicity


def test_toxicity_learns_and_leaves_clean_alone(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = toxicity.predict(more, toxicity.fit(more, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    assert found[found.toxic == 1].is_toxic.mean() >= 0.8
    assert found[found.toxic == 0].is_toxic.mean() <= 0.05


def plain_logistic(x, y, on):
    """The same training on a dense matrix."""
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    decay = np.where(np.arange(x.shape[1]) < x.shape[1] - on[1], toxicity.DECAY, 0.0)
    on = on[0]
    for step in range(1, toxicity.STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x[on].T @ (p - y)[on] / on.sum() + decay * w
        m, v = m + 0.1 * (g - m), v + 0.01 * (g * g - v)
        w = w - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return w


def test_chain_feeds_probabilities_predicted_out_of_fold(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(12)]
    rows = []
    for i in range(90):
        some = rng.choice(words, 6)
        rows.append((i, " ".join(some), int("word1" in some or "word2" in some), int("word2" in some or "word3" in some)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1 - r[2] if r[0] % 9 else None, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.predict(docs, toxicity.fit(docs, labels)).collect()}
    found = [set(toxicity.features([r[1]])[0].ravel().tolist()) - {toxicity.SIZE} for r in rows]
    every = sorted({f for x in found for f in x if sum(f in y for y in found) >= toxicity.SEEN})
    # Prefixes that several words of a text share count for each.
    count = lambda t, f: (toxicity.features([t])[0] == f).sum()
    x = np.array([[count(r[1], f) for f in every] for r in rows], float)
    folds = np.array([zlib.crc32(str(r[0]).encode()) % toxicity.FOLDS for r in rows])
    before_fit, before_use = np.zeros((90, 0)), np.zeros((90, 0))
    for k, name in ((2, "low_quality"), (3, "toxic")):
        y, told = np.array([r[k] for r in rows], float), np.array([name == "toxic" or r[0] % 9 > 0 for r in rows])
        design = lambda more: np.column_stack([x, np.ones(90), more])  # noqa: B023, E731
        held = np.zeros(90)
        for f in range(toxicity.FOLDS):
            w = plain_logistic(design(before_fit), y, (told & (folds != f), 1 + before_fit.shape[1]))
            held[folds == f] = 1 / (1 + np.exp(-np.clip(design(before_fit) @ w, -8, 8)))[folds == f]
        w = plain_logistic(design(before_fit), y, (told, 1 + before_fit.shape[1]))
        p = 1 / (1 + np.exp(-np.clip(design(before_use) @ w, -8, 8)))
        before_fit, before_use = np.column_stack([before_fit, held]), np.column_stack([before_use, p])
        for i in range(90):
            assert math.isclose(got[i][f"p_{name}"], p[i], abs_tol=1e-4)


def test_toxicity_of_odd_rows(spark, odd, none):
    one = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (99, 1, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.predict(odd, toxicity.fit(odd, one)).collect()
    assert len(rows) == len(ODD) and all(r["p_low_quality"] == 0 and 0 < r["p_toxic"] < 1 for r in rows)
    empty = one.limit(0)
    rows = toxicity.predict(odd, toxicity.fit(odd, empty)).collect()
    assert all(r["p_toxic"] == 0 and not r["is_toxic"] for r in rows)
    assert toxicity.predict(none, toxicity.fit(none, empty)).count() == 0


def test_what_is_learned_from_is_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 3, f"words of row {i}", "x") for i in range(3000)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.predict(docs, toxicity.fit(docs, labels)).count() == 3000


# --- 3 neighbours


def test_neighbours_recall_and_scores(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0")
    got = ann.search(vectors, asked, shard=200).collect()
    want = ann.exact(vectors, asked)
    pairs = {(q, v) for q, _, v, _ in want}
    assert len(got) == len(want) and len(pairs & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.95 * len(pairs)
    exact = {(q, v): s for q, _, v, s in want}
    assert all(math.isclose(r["score"], exact[r["query_id"], r["vec_id"]], rel_tol=1e-12) for r in got if (r["query_id"], r["vec_id"]) in exact)


def test_repeated_ids_leave_room_for_others(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    many = [(500, (np.array(rows[0][1]) * 3 + rng.normal(size=8) / 50).tolist()) for _ in range(300)]
    same = [(501, rows[0][1])] * 60 + [(502, rows[0][1])]
    vectors = spark.createDataFrame(rows * 2 + many + same, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 20 = 0 and vec_id < 200")
    got = {}
    for r in ann.search(vectors, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(got) == 10
    each = {(i, tuple(np.float32(v))) for i, v in rows + many + same}
    kept = 0
    for i, found in got.items():
        best = {}
        for j, v in each:
            if j != i:
                best[j] = max(best.get(j, -math.inf), float(np.float64(v) @ np.float64(np.float32(rows[i][1]))))
        kept += len(set(found) & set(sorted(best, key=lambda j: (-best[j], j))[: ann.K]))
        assert len(found) == len(set(found)) == ann.K and (i or found[:3] == [500, 501, 502])
    assert kept >= 0.95 * 10 * ann.K


def compared(spark, rows, kind, **more):
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    asked = vectors.where("vec_id % 20 = 0")
    got = [tuple(r) for r in ann.search(vectors, asked, **more).select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()]
    return got, ann.exact(vectors, asked)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_large_and_double_components_are_not_lost(spark, kind):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * 1e30).tolist()) for i in range(30)]
    got, want = compared(spark, rows, kind)
    assert got == sorted(want) and len(got) == 2 * ann.K
    rows = [(i, (rng.normal(size=6) * 10.0 ** rng.integers(-9, 9)).tolist()) for i in range(700)]
    got, want = compared(spark, rows, kind)
    exact = {(q, v): s for q, _, v, s in want}
    assert len(got) == len(want) and sum((q, v) in exact for q, _, v, _ in got) >= 0.9 * len(want)
    assert all(s == exact[q, v] for q, _, v, s in got if (q, v) in exact)


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(12, 16))
    for n in (120, 1500):
        got, want = compared(spark, [(i, (middles[i % 12] + rng.normal(size=16) / 20).tolist()) for i in range(n)], "float")
        found = {(q, v) for q, _, v, _ in got}
        assert sum((q, v) in found for q, _, v, _ in want) >= (1.0 if n <= ann.WHOLE else 0.95) * len(want)


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [3.0, 3.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("x", "rank")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=3).collect()}
    assert got == {(0, 1): 9, (0, 2): 1, (0, 3): 2, (20, 1): 9, (20, 2): 3, (20, 3): 0}
    empty = vectors.limit(0)
    assert ann.search(empty, empty).count() == 0


# --- 4 language-model scores


def test_scores_are_those_of_counting(spark):
    rows = [(1, "a b a b c"), (2, "a b. A c"), (3, "c c c"), (4, None), (5, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in lm_score.score(table, labels).collect()}
    assert got[4]["score"] is None and got[5]["n_words"] == 0
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in rows}
    loss = {}
    for name, ids in (("t", [1]), ("b", [1, 2, 3])):
        pairs = [p for i in ids for p in zip(["<s>", *words[i]], words[i])]
        all_pairs = [p for i in words for p in zip(["<s>", *words[i]], words[i])]
        uni = {w: sum(p[1] == w for p in pairs) for w in "abc"}
        for i in (1, 2, 3):
            bits = 0
            for v, w in zip(["<s>", *words[i]], words[i]):
                low = 0.3 * (uni[w] + 0.5) / (sum(uni.values()) + 0.5 * 5)
                kept = all_pairs.count((v, w)) >= 2
                head = max(1, sum(p[0] == v for p in pairs))
                bits -= math.log2(0.7 * pairs.count((v, w)) / head + low if kept else low)
            loss[name, i] = bits / len(words[i])
    for i in (1, 2, 3):
        assert math.isclose(got[i]["score"], loss["t", i] - loss["b", i], abs_tol=1e-9)


@pytest.mark.parametrize("sizes", [(12_000_000, 4_000_000, 10**6), (20_000, 3_000, 0), (1, 100_000, 10**6)])
def test_scores_do_not_depend_on_runs_and_buckets(spark, docs, monkeypatch, sizes):
    """A word or pair that comes twice is in the model whatever the size of the corpus, wherever it comes."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    bytes_of = lambda t: [w for w in re.split(rb"[ \t\n\r\v\f.,;:!?\"'()]+", (t or "").lower().encode()) if w]
    texts = [(r["doc_id"], bytes_of(r["text"])) for r in docs.collect()]
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}
    words, pairs, heads = ([{}, {}] for _ in range(3))
    for i, t in texts:
        for k in (0, 1) if i in good else (0,):
            for v, w in zip([b" ", *t], t):
                for of, key in ((words, w), (pairs, (v, w)), (heads, v)):
                    of[k][key] = of[k].get(key, 0) + 1
    total = [sum(x.values()) for x in words]
    known = {w for w, n in words[0].items() if n >= 2}
    rare = [sum(n for w, n in x.items() if w not in known) for x in words]
    want = {}
    for i, t in texts:
        bits = [0.0, 0.0]
        for v, w in zip([b" ", *t], t):
            for k in (0, 1):
                low = 0.3 * ((words[k].get(w, 0) if w in known else rare[k]) + 0.5) / (total[k] + 0.5 * (len(known) + 2))
                high = 0.7 * pairs[k].get((v, w), 0) / max(1, heads[k].get(v, 0)) if pairs[0][v, w] >= 2 else 0
                bits[k] -= math.log2(low + high)
        want[i] = (len(t), *[x / len(t) if t else None for x in (bits[1], bits[0], bits[1] - bits[0])])
    monkeypatch.setattr(lm_score, "RUN", sizes[0])
    monkeypatch.setattr(lm_score, "BUCKET", sizes[1])
    monkeypatch.setattr(lm_score, "BROADCAST", sizes[2])
    got = lm_score.score(docs, labels).collect()
    assert len(got) == len(texts) and len({r["loss_background"] for r in got}) > 10
    for r in got:
        for c, x in zip(("n_words", "loss_target", "loss_background", "score"), want[r["doc_id"]]):
            assert r[c] == x or math.isclose(r[c], x, abs_tol=1e-9)


@pytest.mark.parametrize("most", [10, 3])
def test_a_word_in_every_run_is_added_up_in_parts(spark, docs, monkeypatch, most):
    """Buckets of more rows than are added up together, in one level of parts and in several."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    table = docs.withColumn("text", F.concat(F.lit("everywhere and "), F.coalesce("text", F.lit(""))))
    want = sorted(map(tuple, lm_score.score(table, labels).collect()))
    monkeypatch.setattr(lm_score, "RUN", 20_000)
    monkeypatch.setattr(lm_score, "BUCKET", 100_000)
    monkeypatch.setattr(lm_score, "GROUPED", most)
    got = sorted(map(tuple, lm_score.score(table, labels).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(want) > 100
    for a, b in zip(got, want):
        assert [x is None for x in a] == [x is None for x in b] and all(x == pytest.approx(y, abs=1e-9) for x, y in zip(a[2:], b[2:]) if x is not None)


def test_other_documents_are_scored_by_the_corpus(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    some = docs.where("doc_id < 40")
    want = {r["doc_id"]: r for r in lm_score.score(docs, labels).collect()}
    got = lm_score.score(some, labels, docs).collect()
    assert len(got) == some.count() and all(r == want[r["doc_id"]] for r in got)


def test_pair_keys_are_those_of_spark(spark):
    rows = [(1, 2), (-5, 1 << 60), (0, -1)]
    want = [r[0] for r in spark.createDataFrame(rows, "v long, w long").selectExpr("xxhash64(v, w)").collect()]
    assert lm_score.pair_keys(*(np.array(x, np.int64) for x in zip(*rows))).tolist() == want


def test_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = lm_score.score(odd, labels).collect()
    assert len(rows) == len(ODD) and all(r["score"] in (None, 0.0) for r in rows)
    assert lm_score.score(none, labels).count() == 0


# --- 5 personal data


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]
            if ok():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TRICKY = [
    "a@b.c-x@d.e a@b.c_x@d.e.f ..@x.y @a.b a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 0000255.1.1.1 1.1.1.999", "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 41111111111111112",
    "+49 (30) 123-45.67 +1 +1( ++12345678 +12345678901234567", "é😀 x@y.zz 😀 10.0.0.1 " * 3, "GB82 WEST 1234 5698 7654 32 DE89370400440532013000 DE89370400440532013001", "visa 378282246310005 and 378282246310005", "ssn 123-45-6789 then 123-45-6789 far away " + "x" * 60 + " 123-45-6789",
]


def test_base_spans_are_those_of_the_patterns(spark, docs):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for source in (table, docs):
        texts = texts_of(source)
        for r in pii.digest(pii.find(source)).collect():
            want = base_spans(texts[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (texts[r["doc_id"]][:80], r["spans"], want)
            assert r["spans"].startswith(want) and r["n_email"] == want.count("email:")


def test_added_spans_are_confirmed(spark):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(table)).collect()}
    assert got[5].count("iban:") == 2 and got[6].count("short_card:") == 2 and got[7].count("ssn:") == 2


def test_personal_data_of_odd_rows(odd, none):
    rows = pii.digest(pii.find(odd)).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == "" for r in rows)
    assert pii.digest(pii.find(none)).count() == 0


# --- 6 token file


def test_code_lengths_are_optimal_and_limited():
    for counts in ([5, 9, 12, 13, 16, 45], [1, 1, 2, 3, 5, 8, 13, 21, 34, 55], [7], [1, 1], [0, 4, 0, 4, 4]):
        for longest in (3, 4, 9):
            used = [c for c in counts if c]
            if len(used) > 1 << longest:
                continue
            lengths = token_file.code_lengths(np.array(counts), longest)
            assert sum(2.0 ** -int(x) for x in lengths if x) <= 1 and lengths.max() <= longest
            best = min(sum(c * n for c, n in zip(sorted(used, reverse=True), some)) for some in itertools.combinations_with_replacement(range(1, longest + 1), len(used)) if sum(2.0**-n for n in some) <= 1) if len(used) <= 6 else None
            if best:
                assert sum(int(n) * c for n, c in zip(lengths, counts)) == best


def test_blocks_decode_to_what_was_written():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.geometric(0.02, 5000) - 1, 299)
    code = token_file.Code(token_file.code_lengths(np.bincount(ids, minlength=300)))
    parts = [ids[:1], ids[:256], ids[256:900], ids]
    made = [(*code.write(p), len(p)) for p in parts]
    assert all((a == b).all() for a, b in zip(token_file.read(code.table(), code.bits, made), parts))


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_file_round_trip(spark, name, request):
    table = request.getfixturevalue(name)
    path = scratch(spark, "test")
    token_file.write(table, path, public_tokenizers.path(queries.TOKENIZER))
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER)), 0
    got = sorted(token_file.scan(spark, path).collect(), key=lambda r: r["start"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, np.uint32).tobytes()))
        start += len(ids)
    assert sum(len(r["ids"]) for r in token_file.ids_of(spark, path).collect()) == start


def test_equal_long_documents_keep_their_places(spark):
    """Each is a block of its own, and all blocks have the same document."""
    path = scratch(spark, "test")
    table = spark.createDataFrame([(7, "wort " * 140_000)] * 3 + [(8, "end")], "doc_id long, text string")
    token_file.write(table, path, public_tokenizers.path(queries.TOKENIZER))
    got = sorted(tuple(r) for r in token_file.scan(spark, path).select("start", "doc_id", "n_tokens").collect())
    n = got[0][2]
    assert n > token_file.BLOCK and [g[:2] for g in got] == [(0, 7), (n, 7), (2 * n, 7), (3 * n, 8)]


@pytest.mark.parametrize("hot", [7, None])
def test_a_hot_id_fills_several_parts(spark, tmp_path, hot):
    rows = [(i, f"text {i}") for i in range(40)] + [(hot, f"hot {i % 3}") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    where = f"file://{tmp_path}/t{hot}"
    token_file.write(table, where, public_tokenizers.path(queries.TOKENIZER))
    held = spark.read.parquet(f"{where}/blocks").selectExpr("part", "explode(doc_ids) as d").collect()
    parts = {r["part"] for r in held if r["d"] == hot}
    assert len(parts) >= 2 and max(sum(r["part"] == p and r["d"] == hot for r in held) for p in parts) <= 120
    got = sorted(token_file.scan(spark, where).collect(), key=lambda r: r["start"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert len(got) == 240 and ids == sorted(ids)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(queries.TOKENIZER)))
    want = {t: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for _, t in rows}
    assert sorted(r["ids"] for r in token_file.ids_of(spark, where).collect()) == sorted(want[t] for _, t in rows)


def test_words_are_encoded_as_whole_texts():
    words = token_file.Words(public_tokenizers.path(queries.TOKENIZER), 1)
    texts = ["", "a\x1cb c d", "Don't STOP.. it's, a.b <|endoftext|> x<|startoftext|>y", "É́ İstanbul ΣΑΣ 日本語 text,", "1234. 12,5 ,,, ... .", "Über straße, ÇAUXCH!! ñandú. ΌΣΟΣ ǅ ﬁn Å Å n\u0303 한국어 ё.", "ÀÉÎÕÜ ÿ Ź. œuvre, ªº", "  abc<| x|> ÿŸ ß. Ñ'S o' word<|endoftext|> ", "a!(b) né$$$ a\u00a0b \x00 \x7f × ÷a a≠", " "]
    flat, ends = words.ids(texts)
    for t, a, b in zip(texts, [0, *ends], ends):
        assert flat[a:b].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_empty_file(spark, none):
    path = scratch(spark, "test")
    token_file.write(none, path, public_tokenizers.path(queries.TOKENIZER))
    assert token_file.scan(spark, path).count() == 0


# --- 7 decontamination


def test_masks_hit_every_window_with_two_substitutions():
    for errors in itertools.combinations(range(decontam.WINDOW), 2):
        assert any(not ({at + p for p in mask} & set(errors)) for mask in decontam.MASKS for at in range(decontam.WINDOW - mask[-1]))


def plain_words(t):
    return [w.strip(decontam.MARKS).lower() for w in re.split(r"[ \n\t\r]", t or "") if w.strip(decontam.MARKS)]


def overlaps(text, item):
    d, w = plain_words(text), plain_words(item)
    size = min(decontam.WINDOW, len(w))
    if len(set(d) & set(w)) < 5:
        return False
    for diagonal in range(-len(w) + 1, len(d)):
        same = [0 <= i + diagonal < len(d) and d[i + diagonal] == w[i] for i in range(len(w))]
        if any(sum(same[s : s + size]) >= math.ceil(decontam.SIMILAR * size - 1e-9) for s in range(len(w) - size + 1)):
            return True
    return False


def test_contamination_is_that_of_brute_force(spark):
    items = [(k, " ".join(f"w{k}x{i}" for i in range(20))) for k in range(3)] + [(9, "too short"), (10, None)]
    a = items[0][1].split()
    two = [w if i % 7 != 3 else "other" for i, w in enumerate(a)]
    many = [w if i % 2 else "other" for i, w in enumerate(a)]
    gap = a[:7] + ["in"] + a[7:]
    texts = [" ".join(a).upper() + ".", "x y " + " ".join(two) + " z", " ".join(many), " ".join(a[:8]), " ".join(a[4:17]), " ".join(gap), items[1][1] + "\n" + items[2][1] * 2, "", None, "z " * 300 + items[2][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    want = {(i, k) for i, t in enumerate(texts) for k, x in items if x and len(plain_words(x)) >= decontam.SPAN and overlaps(t, x)}
    assert got == want and len(want) >= 6


def test_short_items_are_found_with_all_substitutions_allowed(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 13)]
    texts, want = [], set()
    for n, item in items:
        allowed = 0 if n < decontam.SPAN else n - math.ceil(decontam.SIMILAR * n - 1e-9)
        for errors in range(allowed + 2):
            for places in itertools.combinations(range(n), errors):
                if errors <= allowed:
                    want.add((len(texts), n))
                texts.append("a b " + " ".join("other" if k in places else w for k, w in enumerate(item.split())) + " c.")
    texts += [items[9][1].rsplit(" ", 2)[0], items[6][1] + " " + items[6][1]]
    want |= {(len(texts) - 2, 10), (len(texts) - 1, 7)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_contamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "the same words again and again and so on it goes"), (2, None)], "item_id long, text string")
    assert decontam.contaminated(odd, bench).count() == 0
    assert decontam.decontaminate(odd, bench).count() == len(ODD)
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(odd, bench.limit(0)).count() == 0


# --- 8 mixing


def test_exponent_meets_the_limits():
    tokens = {"a": 1000, "b": 100, "c": 10, None: 0}
    for repeats in (1.5, 3.0, 1000.0):
        x = mixing.solve(tokens, None, repeats)
        live = {k: v for k, v in tokens.items() if v}
        seen = mixing.passes(live, mixing.weights(live, x))
        assert max(seen.values()) <= repeats + 1e-6 and min(seen.values()) >= 1 - 1e-9
        assert x == 0 or max(seen.values()) >= repeats - 1e-6
    x = mixing.solve(tokens, 0.6, None)
    assert mixing.entropy(mixing.weights({"a": 1000, "b": 100, "c": 10}, x)) <= 0.6 * math.log(3) + 1e-9


def test_schedule_meets_the_budget(docs):
    plan = {r["source"]: r for r in mixing.plan(docs).collect()}
    rows = mixing.schedule(docs).toPandas()
    assert len(rows) == docs.count() and (rows.copies >= 1).all()
    for source, x in rows.groupby("source"):
        seen, p = (x.tokens * x.copies).sum(), plan[source]
        assert p["tokens"] == x.tokens.sum()
        assert seen <= p["passes"] * p["tokens"] + 1 and seen > p["passes"] * p["tokens"] - x.tokens.max() - 1
    texts = texts_of(docs)
    assert all(n == len(texts[i].encode().split()) for i, n in zip(rows.doc_id, rows.tokens))
    assert mixing.mix(docs).count() == rows.copies.sum()


def schedule_by_hand(rows, hashes, repeats=mixing.REPEATS):
    """Copies of rows (doc_id, source, text): passes by bisection anew, blocks and cuts by plain loops; hashes give each id's block hash and draw, and each block's place."""
    size = [len(re.findall(rb"[^ \t-\r]+", (t or "").encode())) for _, _, t in rows]
    total = {}
    for (_, source, _), n in zip(rows, size):
        total[source] = total.get(source, 0) + n
    live = {k: n for k, n in total.items() if n}

    def seen(x):
        w = {k: (n / max(live.values())) ** x for k, n in live.items()}
        w = {k: v / sum(w.values()) for k, v in w.items()}
        budget = max(live[k] / w[k] for k in live)
        return {k: budget * w[k] / live[k] for k in live}

    low, high = 0.0, 1.0
    if not live or max(seen(0.0).values()) <= repeats + 1e-12:
        high = 0.0
    else:
        for _ in range(60):
            x = (low + high) / 2
            low, high = (low, x) if max(seen(x).values()) <= repeats + 1e-12 else (x, high)
    passed = {k: 1.0 for k in total} | (seen(high) if live else {})
    out = [0] * len(rows)
    for source in total:
        mine = [i for i, r in enumerate(rows) if r[1] == source]
        whole = math.floor(passed[source] + 1e-9)
        rest = math.floor((passed[source] - whole) * total[source] + 1e-6)
        blocks = max(1, min(mixing.BLOCKS, total[source] // mixing.BLOCK))
        of = {i: hashes["block"][rows[i][0]] % blocks for i in mine}
        for i in mine:
            out[i] = whole
        for b in sorted(set(of.values()), key=lambda b: (hashes["turn"](source, b), b)):
            inside = [i for i in mine if of[i] == b]
            n = sum(size[i] for i in inside)
            if n <= rest:
                taken = inside
            else:
                taken, used = [], 0
                for draw in sorted({hashes["draw"][rows[i][0]] for i in inside}):
                    same = [i for i in inside if hashes["draw"][rows[i][0]] == draw]
                    used += sum(size[i] for i in same)
                    if used > rest:
                        break
                    taken += same
            for i in taken:
                out[i] += size[i] > 0
            rest -= n
            if rest <= 0:
                break
    return out


def hashes_of(spark, docs):
    ids = docs.select("doc_id").distinct().selectExpr("doc_id", f"xxhash64(doc_id, {mixing.SEED}) as b", f"xxhash64({mixing.SEED + 1}, doc_id) as d").collect()
    places = {(r["source"], r["b"]): r["h"] for r in docs.select("source").distinct().crossJoin(spark.range(200).selectExpr("cast(id as int) as b")).selectExpr("source", "b", f"xxhash64({mixing.SEED + 2}, source, b) as h").collect()}
    return {"block": {r["doc_id"]: r["b"] for r in ids}, "draw": {r["doc_id"]: r["d"] for r in ids}, "turn": lambda source, b: places[source, b]}


@pytest.mark.parametrize("block", [100_000, 500])
def test_schedule_is_that_of_plain_loops(spark, docs, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    some = docs.select("doc_id", "source", "text")
    twice = some.union(some.where("doc_id % 17 = 0")).union(spark.createDataFrame([(None, None, "a b"), (None, "web", None)], some.schema))
    rows = [tuple(r) for r in twice.collect()]
    want = sorted((repr(r), c) for r, c in zip(rows, schedule_by_hand(rows, hashes_of(spark, twice))))
    got = mixing.schedule(twice).join(twice.distinct().select("doc_id", "source", "text"), ["doc_id"], "left").where("doc_id is not null")
    assert len({c for _, c in want}) > 1
    assert sorted((repr((r["doc_id"], r["source"], r["text"])), r["copies"]) for r in mixing.schedule(twice).select("doc_id", "copies").join(some, "doc_id").collect()) == [w for w in want if not w[0].startswith("(None")]
    assert got.count() == len([r for r in rows if r[0] is not None])


@pytest.mark.parametrize("limits", [{}, {"target": 0.9, "repeats": None}, {"repeats": 2.0, "budget": 30_000}])
def test_many_sources_are_solved_where_they_are(docs, monkeypatch, limits):
    want = {r["source"]: r for r in mixing.plan(docs, **limits).collect()}
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    got = mixing.plan(docs, **limits).collect()
    assert len(got) == len(want) and all(r["tokens"] == want[r["source"]]["tokens"] and all(math.isclose(r[c], want[r["source"]][c], rel_tol=1e-9) for c in ("weight", "passes")) for r in got)


def test_mixing_of_odd_rows(odd, none):
    got = mixing.mix(odd)
    assert got.columns == odd.columns and got.count() == mixing.schedule(odd).toPandas().copies.sum() >= len(ODD)
    assert mixing.schedule(none).count() == 0 and mixing.mix(none).count() == 0
    empty = odd.where("doc_id < 3")
    assert mixing.schedule(empty).toPandas().copies.tolist() == [1, 1]


CLASHES = ["__source", "__s", "__b", "__n", "__whole", "__copy", "__block", "__tokens", "__row", "__key0", "__key1", "__kept", "__id", "none", "words", "fp", "least", "row", "seed", "at", "item_id"]


def test_columns_that_clash_keep_their_values(spark, odd):
    """Each stage gives back rows as they came, whatever their other columns are called."""
    wide = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat_ws("-", F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    known = {tuple(r) for r in wide.collect()}
    bench = spark.createDataFrame([(1, "the same words again and again")], "item_id long, text string")
    kept = {"mix": mixing.mix(wide), "dedup": simhash.deduplicate(wide), "clean": decontam.decontaminate(wide, bench), "known": lang_id.keep_known(wide)}
    for name, found in kept.items():
        assert found.columns == wide.columns, name
        rows = [tuple(r) for r in found.collect()]
        assert rows and set(rows) <= known, name
    assert {r[0] for r in kept["mix"].collect()} == {r[0] for r in known}
    assert {r["doc_id"] for r in kept["dedup"].collect()} == {1, 3, 4, 6, None}
    assert {r["doc_id"] for r in kept["clean"].collect()} == {1, 2, 3, 6, None}
    assert {r["doc_id"] for r in kept["known"].collect()}.isdisjoint({1, 2, 3})


# --- 9 SimHash


def print_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    some = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.masks()
    for bits in itertools.combinations(range(64), simhash.RADIUS):
        flipped = sum(1 << b for b in bits)
        assert any(not flipped & m for m in masks)


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates_are_those_of_all_pairs(spark, docs):
    texts = texts_of(docs)
    prints = {i: print_by_hand(t) for i, t in texts.items()}
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = classes(pairs, prints)
    for r in simhash.near_duplicates(docs).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("paired", [512, 1, 3])
def test_large_buckets_lose_no_link(spark, paired):
    rng = np.random.default_rng(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            prints.add(x ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), False)))
    prints = sorted(prints)
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3]
    want = classes([(simhash.signed(a), simhash.signed(b)) for a, b in pairs], [simhash.signed(p) for p in prints])
    rows = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(rows, paired=paired)).collect()}
    assert {n: found.get(n, n) for n in want} == want


def test_near_duplicates_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == "0" * 16 and by[2]["component_id"] == 1 and by[5]["component_id"] == 4
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({by[i]["component_id"] for i in by if i})


def test_stages_keep_documents_without_id_and_with_one_id(spark):
    a, b, c, d = ("the cat sat on the mat today", "a wholly different text about rain and snow", "one more story of ships and far harbours", " ".join(f"w{i}" for i in range(20)))
    rows = [(None, a, None, "en"), (None, a, "en", None), (None, b, None, None), (7, b, None, None), (8, a + " x" * 40, None, None), (8, c, None, None), (8, c, None, None), (None, d, None, None), (9, d, None, None), (9, "clean words here", None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = [(r["doc_id"], r["text"]) for r in simhash.deduplicate(table).collect()]
    want = [(None, a), (7, b), (8, a + " x" * 40), (8, c), (9, d), (9, "clean words here")]
    assert sorted(kept, key=str) == sorted(want, key=str)
    bench = spark.createDataFrame([(1, d)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table, bench).collect()} == {(None, 1), (9, 1)}
    clean = [(r["doc_id"], r["text"]) for r in decontam.decontaminate(table, bench).collect()]
    assert sorted(clean, key=str) == sorted([r[:2] for r in rows if r[1] != d], key=str)


# --- 10 licences


def test_every_known_text_is_found_in_any_spelling(spark):
    rows = [(i, f"Copyright (c) 2020 A. Person\n{t.upper().replace('LICENSE', 'LICENCE')}  \n\n") for i, (_, t) in enumerate(licenses.KNOWN)]
    docs = spark.createDataFrame([(i, t) for i, t in rows if "©" not in t], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs).where("unit = 'text'").collect()}
    assert got == {i: k for i, (k, _) in enumerate(licenses.KNOWN)}
    assert all(re.search(licenses.HINT, t) for _, t in licenses.KNOWN)


def test_whole_texts_in_usual_layouts(spark):
    bare = {k: t for k, t in reversed(licenses.KNOWN) if len(t) > 500}
    wrapped = {k: "\n\n".join(textwrap.fill(p, 76) for p in t.split("\n")) for k, t in bare.items()}
    isc = bare["ISC"].replace("the above copyright", "the above\ncopyright")
    texts = [(k, t) for k, t in licenses.SHIPPED] + [(k, textwrap.fill(t, 60)) for k, t in licenses.SHIPPED if k == "CC0-1.0"]
    texts += [("ISC", "ISC License\n\nCopyright (c) 2020, A. Person\n\n" + isc), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, A. Person\nAll rights reserved.\n\n" + wrapped["BSD-3-Clause"])]
    texts += [("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright 2020 The Authors\n\n" + wrapped["BSD-2-Clause"]), ("MIT", "Copyright The Authors\n" + wrapped["MIT"]), ("Zlib", "zlib License\n\n(c) Someone\n\n" + bare["Zlib"])]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs).where("unit = 'text'").collect()}
    assert got == {i: k for i, (k, _) in enumerate(texts)} and {"Apache-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "LGPL-2.1", "CC0-1.0"} <= set(got.values())


def test_license_lines_of_documents(docs):
    notice = {re.sub(r"\W+", " ", t.lower()).strip(): k for k, t in licenses.KNOWN}
    want = {(i, notice[c]) for i, t in texts_of(docs).items() for line in t.split("\n") if (c := re.sub(r"\W+", " ", line.lower()).strip()) in notice}
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scan(docs).collect()}
    assert got == want and want


def test_licenses_of_odd_rows(odd, none):
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0
