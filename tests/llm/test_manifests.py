"""SentencePiece, the prefix trie and the Merkle manifest against the library and brute force, and their defined results for odd rows."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tessera.llm import _runs, merkle, queries, sentence_pieces, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, __nth int, ids string"
ODD = [
    (1, None, None, None, None, "x", 1, "y"),
    (2, "", "en", "a", 0, "x", 1, "y"),
    (3, "a line\nand one\n", None, "a", 3, None, None, None),
    (4, "the same again", "en", "a", 30, None, None, None),
    (4, "the same again", "en", "a", 30, None, None, None),
    (4, "not the same", "en", "a", 30, None, None, None),
    (5, "▁ marks ▁▁ of  \t\r\n their own é 日本 \U0001f600\0", None, "Ä", 30, None, None, None),
    (6, "wort " * 20_000 + "x" * 3_000, "de", "b", 200_000, None, None, None),
    (None, "no id here\n", "en", "b", 10, None, None, None),
    (None, None, None, "b", None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def nulls(row):
    return tuple((v is not None, v) for v in row)


# --- prefix sums


def test_running_values_cross_partitions(spark):
    rng = random.Random(3)
    rows = [(None if g == 3 else f"g{g}", i, rng.randrange(-(1 << 62), 1 << 62), 1) for i in range(3000) for g in [min(5, rng.randrange(14))]]
    df = spark.createDataFrame(rows, "g string, i long, x long, one long").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r["g"], r["i"]): (r["__nth"], r["run_one"], r["run_x"]) for r in _runs.running(df, ["g"], ["i"], ["one"], ["x"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    groups, last, seen = [], None, {}
    for g, i, x, _ in sorted(rows, key=lambda r: nulls(r[:2])):
        if not groups or g != groups[-1]:
            groups.append(g)
            n = acc = 0
        n, acc = n + 1, acc ^ x
        seen[g, i] = (len(groups) - 1, n, acc)
    assert got == seen and len(groups) == 6


# --- 11 SentencePiece


def by_library(rows):
    model = SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECES))
    out = []
    for doc_id, text in rows:
        ids = model.encode(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    return sorted(out, key=nulls)


def test_pieces_are_the_librarys(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted((tuple(r) for r in queries.pieces(spark, SMALL).collect()), key=nulls)
    assert got == by_library([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_pieces_of_odd_rows(spark, odd, none):
    path = public_tokenizers.path(queries.PIECES)
    model = SentencePieceProcessor(model_file=path)
    got = [(r["doc_id"], r["ids"], r["text"]) for r in sentence_pieces.decode(sentence_pieces.encode(odd, path), path).collect()]
    want = [(r[0], model.encode(r[1] or ""), model.decode(model.encode(r[1] or ""))) for r in ODD]
    assert sorted(got, key=nulls) == sorted(want, key=nulls)
    assert sentence_pieces.decode(sentence_pieces.encode(none, path), path).count() == 0


def test_random_texts_are_cut_where_nothing_merges():
    path, rng = public_tokenizers.path(queries.PIECES), random.Random(5)
    chunks = sentence_pieces.Chunks(path, 500)
    texts = ["".join(rng.choice(" \n▁\r\tab{;)}é日\0\U0001f600  ") for _ in range(rng.randrange(40))) for _ in range(3000)]
    for some in (texts[:7], texts[7:2000], texts[2000:]):  # the table is emptied in between
        flat, ends = chunks.ids(some)
        assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == chunks.model.encode(some)
    assert [x.tolist() for x in chunks.ids(["", ""])] == [[], [0, 0, 0]]


def test_control_and_broken_ids_decode_as_the_library_does(spark):
    path = public_tokenizers.path(queries.PIECES)
    rows = [(1, [1, 264, 2]), (2, [0, 264, 0]), (3, [200, 201, 264]), (4, []), (5, None)]
    model = SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r["text"] for r in sentence_pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), path).collect()}
    assert got == {k: model.decode(v or []) for k, v in rows}


# --- 12 prefix trie


def trie_by_hand(rows, base=True):
    own = {}
    for r in rows:
        if r["conv_id"] is not None:
            own.setdefault(r["conv_id"], []).append(r)

    def digest(r):
        role = (r["role"] or "").encode()
        return hashlib.sha256(b"%d:" % len(role) + role + (r["text"] or "").encode()).hexdigest()

    for c, v in own.items():
        v.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0, digest(r)))
        own[c] = [(r["role"] or "", r["text"] or "") for r in v]
    built = own
    if base:
        built = {}
        for c in own:
            h = zlib.crc32(str(c).encode()) % 6
            built[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        done = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(done.encode()).hexdigest()))
    return sorted(out, key=nulls)


def nodes(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=nulls)


TALKS = "conv_id long, turn long, role string, text string, depth string, rank int"


def test_trie_of_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    assert nodes(queries.prefix_trie(spark, sf)) == trie_by_hand(rows)


def test_trie_of_odd_rows(spark):
    rows = [(c, t, None if t == 2 else "user", f"text {min(t, c % 3)}", "x", 1) for c in (0, 7, 8, 9, 107, 203, 204) for t in range(c % 9)]
    rows += [(0, None, "user", "first", None, None), (0, None, None, None, None, None), (None, 1, "user", "lost", None, None)]
    rows += [(11, 1, "user", "twice", None, None)] * 2 + [(12, 1, "user", "twice", None, None), (12, 2, "user", "twice", None, None), (13, 0, "", "", None, None)]
    rows += [(300, t, "user", f"{t}", None, None) for t in range(150)] + [(301, t, "user", f"{t}", None, None) for t in range(149)]
    talks = spark.createDataFrame(rows, TALKS)
    own = trie.turns(talks)
    assert nodes(trie.trie(trie.rebuilt(own), 3)) == trie_by_hand(talks.collect())
    assert nodes(trie.trie(trie.rebuilt(own))) == trie_by_hand(talks.collect())
    assert nodes(trie.trie(trie.rooted(own), 8)) == trie_by_hand(talks.collect(), base=False)
    assert nodes(trie.trie(trie.rebuilt(trie.turns(spark.createDataFrame([], TALKS))))) == []


def test_intervals_nest_in_preorder(spark):
    found = trie.trie(trie.rebuilt(trie.turns(spark.read.parquet(f"{SMALL}/conversations.parquet")))).collect()
    assert sorted(r["preorder"] for r in found) == list(range(len(found)))
    open_ends = []
    for r in sorted(found, key=lambda r: r["preorder"]):
        while open_ends and open_ends[-1] <= r["preorder"]:
            open_ends.pop()
        assert len(open_ends) == r["depth"] and all(r["subtree_end"] <= e for e in open_ends)
        open_ends.append(r["subtree_end"])


def test_lists_of_members_in_pieces_are_hashed_whole(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 10)
    ranks = spark.createDataFrame([(c, c % 2 + c // 500) for c in range(1000)], "conv_id long, rank long").repartitionByRange(5, "rank", "conv_id").sortWithinPartitions("rank", "conv_id")
    got = {r["rank"]: r["ends_sha256"] for r in trie.ends(ranks).collect()}
    assert got == {k: hashlib.sha256(",".join(str(c) for c in range(1000) if c % 2 + c // 500 == k).encode()).hexdigest() for k in range(3)}


# --- 13 Merkle manifest


def manifest_by_hand(rows):
    def of(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(r, text):
        fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return of("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields)

    def tree(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [of(nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
            out.append(nodes)
        return out

    def path(levels, i):
        for nodes in levels[:-1]:
            yield nodes[i - i % 3 : i], nodes[i + 1 : i - i % 3 + 3]
            i //= 3

    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for k in order:
        sources[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {k: tree([leaf(r, r["text"]) for r in sources[k]]) for k in order}
    top, out = tree([trees[k][-1][0] for k in order]), []
    for j, k in enumerate(order):
        for i, r in enumerate(sources[k]):
            steps, text = [*path(trees[k], i), *path(top, j)], r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for left, right in steps:
                folded = of([*left, folded, *right])
            proof = of(x for left, right in steps for x in left + right)
            out.append((r["doc_id"], trees[k][0][i], trees[k][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=nulls)


def tampered(docs, stride):
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(merkle.leaves(docs, {"text": text}), stride=stride)
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256), "folded_root", "verified").collect()), key=nulls)


def test_manifest_of_whole_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = manifest_by_hand(docs.collect())
    assert sorted((tuple(r) for r in queries.dataset_manifest(spark, SMALL).collect()), key=nulls) == want
    assert {r[-1] for r in want} == {True, False}
    assert tampered(docs, 1) == want


@pytest.mark.parametrize("stride", [1, 2, 6])
def test_manifest_of_odd_rows(spark, odd, none, stride):
    assert tampered(odd, stride) == manifest_by_hand(odd.collect())
    assert tampered(none, stride) == []
    assert tampered(odd.where("doc_id = 2"), stride) == manifest_by_hand(odd.where("doc_id = 2").collect())


def test_manifest_of_many_sources_and_of_none_altered(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST", 10)
    docs = spark.range(700).selectExpr("id AS doc_id", "concat('t ', id % 9) AS text", "'en' AS lang", "concat('s', cast(pow(id, 0.8) AS int)) AS source", "id AS n_chars")
    assert tampered(docs, 2) == manifest_by_hand(docs.collect())
    found = merkle.manifest(merkle.leaves(docs))
    assert found.where("not verified").count() == 0 and found.count() == 700
