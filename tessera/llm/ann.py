"""Approximate nearest neighbours by inner product on robust-pruned graphs, one for each shard.

Rows that repeat id and vector are one. They are dealt to shards of bounded size by a hash of both. In a shard, inner product is turned into
distance by one more coordinate that brings all vectors to one length; equal vectors are one node. Graphs are laid out
on vectors scaled to the shard's largest component, so that no square overflows; scores are of the vectors as they came.
The graph starts from a few random edges; twice, batch by batch, a greedy search for each node proposes
neighbours, and relaxed pruning keeps a candidate only if no kept one is nearer to it, by the
factor ALPHA, than the node is; back edges are added and pruned alike. A query searches the graph of
every shard with a beam, widened where too few different ids are in it, and exact scores in double precision merge what the shards found.
Every query looks at a shard's longest vectors as well. A shard of up to WHOLE nodes is compared whole.

A shard with its graph is one row of bytes, written to the shared folder. Each shard's task reads its own and is sent the
queries, one at a time in order after it; what crosses the network is the index once and, for each shard, the queries
and their k answers. A task holds one shard and QUERIES queries whatever the size of the tables.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; rows with the query's own vec_id are its own; equal scores go to the smaller
vec_id; rows repeating a candidate's vec_id count once, the largest score standing; fewer than k
candidates are all returned; a query id with several vectors is searched for with each, the largest score of a candidate standing;
empty tables give an empty result; other columns are not read. A score beyond the range of doubles is infinite.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import scratch

K = 20
#: Vectors in a shard, edges of a node, width of the beam when building and searching, relaxation.
SHARD, DEGREE, BEAM, ALPHA = 4096, 32, 64, 1.2
#: Queries searched together; nodes of a shard up to which all are compared.
QUERIES, WHOLE = 1024, 256
SEED = 7


def _search(vectors: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step: ids and distances of the ``beam`` nearest found, and all that was expanded is among them.

    Node len(vectors) stands for "none" at distance infinity.
    """
    n, q, width = len(vectors), len(queries), edges.shape[1]
    norms = np.append((vectors**2).sum(axis=1), np.float32(np.inf)).astype(np.float32)
    wide = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    ids = np.full((q, beam), n, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    ids[:, 0], dist[:, 0] = start, norms[start] - 2 * queries @ vectors[start]
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)
    seen[:, start] = seen[:, n] = True
    live = np.arange(q)
    while len(live):
        waiting = np.where(done[live] | (ids[live] == n), np.inf, dist[live])
        pick = waiting.argmin(axis=1)
        going = np.isfinite(waiting[np.arange(len(live)), pick])
        live, pick = live[going], pick[going]
        if not len(live):
            break
        done[live, pick] = True
        new = edges[ids[live, pick]]
        fresh = ~seen[live[:, None], new]
        new = np.where(fresh, new, n)
        seen[live[:, None], new] = True
        away = norms[new] - 2 * np.einsum("qwd,qd->qw", wide[new], queries[live])
        all_ids, all_dist = np.concatenate([ids[live], new], axis=1), np.concatenate([dist[live], away], axis=1)
        all_done = np.concatenate([done[live], np.zeros((len(live), width), bool)], axis=1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        ids[live], dist[live], done[live] = (np.take_along_axis(x, best, axis=1) for x in (all_ids, all_dist, all_done))
    return ids, dist


def _prune(vectors: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of a row of candidates for each node, ``len(vectors)`` standing for none."""
    n = len(vectors)
    wide = np.vstack([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    out = np.full((len(nodes), degree), n, np.int64)
    for at in range(0, len(nodes), 256):
        me, some = nodes[at : at + 256], np.sort(candidates[at : at + 256], axis=1)
        some[:, 1:][some[:, 1:] == some[:, :-1]] = n
        some[some == me[:, None]] = n
        points = wide[some]
        norms = (points**2).sum(axis=2)
        away = norms - 2 * np.einsum("qcd,qd->qc", points, wide[me]) + (wide[me] ** 2).sum(axis=1)[:, None]
        away[some == n] = np.inf
        order = np.argsort(away, axis=1)[:, : 3 * degree]
        some, away, norms = (np.take_along_axis(x, order, axis=1) for x in (some, away, norms))
        points = np.take_along_axis(points, order[:, :, None], axis=1)
        between = norms[:, :, None] + norms[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
        alive, kept, rows = np.isfinite(away), np.zeros(len(me), np.int64), np.arange(len(me))
        for c in range(some.shape[1]):
            take = rows[alive[:, c] & (kept < degree)]
            out[at + take, kept[take]] = some[take, c]
            kept[take] += 1
            alive[take] &= alpha * alpha * between[take, c] > away[take]
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph of a shard: a row of ``degree`` neighbours for each vector, and the node nearest the middle."""
    n, rng = len(vectors), np.random.default_rng(SEED)
    start = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, degree), n, np.int64)
    edges[:, : min(8, degree)] = rng.integers(0, n, (n, min(8, degree)))
    for relaxed in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, 512):
            me = order[at : at + 512]
            found, _ = _search(vectors, edges, start, vectors[me], beam)
            edges[me] = _prune(vectors, me, np.concatenate([found, edges[me]], axis=1), degree, relaxed)
            to, back = edges[me].ravel(), np.repeat(me, degree)
            back, to = back[to < n], to[to < n]
            by = np.argsort(to, kind="stable")
            to, back = to[by], back[by]
            whom, first, count = np.unique(to, return_index=True, return_counts=True)
            more = np.full((len(whom), int(count.max(initial=0))), n, np.int64)
            more[np.repeat(np.arange(len(whom)), count), np.arange(len(to)) - np.repeat(first, count)] = back
            edges[whom] = _prune(vectors, whom, np.concatenate([edges[whom], more], axis=1), degree, relaxed)
    return edges, start


def _scale(vectors: np.ndarray) -> float:
    """A power of two over all components."""
    return float(2.0 ** np.ceil(np.log2(np.abs(vectors).max())))


def _index(degree: int, beam: int, alpha: float):
    def run(x: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = x["vec_id"].to_numpy(np.int64), np.stack(x["embedding"])
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        nodes, member = np.unique(vectors, axis=0, return_inverse=True)
        member = member.ravel()
        by = np.argsort(member, kind="stable")
        # Equal vectors of one id that differ in the sign of a zero are left.
        by = by[np.append(True, (np.diff(member[by]) != 0) | (np.diff(ids[by]) != 0))]
        edges, start = np.zeros((0, degree), np.int32), 0
        if len(nodes) > WHOLE:
            edges, start = build(_lifted(nodes), degree, beam, alpha)
        raw = pickle.dumps((nodes, edges.astype(np.int32), start, ids[by], np.searchsorted(member[by], np.arange(len(nodes) + 1))), protocol=5)
        return pd.DataFrame({"shard": [int(x["shard"].iloc[0])], "index": [raw]})

    return run


def _lifted(nodes: np.ndarray) -> np.ndarray:
    """The scaled vectors with the coordinate that brings all to one length."""
    scaled = nodes.astype(np.float64) / _scale(nodes)
    square = (scaled**2).sum(axis=1)
    return np.column_stack([scaled, np.sqrt(np.maximum(square.max() - square, 0))]).astype(np.float32)


def _answer(k: int, beam: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, held = None, []
        for batch in batches:
            for raw, query, vector in zip(batch["index"], batch["vec_id"], batch["embedding"]):
                if raw is None:
                    held.append((int(query), vector))
                if held and (raw is not None or len(held) == QUERIES):
                    yield _answered(index, held, k, beam)
                    held = []
                if raw is not None:
                    nodes, edges, start, members, firsts = pickle.loads(raw)
                    index = (nodes, _lifted(nodes), edges.astype(np.int64), start, members, firsts)
        if held:
            yield _answered(index, held, k, beam)

    return run


def _answered(index: tuple, asked: list[tuple[int, np.ndarray]], k: int, beam: int) -> pd.DataFrame:
    """The k best of a shard for each query."""
    nodes, lifted, edges, start, members, firsts = index
    ids, queries = np.array([i for i, _ in asked], np.int64), np.stack([v for _, v in asked]).astype(np.float64)
    # What is nearest does not depend on a query's length.
    wide = np.column_stack([queries / np.abs(queries).max(axis=1)[:, None], np.zeros(len(queries))]).astype(np.float32)
    q, v, s = [], [], []
    todo, width = np.arange(len(ids)), max(beam, k + 1)
    whole = len(nodes) <= WHOLE
    # The longest vectors are looked at by every query: where lengths differ much, they are what is nearest to most.
    longest = np.sort(np.argsort(lifted[:, -1], kind="stable")[:beam])
    while len(todo):
        # A beam as wide as the shard is all of it.
        whole, again = whole or width >= len(nodes), []
        found, away = _search(lifted, edges, start, wide[todo], width) if not whole else (None, None)
        for at, i in enumerate(todo):
            near = np.arange(len(nodes)) if whole else np.union1d(found[at][np.isfinite(away[at])], longest)
            with np.errstate(over="ignore", invalid="ignore"):
                score = nodes[near].astype(np.float64) @ queries[i]
            # The smallest k + 1 ids of a node are enough: its members tie, and one may be the query.
            each = [members[firsts[m] : min(firsts[m + 1], firsts[m] + k + 1)] for m in near]
            some = np.concatenate(each) if each else np.zeros(0, np.int64)
            score = np.repeat(score, [len(e) for e in each])
            other = some != ids[i]
            some, score = some[other], score[other]
            order = np.lexsort((some, -score))
            # Of each id its best place only.
            best = order[np.sort(np.unique(some[order], return_index=True)[1])[:k]]
            if len(best) < k and not whole:
                again.append(i)
                continue
            q.append(np.full(len(best), ids[i]))
            v.append(some[best])
            s.append(score[best])
        todo, width = np.array(again, np.int64), 4 * width
    return pd.DataFrame({"query_id": np.concatenate(q), "vec_id": np.concatenate(v), "score": np.concatenate(s)})


def usable(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """vec_id and embedding, float or double as it comes, of the rows that take part: those of ``size`` components, by default the most common size."""
    kind = "array<double>" if dict(vectors.dtypes)["embedding"] != "array<float>" else "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    rows = rows.where("vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)")
    if size is None:
        sizes = rows.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
        size = sizes["n"] if sizes else 0
    return rows.where(F.size("embedding") == size)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` vectors of ``vectors`` found nearest to each of ``queries``."""
    spark = vectors.sparkSession
    sizes = usable(vectors).select(F.size("embedding")).first()
    rows, asked = (usable(x, sizes[0] if sizes else 0).dropDuplicates(["vec_id", "embedding"]) for x in (vectors, queries))
    n = rows.select("vec_id", F.xxhash64("embedding")).distinct().count()
    shards = max(1, -(-n // shard))
    path = scratch(spark, "shards")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))
    # A number of partitions that is asked for is not made smaller at run time: shards are built side by side.
    dealt = dealt.repartition(2 * shards, "shard")
    dealt.groupBy("shard").applyInPandas(_index(degree, beam, alpha), "shard int, index binary").write.parquet(path)
    index = spark.read.parquet(path)
    each = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = index.select("shard", "index", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast(asked.schema["embedding"].dataType).alias("embedding")).union(each.select("shard", F.lit(None).cast("binary"), "vec_id", "embedding"))
    # In each shard its index comes before the queries.
    both = both.repartition(2 * shards, "shard").sortWithinPartitions("shard", F.col("vec_id").asc_nulls_first())
    found = both.select("index", F.coalesce("vec_id", F.lit(0)).alias("vec_id"), "embedding").mapInPandas(_answer(k, beam), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: DataFrame, queries: DataFrame, k: int = K) -> list[tuple[int, int, int, float]]:
    """The same by comparing all, in the driver: for tests and for measuring recall on small tables."""
    sizes = usable(vectors).select(F.size("embedding")).first()
    rows, asked = (usable(x, sizes[0] if sizes else 0).toPandas() for x in (vectors, queries))
    out = []
    if len(rows) and len(asked):
        ids, all_ = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(np.float64)
        for q, v in zip(asked["vec_id"], asked["embedding"]):
            score = all_ @ np.asarray(v, np.float64)
            best = np.lexsort((ids, -score))
            best = best[ids[best] != q]
            best = best[np.sort(np.unique(ids[best], return_index=True)[1])[:k]]
            out += [(int(q), r + 1, int(ids[b]), float(score[b])) for r, b in enumerate(best)]
    return out
