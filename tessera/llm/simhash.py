"""Near-duplicate detection with SimHash fingerprints and covering locality-sensitive hashing.

Every bit of the 64-bit fingerprint is given a nonzero vector of F2^4, in turn. For each of the 15
nonzero vectors v there is a table; its mask keeps the bits whose vector has an odd product with v.
Three differing bits span at most three dimensions, so some v is orthogonal to all of them: its mask
keeps none of them, and the two fingerprints collide in its table. No pair within the radius is lost.

Defined results: a null text counts as empty; a text without words has fingerprint zero and is
linked like any other; equal rows and repeated ids keep their rows and share a component; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import components, durable, give_back, held, row_key, unpacked

RADIUS = 3
WORDS = 3
SEED = 42
#: A bucket with up to this many fingerprints has its pairs compared; larger ones go by hubs, which is exact too.
PAIRED = 512
#: Shingles hashed at a time, so that a very long text needs bounded memory.
BLOCK = 1 << 18


def masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 masks, as unsigned 64-bit integers."""
    vectors = range(1, 2 ** (radius + 1))
    return [sum(1 << i for i in range(64) if (vectors[i % len(vectors)] & v).bit_count() % 2) for v in vectors]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        some = parts[at : min(at + BLOCK, n) + words - 1]
        hashes = np.array([digest(b" ".join(x), SEED) for x in zip(*(some[k:] for k in range(min(words, len(some)))))], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        yield x.drop(columns="text").assign(fp=np.array([fingerprint(t) for t in x["text"]], np.uint64).view(np.int64))
    give_back()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long, ``fp``, of every row."""
    # A null id would make the whole column one of floats in pandas.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "text")
    return rows.mapInPandas(_prints, "doc_id long, none boolean, fp long").select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "fp")


def links(prints: DataFrame, radius: int = RADIUS, paired: int = PAIRED) -> DataFrame:
    """Links ``a``, ``b`` that join the distinct fingerprints ``fp`` just as all pairs within the radius do.

    In a bucket of at most ``paired`` fingerprints every pair within the radius is a link, given once,
    in the first table in which it collides. The fingerprints of larger buckets are joined through
    hubs: any two within distance 3 have a word z within 1 of the one and 2 of the other, and the
    smallest fingerprint within 1 of z is within 3 of all those within 2 of it. That needs a fixed
    number of rows for each fingerprint, whatever the bucket's size, and loses no connection.
    """
    if radius != 3:
        raise ValueError("the hubs are laid out for radius 3")
    table = [signed(x) for x in masks(radius)]
    rows = prints.select("fp", F.posexplode(F.array(*[F.lit(x) for x in table])).alias("k", "mask")).select("fp", "k", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = rows.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = durable(rows.join(sizes, ["k", "key"]))
    some = shared.where(F.col("n") <= paired)
    x, y = some.select("k", "key", F.col("fp").alias("a")), some.select("k", "key", F.col("fp").alias("b"))
    before = " and ".join(f"(k <= {i} or ((a ^ b) & {m}L) <> 0)" for i, m in enumerate(table[:-1]))
    pairs = x.join(y, ["k", "key"]).where(f"a < b and bit_count(a ^ b) <= {radius} and {before}").select("a", "b")
    crowded = shared.where(F.col("n") > paired).select("fp").distinct()
    if crowded.isEmpty():
        return pairs
    bits = [1 << i for i in range(64)]
    one = F.array(F.lit(0), *[F.lit(signed(x)) for x in bits])
    near = crowded.select("fp", F.explode(one).alias("d")).select("fp", F.col("fp").bitwiseXOR(F.col("d")).alias("z"))
    hubs = near.groupBy("z").agg(F.min("fp").alias("a"))
    far = near.select("fp", "z", F.explode(one).alias("d")).select(F.col("fp").alias("b"), F.col("z").bitwiseXOR(F.col("d")).alias("z"))
    return pairs.union(far.join(hubs, "z").where("a <> b").select("a", "b").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row.

    Equal fingerprints are first joined to one node by a partial aggregate, so a group of copies of
    any size is one row in all that follows.
    """
    prints = durable(fingerprints(docs))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = _rooted(nodes)
    groups = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(groups, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(nodes: DataFrame) -> DataFrame:
    """``nodes``, which have distinct ``fp`` and ``least``, with the root of the component of each."""
    roots = durable(components(links(nodes.select("fp"))))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest doc_id, a null id after all others.

    Among rows that share this id in a component the smallest hash of all columns decides; equal rows are
    one. Rows that share an id in different components are different documents, and each may stay.
    """
    keys = [k.alias(f"__key{i}") for i, k in enumerate(row_key([F.col(f"`{c}`") for c in docs.columns]))]
    keyed = held(docs, "text", F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), *keys)
    prints = keyed.drop("__row").mapInPandas(_prints, "none boolean, doc_id long, __key0 long, __key1 long, fp long")
    nodes = durable(prints.groupBy("fp").agg(F.min(F.struct("none", "doc_id", "__key0", "__key1")).alias("least")))
    keep = _rooted(nodes).groupBy("root").agg(F.min("least").alias("least")).select("least.__key0", "least.__key1")
    kept = keyed.select("__row", "__key0", "__key1").join(keep, ["__key0", "__key1"], "left_semi")
    return unpacked(kept.dropDuplicates(["__key0", "__key1"]), docs.columns)
