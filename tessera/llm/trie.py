"""The trie of all prefixes of conversations, by preorder intervals.

A conversation is a row a turn: ``conv_id``, ``depth`` (from 1; the row of depth 0 stands for the conversation itself), ``digest`` (32 hex digits of
role and text) and ``chars``. A node is a distinct prefix; its key is the exclusive or of hashes of depth and digest up to there, 128 bits,
so that prefixes of a conversation of any length are keyed by prefix sums (``_runs``).

Whole conversations are ranked in lexicographic order of their digests: ``CHUNK`` turns are one text, the distinct texts are
ranked by a sort, and ranks take the place of turns until each conversation is one rank. The members of a node are
neighbours in this order, from its first rank to its last. A node stands in preorder by its first rank and its depth, and its
subtree ends where the nodes of its last rank end. Numbers of nodes, leaves and tokens up to each place are prefix
sums, and what a subtree holds is a difference of two of them.

Defined results: a null role or text counts as empty; a null turn comes first; turns of one number are ordered by their digest, and rows that repeat are
turns of their own; rows without a ``conv_id`` belong to no conversation; a conversation may have no turns, and is then a
member of the root alone; an empty table gives no nodes; other columns are not read. Remainders of negative ids are those of SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import durable
from tessera.llm._runs import running

CHUNK = 64
#: Bytes of ids in a piece of a list of members.
PIECE = 1 << 16
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def turns(talks: DataFrame) -> DataFrame:
    """``conv_id``, ``depth``, ``digest`` and ``chars`` of every turn, the turns of a conversation numbered in their order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    own = talks.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("n"))
    own = durable(own.withColumn("uid", F.monotonically_increasing_id()))
    return running(own, ["conv_id"], ["turn", "digest", "uid"], ["n"]).select("conv_id", F.col("run_n").alias("depth"), "digest", "chars")


def rooted(own: DataFrame) -> DataFrame:
    """Conversations as they are, with the row of depth 0 for each."""
    return own.unionByName(_roots(own.select("conv_id").distinct()))


def _roots(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("chars"))


def rebuilt(own: DataFrame, of: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % ``of`` in place of its own first h; h is the CRC-32 of c modulo ``most``."""
    own = durable(own)
    sizes = own.groupBy("conv_id").agg(F.max("depth").alias("n"))
    c = F.col("conv_id")
    convs = sizes.select("conv_id", (c - c % of).alias("base"), (F.crc32(c.cast("string")) % most).alias("h"))
    bases = sizes.where(c % of == 0).select(c.alias("base"), F.col("n").alias("base_n"))
    convs = durable(convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n"))
    lead = own.where((c % of == 0) & (F.col("depth") < most)).withColumnRenamed("conv_id", "base")
    first = convs.join(lead, "base").where("depth <= k").select("conv_id", "depth", "digest", "chars")
    after = own.join(convs.select("conv_id", "h", "k"), "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"), "digest", "chars")
    return first.unionByName(after).unionByName(_roots(convs))


def ranked(talks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv_id`` and ``rank``, the number of lesser distinct sequences, in ascending order of both; ``talks`` has a row of depth 0 for each conversation.

    A sequence comes before those that it begins.
    """
    items = talks.select("conv_id", F.greatest(F.col("depth") - 1, F.lit(0)).alias("place"), F.coalesce("digest", F.lit("")).alias("unit"))
    while True:
        # A conversation's row of depth 0 falls in its first chunk and adds nothing.
        told = F.transform(F.sort_array(F.collect_list(F.struct("place", "unit"))), lambda x: x["unit"])
        items = durable(items.groupBy("conv_id", F.floor(F.col("place") / chunk).cast("long").alias("place")).agg(F.array_join(told, "").alias("unit")))
        longest = items.agg(F.max("place").alias("m")).first()["m"]
        placed = running(items, ["unit"], ["conv_id", "place"])
        if not longest:
            return placed.select("conv_id", F.col("__nth").alias("rank"))
        items = placed.select("conv_id", "place", F.lpad(F.hex(F.col("__nth") + 1), 16, "0").alias("unit"))


def ends(ranks: DataFrame) -> DataFrame:
    """Of each rank the SHA-256 of its conversations' ids, ascending, joined by commas.

    Ids are first joined to pieces where they lie, in order; a rank's pieces then go through one hash, one after the other.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rank", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        rank, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for c, r in zip(batch.column("conv_id").to_pylist(), batch.column("rank").to_pylist()):
                if r != rank or size > PIECE:
                    if ids:
                        out.append((rank, first, ",".join(ids)))
                    rank, first, ids, size = r, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], schema=schema)
        if ids:
            yield pa.RecordBatch.from_pylist([{"rank": rank, "first": first, "ids": ",".join(ids)}], schema=schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        schema = pa.schema([("rank", pa.int64()), ("ends_sha256", pa.string())])
        rank, now = None, None
        for batch in batches:
            out = []
            for r, ids in zip(batch.column("rank").to_pylist(), batch.column("ids").to_pylist()):
                if r == rank:
                    now.update(b"," + ids.encode())
                    continue
                if rank is not None:
                    out.append((rank, now.hexdigest()))
                rank, now = r, sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], schema=schema)
        if rank is not None:
            yield pa.RecordBatch.from_pylist([{"rank": rank, "ends_sha256": now.hexdigest()}], schema=schema)

    cut = ranks.mapInArrow(pieces, "rank long, first long, ids string")
    return cut.repartition("rank").sortWithinPartitions("rank", "first").mapInArrow(hashes, "rank long, ends_sha256 string")


def trie(talks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row a node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``,
    and its interval, ``preorder`` up to before ``subtree_end``. ``talks`` has a row of depth 0 for each conversation."""
    talks = durable(talks)
    root = F.col("depth") == 0
    keys = {f"k{i}": F.when(root, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(i), "depth", "digest")) for i in range(2)}
    keyed = running(talks.withColumns(keys), ["conv_id"], ["depth"], [], ["k0", "k1"])
    ranks = durable(ranked(talks, chunk))
    member = keyed.join(ranks, "conv_id")
    above = [F.col(f"run_k{i}").bitwiseXOR(F.col(f"k{i}")).alias(f"above{i}") for i in range(2)]
    member = member.select("conv_id", "depth", "chars", "rank", "run_k0", "run_k1", *above)
    nodes = durable(
        member.groupBy("run_k0", "run_k1", "depth").agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("rank").alias("first"), F.max("rank").alias("last"),
            F.max("chars").alias("chars"), F.max("above0").alias("above0"), F.max("above1").alias("above1"),
        )
    )
    below = F.col("depth") - 1
    kids = nodes.where("depth > 0").groupBy(F.col("above0").alias("run_k0"), F.col("above1").alias("run_k1"), below.alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("run_k0").alias("above0"), F.col("run_k1").alias("above1"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    # A conversation's own node is the deepest of those that its rank is the first of.
    own = ranks.join(talks.groupBy("conv_id").agg(F.max("depth").alias("depth")), "conv_id").groupBy(F.col("rank").alias("first")).agg(F.max("depth").alias("depth"))
    own = own.join(ends(ranks).withColumnRenamed("rank", "first"), "first")
    told = nodes.join(kids, ["run_k0", "run_k1", "depth"], "left").join(parents, ["above0", "above1", "depth"], "left").join(own, ["first", "depth"], "left")
    n = F.coalesce("n_children", F.lit(0)).cast("long")
    told = told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", n.alias("n_children"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "first", "last",
        F.lit(1).cast("long").alias("node"), F.when(n == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    placed = durable(running(told, [], ["first", "depth"], ["node", "leaf", "saved"]))
    # Sums do not fall along the order, so those at a rank's last node are its largest.
    upto = placed.groupBy(F.col("first").alias("last")).agg(*[F.max(f"run_{c}").alias(f"end_{c}") for c in ("node", "leaf", "saved")])
    return placed.join(upto, "last").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("end_leaf") - F.col("run_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("end_saved") - F.col("run_saved") + F.col("saved")).alias("saved_tokens"),
        "ends_sha256", (F.col("run_node") - 1).alias("preorder"), F.col("end_node").alias("subtree_end"),
    )
