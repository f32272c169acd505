"""A Merkle manifest of a data set by Pregel-style supersteps.

Every row is a leaf, the SHA-256 of its fields. The leaves of a source, in ascending order, are nodes; every ``ARITY``
consecutive ones become their hash until one remains, the source's subroot. The subroots, in order of their sources,
become the root in the same way.

A vertex is a block of the tree, ``STRIDE`` levels high: it holds its lowest nodes in order. In an upward superstep the
vertices that have all their children hash them and message their top to the block above, or, if that is a
subroot, to the blocks over the sources. In the reverse supersteps each vertex messages to each of its children the path
from there to the root, which is its own part of it and what came from above. At the leaves the path
arrives whole: each leaf is folded along it, as it is now, and compared with the root.

Places in a source come from a sort and prefix sums (``_runs``), so a source of any size lies in as many tasks as its
rows ask for. A vertex holds at most ``ARITY ** STRIDE`` nodes. Vertices are checkpointed, and texts are read once, where the
leaves are hashed; what is shuffled is digests.

Defined results: a null field counts as such, apart from an empty one; a null source is a source of its own and comes first, null ids come first
in theirs; rows that share an id are ordered by their leaf, equal rows are neighbours, each with a place of its own;
an empty table gives no rows; other columns are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import groupby

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import durable, shared_dir
from tessera.llm._runs import running

ARITY, STRIDE = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of the table of sources up to which it is broadcast.
BROADCAST = 200_000


def leaf(fields: list[Column]) -> Column:
    """Hash of the fields, each as its bytes in UTF-8, a colon and its value, or ``-``."""
    told = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in told]), 256)


def leaves(docs: DataFrame, now: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``doc_id``, ``source``, ``leaf`` and ``now``, the leaf with some fields as they are said to be now (null if it is the same)."""
    old = leaf([F.col(f) for f in fields])
    new = leaf([(now or {}).get(f, F.col(f)) for f in fields]) if now else old
    return docs.select("doc_id", "source", old.alias("leaf"), F.nullif(new, old).alias("now"))


# --- the tree within a block


def _hash(run: list[bytes]) -> bytes:
    return sha256(b"".join(run)).hexdigest().encode()


def levels(nodes: list[bytes], size: int, arity: int, stride: int) -> list[list[bytes]]:
    """A block's nodes and the levels over them; ``size`` is how many nodes the whole level has, and where one is left there is none above."""
    out = [nodes]
    while size > 1 and len(out) <= stride:
        nodes = [_hash(nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        size = -(-size // arity)
        out.append(nodes)
    return out


def siblings(tree: list[list[bytes]], place: int, arity: int) -> list[tuple[bytes, bytes]]:
    """Of a node in a block what stands left and right of it in its run, level by level."""
    out = []
    for nodes in tree[:-1]:
        at = place - place % arity
        out.append((b"".join(nodes[at:place]), b"".join(nodes[place + 1 : at + arity])))
        place //= arity
    return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        digest = _hash([left, digest, right])
    return digest


# --- supersteps


def _kept(rdd: RDD) -> RDD:
    rdd.persist(StorageLevel.DISK_ONLY)
    rdd.checkpoint()
    return rdd


def _packed(width: int):
    """Rows (group, place, size, state) to pieces of blocks; those of a block that follow one another are one piece."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, some in groupby(rows, lambda r: (r[0], r[1] // width)):
            some = list(some)
            yield key, (some[0][2], [(r[1] % width, r[3]) for r in some])

    return run


def _vertex(pieces: Iterable[tuple]) -> tuple:
    """Pieces of a block to (size of its level, states in order)."""
    pieces = list(pieces)
    return pieces[0][0], [state for _, state in sorted((x for p in pieces for x in p[1]), key=lambda x: x[0])]


def _digest(state) -> bytes:
    return state if isinstance(state, bytes) else state[1]


class Supersteps:
    def __init__(self, parts: int, arity: int = ARITY, stride: int = STRIDE):
        self.parts, self.arity, self.stride, self.width = parts, arity, stride, arity**stride

    def vertices(self, rows: RDD) -> RDD:
        return _kept(rows.mapPartitions(_packed(self.width)).groupByKey(self.parts).mapValues(_vertex))

    def upward(self, rows: RDD, largest: int) -> tuple[list[RDD], RDD]:
        """Vertices of each superstep, and (group, (top, superstep)) of the groups."""
        arity, stride, width = self.arity, self.stride, self.width
        steps, tops = [], []
        while True:
            now = self.vertices(rows)
            steps.append(now)
            step = len(steps) - 1

            def top(kv):
                (group, block), (size, states) = kv
                return group, block, size, levels([_digest(s) for s in states], size, arity, stride)[-1][0]

            sent = now.map(top)
            tops.append(sent.filter(lambda r: r[2] <= width).map(lambda r, step=step: (r[0], (r[3], step))))
            if largest <= width:
                break
            rows = sent.filter(lambda r: r[2] > width).map(lambda r: (r[0], r[1], -(-r[2] // width), r[3]))
            largest = -(-largest // width)
        return steps, rows.context.union(tops) if len(tops) > 1 else tops[0]

    def downward(self, steps: list[RDD], entries: RDD):
        """Hand paths down. ``entries``: (group, superstep, what came from above); yields for each lowest node (group, place, state, its path in the group, what came)."""
        arity, stride, width, parts = self.arity, self.stride, self.width, self.parts
        above = None
        for step in range(len(steps) - 1, -1, -1):
            messages = entries.filter(lambda r, step=step: r[1] == step).map(lambda r: ((r[0], 0), ([], r[2])))
            if above is not None:
                messages = messages.union(above)

            def hand(kv, step=step):
                (group, block), ((size, states), (path, came)) = kv
                tree = levels([_digest(s) for s in states], size, arity, stride)
                for k, state in enumerate(states):
                    own = siblings(tree, k, arity) + path
                    yield ((group, block * width + k), (own, came)) if step else (group, block * width + k, size, state, own, came)

            above = steps[step].join(messages, parts).flatMap(hand)
        return above


def manifest(found: DataFrame, arity: int = ARITY, stride: int = STRIDE) -> DataFrame:
    """Of every leaf its place and proof, and what it comes to now.

    ``found`` is what ``leaves`` gives. Columns: ``doc_id``, ``source_nth``, ``place`` and ``size`` (of the source), ``leaf``, ``subroot``,
    ``root``, ``proof`` (its siblings from the leaf to the root, left to right, 64 digits each, in one text), ``folded_root``, ``verified``.
    """
    spark = found.sparkSession
    shared_dir(spark)
    held = durable(found.withColumns({"__uid": F.monotonically_increasing_id(), "__one": F.lit(1).cast("long")}))
    placed = running(held, ["source"], ["doc_id", "leaf", "__uid"], ["__one"])
    sizes = durable(placed.groupBy("__nth").agg(F.count(F.lit(1)).alias("__size")))
    told = sizes.agg(F.count(F.lit(1)).alias("n"), F.max("__size").alias("most")).first()
    kind = found.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source_nth long, place long, size long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
    if not told["n"]:
        return spark.createDataFrame([], schema)
    rows = placed.join(F.broadcast(sizes) if told["n"] <= BROADCAST else sizes, "__nth")
    rows = rows.select("__nth", (F.col("run___one") - 1).alias("place"), "__size", "doc_id", "leaf", "now")
    states = rows.rdd.map(lambda r: (r[0], r[1], r[2], (r[3], r[4].encode(), r[5] and r[5].encode())))
    steps = Supersteps(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), arity, stride)

    low, tops = steps.upward(states, told["most"])
    n = told["n"]
    over, roots = steps.upward(tops.map(lambda r: (0, r[0], n, (r[1][1], r[1][0]))), n)
    root, last = roots.first()[1]
    # From the root to the sources, and from there to the leaves.
    entries = steps.downward(over, over[0].context.parallelize([(0, last, None)], 1))
    entries = entries.map(lambda r: (r[1], r[3][0], (r[3][1], r[4])))
    proofs = steps.downward(low, _kept(entries))

    def told_of(r):
        group, place, size, (doc_id, was, now), own, (subroot, above) = r
        path = own + above
        proof = b"".join(left + right for left, right in path).decode()
        folded = fold(now or was, path)
        return doc_id, group, place, size, was.decode(), subroot.decode(), root.decode(), proof, folded.decode(), folded == root

    return spark.createDataFrame(proofs.map(told_of), schema, verifySchema=False)
