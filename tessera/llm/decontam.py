"""Benchmark decontamination by spaced seeds.

A seed reads the words at the positions its mask keeps and ignores the others. The two masks are chosen so
that any WINDOW words in a row, two of them substituted at any places, hold an intact seed (tested
by trying all pairs). Seeds of training texts are joined by hash to those of the benchmark; each hit
names a diagonal (place in the document less place in the item), and around it the words are compared
one by one. A document holds an item's passage if on some diagonal WINDOW words in a row (the whole
item, if that is shorter) agree in at least SIMILAR of their places. Items under SPAN words must agree in all.

Items under WINDOW words are searched for by pieces too, words in a row: the whole item under SPAN words, else one
disjoint piece more than SIMILAR allows substitutions, of which one is intact. Documents are read for
the lengths of pieces that the benchmark has, so that without short items this costs nothing.

All of it is built-in functions on the JVM: positions and masks are exploded inside generated code, and
only seeds that are also the benchmark's leave it. Documents are read again for the few hits, by a join with
their keys, which are broadcast up to BROADCAST of them; only beyond does text cross the network, in that join.

Defined results: null or empty texts hold nothing and give no row; items without words are not searched for; repeated documents and items
each give their rows, once for each pair of ids; empty tables give an empty result; other columns of
the inputs are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import durable, held, row_key, unpacked

#: Positions that each mask keeps. Fixed values, found by search.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
WINDOW, SIMILAR = 13, 0.8
#: Benchmark seeds (24 bytes each) and keys of documents found up to which they are broadcast; beyond, the joins shuffle.
BROADCAST = 2_000_000
#: Marks taken off the ends of words.
MARKS = ".,;:!?()[]{}<>*_|#~-+=/&%$@^`\""


def words(text: str) -> F.Column:
    """The words of a text, as hashes: parted by white space, marks at their ends taken off, lower case.

    Cutting at a plain space and trimming word by word costs far less than a pattern of letter classes.
    """
    spaced = f"replace(replace(replace(coalesce({text}, ''), '\n', ' '), '\t', ' '), '\r', ' ')"
    plain = f"transform(split({spaced}, ' '), w -> trim(BOTH '{MARKS}' FROM w))"
    return F.expr(f"transform(filter({plain}, w -> w <> ''), w -> xxhash64(lower(w)))")


def seeds(rows: DataFrame) -> DataFrame:
    """Of rows with ``words`` and other columns: all columns but words, and ``at``, ``seed``, for every position and mask.

    Too few words give no positions; that is said in the sequence, since a filter would be pushed below
    the words and have them made twice.
    """
    kept = [c for c in rows.columns if c != "words"]
    places = F.when(F.size("words") >= SPAN, F.sequence(F.lit(0), F.size("words") - SPAN))
    at = rows.select(*kept, "words", F.explode(places).alias("at"))
    hashes = [F.xxhash64(F.lit(k), *[F.get("words", F.col("at") + F.lit(p)) for p in mask]) for k, mask in enumerate(MASKS)]
    return at.select(*kept, "at", F.explode(F.array(*hashes)).alias("seed"))


def pieces(n: int) -> list[tuple[int, int]]:
    """Place and length of the pieces of an item of ``n`` words."""
    if n >= WINDOW:
        return []
    if n < SPAN:
        return [(0, n)]
    m = n - math.ceil(SIMILAR * n - 1e-9) + 1
    size = min(4, n // m)
    return [(k * size, size) for k in range(m)]


def _piece(length: int) -> F.Column:
    return F.xxhash64(F.lit(-length), *[F.get("words", F.col("at") + F.lit(p)) for p in range(length)])


def short_hits(texts: DataFrame, items: DataFrame) -> DataFrame | None:
    """Key of the row, item_id and diagonal where a piece of a short item stands; None if the benchmark has no short items.

    A whole item is a match as it stands: its first place in a document is enough.
    """
    sizes = [r[0] for r in items.select(F.size("words").alias("n")).where(f"n between 1 and {WINDOW - 1}").distinct().collect()]
    if not sizes:
        return None
    lengths = sorted({size for n in sizes for _, size in pieces(n)})
    where = F.coalesce(*[F.when(F.size("words") == n, F.array(*[F.struct(F.lit(a).alias("at"), F.lit(b).alias("length")) for a, b in pieces(n)])) for n in sizes])
    each = items.withColumn("whole", F.size("words") < SPAN).select("item_id", "words", "whole", F.explode(where).alias("p")).select("item_id", "words", "whole", "p.at", "p.length")
    keys = each.select("item_id", F.col("at").alias("item_at"), "whole", F.coalesce(*[F.when(F.col("length") == x, _piece(x)) for x in lengths]).alias("seed")).distinct()
    places = F.when(F.size("words") >= lengths[0], F.sequence(F.lit(0), F.size("words") - lengths[0]))
    at = texts.select("__key0", "__key1", "words", F.explode(places).alias("at"))
    found = at.select("__key0", "__key1", "at", F.explode(F.array(*[F.when(F.col("at") + x <= F.size("words"), _piece(x)) for x in lengths])).alias("seed"))
    if keys.count() <= BROADCAST:
        keyed = keys.groupBy("seed").agg(F.collect_list(F.struct("item_id", "item_at", "whole")).alias("places"))
        hits = found.join(F.broadcast(keyed), "seed").select("__key0", "__key1", "at", F.explode("places").alias("p")).select("__key0", "__key1", "at", "p.*")
    else:
        hits = found.join(keys, "seed")
    hits = hits.select("__key0", "__key1", "item_id", "whole", (F.col("at") - F.col("item_at")).alias("diagonal"))
    return hits.groupBy("__key0", "__key1", "item_id", F.when(~F.col("whole"), F.col("diagonal")).alias("each")).agg(F.min("diagonal").alias("diagonal")).drop("each")


KEY = ["__key0", "__key1"]


def _keys() -> list[F.Column]:
    """A key of id and text: ids may be null, or those of several documents."""
    return [k.alias(name) for name, k in zip(KEY, row_key([F.col("doc_id"), F.col("text")]))]


def _some(keys: DataFrame) -> DataFrame:
    """Keys of the few documents found, 16 bytes each: broadcast up to BROADCAST of them, so that no text is shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def _passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Key and id of the document, item and ``starts`` and ``sums`` of every diagonal on which it holds the item's passage."""
    items = durable(benchmark.select("item_id", words("text").alias("words")).distinct())
    keys = items.transform(seeds).select("item_id", F.col("at").alias("item_at"), "seed").distinct()
    docs = docs.select("doc_id", "text", *_keys())
    texts = docs.select("__key0", "__key1", words("text").alias("words"))
    keyed = keys.groupBy("seed").agg(F.collect_list(F.struct("item_id", "item_at")).alias("places"))
    small = keys.count() <= BROADCAST
    if not small:
        # Very common seeds stay apart, so that no list of places grows without bound.
        hits = texts.transform(seeds).join(keys, "seed")
    else:
        hits = texts.transform(seeds).join(F.broadcast(keyed), "seed").select("__key0", "__key1", "at", F.explode("places").alias("p")).select("__key0", "__key1", "at", "p.item_id", "p.item_at")
    hits = hits.select("__key0", "__key1", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"))
    short = short_hits(texts, items)
    diagonals = durable((hits if short is None else hits.unionByName(short)).distinct())
    found = docs.join(_some(diagonals.select(*KEY).distinct()), KEY, "left_semi").select("doc_id", "__key0", "__key1", words("text").alias("words"))
    both = diagonals.join(found, KEY).join(items.select("item_id", F.col("words").alias("item")), "item_id")
    # Only the part of the document beside the item is carried on.
    both = both.select("doc_id", "__key0", "__key1", "item_id", "diagonal", "item", F.expr("transform(item, (w, i) -> i + diagonal >= 0 and w <=> get(words, i + diagonal))").alias("same"))
    size = f"least({WINDOW}, size(item))"
    need = f"if(size(item) < {SPAN}, size(item), ceil({SIMILAR} * {size} - 1e-9))"
    sums = "aggregate(same, named_struct('n', 0, 'all', array(0)), (a, x) -> named_struct('n', a.n + int(x), 'all', concat(a.all, array(a.n + int(x)))), a -> a.all)"
    both = both.withColumn("sums", F.expr(sums))
    both = both.withColumn("starts", F.expr(f"filter(sequence(0, size(item) - {size}), s -> sums[s + {size}] - sums[s] >= {need})")).where("size(starts) > 0")
    return both


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it holds a passage of: doc_id, item_id, matched (words that agree on
    the best diagonal), doc_start and item_start (word places of that diagonal's first agreeing window), windows."""
    both = _passages(docs, benchmark)
    best = both.select("doc_id", "item_id", F.expr("struct(element_at(sums, -1) as matched, -diagonal as d, -starts[0] as s, size(starts) as n)").alias("b")).groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return best.selectExpr("doc_id", "item_id", "cast(b.matched as bigint) as matched", "cast(- b.s - b.d as bigint) as doc_start", "cast(- b.s as bigint) as item_start", "cast(b.n as bigint) as windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark."""
    bad = durable(_passages(docs, benchmark).select(*KEY).distinct())
    return unpacked(held(docs, *_keys()).join(_some(bad), KEY, "left_anti"), docs.columns)
