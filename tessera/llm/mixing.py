"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's share of all tokens (words parted by white space) is raised to an exponent and normalised.
The exponent is bisected: 1 keeps the shares, 0 makes them equal, and the smallest exponent stands that
keeps the entropy of the weights at or below ``entropy`` (a part of the entropy of equal shares, if
given) and the passes over any one source at or below ``repeats``. The budget of tokens is the smallest
with which every source is seen whole once, unless ``budget`` says otherwise.

A source with b tokens of budget and n of its own is passed floor(b / n) times whole. What remains is
drawn by blocks: a hash deals its documents to blocks, another hash orders the blocks, whole blocks are
taken while they fit the rest of the budget, and the block at the edge gives its documents, in hash
order, while they fit. Only sums by source and by block are moved, never a source as a whole.

Defined results: a null source is a source of its own; a null or empty text has no tokens and is seen
in every whole pass; repeated rows are dealt together; if there are no tokens at all, every row is seen
once; an empty table gives an empty result; other columns of the input are kept by ``mix`` alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import durable, held, unpacked

REPEATS = 1.25
#: Blocks of a source at most; fewer if blocks would fall under BLOCK tokens.
BLOCKS, BLOCK = 4096, 100_000
SEED = 17
#: Rows of the tables of sources and blocks up to which they are broadcast.
BROADCAST = 200_000


def weights(shares: dict, exponent: float) -> dict:
    top = max(shares.values(), default=1)
    raised = {k: math.exp(exponent * math.log(v / top)) if v else 0.0 for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()} if total else raised


def entropy(of: dict) -> float:
    return -sum(v * math.log(v) for v in of.values() if v)


def passes(tokens: dict, w: dict, budget: float | None = None) -> dict:
    """Passes over each source; the default budget sees every source whole once."""
    if budget is None:
        budget = max((tokens[k] / w[k] for k in tokens if w[k]), default=0)
    return {k: budget * w[k] / n if n else 1.0 for k, n in tokens.items()}


def solve(tokens: dict, target: float | None = None, repeats: float | None = REPEATS, budget: float | None = None, steps: int = 60) -> float:
    """The smallest exponent between 0 and 1 that meets the limits, by bisection."""
    live = {k: v for k, v in tokens.items() if v}
    most = math.log(len(live)) if len(live) > 1 else 0.0

    def fits(x: float) -> bool:
        w = weights(live, x)
        return (target is None or entropy(w) <= target * most + 1e-12) and (repeats is None or max(passes(live, w, budget).values()) <= repeats + 1e-12)

    if not live or fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def _counted(docs: DataFrame) -> DataFrame:
    """A word is a run of other bytes than white space: each starts the text or follows white space."""
    return docs.withColumn("__tokens", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")).cast("long"), F.lit(0).cast("long")))


def _solve_at_scale(sources: DataFrame, target: float | None, repeats: float | None, budget: float | None, steps: int = 60) -> float:
    """``solve`` for more sources than the driver should hold: each step of the bisection is an aggregate over the table of sources."""
    live = sources.where("tokens > 0")
    top, most = live.agg(F.max("tokens"), F.log(F.count(F.lit(1)))).first()

    def fits(x: float) -> bool:
        raised = F.exp(F.lit(x) * F.log(F.col("tokens") / F.lit(top)))
        z, spread, scarce, dense = live.select("tokens", raised.alias("r")).agg(F.sum("r"), F.sum(F.when(F.col("r") > 0, F.col("r") * F.log("r"))), F.max(F.col("tokens") / F.col("r")), F.max(F.col("r") / F.col("tokens"))).first()
        seen = (scarce if budget is None else budget / z) * dense
        return (target is None or math.log(z) - (spread or 0.0) / z <= target * most + 1e-12) and (repeats is None or seen <= repeats + 1e-12)

    if top is None or fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def plan(docs: DataFrame, target: float | None = None, repeats: float | None = REPEATS, budget: float | None = None) -> DataFrame:
    """One row for each source: source, tokens, weight, passes. Up to BROADCAST sources are gathered to solve."""
    spark = docs.sparkSession
    sources = durable(_counted(docs.select("source", "text")).groupBy("source").agg(F.sum("__tokens").alias("tokens")))
    if sources.count() <= BROADCAST:
        tokens = {r["source"]: r["tokens"] for r in sources.collect()}
        live = {k: v for k, v in tokens.items() if v}
        w = weights(live, solve(tokens, target, repeats, budget))
        seen = passes(live, w, budget)
        return spark.createDataFrame([(k, n, float(w.get(k, 0.0)), float(seen.get(k, 1.0))) for k, n in tokens.items()], "source string, tokens long, weight double, passes double")
    x = _solve_at_scale(sources, target, repeats, budget)
    top = sources.agg(F.max("tokens")).first()[0] or 1
    raised = sources.withColumn("r", F.when(F.col("tokens") > 0, F.exp(F.lit(x) * F.log(F.col("tokens") / F.lit(top)))).otherwise(0.0))
    z, scarce = raised.agg(F.sum("r"), F.max(F.when(F.col("r") > 0, F.col("tokens") / F.col("r")))).first()
    whole = (scarce or 0.0) * z if budget is None else budget
    weight = F.col("r") / F.lit(z or 1.0)
    return raised.select("source", "tokens", weight.alias("weight"), F.when(F.col("tokens") > 0, F.lit(whole) * weight / F.col("tokens")).otherwise(1.0).alias("passes"))


def _dealt(docs: DataFrame, target: float | None, repeats: float | None, budget: float | None) -> DataFrame:
    """``docs``, which have doc_id, source and text, with __tokens, __copies, __block and __position.

    Two scans give the sums by source and by block, a third the hash at which the block at the edge of
    each source's budget is cut. The table of blocks then tells of each document what becomes of it, so
    that no text is shuffled; it is broadcast up to BROADCAST rows and joined by shuffle beyond.
    """
    sources = plan(docs, target, repeats, budget).selectExpr("source as __source", "tokens as __all", "passes as __passes", f"cast(greatest(1, least({BLOCKS}, tokens div {BLOCK})) as int) as __blocks")
    few = sources.count() <= BROADCAST
    rows = _counted(docs).join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("__source")))
    rows = rows.withColumns({"__block": F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("__blocks")).cast("int"), "__draw": F.xxhash64(F.lit(SEED + 1), "doc_id")})
    slim = rows.select("__source", "__block", "__draw", "__tokens", "__all", "__passes", "__blocks")
    sums = slim.groupBy("__source", "__block").agg(F.sum("__tokens").alias("__n"), F.first("__all").alias("__all"), F.first("__passes").alias("__passes"), F.first("__blocks").alias("__of"))
    order = Window.partitionBy("__source").orderBy(F.xxhash64(F.lit(SEED + 2), "__source", "__block"), "__block")
    sums = sums.withColumns({"__upto": F.sum("__n").over(order), "__turn": F.row_number().over(order), "__whole": F.floor(F.col("__passes") + 1e-9).cast("long")})
    rest = F.floor((F.col("__passes") - F.col("__whole")) * F.col("__all") + 1e-6)
    blocks = durable(
        sums.select(F.col("__source").alias("__s"), F.col("__block").alias("__b"), "__n", "__whole", (rest - F.col("__upto") + F.col("__n")).alias("__left"), ((F.col("__turn") - 0.5) / F.col("__of")).alias("__position"))
    )
    edges = blocks.where("__left > 0 and __left < __n").select("__s", "__b", "__left")
    same = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b"))
    within = Window.partitionBy("__source").orderBy("__draw").rangeBetween(Window.unboundedPreceding, 0)
    # Documents of one draw stand or fall together, and are one row before they meet in a window.
    draws = slim.join(F.broadcast(edges) if few else edges, same).groupBy("__source", "__draw", "__left").agg(F.sum("__tokens").alias("__tokens"))
    cut = draws.withColumn("__upto", F.sum("__tokens").over(within)).where("__upto <= __left")
    cut = cut.groupBy("__source").agg(F.max("__draw").alias("__cut")).withColumnRenamed("__source", "__cs")
    table = blocks.join(cut, F.col("__s").eqNullSafe(F.col("__cs")), "left")
    out = rows.join(F.broadcast(table) if blocks.count() <= BROADCAST else table, same)
    more = F.when(F.col("__left") >= F.col("__n"), True).when(F.col("__left") <= 0, False).otherwise(F.col("__draw") <= F.col("__cut"))
    return out.withColumn("__copies", F.col("__whole") + F.when(more & (F.col("__tokens") > 0), 1).otherwise(0))


def schedule(docs: DataFrame, target: float | None = None, repeats: float | None = REPEATS, budget: float | None = None) -> DataFrame:
    """doc_id, source, tokens, and ``copies``: how often the document is seen; ``block`` and ``position`` of its partial pass.

    ``position``, from 0 to 1 within the source, orders blocks so that sources interleave.
    """
    rows = _dealt(docs.select("doc_id", "source", "text"), target, repeats, budget)
    return rows.select("doc_id", "source", F.col("__tokens").alias("tokens"), F.col("__copies").alias("copies"), F.col("__block").alias("block"), F.col("__position").alias("position"))


def mix(docs: DataFrame, target: float | None = None, repeats: float | None = REPEATS, budget: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the schedule says."""
    rows = _dealt(held(docs, "doc_id", "source", "text"), target, repeats, budget)
    times = F.expr("if(__copies > 0, sequence(1L, __copies), cast(array() as array<bigint>))")
    return unpacked(rows.select("__row", F.explode(times).alias("__copy")), docs.columns)
