"""What strings expressions come to, by propagation over a table of expression nodes.

A node is (scope, id, kind, value, args): ``literal`` (its value), ``name`` (of a variable, its value), ``concat``, ``join`` (the delimiter first), ``format`` (the format is its value), ``valueof``,
``config`` (a key, looked up outside). In every round the nodes whose arguments are all known become known; rounds end when nothing is added, so what depends on itself or on anything unknown stays unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import durable

#: Values of a variable at most, how deep operations may nest, and how sure a literal, something worked out, and one of several values are.
MOST, DEEPEST = 8, 10
SURE, WORKED_OUT, ONE_OF = 1.0, 0.8, 0.6


def _formatted(pattern: Column, values: Column) -> Column:
    """``%s`` by the values in turn, ``%%`` as a sign; null for any other specifier, or another number of values."""
    parts = F.regexp_extract_all(pattern, F.lit("(?s)%s|%%|[^%]+|%"), F.lit(0))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def step(a: Column, p: Column) -> Column:
        hit = p == "%s"
        return F.struct((a["n"] + F.when(hit, 1).otherwise(0)).alias("n"), F.concat(a["out"], F.when(hit, F.coalesce(F.get(values, a["n"]), F.lit(""))).when(p == "%%", "%").otherwise(p)).alias("out"))

    done = F.aggregate(parts, start, step)
    return F.when(~F.array_contains(parts, "%") & (done["n"] == F.size(values)), done["out"])


def resolve(nodes: DataFrame, assigned: DataFrame, config: DataFrame | None = None, most: int = MOST, deepest: int = DEEPEST) -> DataFrame:
    """Of each node that is known ``scope``, ``id``, its ``value``, or ``candidates`` (``most`` at most, ``truncated`` if there are more) of a variable with several, and the ``confidence``.

    ``assigned`` is (scope, name, ord, id): the expressions that a variable is given, all of which must be known and single. ``config`` is (key, value); blank values are none. A variable with several values makes
    what it stands in unknown. Nodes under more than ``deepest`` operations are unknown.
    """
    given = assigned.groupBy("scope", F.col("name").alias("value")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("given"))
    told = nodes.join(given.withColumn("kind", F.lit("name")), ["scope", "value", "kind"], "left").withColumn("args", F.coalesce("given", "args", F.array().cast("array<long>"))).drop("given")
    told = durable(told.select("scope", "id", "kind", "value", "args"))
    one = F.lit(None).cast("array<string>")
    known = told.where("kind = 'literal' AND value IS NOT NULL").select("scope", "id", "value", one.alias("candidates"), F.lit(False).alias("truncated"), F.lit(True).alias("literal"), F.lit(0).alias("height"))
    known = durable(known)
    rest = told.where("kind <> 'literal' AND size(args) > 0")
    n = known.count()
    while True:
        asked = rest.join(known.select("scope", "id"), ["scope", "id"], "left_anti").select("scope", "id", "kind", F.col("value").alias("own"), F.size("args").alias("wanted"), F.posexplode("args").alias("pos", "arg"))
        parts = asked.join(known.where("value IS NOT NULL").select("scope", F.col("id").alias("arg"), "value", "literal", "height"), ["scope", "arg"])
        ready = parts.groupBy("scope", "id", "kind", "own", "wanted").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("v"), F.min("literal").alias("literal"), F.max("height").alias("height")).where(F.size("v") == F.col("wanted"))
        if config is not None:
            ready = ready.join(config.where("trim(value) <> ''").select(F.col("key").alias("asked"), F.col("value").alias("outside")), (F.col("kind") == "config") & (F.get("v", F.lit(0)) == F.col("asked")), "left")
        else:
            ready = ready.withColumn("outside", F.lit(None).cast("string"))
        kind, v = F.col("kind"), F.col("v")
        different = F.array_distinct(v)
        several = (kind == "name") & (F.size(different) > 1)
        value = (
            F.when(kind == "name", F.when(F.size(different) == 1, different[0])).when(kind == "concat", F.array_join(v, "")).when((kind == "join") & (F.size(v) > 1), F.aggregate(F.slice(v, F.lit(3), F.size(v)), F.get(v, F.lit(1)), lambda a, x: F.concat(a, v[0], x)))
            .when(kind == "format", _formatted(F.col("own"), v)).when((kind == "valueof") & F.col("literal") & (F.size(v) == 1), v[0]).when(kind == "config", F.col("outside"))
        )
        height = F.col("height") + F.when(kind == "name", 0).otherwise(1)
        made = ready.select(
            "scope", "id", value.alias("value"), F.when(several, F.slice(different, F.lit(1), F.lit(most))).alias("candidates"), (several & (F.size(different) > most)).alias("truncated"),
            F.when(kind == "name", False).when(kind.isin("format", "valueof"), F.col("literal")).otherwise(False).alias("literal"), height.alias("height"),
        ).where((F.col("height") <= deepest) & (F.col("value").isNotNull() | F.col("candidates").isNotNull()))
        known = durable(known.unionByName(made))
        before, n = n, known.count()
        if n == before:
            break
    sure = F.when(F.col("candidates").isNotNull(), ONE_OF).when(F.col("literal"), SURE).otherwise(WORKED_OUT)
    return known.select("scope", "id", "value", "candidates", "truncated", sure.alias("confidence"))
