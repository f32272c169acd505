"""Merging and comparing two overlapping tables by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLVED, UNRESOLVED, AMBIGUOUS = "RESOLVED", "UNRESOLVED", "AMBIGUOUS"


def prefer_second(a: Column, b: Column) -> Column:
    """The second if it is over zero, else the first."""
    return F.when(b > 0, b).otherwise(F.coalesce(a, b))


def fill(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def either(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def union_lists(a: Column, b: Column) -> Column:
    """Both lists in order, without repeats."""
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def union_exceptions(a: Column, b: Column) -> Column:
    """Like union_lists, but a simple name goes if its java.lang name is there."""
    both = union_lists(a, b)
    return F.filter(both, lambda x: x.contains(".") | ~F.array_contains(both, F.concat(F.lit("java.lang."), x)))


def full_merge(first: DataFrame, second: DataFrame, keys: list[str], rules: dict) -> DataFrame:
    """Full outer merge; ``rules`` gives for each column what is made of both sides' values. One shuffle of each side on the keys."""
    a, b = first.alias("a"), second.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = a.join(b, on, "full_outer")
    both = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    return joined.select(*both, *[rule(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c, rule in rules.items()])


def merge_edges(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two engines' edges, with columns key, resolved, status, confidence: equal stays, different is ambiguous at 0.5, one resolved wins."""
    j = first.alias("a").join(second.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    ra, rb = (F.coalesce(F.col(f"{s}.status") == RESOLVED, F.lit(False)) for s in "ab")
    same = F.col("a.resolved").eqNullSafe(F.col("b.resolved"))
    status = F.when(ra & rb & ~same, AMBIGUOUS).when(ra | rb, RESOLVED).otherwise(F.coalesce("a.status", "b.status"))
    confidence = F.when(ra & rb & ~same, 0.5).when(ra & ~rb, F.col("a.confidence")).when(rb & ~ra, F.col("b.confidence")).otherwise(F.greatest("a.confidence", "b.confidence"))
    resolved = F.when(ra & rb & ~same, None).when(ra, F.col("a.resolved")).when(rb, F.col("b.resolved"))
    candidates = F.when(ra & rb & ~same, F.array("a.resolved", "b.resolved")).otherwise(F.array().cast(first.select(F.array("resolved")).dtypes[0][1]))
    return j.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), resolved.alias("resolved"), status.alias("status"), confidence.alias("confidence"), candidates.alias("candidates"))


def difference(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side they are on."""
    j = first.select(F.col(key).alias("__a")).distinct().join(second.select(F.col(key).alias("__b")).distinct(), F.col("__a") == F.col("__b"), "full_outer")
    return j.where("__a is null or __b is null").select(F.coalesce("__a", "__b").alias(key), F.when(F.col("__b").isNull(), "first").otherwise("second").alias("side"))


def keyed(classes: DataFrame, fqn: str = "fqn", path: str = "file_path", key: str = "key") -> DataFrame:
    """With the key by which classes are merged: the name, or the path of what has none."""
    def said(c: str) -> Column:
        return F.when(F.trim(c) != "", F.col(c))

    return classes.withColumn(key, F.coalesce(said(fqn), said(path)))


def compare(first: DataFrame, second: DataFrame, key: str, count: str, sets: list[str]) -> DataFrame:
    """What differs, a row each: key, what (``only_first``, ``only_second``, ``count``, or the name of a list column), and the values on either side alone."""
    j = first.alias("a").join(second.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    nothing = F.array().cast("array<string>")

    def found(when: Column, what: str, mine: Column, other: Column) -> Column:
        return F.when(when, F.struct(F.lit(what).alias("what"), F.array_sort(mine).alias("first"), F.array_sort(other).alias("second")))

    a, b, counts = F.col(f"b.{key}").isNull(), F.col(f"a.{key}").isNull(), [F.col(f"{x}.{count}") for x in "ab"]
    rows = [found(a, "only_first", nothing, nothing), found(b, "only_second", nothing, nothing), found(~a & ~b & (counts[0] != counts[1]), "count", *[F.array(c.cast("string")) for c in counts])]
    for c in sets:
        x, y = F.coalesce(f"a.{c}", nothing), F.coalesce(f"b.{c}", nothing)
        mine, other = F.array_except(x, y), F.array_except(y, x)
        rows.append(found(~a & ~b & ((F.size(mine) > 0) | (F.size(other) > 0)), c, mine, other))
    return j.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.explode(F.array_compact(F.array(*rows))).alias("d")).select(key, "d.what", "d.first", "d.second")


def path_sets(first: Column, second: Column) -> Column:
    """Struct of the ids in both lists, and in the one or the other alone."""
    return F.struct(F.array_intersect(first, second).alias("both"), F.array_except(first, second).alias("only_first"), F.array_except(second, first).alias("only_second"))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def attach_if_absent(base: DataFrame, more: DataFrame, key: str, column: str) -> DataFrame:
    """Attach ``more``'s lists to ``base`` unless any row of it has some already."""
    if not base.where(F.size(column) > 0).isEmpty():
        return base
    lists = more.groupBy(key).agg(F.collect_list(column).alias("__more"))
    return base.join(lists, key, "left").withColumn(column, F.coalesce("__more", column)).drop("__more")
