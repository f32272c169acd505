"""Weighted edges, top lists and roll-ups along a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.code import package_role
from tessera.functions.rules import risk_score


def edge_weights(calls: DataFrame, source: str, target: str) -> DataFrame:
    """How often each source refers to each other target."""
    return calls.groupBy(source, target).agg(F.count(F.lit(1)).alias("weight"))


def top_per_source(edges: DataFrame, source: str, target: str, k: int) -> DataFrame:
    """The k strongest edges of each source, ties by target; Spark limits each group before the shuffle."""
    order = Window.partitionBy(source).orderBy(F.desc("weight"), target)
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def along(rows: DataFrame, chain: Column, *sums: Column) -> DataFrame:
    """Aggregates of every node of the hierarchy: each row adds to all nodes of its chain."""
    return rows.withColumn("node", F.explode(chain)).groupBy("node").agg(*sums)


def edges_by_level(edges: DataFrame, source_chain: Column, target_chain: Column, weight: str = "weight") -> DataFrame:
    """Edges rolled up at every depth that both ends have, without self edges."""
    pairs = F.explode(F.filter(F.zip_with(source_chain, target_chain, lambda a, b: F.struct(a.alias("source"), b.alias("target"))), lambda p: p["source"].isNotNull() & p["target"].isNotNull()))
    return edges.select(pairs.alias("e"), weight).where("e.source <> e.target").groupBy("e.source", "e.target").agg(F.sum(weight).alias(weight))


def unary_root(nodes: DataFrame, node: str = "node", parent: str = "parent") -> str | None:
    """The node at which a display starts: below the root while there is only one child. One small job a level."""
    at = nodes.where(F.col(parent).isNull())
    name = None
    while True:
        two = [r[0] for r in at.select(node).limit(2).collect()]
        if len(two) != 1:
            return name
        name = two[0]
        at = nodes.where(F.col(parent) == name)


def common_prefix(names: DataFrame, name: str, most: int = 3) -> list[str]:
    """Leading tokens that all names share, at most so many."""
    parts = F.split(F.col(name), r"\.")
    row = names.agg(*[F.min(F.get(parts, F.lit(i))).alias(f"a{i}") for i in range(most)], *[F.max(F.coalesce(F.get(parts, F.lit(i)), F.lit("￿"))).alias(f"z{i}") for i in range(most)]).first()
    out = []
    for i in range(most):
        if row[f"a{i}"] is None or row[f"a{i}"] != row[f"z{i}"]:
            break
        out.append(row[f"a{i}"])
    return out


def package_cluster(package: Column | str, prefix: list[str]) -> Column:
    """The first token after the common prefix; of shorter names the third, else the last one."""
    name = F.col(package) if isinstance(package, str) else package
    parts = F.split(name, r"\.")
    token = F.coalesce(F.get(parts, F.lit(len(prefix))), F.get(parts, F.lit(2)), F.element_at(parts, -1))
    return F.when(name.isNull() | (F.trim(name) == "") | (name == "(default)"), "default").otherwise(F.lower(token))


def snapshot(classes: DataFrame, prefix: list[str]) -> DataFrame:
    """Nodes of an overview: classes (fqn, package, loc, methods, complexity) with role, cluster and risk against the greatest complexity."""
    most = classes.agg(F.greatest(F.lit(1), F.max("complexity")).alias("__most"))
    risk = risk_score(F.col("complexity"), F.col("__most"), F.col("loc"), F.col("methods"))
    return classes.join(F.broadcast(most)).select("fqn", "package", package_role("package").alias("role"), package_cluster("package", prefix).alias("cluster"), "loc", "methods", "complexity", risk.alias("risk"))


def select_targets(methods: DataFrame, score: Column, keep: Column, per_class: int, per_package: int, most: int) -> DataFrame:
    """Methods (id, class_name, package) worth a test: those kept, the best by score in each class, then in each package, then of all; ties by id."""
    best = methods.where(keep).withColumn("score", score)
    for by, n in (("class_name", per_class), ("package", per_package)):
        order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
        best = best.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")
    return best.orderBy(F.desc("score"), "id").limit(most)
