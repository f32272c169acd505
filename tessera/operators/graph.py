"""Cycles, unreferenced nodes, and orders of small dependency graphs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import durable


def _peeled(edges: DataFrame) -> tuple[DataFrame, int]:
    """Without the nodes that have no way in or no way out, again and again; and how many edges are left."""
    now, n = edges, -1
    while (m := now.count()) != n:
        n = m
        now = durable(now.join(now.select(F.col("dst").alias("__in")).distinct(), F.col("src") == F.col("__in"), "left_semi").join(now.select(F.col("src").alias("__out")).distinct(), F.col("dst") == F.col("__out"), "left_semi"))
    return now, n


def _least_reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of every node the smallest node that reaches it, as (node, label)."""
    labels = changed = nodes.withColumn("label", F.col("node"))
    while not changed.isEmpty():
        sent = edges.join(changed, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("sent"))
        met = durable(labels.join(sent, "node", "left").select("node", F.least("label", "sent").alias("label"), F.col("label").alias("before")))
        labels, changed = met.select("node", "label"), met.where("label <> before").select("node", "label")
    return labels


def cyclic_nodes(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Nodes on a cycle or with an edge to themselves.

    First nodes without a way in or without a way out are peeled off, again and again. If as many edges are left as nodes, these
    are cycles. Else every node takes the smallest node that reaches it; what reaches that one back, within what it named, is
    its component; the components are taken out, edges between different names too, and the rest is peeled and searched anew.
    There is one row a node and an edge at any time; every round is an equi-join and is checkpointed.
    """
    now = durable(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src is not null and dst is not null").distinct())
    out = now.where("src = dst").select(F.col("src").alias("node"))
    now, n = _peeled(durable(now.where("src <> dst")))
    while n:
        nodes = durable(now.select(F.col("src").alias("node")).distinct())
        if nodes.count() == n:
            out = out.union(nodes)
            break
        names = _least_reaching(nodes, now)
        within = durable(now.join(names.toDF("src", "__s"), "src").join(names.toDF("dst", "__d"), "dst").where("__s = __d").select("src", "dst"))
        # From the node that named the others, against the edges.
        back, found = within.select(F.col("dst").alias("a"), F.col("src").alias("b")), durable(names.where("node = label").select("node"))
        new = found
        while not new.isEmpty():
            new = durable(back.join(new, F.col("a") == F.col("node")).select(F.col("b").alias("node")).distinct().join(found, "node", "left_anti"))
            found = durable(found.union(new))
        sizes = found.join(names, "node").groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = durable(out.union(found.join(names, "node").join(sizes, "label", "left_semi").select("node")))
        now, n = _peeled(durable(within.join(found, F.col("src") == F.col("node"), "left_anti").join(found, F.col("dst") == F.col("node"), "left_anti")))
    return out.distinct()


def unreferenced(nodes: DataFrame, key: str, references: DataFrame, reference_key: str) -> DataFrame:
    """Nodes nothing refers to."""
    return nodes.join(references.select(F.col(reference_key).alias("__r")).distinct(), F.col(key) == F.col("__r"), "left_anti")


def dead_methods(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Methods (key, visibility, has_body, is_entry) with how often they are called, and whether they are dead."""
    counts = calls.groupBy(F.col("callee").alias("__k")).agg(F.count(F.lit(1)).alias("usage"))
    used = methods.join(counts, F.col("key") == F.col("__k"), "left").drop("__k").withColumn("usage", F.coalesce("usage", F.lit(0)))
    open_ = F.coalesce(F.col("visibility").isin("public", "protected"), F.lit(False))
    return used.withColumn("dead", (F.col("usage") == 0) & ~open_ & F.coalesce("has_body", F.lit(True)) & ~F.coalesce("is_entry", F.lit(False)))


def dead_groups(members: DataFrame, group: str, dead: str = "dead") -> DataFrame:
    """Groups with members, all dead."""
    return members.groupBy(group).agg(F.bool_and(dead).alias("dead"), F.count(F.lit(1)).alias("members"))


def dependency_edges(*parts: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) of several kinds of dependency, without self edges."""
    out = parts[0].select("src", "dst")
    for p in parts[1:]:
        out = out.unionByName(p.select("src", "dst"))
    return out.where("src <> dst").distinct()


def topological(nodes: Iterable[str], needs: dict[str, Iterable[str]]) -> list[str]:
    """Workflow nodes in an order that respects what they need; ties by the order given. A cycle is an error."""
    left, out = list(nodes), []
    while left:
        ready = next((n for n in left if all(x in out for x in needs.get(n, ()))), None)
        if ready is None:
            raise ValueError(f"a cycle among {', '.join(left)}")
        out.append(ready)
        left.remove(ready)
    return out


def closure(wanted: Iterable[str], needs: dict[str, Iterable[str]]) -> set[str]:
    """The wanted nodes and all they need, directly or not."""
    out, todo = set(), list(wanted)
    while todo:
        n = todo.pop()
        if n not in out:
            out.add(n)
            todo += needs.get(n, ())
    return out


def rebound_calls(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """How often each method (key, class_name, method, arity, types) is called: key and ``incoming``.

    Calls (callee, class_name, method, arity, types) are counted one for each place. A callee that is no method's key is bound to the one
    method of that class, name and arity, else to the one of that simple class name; if there are several, to the only one with its parameter types.
    """
    counts = calls.groupBy(F.col("callee").alias("key"), "class_name", "method", "arity", "types").agg(F.count(F.lit(1)).alias("n"))
    known = methods.select("key", F.lower("class_name").alias("c"), F.lower(F.substring_index("class_name", ".", -1)).alias("s"), F.lower("method").alias("m"), F.col("arity").alias("a"), F.col("types").alias("t"))
    direct = counts.join(known.select("key"), "key", "left_semi").select("key", "n")
    loose = counts.join(known.select("key"), "key", "left_anti").select(F.col("key").alias("callee"), "n", F.lower("class_name").alias("c"), F.lower(F.substring_index("class_name", ".", -1)).alias("s"), F.lower("method").alias("m"), F.col("arity").alias("a"), F.col("types").alias("want"))

    def bound(rows: DataFrame, on: str) -> DataFrame:
        return rows.join(known.select("key", on, "m", "a", "t"), [on, "m", "a"])

    exact = bound(loose, "c").select("callee", "n", "want", "key", "t")
    simple = bound(loose.join(exact.select("callee").distinct(), "callee", "left_anti"), "s").select("callee", "n", "want", "key", "t")
    both = exact.union(simple).withColumn("same", F.col("t") == F.col("want"))
    # Counts decide, so that no list of candidates is gathered.
    picked = both.groupBy("callee", "n").agg(F.count(F.lit(1)).alias("all"), F.min("key").alias("only"), F.count_if("same").alias("fit"), F.min(F.when(F.col("same"), F.col("key"))).alias("fitting"), F.max(F.size("want")).alias("told"))
    key = F.when(F.col("all") == 1, F.col("only")).when((F.col("told") > 0) & (F.col("fit") == 1), F.col("fitting"))
    return direct.union(picked.select(key.alias("key"), "n").where("key is not null")).groupBy("key").agg(F.sum("n").alias("incoming"))
