"""Summaries, trends, duplicates, usage and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import half_up, rate
from tessera.sources.shared import durable


def status_pivot(rows: DataFrame, group: str, status: str, values: list[str], good: str) -> DataFrame:
    """Counts of each status by group, the total, and the good ones' rate in per cent to two places."""
    counts = [F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values]
    out = rows.groupBy(group).agg(*counts, F.count(F.lit(1)).alias("total"))
    return out.withColumn("rate", half_up(100 * rate(F.col(f"n_{good}"), F.col("total"))))


def run_summary(tasks: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Counts over tasks distinct by key, the first of each in order (tasks have ``selected`` and ``excluded``)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    once = tasks.withColumn("__n", n).where("__n = 1")
    return once.agg(F.count(F.lit(1)).alias("total"), F.count_if("selected").alias("selected"), F.count_if("excluded").alias("excluded"))


def reason_stats(tasks: DataFrame, reasons: str, normalize, *counts: Column) -> DataFrame:
    """Tasks by normalised reason; a task counts once for each time it has the reason."""
    return tasks.withColumn("reason", F.explode(reasons)).withColumn("reason", normalize("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("tasks"), *counts)


def duplicates(rows: DataFrame, key: str, digest: Column, least: int = 2) -> DataFrame:
    """Rows that share their digest with others: key, digest, size of the group, its first key. Counts meet before rows do."""
    told = rows.select(F.col(key), digest.alias("digest"))
    groups = told.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min(key).alias("first")).where((F.col("size") >= least) & F.col("digest").isNotNull())
    return told.join(groups, "digest").select(key, "digest", "size", "first")


def usage(rows: DataFrame, scope: str, at: str, requests: Column, tokens: Column) -> DataFrame:
    """Requests and tokens by scope, day and month; negatives count as none."""
    clean = rows.select(scope, F.to_date(at).alias("day"), F.greatest(requests, F.lit(0)).alias("r"), F.greatest(tokens, F.lit(0)).alias("t")).where("r > 0 or t > 0")
    return clean.groupBy(scope, "day", F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("r").alias("requests"), F.sum("t").alias("tokens"))


def quota(monthly: Column, limit: int, block: bool = True) -> Column:
    return F.when(monthly + 1 > limit, "block" if block else "warn").otherwise("allow")


def trend(runs: DataFrame, at: str, value: str, keep: int = 100, by: str | None = None) -> DataFrame:
    """The newest ``keep`` runs with the change against the run before. Without ``by`` only those runs, found by a distributed top list, meet in one task."""
    if by:
        w = Window.partitionBy(by)
        newest = runs.withColumn("__n", F.row_number().over(w.orderBy(F.desc(at)))).where(F.col("__n") <= keep).drop("__n")
    else:
        w, newest = Window.partitionBy(F.lit(1)), runs.orderBy(F.desc(at)).limit(keep)
    return newest.withColumn("delta", F.col(value) - F.lag(value).over(w.orderBy(at)))


def evict(entries: DataFrame, most: int, used: Column, key: str) -> DataFrame:
    """Entries that stay: over ``most``, the oldest fifth of all entries (one at least) go.

    The cut is found over sorted partitions: a row's place is the sizes of those before its own, and its place in there.
    """
    n = entries.count()
    if n <= most:
        return entries
    cut = max(1, n // 5)
    ordered = durable(entries.select(used.alias("__used"), F.col(key).alias("__gone")).orderBy("__used", "__gone").select("__gone", F.monotonically_increasing_id().alias("__at")))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    before, whole, last = 0, [], None
    for r in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect():
        if before + r["c"] > cut:
            last = (r["p"], cut - before)
            break
        before += r["c"]
        whole.append(r["p"])
    first = part <= (whole[-1] if whole else -1)
    out = ordered.where(first | ((part == last[0]) & (place < last[1])) if last else first).select("__gone")
    return entries.join(out, F.col(key) == F.col("__gone"), "left_anti")


def expired(written: Column, now: Column, ttl: int) -> Column:
    """Strictly older than ttl; what has no time of writing never expires."""
    return F.when(written > 0, now - written > ttl).otherwise(F.lit(False))


def selection_features(resolutions: DataFrame, key: str) -> DataFrame:
    """By method: least confidence, unresolved and external ones."""
    return resolutions.groupBy(key).agg(F.min("confidence").alias("least"), F.count_if(F.col("status") == "UNRESOLVED").alias("unresolved"), F.count_if(F.col("status") == "EXTERNAL").alias("external"))


def trust_counts(resolutions: DataFrame, by: str, level: Column) -> DataFrame:
    told = resolutions.withColumn("level", level)
    return told.groupBy(by).agg(*[F.count_if(F.col("level") == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")], F.avg("confidence").alias("mean"))


def generation_stats(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Succeeded, failed and skipped results (``status``) and the succeeded ones' part of those that were not skipped."""
    status = F.col("status")
    good, bad = F.count_if(status == "success"), F.count_if(status.isin("failure", "processed"))
    return results.groupBy(*(by or [])).agg(good.alias("succeeded"), bad.alias("failed"), F.count_if(status == "skipped").alias("skipped"), rate(good, good + bad).alias("success_rate"))


def categories(results: DataFrame, category: str, by: list[str] | None = None) -> DataFrame:
    """How often each category that is not empty comes."""
    return results.where((F.col(category).isNotNull()) & (F.col(category) != "")).groupBy(*(by or []), category).agg(F.count(F.lit(1)).alias("n"))


def brittleness(methods: DataFrame, signals: str, by: list[str]) -> DataFrame:
    """Methods with a signal, all methods, and their rate, 0 if there are none."""
    some = F.count_if(F.size(signals) > 0)
    return methods.groupBy(*by).agg(some.alias("brittle"), F.count(F.lit(1)).alias("methods"), F.coalesce(rate(some, F.count(F.lit(1))), F.lit(0.0)).alias("rate"))


def top_complexity(methods: DataFrame, package: str, class_name: str, name: str, complexity: str, order: str) -> DataFrame:
    """By package: classes, methods, the greatest complexity (1 at least) and the first method that has it, by class and name."""
    first = F.max_by(F.struct(class_name, name), F.struct(F.col(complexity), -F.col(order)))
    return methods.groupBy(package).agg(F.count_distinct(class_name).alias("classes"), F.count(F.lit(1)).alias("methods"), F.greatest(F.lit(1), F.max(complexity)).alias("most"), first[class_name].alias("top_class"), first[name].alias("top_method"))
