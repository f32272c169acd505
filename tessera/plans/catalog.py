"""Queries over the driver's tables, and the same as DuckDB SQL.

Money and quantities are added as decimals, so that sums do not depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import code, redaction, rules
from tessera.operators import graph, lookup, merge, rollup, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def dec(c: str) -> F.Column:
    return F.col(c).cast("decimal(18,2)")


def total(c: str) -> F.Column:
    return F.sum(dec(c)).cast("double")


EDGES = "SELECT l_partkey, l_suppkey, count(*) AS weight FROM lineitem GROUP BY 1, 2"


# --- weighted edges and roll-ups


@query(f"SELECT l_partkey, l_suppkey, weight, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY weight DESC, l_suppkey) AS rn FROM ({EDGES})) WHERE rn <= 12")
def edge_weights_topk_per_source(t):
    return rollup.top_per_source(rollup.edge_weights(t.lineitem, "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", 12)


@query(f"{EDGES} ORDER BY weight DESC, l_partkey, l_suppkey LIMIT 200")
def edge_weights_global_topk(t):
    return rollup.top(rollup.edge_weights(t.lineitem, "l_partkey", "l_suppkey"), [F.desc("weight"), F.col("l_partkey"), F.col("l_suppkey")], 200)


@query("SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS total, sum(l_quantity) / count(*) AS mean, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def class_metrics(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"), (F.sum("l_quantity") / F.count(F.lit(1))).alias("mean"), F.max("l_quantity").alias("most"))


@query(
    """SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(l_extendedprice) AS most, sum(l_quantity) / count(*) AS mean_quantity
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""
)
def container_metrics(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), total("l_extendedprice").alias("total"), F.max("l_extendedprice").alias("most"), (F.sum("l_quantity") / F.count(F.lit(1))).alias("mean_quantity"))


@query(
    """WITH leaf AS (SELECT r_name, n_name, c_mktsegment, count(*) AS n, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
    chains AS (SELECT r_name AS node, n, b FROM leaf UNION ALL SELECT r_name || '.' || n_name, n, b FROM leaf UNION ALL SELECT r_name || '.' || n_name || '.' || c_mktsegment, n, b FROM leaf)
    SELECT node, CAST(sum(n) AS BIGINT) AS customers, CAST(sum(b) AS DOUBLE) AS balance FROM chains GROUP BY 1"""
)
def hierarchy_rollup(t):
    leaf = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum(dec("c_acctbal")).alias("b"))
    leaf = leaf.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rollup.along(leaf, lookup.prefixes(F.concat_ws(".", "r_name", "n_name", "c_mktsegment")), F.sum("n").alias("customers"), F.sum("b").cast("double").alias("balance"))


@query(
    """WITH e AS (SELECT r1.r_name AS sr, r1.r_name || '.' || n1.n_name AS sn, r2.r_name AS tr, r2.r_name || '.' || n2.n_name AS tn, count(*) AS w
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
      JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN region r1 ON n1.n_regionkey = r1.r_regionkey JOIN nation n2 ON c_nationkey = n2.n_nationkey JOIN region r2 ON n2.n_regionkey = r2.r_regionkey GROUP BY ALL)
    SELECT source, target, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT sr AS source, tr AS target, w FROM e UNION ALL SELECT sn, tn, w FROM e) WHERE source <> target GROUP BY 1, 2"""
)
def rolled_edges(t):
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws(".", "r_name", "n_name").alias("name"))
    j = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    raw = j.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("weight"))
    named = raw.join(nations.withColumnsRenamed({"n_nationkey": "a", "name": "s"}), F.col("s_nationkey") == F.col("a")).join(nations.withColumnsRenamed({"n_nationkey": "b", "name": "d"}), F.col("c_nationkey") == F.col("b"))
    return rollup.edges_by_level(named, lookup.prefixes(F.col("s")), lookup.prefixes(F.col("d")))


@query(
    """SELECT l_returnflag, l_linestatus, round(CAST(sum(CAST(l_discount AS DECIMAL(18,2)) * greatest(1, CAST(l_quantity AS BIGINT))) AS DOUBLE) / CAST(sum(greatest(1, CAST(l_quantity AS BIGINT))) AS DOUBLE), 10) AS mean
    FROM lineitem GROUP BY 1, 2"""
)
def weighted_average(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(rules.weighted_mean(dec("l_discount"), F.col("l_quantity").cast("long")), 10).alias("mean"))


@query(
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'O') AS "n_O", count(*) FILTER (o_orderstatus = 'P') AS "n_P", count(*) AS total,
    floor(100 * (count(*) FILTER (o_orderstatus = 'F') / count(*)) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS rate FROM orders GROUP BY 1"""
)
def status_by_source(t):
    return stats.status_pivot(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], "F")


# --- merging and lookups


@query(
    """WITH b AS (SELECT o_custkey AS k, count(*) AS cc, max(o_totalprice) AS loc, bool_or(o_orderstatus = 'P') AS flag, list_sort(list(DISTINCT o_orderpriority)) AS tags FROM orders GROUP BY 1),
    a AS (SELECT c_custkey AS k, CAST(floor(c_acctbal) AS BIGINT) AS cc, CAST(NULL AS DOUBLE) AS loc, c_acctbal < 0 AS flag, [c_mktsegment] AS tags FROM customer)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.cc > 0 THEN b.cc ELSE coalesce(a.cc, b.cc) END AS cc, coalesce(a.loc, b.loc) AS loc, coalesce(a.flag, false) OR coalesce(b.flag, false) AS flag,
    array_to_string(list_concat(coalesce(a.tags, []), coalesce(b.tags, [])), ',') AS tags FROM a FULL OUTER JOIN b ON a.k = b.k"""
)
def full_outer_merge(t):
    a = t.customer.select(F.col("c_custkey").alias("k"), F.floor("c_acctbal").alias("cc"), F.lit(None).cast("double").alias("loc"), (F.col("c_acctbal") < 0).alias("flag"), F.array("c_mktsegment").alias("tags"))
    b = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("cc"), F.max("o_totalprice").alias("loc"), F.bool_or(F.col("o_orderstatus") == "P").alias("flag"), F.sort_array(F.collect_set("o_orderpriority")).alias("tags"))
    merged = merge.full_merge(a, b, ["k"], {"cc": merge.prefer_second, "loc": merge.fill, "flag": merge.either, "tags": merge.union_lists})
    return merged.withColumn("tags", F.concat_ws(",", "tags"))


@query(
    f"""WITH w AS ({EDGES}), a AS (SELECT l_partkey AS k, l_suppkey AS resolved, CASE WHEN weight >= 2 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status, CASE WHEN weight >= 2 THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END AS confidence
      FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY weight DESC, l_suppkey) AS r FROM w) WHERE r = 1),
    q AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
    b AS (SELECT l_partkey AS k, l_suppkey AS resolved, CASE WHEN q >= 45 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status, CASE WHEN q >= 45 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence
      FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY q DESC, l_suppkey) AS r FROM q) WHERE r = 1),
    j AS (SELECT coalesce(a.k, b.k) AS k, a.resolved AS ar, b.resolved AS br, coalesce(a.status = 'RESOLVED', false) AS x, coalesce(b.status = 'RESOLVED', false) AS y, a.status AS s1, b.status AS s2, a.confidence AS ac, b.confidence AS bc FROM a FULL OUTER JOIN b ON a.k = b.k)
    SELECT k, CASE WHEN x AND y AND ar <> br THEN NULL WHEN x THEN ar WHEN y THEN br END AS resolved, CASE WHEN x AND y AND ar <> br THEN 'AMBIGUOUS' WHEN x OR y THEN 'RESOLVED' ELSE coalesce(s1, s2) END AS status,
    CASE WHEN x AND y AND ar <> br THEN 0.5::DOUBLE WHEN x AND NOT y THEN ac WHEN y AND NOT x THEN bc ELSE greatest(ac, bc) END AS confidence,
    CAST(CASE WHEN x AND y AND ar <> br THEN 2 ELSE 0 END AS INT) AS candidates FROM j"""
)
def edge_merge_ambiguity(t):
    first = lookup.best_of(rollup.edge_weights(t.lineitem, "l_partkey", "l_suppkey"), "l_partkey", [F.desc("weight"), F.col("l_suppkey")])
    by_q = t.lineitem.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    second = lookup.best_of(by_q, "l_partkey", [F.desc("q"), F.col("l_suppkey")])

    def side(rows, hit, yes, no):
        return rows.select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("resolved"), F.when(hit, "RESOLVED").otherwise("UNRESOLVED").alias("status"), F.when(hit, yes).otherwise(no).alias("confidence"))

    return merge.merge_edges(side(first, F.col("weight") >= 2, 0.9, 0.4), side(second, F.col("q") >= 45, 0.8, 0.5), "k").withColumn("candidates", F.size("candidates"))


@query(
    """WITH a AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 25), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity >= 50)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'first' ELSE 'second' END AS side FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL"""
)
def symmetric_diff(t):
    return merge.difference(t.part.where("p_size > 25").select(F.col("p_partkey").alias("k")), t.lineitem.where("l_quantity >= 50").select(F.col("l_partkey").alias("k")), "k")


@query(
    """WITH u1 AS (SELECT p_name || '#' || p_brand AS k, min(p_partkey) AS v FROM part GROUP BY 1 HAVING count(*) = 1), u2 AS (SELECT p_name || '#' || p_type AS k, min(p_partkey) AS v FROM part GROUP BY 1 HAVING count(*) = 1),
    u3 AS (SELECT p_name AS k, min(p_partkey) AS v FROM part GROUP BY 1 HAVING count(*) = 1)
    SELECT p_partkey AS ref, coalesce(u1.v, u2.v, u3.v) AS found, CAST(CASE WHEN u1.v IS NOT NULL THEN 1 WHEN u2.v IS NOT NULL THEN 2 WHEN u3.v IS NOT NULL THEN 3 ELSE 0 END AS INT) AS tier
    FROM part LEFT JOIN u1 ON u1.k = p_name || '#' || p_brand LEFT JOIN u2 ON u2.k = p_name || '#' || p_type LEFT JOIN u3 ON u3.k = p_name"""
)
def tiered_lookup(t):
    refs = t.part.select(F.col("p_partkey").alias("ref"), F.concat_ws("#", "p_name", "p_brand").alias("k1"), F.concat_ws("#", "p_name", "p_type").alias("k2"), F.col("p_name").alias("k3"))
    dim = refs.withColumnRenamed("ref", "found")
    return lookup.tiered(refs, "ref", [(k, lookup.unique(dim, k, "found")) for k in ("k1", "k2", "k3")], "found")


HOST = r"^[a-z]+://([^/?#]+)"


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages), r AS (SELECT page_id, array_to_string(list_reverse(string_split(host, '.')), '.') AS name FROM p),
    inside AS (SELECT name FROM r GROUP BY 1 HAVING count(*) >= 5)
    SELECT page_id, name FROM r WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.name = r.name OR starts_with(i.name, r.name || '.') OR starts_with(r.name, i.name || '.'))"""
)
def prefix_anti_join(t):
    rows = t.pages.select("page_id", F.array_join(F.reverse(F.split(F.regexp_extract("url", HOST, 1), r"\.")), ".").alias("name"))
    inside = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return lookup.outside(rows, "name", inside, "name")


# Rules of the example, first match wins: number, type, prefix of the properties, label.
RULES = [(1, "error", '{"k": 1', "reflective"), (2, "error", '{"k"', "proxy"), (3, "click", '{"k": 2', "dynamic"), (4, "purchase", '{"k": 2', "loader"), (5, "view", '{"k": 99', "script")]
RULES_SQL = ", ".join(f"({n}, '{k}', '{p}', '{x}')" for n, k, p, x in RULES)


@query(
    f"""WITH r(rule, kind, prefix, label) AS (VALUES {RULES_SQL}) SELECT event_id, CAST(rule AS INT) AS rule, label FROM
    (SELECT event_id, rule, label, row_number() OVER (PARTITION BY event_id ORDER BY rule) AS n FROM events JOIN r ON event_type = kind AND starts_with(props, prefix)) WHERE n = 1"""
)
def rule_match_first_wins(t):
    rule_table = t._spark.createDataFrame(RULES, "rule int, kind string, prefix string, label string")
    found = lookup.match_rules(t.events.select("event_id", "event_type", "props"), "event_id", rule_table, (F.col("event_type") == F.col("kind")) & F.col("props").startswith(F.col("prefix")), "rule")
    return found.select("event_id", "rule", "label")


@query(
    """SELECT user_id, event_type, day, event_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY rank DESC, event_id) AS n FROM
    (SELECT user_id, event_type, CAST(ts AS DATE) AS day, event_id, CASE WHEN value >= 100 THEN 3 WHEN value >= 30 THEN 2 ELSE 1 END AS rank FROM events)) WHERE n = 1"""
)
def dedupe_highest_severity(t):
    rows = t.events.select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id", F.when(F.col("value") >= 100, 3).when(F.col("value") >= 30, 2).otherwise(1).alias("rank"))
    return merge.first_by(rows, ["user_id", "event_type", "day"], [F.desc("rank"), F.col("event_id")])


@query(
    """WITH h AS (SELECT doc_id, sha256(regexp_replace(text, '\\s+', '', 'g')) AS digest FROM documents), g AS (SELECT digest, count(*) AS size, min(doc_id) AS first FROM h GROUP BY 1 HAVING count(*) >= 2)
    SELECT doc_id, h.digest, size, first FROM h JOIN g ON h.digest = g.digest"""
)
def duplicate_groups(t):
    return stats.duplicates(t.documents, "doc_id", F.sha2(F.regexp_replace("text", r"[\t\n\f\r ]+", ""), 256))


# --- usage, trends, stats


@query(
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS requests, CAST(sum(CAST(ceil(length(props) / 4) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2),
    m AS (SELECT user_id, strftime(day, '%Y-%m') AS month, sum(requests) AS monthly FROM d GROUP BY 1, 2)
    SELECT d.user_id, day, m.month, requests, tokens, CAST(monthly AS BIGINT) AS monthly, CASE WHEN monthly + 1 > 70 THEN 'block' ELSE 'allow' END AS decision FROM d JOIN m ON d.user_id = m.user_id AND strftime(d.day, '%Y-%m') = m.month"""
)
def usage_day_month(t):
    daily = stats.usage(t.events, "user_id", "ts", F.lit(1), rules.token_estimate("props"))
    monthly = F.sum("requests").over(Window.partitionBy("user_id", "month"))
    return daily.withColumn("monthly", monthly).withColumn("decision", stats.quota(F.col("monthly"), 70))


@query("SELECT role, count(*) AS messages, CAST(sum(coalesce(CAST(ceil(length(text) / 4) AS BIGINT), 0)) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def token_estimate(t):
    return t.conversations.groupBy("role").agg(F.count(F.lit(1)).alias("messages"), F.sum(rules.token_estimate("text")).alias("tokens"))


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate FROM events GROUP BY 1), n AS (SELECT * FROM d ORDER BY day DESC LIMIT 100)
    SELECT day, success_rate, success_rate - lag(success_rate) OVER (ORDER BY day) AS delta FROM n"""
)
def run_trend(t):
    daily = t.events.groupBy(F.to_date("ts").alias("day")).agg(rules.rate(F.count_if(F.col("event_type") != "error"), F.count(F.lit(1))).alias("success_rate"))
    return stats.trend(daily, "day", "success_rate")


@query(
    """WITH d AS (SELECT date_trunc('hour', ts) AS h, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate FROM events GROUP BY 1), n AS (SELECT * FROM d ORDER BY h DESC LIMIT 100)
    SELECT strftime(h, '%Y-%m-%d %H') AS run, success_rate, success_rate - lag(success_rate) OVER (ORDER BY h) AS delta FROM n"""
)
def run_trend_by_hour(t):
    """More runs than are kept: the newest hundred."""
    hourly = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("run")).agg(rules.rate(F.count_if(F.col("event_type") != "error"), F.count(F.lit(1))).alias("success_rate"))
    return stats.trend(hourly, "run", "success_rate")


@query(
    """WITH x AS (SELECT event_id, value, unnest([CASE WHEN value < 10 THEN 'low_conf' END, CASE WHEN event_type = 'error' THEN 'unresolved' END, CASE WHEN event_type = 'signup' THEN 'external' END, CASE WHEN value < 1 THEN 'skip_low_conf' END, CASE WHEN value > 300 THEN 'branch_candidates' END]) AS reason FROM events)
    SELECT reason, count(*) AS tasks, count(*) FILTER (value < 1) AS excluded FROM x WHERE reason IS NOT NULL GROUP BY 1"""
)
def reason_explode_stats(t):
    v, kind = F.col("value"), F.col("event_type")
    raw = F.array_compact(F.array(F.when(v < 10, "low_conf(0.10)<0.60"), F.when(kind == "error", "unresolved(2)*0.10"), F.when(kind == "signup", " external(1)*0.20 "), F.when(v < 1, "SKIP:min_conf<0.30"), F.when(v > 300, "branch_candidates")))
    return stats.reason_stats(t.events.withColumn("reasons", raw), "reasons", rules.normalize_reason, F.count_if(F.col("value") < 1).alias("excluded"))


@query(
    """SELECT event_type, count(*) AS n, count(*) FILTER (value >= 100) AS high, count(*) FILTER (value >= 30 AND value < 100) AS medium, count(*) FILTER (value < 30) AS low,
    CAST(sum(CASE WHEN value >= 100 THEN 3 WHEN value >= 30 THEN 2 ELSE 1 END) AS BIGINT) AS score FROM events GROUP BY 1 ORDER BY score DESC, event_type LIMIT 10"""
)
def severity_score(t):
    rows = t.events.withColumn("s", F.when(F.col("value") >= 100, "HIGH").when(F.col("value") >= 30, "MEDIUM").otherwise("LOW"))
    out = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("s") == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")], F.sum(rules.severity_weight("s")).alias("score"))
    return rollup.top(out, [F.desc("score"), F.col("event_type")], 10)


@query(
    """WITH c AS (SELECT event_type, least(1.0::DOUBLE, value / 100) AS confidence FROM events)
    SELECT event_type, count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence >= 0.6 AND confidence < 0.9) AS medium, count(*) FILTER (confidence < 0.6) AS low,
    round(CAST(sum(CAST(confidence AS DECIMAL(18,4))) AS DOUBLE) / count(*), 8) AS mean FROM c GROUP BY 1"""
)
def trust_level_counts(t):
    rows = t.events.select("event_type", F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"))
    out = stats.trust_counts(rows.withColumn("confidence", F.col("confidence").cast("decimal(18,4)")).withColumn("c", F.col("confidence").cast("double")), "event_type", rules.trust_level("c"))
    exact = rows.groupBy(F.col("event_type").alias("e")).agg(F.round(F.sum(F.col("confidence").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1)), 8).alias("m"))
    return out.join(exact, F.col("event_type") == F.col("e")).select("event_type", "high", "medium", "low", F.col("m").alias("mean"))


# --- graph


@query(
    """WITH used AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45), d AS (SELECT p_partkey, p_brand, l_partkey IS NULL AS dead FROM part LEFT JOIN used ON p_partkey = l_partkey)
    SELECT p_brand, bool_and(dead) AS dead, count(*) AS members, count(*) FILTER (dead) AS dead_members FROM d GROUP BY 1"""
)
def dead_groups(t):
    used = t.lineitem.where("l_returnflag = 'R' and l_quantity > 45")
    dead = graph.unreferenced(t.part.select("p_partkey"), "p_partkey", used, "l_partkey").withColumn("dead", F.lit(True))
    marked = t.part.select("p_partkey", "p_brand").join(dead, "p_partkey", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    return graph.dead_groups(marked, "p_brand").join(marked.groupBy("p_brand").agg(F.count_if("dead").alias("dead_members")), "p_brand")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def dead_nodes(t):
    return graph.unreferenced(t.part.select("p_partkey"), "p_partkey", t.lineitem.where("l_returnflag = 'R' and l_quantity > 45"), "l_partkey")


NEXT_USER = """SELECT user_id AS src, nxt AS dst FROM (SELECT user_id, nxt, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, nxt) AS r FROM
    (SELECT user_id, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY 1, 2) WHERE r = 1"""


@query(f"WITH RECURSIVE e AS ({NEXT_USER}), reach(start, node) AS (SELECT src, dst FROM e UNION SELECT start, dst FROM reach JOIN e ON node = src) SELECT DISTINCT start AS node FROM reach WHERE start = node")
def cycle_membership(t):
    following = F.lead("user_id").over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    steps = t.events.select(F.col("user_id").alias("src"), following.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return graph.cyclic_nodes(lookup.best_of(steps, "src", [F.desc("n"), F.col("dst")]).select("src", "dst"))


# --- scores, rules and gates


@query(
    """WITH m AS (SELECT max(p_size) AS top FROM part) SELECT p_partkey, CAST(least(100, greatest(8, floor(p_size * 62.0::DOUBLE / top + least(22.0::DOUBLE, p_retailprice / 18.0::DOUBLE) + least(16.0::DOUBLE, length(p_name) * 1.5::DOUBLE) + 0.5))) AS BIGINT) AS risk,
    CASE WHEN p_size <= 5 THEN 'simple' WHEN p_size <= 10 THEN 'moderate' WHEN p_size <= 20 THEN 'complex' ELSE 'very_complex' END AS band FROM part, m"""
)
def risk_score(t):
    most = t.part.agg(F.max("p_size").alias("top"))
    risk = rules.risk_score(F.col("p_size"), F.col("top"), F.col("p_retailprice"), F.length("p_name"))
    return t.part.join(F.broadcast(most)).select("p_partkey", risk.alias("risk"), rules.complexity_band("p_size").alias("band"))


@query("SELECT o_custkey, max(o_totalprice) AS most, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, count(*) AS n FROM orders GROUP BY 1 ORDER BY most DESC, mean DESC, n DESC, o_custkey LIMIT 5")
def risk_top_n(t):
    out = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"), (total("o_totalprice") / F.count(F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("n"))
    return rollup.top(out, [F.desc("most"), F.desc("mean"), F.desc("n"), F.col("o_custkey")], 5)


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type <> 'error') / count(*) AS rate, count(*) FILTER (value >= 100) AS dynamic, min(user_id) % 4 AS k FROM events GROUP BY 1)
    SELECT day, CAST(greatest(0, floor(rate * 100 + 0.5) - least(dynamic, 30) - CASE k WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 0 END - CASE WHEN k = 2 THEN 5 ELSE 0 END) AS BIGINT) AS score,
    coalesce(nullif(concat_ws(',', CASE WHEN rate < 0.8 THEN 'raise_type_resolution' END, CASE WHEN dynamic > 20 THEN 'review_dynamic_features' END, CASE WHEN dynamic > 20 AND k < 3 THEN 'focus_dynamic_hotspots' END, CASE WHEN k = 3 THEN 'preprocess_for_lombok' END, CASE k WHEN 0 THEN 'mend_preprocessing' WHEN 1 THEN 'look_at_fallback' END, CASE WHEN k = 2 THEN 'give_a_class_path' END), ''), 'none') AS advice FROM d"""
)
def quality_score(t):
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(rules.rate(F.count_if(F.col("event_type") != "error"), F.count(F.lit(1))).alias("rate"), F.count_if(F.col("value") >= 100).alias("dynamic"), (F.min("user_id") % 4).alias("k"))
    k, rate, dynamic = F.col("k"), F.col("rate"), F.col("dynamic")
    score = rules.quality_score(rate, dynamic, F.when(k == 0, 10).when(k == 1, 5).otherwise(0), F.when(k == 2, 5).otherwise(0))
    advice = rules.recommendations(rate, dynamic, F.when(k == 3, "OFF"), F.when(k == 0, "FAILED").when(k == 1, "FAILED_FALLBACK"), F.when(k == 2, "NO"), k == 3, F.when(k < 3, F.array(F.lit("f"))))
    return d.select("day", score.alias("score"), F.concat_ws(",", advice).alias("advice"))


@query(
    """WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
    SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'not_selected' WHEN o_orderstatus = 'P' THEN 'build_failed' WHEN l_orderkey IS NULL AND o_custkey % 2 = 0 THEN 'test_not_found' WHEN l_orderkey IS NULL THEN 'build_failed' WHEN o_custkey % 7 = 0 THEN 'build_failed' WHEN failed > 0 THEN 'test_failed' ELSE 'success' END AS status
    FROM orders LEFT JOIN l ON o_orderkey = l_orderkey"""
)
def decision_list_status(t):
    lines = t.lineitem.where("l_linenumber % 2 = 0").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    j, customer = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left"), F.col("o_custkey")
    return j.select("o_orderkey", rules.task_status(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus") != "P", F.col("l_orderkey").isNotNull(), F.coalesce("failed", F.lit(0)), customer % 2 == 0, customer % 7 != 0).alias("status"))


@query(
    """WITH d AS (SELECT user_id, count(*) AS n, count(*) FILTER (value < 10) AS ex, count(*) FILTER (value < 10 AND event_id % 3 = 0) AS good, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'error' AND value >= 50) AS dominant FROM events GROUP BY 1)
    SELECT user_id, CASE WHEN ex / n > 0.20 AND coalesce(good / nullif(ex, 0), 0) >= 0.30 THEN 'TOO_STRICT' WHEN failed / n >= 0.15 AND coalesce(dominant / nullif(failed, 0), 0) >= 0.50 THEN 'TOO_WEAK' ELSE 'OK' END AS strength FROM d"""
)
def selection_strength(t):
    n, bad, low = F.count(F.lit(1)), F.col("event_type") == "error", F.col("value") < 10
    d = t.events.groupBy("user_id").agg(rules.rate(F.count_if(low), n).alias("x"), F.coalesce(rules.rate(F.count_if(low & (F.col("event_id") % 3 == 0)), F.count_if(low)), F.lit(0.0)).alias("w"), rules.rate(F.count_if(bad), n).alias("f"), F.coalesce(rules.rate(F.count_if(bad & (F.col("value") >= 50)), F.count_if(bad)), F.lit(0.0)).alias("c"))
    return d.select("user_id", rules.selection_strength(F.col("x"), F.col("w"), F.col("f"), F.col("c")).alias("strength"))


@query(
    """WITH p AS (SELECT page_id, length(html) AS used FROM pages), g AS (SELECT page_id FROM p ORDER BY used, page_id LIMIT (SELECT CASE WHEN count(*) > 20 THEN greatest(1, count(*) // 5) ELSE 0 END FROM p))
    SELECT page_id, CAST(used AS BIGINT) AS used, used > 0 AND 100000 - used > 97000 AS expired FROM p WHERE page_id NOT IN (SELECT page_id FROM g)"""
)
def eviction_and_expiry(t):
    rows = t.pages.select("page_id", F.length("html").cast("long").alias("used"))
    return stats.evict(rows, 20, F.col("used"), "page_id").withColumn("expired", stats.expired(F.col("used"), F.lit(100000), 97000))


@query(
    """SELECT label, n, floor(n / least(total, 1000000000) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS ratio, n / total >= 0.05 AS pass FROM
    (SELECT 'quality' AS label, sum(quality) AS n, count(*) AS total FROM labels UNION ALL SELECT 'toxic', sum(toxic), count(*) FROM labels UNION ALL SELECT 'labelled', (SELECT count(*) FROM labels SEMI JOIN documents USING (doc_id)), (SELECT count(*) FROM documents))"""
)
def gate_result(t):
    counts = t.labels.agg(F.sum("quality").alias("q"), F.sum("toxic").alias("x"), F.count(F.lit(1)).alias("n"))
    covered = t.labels.select("doc_id").join(t.documents.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("c"))
    docs = t.documents.agg(F.count(F.lit(1)).alias("d"))
    one = counts.join(F.broadcast(covered)).join(F.broadcast(docs))
    rows = one.select(F.explode(F.array(F.struct(F.lit("quality").alias("label"), F.col("q").alias("n"), F.col("n").alias("total")), F.struct(F.lit("toxic").alias("label"), F.col("x").alias("n"), F.col("n").alias("total")), F.struct(F.lit("labelled").alias("label"), F.col("c").alias("n"), F.col("d").alias("total")))).alias("r")).select("r.*")
    return rows.select("label", F.col("n"), rules.half_up(rules.rate(F.col("n"), F.col("total")), 4).alias("ratio"), (rules.rate(F.col("n"), F.col("total")) >= 0.05).alias("pass"))


# --- text safety


@query(
    r"""SELECT doc_id, CAST((length(t) - length(replace(t, 'license', ''))) / 7 + (length(t) - length(replace(t, 'token', ''))) / 5 AS BIGINT) AS hits FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE contains(t, 'license') OR contains(t, 'token')"""
)
def dictionary_hits(t):
    spans = redaction.dictionary_spans("text", ("license", "token", "apache"), allow=("apache",))
    return t.documents.select("doc_id", F.size(spans).cast("long").alias("hits")).where("hits > 0")


@query(
    r"""SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(html, '\bLocalDateTime\s*\.\s*now\s*\(|\bInstant\s*\.\s*now\s*\(|\bSystem\s*\.\s*(?:currentTimeMillis|nanoTime)\s*\(') THEN 'TIME' END, CASE WHEN regexp_matches(html, '\bnew\s+Random\s*\(|\bThreadLocalRandom\s*\.\s*current\s*\(|\bUUID\s*\.\s*randomUUID\s*\(') THEN 'RANDOM' END,
    CASE WHEN regexp_matches(html, '\bSystem\s*\.\s*(?:getenv|getProperty)\s*\(') THEN 'ENVIRONMENT' END, CASE WHEN contains(html, 'parallelStream(') THEN 'CONCURRENCY' END, CASE WHEN regexp_matches(html, '\bFiles\s*\.\s*(?:readAllLines|readAllBytes|newInputStream)\s*\(|\bnew\s+(?:Server)?Socket\s*\(') THEN 'IO' END,
    CASE WHEN regexp_matches(html, '(?s)Hash(?:Set|Map).*(?:\.toString\(|String\.valueOf\()|(?s)(?:\.toString\(|String\.valueOf\().*Hash(?:Set|Map)') THEN 'COLLECTION_ORDER' END, CASE WHEN regexp_matches(html, 'track\s*\(') THEN 'CALL' END) AS signals FROM pages"""
)
def signal_flags(t):
    return t.pages.select("page_id", F.concat_ws(",", code.brittle_signals("html"), F.when(F.col("html").rlike(r"track\s*\("), "CALL")).alias("signals"))


@query(
    """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages), k AS (SELECT page_id, host, array_to_string(list_reverse(string_split(host, '.')), '.') AS rev FROM h),
    x AS (SELECT host, CASE WHEN string_split(rev, '.')[1] IN ('com', 'org', 'net', 'io', 'dev', 'edu') AND len(string_split(rev, '.')) > 1 THEN string_split(rev, '.')[1] || '.' || string_split(rev, '.')[2] ELSE string_split(rev, '.')[1] END AS library FROM k)
    SELECT library, count(DISTINCT host) AS classes, count(*) AS imports FROM x GROUP BY 1 ORDER BY classes DESC, imports DESC, library LIMIT 40"""
)
def library_rank(t):
    rows = t.pages.select(F.lower(F.regexp_extract("url", HOST, 1)).alias("host"))
    rows = rows.withColumn("library", code.library_key(F.array_join(F.reverse(F.split("host", r"\.")), ".")))
    out = rows.groupBy("library").agg(F.count_distinct("host").alias("classes"), F.count(F.lit(1)).alias("imports"))
    return rollup.top(out, [F.desc("classes"), F.desc("imports"), F.col("library")], 40)
