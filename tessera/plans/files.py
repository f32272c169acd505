"""Queries that write files of every kind that is read, read them back, and say the same in SQL on the tables they were made from.

Files go to the shared folder; executors write them, hundreds of each kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.operators import lookup, merge, stats
from tessera.plans.catalog import query
from tessera.sources import readers, writers
from tessera.sources.shared import scratch


#: A row a part, from which files are made by the executors, about two hundred of each kind: number, name, package, what is said, and which file.
BASE = "(SELECT p_partkey AS k, 'N' || CAST(p_partkey AS STRING) AS n, 'r' || CAST(p_size AS STRING) AS r, p_name AS said, p_partkey % 199 AS f FROM part)"


def parts(t) -> DataFrame:
    return t.part.selectExpr("p_partkey AS k", "'N' || CAST(p_partkey AS STRING) AS n", "'r' || CAST(p_size AS STRING) AS r", "p_name AS said", "p_partkey % 199 AS f")


def spread(rows: DataFrame, by: str) -> DataFrame:
    """Rows of files dealt out to tasks: a small table can be many files."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def bodies(rows: DataFrame, name: str, piece: str, head: str = "''", foot: str = "''") -> DataFrame:
    """Names and bodies of files of many pieces, in the order of their numbers, with what stands before and after them; all are SQL expressions, ``head`` and ``foot`` over ``f``."""
    made = rows.groupBy(F.expr(name).alias("name"), "f").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.expr(piece).alias("piece")))), lambda x: x["piece"]), "").alias("all"))
    return made.select("name", F.concat(F.expr(head), "all", F.expr(foot)).alias("body"))


def filed(t, rows: DataFrame, *told: str) -> str:
    folder = scratch(t._spark, "files")
    writers.named_files(bodies(rows, *told), folder)
    return folder


def written(t, rows: DataFrame, kind: str = "json") -> str:
    path = scratch(t._spark, "files")
    getattr(rows.write, kind)(path)
    return path


JOINED = "FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(
    f"""WITH b AS (SELECT r || '/' || n || '.java' AS path, k, said FROM {BASE} WHERE k % 4 <> 0 AND r <> 'r7'), o AS (SELECT path, row_number() OVER (ORDER BY path) AS ord FROM b)
    SELECT CAST(ord AS INT) AS ord, path, CASE WHEN k % 11 <> 0 THEN 'class ' || said || ' {{}}' END AS text, CASE WHEN k % 11 = 0 THEN 'not UTF-8' END AS error FROM b JOIN o USING (path)"""
)
def source_files(t):
    """A file a class; some are not UTF-8, some are no sources, some lie in folders that are left out."""
    body = F.when(F.col("k") % 11 == 0, F.unhex(F.lit("FFFE00"))).otherwise(F.encode(F.concat(F.lit("class "), "said", F.lit(" {}")), "UTF-8"))
    name = F.concat("r", F.lit("/"), F.when(F.col("k") % 4 == 0, F.concat(F.lit("skipped/"), "n")).otherwise(F.col("n")))
    files = parts(t).select(F.concat(name, F.lit(".java")).alias("name"), body.alias("body")).unionByName(parts(t).where("k % 5 = 0").select(F.concat(name, F.lit(".txt")).alias("name"), F.encode(F.lit("no source"), "UTF-8").alias("body")))
    base = scratch(t._spark, "files")
    writers.named_files(spread(files, "name"), base)
    return readers.sources(t._spark, base, exclude=("/skipped/", "/r7/")).select("ord", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "text", "error")


def shard_files(t, rows: DataFrame, more: int = 0) -> str:
    told = "lpad(CAST(f AS STRING), 3, '0')"
    head = f"""'{{"project_id": "p' || {told} || '", "commit_hash": "c' || {told} || '", "errors": [{{"message": "e' || {told} || '"}}, {{"message": "' || CAST(f * 7 AS STRING) || '"}}], "classes": [null'"""
    return filed(t, rows, f"'analysis_' || {told} || '.json'", f"""', {{"fqn": "com.' || r || '.' || n || '", "loc": ' || CAST(k + {more} AS STRING) || '}}'""", head, "']}'")


@query(f"SELECT 'p' || lpad(CAST(m AS VARCHAR), 3, '0') AS project_id, 'c' || lpad(CAST(m AS VARCHAR), 3, '0') AS commit_hash, 'com.' || r || '.' || n AS fqn, CAST(k AS BIGINT) AS loc FROM {BASE}, (SELECT min(f) AS m FROM {BASE})")
def analysis_shards(t):
    return readers.analysis(t._spark, shard_files(t, parts(t))).where("fqn IS NOT NULL").select("project_id", "commit_hash", "fqn", "loc")


@query(f"SELECT 'com.' || r || '.' || n AS fqn, CAST(CASE WHEN k % 2 = 0 THEN k + 100 ELSE k END AS BIGINT) AS loc, k % 2 = 0 AS second FROM {BASE} WHERE k % 2 = 0 OR k % 3 = 0")
def two_engines(t):
    """What a second engine found, in shards of its own, is merged into what the first one found."""
    first = readers.analysis(t._spark, shard_files(t, parts(t).where("k % 3 = 0"))).where("fqn IS NOT NULL").select("fqn", "loc", F.lit(False).alias("second"))
    second = readers.analysis(t._spark, shard_files(t, parts(t).where("k % 2 = 0"), 100)).where("fqn IS NOT NULL").select("fqn", "loc", F.lit(True).alias("second"))
    return merge.full_merge(first, second, ["fqn"], {"loc": merge.prefer_second, "second": merge.either})


@query(f"SELECT 'p' || lpad(CAST(m AS VARCHAR), 3, '0') AS project_id, unnest(['e' || lpad(CAST(m AS VARCHAR), 3, '0'), CAST(m * 7 AS VARCHAR)]) AS message FROM (SELECT min(f) AS m FROM {BASE} WHERE r >= 'r3')")
def analysis_errors(t):
    """Errors are those of the first shard alone."""
    return readers.analysis_errors(t._spark, shard_files(t, parts(t).where("r >= 'r3'"))).select("project_id", "message")


@query("SELECT CASE WHEN p_partkey % 5 = 0 THEN 'bad' WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'both' WHEN p_partkey % 3 = 0 THEN 'result' ELSE 'task' END AS kind, count(*) AS n FROM part GROUP BY 1")
def task_lines(t):
    n = F.col("p_partkey")
    line = F.when(n % 5 == 0, '{"task_id": ').otherwise(F.to_json(F.struct(n.cast("string").alias("task_id"), F.when(n % 2 == 0, "m").alias("method_name"), F.when(n % 3 == 0, "success").alias("status"))))
    rows = t.part.select(F.explode(F.array(line, F.lit(""))).alias("value"))
    read = readers.tasks(t._spark, written(t, rows, "text"), "task_id string, method_name string, status string")
    return read.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT n AS task_id, said AS method_name, length(said) > 10 AS selected, x.f AS format FROM {BASE}, (VALUES ('json'), ('yaml')) AS x(f)")
def task_documents(t):
    """The same tasks in JSON documents and in YAML, many to a file."""
    chosen, nl = "CASE WHEN length(said) > 10 THEN 'true' ELSE 'false' END", "chr(10)"
    as_json = filed(t, parts(t).withColumn("first", F.col("k") == F.min("k").over(Window.partitionBy("f"))), "'tasks' || CAST(f AS STRING) || '.json'", f"""CASE WHEN first THEN '' ELSE ', ' END || '{{"task_id": "' || n || '", "method_name": "' || said || '", "selected": ' || {chosen} || '}}'""", """'{"tasks": ['""", "']}'")
    as_yaml = filed(t, parts(t), "'tasks' || CAST(f AS STRING) || '.yaml'", f"'  - task_id: ' || n || {nl} || '    method_name: ' || chr(39) || said || chr(39) || '  # name' || {nl} || '    selected: ' || {chosen} || {nl}", f"'# tasks' || {nl} || 'tasks:' || {nl}")
    schema = "task_id string, method_name string, selected boolean"
    both = [readers.task_file(t._spark, f"{base}/*.{x}", schema).select("*", F.lit(x).alias("format")) for x, base in (("json", as_json), ("yaml", as_yaml))]
    return both[0].unionByName(both[1])


def coverage_files(t, rows: DataFrame | None = None) -> str:
    def counter(kind: str, missed: str, covered: str) -> str:
        return f"""'<counter type="{kind}" missed="' || CAST({missed} AS STRING) || '" covered="' || CAST({covered} AS STRING) || '"/>'"""

    methods = f"""'<method name="go" desc="(I)V" line="' || CAST(k AS STRING) || '">' || {counter("LINE", "k % 3", "k % 50")} || '</method><method name="&lt;init&gt;" desc="()V">' || {counter("LINE", "0", "1")} || '</method>'"""
    piece = f"""'<package name="com/' || r || '"><class name="com/' || r || '/' || n || '">' || {methods} || {counter("LINE", "k % 3", "k + 1")} || {counter("BRANCH", "k", "f")} || '</class></package>'"""
    return filed(t, parts(t) if rows is None else rows, "'m' || CAST(f AS STRING) || '/jacoco.xml'", piece, """'<?xml version="1.0"?><report name="x">'""", "'</report>'") + "/m*"


COVERAGE = f"SELECT type, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(covered) AS BIGINT) AS covered, sum(covered) / nullif(sum(missed) + sum(covered), 0) AS rate FROM (SELECT 'LINE' AS type, k % 3 AS missed, k + 1 AS covered FROM {BASE} UNION ALL SELECT 'BRANCH', k, f FROM {BASE}) GROUP BY 1"


@query(COVERAGE)
def coverage_totals(t):
    return readers.coverage_totals(readers.coverage(t._spark, coverage_files(t)))


@query(f"SELECT 'com.' || r || '.' || n AS class, m AS method, CAST(CASE WHEN m = 'go' THEN k % 3 ELSE 0 END AS BIGINT) AS missed, CAST(CASE WHEN m = 'go' THEN k % 50 ELSE 1 END AS BIGINT) AS covered, CASE WHEN m = 'go' THEN (k % 50) / nullif(k % 3 + k % 50, 0) ELSE 1.0 END AS rate FROM {BASE}, (VALUES ('go'), ('<init>')) AS x(m)")
def coverage_of_methods(t):
    return readers.method_coverage(t._spark, coverage_files(t)).where("type = 'LINE'").select("class", "method", "missed", "covered", "rate")


@query(COVERAGE)
def coverage_merged(t):
    """Summaries of two batches are stored, and merged without their reports: they come to the summary of all."""
    stored = scratch(t._spark, "summaries")
    for half in (0, 1):
        readers.coverage_totals(readers.coverage(t._spark, coverage_files(t, parts(t).where(f"k % 2 = {half}")))).write.mode("append").parquet(stored)
    return readers.coverage_totals(t._spark.read.parquet(stored))


def junit(t) -> str:
    """Reports with cases in nested suites, whose own figures are wrong, and reports with nothing but figures."""
    inner = """CASE k % 6 WHEN 0 THEN '<failure message="no ' || said || '" type="E">x</failure>' WHEN 1 THEN '<error message="bad"/>' WHEN 2 THEN '<skipped/>' ELSE '' END"""
    suite = f"""'<testsuite name="' || n || '" tests="9" failures="9" errors="0" skipped="0"><testsuite name="in' || n || '"><testcase classname="c.' || n || '" name="t' || CAST(k AS STRING) || '" time="0.5">' || {inner} || '</testcase></testsuite></testsuite>'"""
    bare = """'<testsuite name="b' || n || '" tests="' || CAST(k + 3 AS STRING) || '" failures="1" errors="' || CAST(k % 2 AS STRING) || '" skipped="1"/>'"""
    return filed(t, parts(t), "'TEST-' || CAST(f AS STRING) || '.xml'", f"CASE WHEN f % 2 = 0 THEN {suite} ELSE {bare} END", "'<testsuites>'", "'</testsuites>'")


@query(f"SELECT 'c.' || n AS class, 't' || k AS name, CASE k % 6 WHEN 0 THEN 'failure' WHEN 1 THEN 'error' WHEN 2 THEN 'skipped' ELSE 'passed' END AS status, CASE k % 6 WHEN 0 THEN 'no ' || said WHEN 1 THEN 'bad' END AS message, 0.5::DOUBLE AS seconds FROM {BASE} WHERE f % 2 = 0")
def test_cases(t):
    return readers.test_cases(t._spark, junit(t))


@query(
    f"""SELECT 'TEST-' || f || '.xml' AS file, CAST(sum(CASE WHEN f % 2 = 0 THEN 1 ELSE k + 3 END) AS BIGINT) AS tests, CAST(sum(CASE WHEN f % 2 = 1 OR k % 6 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures,
    CAST(sum(CASE WHEN f % 2 = 1 THEN k % 2 WHEN k % 6 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN f % 2 = 1 OR k % 6 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
    CAST(sum(CASE WHEN f % 2 = 1 THEN k + 1 - k % 2 WHEN k % 6 > 2 THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM {BASE} GROUP BY f"""
)
def test_totals(t):
    """Cases are counted; a report without cases is told by its suites' own figures."""
    found = readers.test_summary(t._spark, junit(t))
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "tests", "failures", "errors", "skipped", "passed")


@query(
    f"""SELECT 'spotbugs' AS tool, CASE k % 4 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, 'R' || r AS rule_id, 'said ' || said AS message, n || '.java' AS file_path, CAST(k AS BIGINT) AS line_number, 'c.' || n AS class_name FROM {BASE}
    UNION ALL SELECT 'pmd', CASE k % 4 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END, 'R' || r, 'said ' || said, n || '.java', CAST(k AS BIGINT), n FROM {BASE}
    UNION ALL SELECT 'checkstyle', CASE k % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END, 'R' || r, 'said ' || said, n || '.java', CAST(k AS BIGINT), NULL FROM {BASE}"""
)
def findings(t):
    at, name = "CAST(k AS STRING)", "'f' || CAST(f AS STRING) || '.xml'"
    bugs = f"""'<BugInstance type="R' || r || '" priority="' || CAST(k % 4 AS STRING) || '"><Class classname="c.' || n || '"/><LongMessage>said ' || said || '</LongMessage><SourceLine sourcepath="' || n || '.java" start="' || {at} || '"/></BugInstance>'"""
    pmd = f"""'<file name="' || n || '.java"><violation beginline="' || {at} || '" rule="R' || r || '" priority="' || CAST(k % 4 AS STRING) || '" class="' || n || '">' || chr(10) || 'said ' || said || chr(10) || '</violation></file>'"""
    style = f"""'<file name="' || n || '.java"><error line="' || {at} || '" severity="' || CASE k % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'ignore' END || '" message="said ' || said || '" source="R' || r || '"/></file>'"""
    out = None
    for tool, piece, root in (("spotbugs", bugs, "BugCollection"), ("pmd", pmd, "pmd"), ("checkstyle", style, "checkstyle")):
        found = readers.findings(t._spark, filed(t, parts(t), name, piece, f"'<{root}>'", f"'</{root}>'"), tool)
        out = found if out is None else out.unionByName(found)
    return out


@query(f"SELECT r || '.' || k AS key, CASE WHEN k % 2 = 0 THEN said ELSE 'yaml ' || said END AS value FROM {BASE} UNION ALL SELECT 'spring.list[' || i || ']', 'v' || i FROM range(3) r(i)")
def configuration(t):
    """Keys of .properties and YAML files; the first by path and line wins."""
    number, nl = "lpad(CAST(f AS STRING), 3, '0')", "chr(10)"
    # Even numbers stand in the first files and once more in later ones, all of them in YAML files after these.
    even = parts(t).where("k % 2 = 0")
    made = [
        bodies(even, f"'a' || {number} || '.properties'", f"r || '.' || CAST(k AS STRING) || ' = ' || said || {nl}", f"'# comment' || {nl} || '! too' || {nl}"),
        bodies(even, f"'b' || {number} || '.properties'", f"r || '.' || CAST(k AS STRING) || ': again' || {nl}"),
        bodies(parts(t), f"'c/' || {number} || '.yml'", f"r || ':' || {nl} || '  ' || CAST(k AS STRING) || ': \"yaml ' || said || '\"' || {nl}", "''", f"'spring:' || {nl} || '  list:' || {nl} || '    - v0' || {nl} || '    - v1' || {nl} || '    - v2' || {nl}"),
    ]
    base = scratch(t._spark, "files")
    writers.named_files(made[0].unionByName(made[1]).unionByName(made[2]), base)
    return readers.configuration(t._spark, base)


@query(
    f"""SELECT 'com/' || r || '/' || n || '.json' AS file, 'com.' || r || '.' || n AS fqn, CAST(k AS BIGINT) AS loc, 'p' || k % 5 AS project, array_to_string(e, ',') AS errors FROM {BASE}
    LEFT JOIN (SELECT 'p' || s_nationkey % 5 AS p, list_sort(list(s_name)) AS e FROM supplier WHERE s_nationkey % 5 < 4 GROUP BY 1) ON p = 'p' || k % 5"""
)
def class_files(t):
    """A file a class, and the errors of projects once; read back, with its place and its project's errors."""
    classes = parts(t).select(F.concat_ws(".", F.lit("com"), "r", "n").alias("fqn"), F.col("k").cast("long").alias("loc"), F.concat(F.lit("p"), F.col("k") % 5).alias("project"))
    errors = t.supplier.where("s_nationkey % 5 < 4").select(F.concat(F.lit("p"), F.col("s_nationkey") % 5).alias("project"), F.col("s_name").alias("message"))
    folder = scratch(t._spark, "classes")
    writers.class_files(spread(classes, "fqn"), folder, "fqn", errors, "project")
    read = readers.class_files(t._spark, folder, "fqn string, loc long, project string", "project")
    return read.select(F.regexp_extract("path", r"(com/.*)$", 1).alias("file"), "fqn", "loc", "project", F.array_join("errors", ",").alias("errors"))


@query("SELECT 'f' || p_size AS path, count(DISTINCT p_brand) AS commits FROM part GROUP BY 1")
def commit_counts(t):
    return readers.commit_counts(t.part.select(F.col("p_brand").alias("commit"), F.concat(F.lit("f"), "p_size").alias("path")))


RUNS = "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS run_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok FROM events GROUP BY 1"


@query(f"SELECT run_id, CAST(total AS INT) AS total_tasks, CAST(ok AS INT) AS succeeded, ok / total AS success_rate FROM ({RUNS}) ORDER BY run_id DESC LIMIT 10")
def history_saved_and_loaded(t):
    """A run is added to the history, of which the newest ten stay."""
    daily = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id")).agg(F.count(F.lit(1)).cast("int").alias("total_tasks"), F.count_if(F.col("event_type") != "error").cast("int").alias("succeeded"), F.unix_micros(F.min(F.col("ts").cast("timestamp"))).alias("timestamp"))
    runs = daily.select("run_id", "timestamp", "total_tasks", "succeeded", (F.col("total_tasks") - F.col("succeeded")).alias("failed"), F.lit(0).alias("skipped"), rules.rate(F.col("succeeded"), F.col("total_tasks")).alias("success_rate"))
    first, second = scratch(t._spark, "history"), scratch(t._spark, "history")
    newest = runs.orderBy(F.desc("run_id")).limit(1)
    writers.history(runs.join(newest.select("run_id"), "run_id", "left_anti"), first, 1000)
    writers.history(readers.history(t._spark, first).unionByName(newest.select(*readers.history(t._spark, first).columns)), second, 10)
    return readers.history(t._spark, second).select("run_id", "total_tasks", "succeeded", "success_rate")


@query("SELECT n_name AS method, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 3 + 1 ELSE 0 END AS n FROM nation")
def attached_resolutions(t):
    base = t.nation.select(F.col("n_name").alias("method"), F.array().cast("array<string>").alias("resolutions"))
    more = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("method"), F.explode(F.sequence(F.lit(0), F.col("n_nationkey") % 3).cast("array<string>")).alias("resolutions"))
    attached = merge.attach_if_absent(base, more, "method", "resolutions")
    again = merge.attach_if_absent(attached, more, "method", "resolutions")
    return again.select("method", F.size("resolutions").alias("n"))


# --- sinks


@query(f"SELECT 'com/' || r_name AS folder, n_name AS name, r_name AS error {JOINED}")
def class_shards(t):
    """One shard a class, in folders by package, the errors of its project in each."""
    classes = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("com."), "r_name").alias("package"), F.col("n_name").alias("name"), "r_name")
    errors = t.region.select("r_name", F.col("r_name").alias("error"))
    path = scratch(t._spark, "shards")
    writers.class_shards(classes, path, "package", "name", errors, "r_name")
    return readers.class_shards(t._spark, path).select("folder", "name", F.explode("errors").alias("error"))


@query("SELECT CAST(row_number() OVER (ORDER BY p) AS INT) AS place, p AS path FROM (SELECT DISTINCT p_type || '/' || p_size AS p FROM part)")
def file_list(t):
    path = scratch(t._spark, "list")
    writers.file_list(t.part.select(F.concat("p_type", F.lit("/"), "p_size").alias("path")), path)
    return readers.file_list(t._spark, path)


@query("SELECT event_type AS feature_type, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS line_start FROM events GROUP BY 1")
def event_lines(t):
    path = scratch(t._spark, "events")
    writers.events(t.events.select(F.col("event_type").alias("feature_type"), F.floor("value").alias("line_start")), path)
    return t._spark.read.schema("feature_type string, line_start long").json(path).groupBy("feature_type").agg(F.count(F.lit(1)).alias("n"), F.sum("line_start").alias("line_start"))


@query(
    """SELECT o_orderpriority AS source, count(*) FILTER (o_orderstatus = 'F') AS "n_RESOLVED", count(*) FILTER (o_orderstatus = 'O') AS "n_UNRESOLVED", count(*) FILTER (o_orderstatus = 'P') AS "n_AMBIGUOUS", count(*) AS total, floor(100 * (count(*) FILTER (o_orderstatus = 'F') / count(*)) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS rate,
    (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT o_orderkey AS k FROM orders i WHERE i.o_orderpriority = o.o_orderpriority AND i.o_orderstatus = 'O' ORDER BY k LIMIT 10)) AS examples FROM orders o GROUP BY 1"""
)
def resolution_summary(t):
    status = F.when(F.col("o_orderstatus") == "F", "RESOLVED").when(F.col("o_orderstatus") == "O", "UNRESOLVED").otherwise("AMBIGUOUS")
    calls = t.orders.select(F.col("o_orderpriority").alias("source"), status.alias("status"), F.col("o_orderkey").alias("ref"))
    return writers.resolution_summary(calls, "ref", "UNRESOLVED").withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query(
    """SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 4 = 0 THEN 'done' ELSE o_orderstatus END AS status, o_orderpriority AS kind, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS tests FROM orders WHERE o_orderkey % 3 = 0"""
)
def tasks_with_results(t):
    key = F.col("o_orderkey")
    tasks = t.orders.select(key.alias("task_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"))
    results = t.orders.where("o_orderkey % 3 = 0").select(key.alias("task_id"), F.when(key % 4 == 0, "done").alias("status"), F.when(key % 2 == 0, F.col("o_custkey")).alias("tests"))
    path = scratch(t._spark, "tasks")
    writers.task_file(writers.with_results(tasks, results, "task_id"), path)
    return t._spark.read.schema("task_id long, status string, kind string, tests long").json(path)


@query(f"SELECT CAST(row_number() OVER (ORDER BY k, l) AS INT) AS place, l AS line FROM (SELECT 0 AS k, 'classDiagram' AS l UNION ALL SELECT DISTINCT 1, '  ' || r_name || ' --> ' || n_name {JOINED})")
def mermaid_lines(t):
    edges = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    path = scratch(t._spark, "diagram")
    writers.diagram(edges.union(edges), path, "r_name", "n_name")
    return readers.ordered_lines(t._spark, path).select("place", "line")


@query(f"SELECT CAST(row_number() OVER (ORDER BY k, l) AS INT) AS place, l AS line FROM (SELECT 0 AS k, '@startuml' AS l UNION ALL SELECT DISTINCT 1, r_name || ' --> ' || n_name {JOINED} UNION ALL SELECT 2, '@enduml')")
def plantuml_lines(t):
    edges = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")
    path = scratch(t._spark, "diagram")
    writers.diagram(edges, path, "r_name", "n_name", "plantuml")
    return readers.ordered_lines(t._spark, path).select("place", "line")


@query(
    """WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS request, CASE WHEN role <> 'user' THEN text END AS response FROM conversations)
    SELECT conv_id, turn, length(request) AS request_chars, length(response) AS response_chars, sha256(request) AS request_sha256, sha256(response) AS response_sha256, CAST(coalesce(ceil(length(request) / 4), 0) AS BIGINT) AS request_tokens, CAST(coalesce(ceil(length(response) / 4), 0) AS BIGINT) AS response_tokens, CASE WHEN response IS NULL THEN 'failed' ELSE 'answered' END AS outcome FROM c"""
)
def audit_records(t):
    said = [F.when((F.col("role") == "user") == F.lit(x), F.col("text")).alias(c) for x, c in ((True, "request"), (False, "response"))]
    path = scratch(t._spark, "audit")
    writers.audit(t.conversations.select("conv_id", "turn", *said), path)
    return t._spark.read.schema("conv_id long, turn long, request_chars long, response_chars long, request_sha256 string, response_sha256 string, request_tokens long, response_tokens long, outcome string").json(path)


# --- stages


def _fails(rows: DataFrame, until: int) -> DataFrame:
    """The rows; while its stage is in an attempt before ``until``, the task of the first partition raises."""
    from tessera.plans.stages import ATTEMPT

    early = ATTEMPT.get() < until

    def checked(batches):
        from pyspark import TaskContext

        if early and TaskContext.get().partitionId() == 0:
            raise OSError("not yet")
        yield from batches

    return rows.mapInArrow(checked, rows.schema)


def _sleeps(rows: DataFrame) -> DataFrame:
    """The rows, each task an hour late."""

    def late(batches):
        import time

        time.sleep(3600)
        yield from batches

    return rows.mapInArrow(late, rows.schema)


@query("SELECT CASE WHEN k = 0 THEN 'low' ELSE 'high' END AS band, count(*) AS n FROM (SELECT CASE WHEN p_size < 25 THEN 0 ELSE 1 END AS k FROM part WHERE p_partkey % 2 = 0) GROUP BY 1")
def staged_run(t):
    """Stages with retries and policies: a task of one fails twice and then works, one fails for good and is passed over; a check after each may only warn."""
    from tessera.plans.stages import Stage, run

    def broken(rows: DataFrame) -> DataFrame:
        return _fails(rows, 99)

    def banded(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.when(F.col("p_size") < 25, "low").otherwise("high").alias("band")).agg(F.count(F.lit(1)).alias("n"))

    def warns(name: str, rows: DataFrame) -> None:
        raise RuntimeError("only a warning")

    stages = [Stage("shaky", lambda rows: _fails(rows, 2).where("p_partkey % 2 = 0"), retries=2), Stage("broken", broken, on_failure="skip"), Stage("banded", banded, needs=("shaky",))]
    return run(stages, t.part, after=[warns], folder=scratch(t._spark, "stages"))[0]


@query(
    """WITH f AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT l_suppkey, sum(CAST(l_quantity AS DECIMAL(18, 2))) AS quantity FROM f GROUP BY 1),
    n AS (SELECT (SELECT count(*) FROM f) AS f, (SELECT count(*) FROM g) AS g, (SELECT count(*) FROM g WHERE quantity > 100) AS h, (SELECT CAST(sum(quantity) AS DOUBLE) FROM g WHERE quantity > 100) AS q)
    SELECT run, stage, status, attempts, CASE stage WHEN 'returned' THEN f WHEN 'late' THEN f WHEN 'suppliers' THEN g ELSE h END AS n, CASE WHEN stage = 'large' THEN q END AS quantity FROM n, (VALUES
      (1, 'returned', 'done', 3), (1, 'late', 'continued', 1), (1, 'suppliers', 'done', 1), (1, 'large', 'done', 1),
      (2, 'returned', 'resumed', 0), (2, 'late', 'continued', 1), (2, 'suppliers', 'resumed', 0), (2, 'large', 'done', 1)) AS v(run, stage, status, attempts)"""
)
def resumed_run(t):
    """Two runs over one folder: a task raises in two attempts, a stage overruns its time and is cancelled, and the second run takes what is committed and has the same version."""
    from tessera.plans.stages import Stage, run

    folder, out = scratch(t._spark, "stages"), None
    for nth in (1, 2):
        stages = [
            Stage("returned", lambda rows: _fails(rows.where("l_returnflag = 'R'"), 2), retries=2), Stage("late", _sleeps, needs=("returned",), timeout=1.5, on_failure="continue"),
            Stage("suppliers", lambda rows: rows.groupBy("l_suppkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity")), needs=("late",)),
            Stage("large", lambda rows: rows.where("quantity > 100"), needs=("suppliers",), version=str(nth)),
        ]
        sizes = {}
        rows, log = run(stages, t.lineitem, after=[lambda name, made: sizes.__setitem__(name, made)], folder=folder, origin="lineitem")
        for x in log:
            if x["status"] == "resumed":
                sizes[x["stage"]] = t._spark.read.parquet(_committed(t._spark, folder, x["stage"]))
        for x in log:
            made = sizes.get(x["stage"], sizes["returned"])
            q = F.sum("quantity").cast("double") if x["stage"] == "large" else F.lit(None).cast("double")
            row = made.agg(F.count(F.lit(1)).alias("n"), q.alias("quantity")).select(F.lit(nth).alias("run"), F.lit(x["stage"]).alias("stage"), F.lit(x["status"]).alias("status"), F.lit(x["attempts"]).alias("attempts"), "n", "quantity")
            out = row if out is None else out.unionByName(row)
    return out


def _committed(spark, folder: str, stage: str) -> str:
    from tessera.plans.stages import _Folder

    return _Folder(spark, folder).marker(stage)["path"]
