"""Queries over names, methods and calls that are made up from the driver's tables, and the same as SQL.

The made-up inputs are written once, in words that Spark and DuckDB share; what is done with them is written twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import code, rules
from tessera.operators import graph, lookup, merge, rollup, stats
from tessera.plans.catalog import query


class Made:
    """Columns made from a table; ARR( stands for a list of values."""

    def __init__(self, table: str, *columns: str):
        self.table, self.columns = table, columns
        self.sql = f"(SELECT {', '.join(columns).replace('ARR(', 'list_value(')} FROM {table})"

    def __call__(self, t) -> DataFrame:
        return getattr(t, self.table).selectExpr(*[c.replace("ARR(", "array(") for c in self.columns])


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


N = text("p_partkey % 7")
METHODS = Made(
    "part", "p_partkey AS id", "'com.' || replace(p_name, ' ', '.') AS package", f"'C' || lower(p_type) || {N} AS simple", f"'com.' || replace(p_name, ' ', '.') || '.C' || lower(p_type) || {N} AS fqn",
    "CASE p_partkey % 6 WHEN 0 THEN 'getToken' WHEN 1 THEN 'load' WHEN 2 THEN 'encryptAll' WHEN 3 THEN 'toString' WHEN 4 THEN 'build' ELSE 'run' END AS name",
    "CASE p_size % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'public' END AS visibility", "p_size AS complexity", "p_partkey % 5 AS loc", "p_partkey % 4 AS parameters", "p_size % 4 > 0 AS has_body", "p_partkey % 11 = 0 AS flag",
    "ARR(CASE WHEN p_size % 5 = 0 THEN '@org.x.Secured' ELSE 'Override' END, CASE WHEN p_size % 9 = 0 THEN 'Test' ELSE 'Bean' END) AS annotations",
)


# --- predicates and names


@query(
    f"""WITH m AS {METHODS.sql}, c AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY 1)
    SELECT id AS key, coalesce(n, 0) AS usage, coalesce(n, 0) = 0 AND coalesce(visibility, '') <> 'public' AND has_body AND NOT list_contains(annotations, 'Test') AS dead FROM m LEFT JOIN c ON l_partkey = id"""
)
def dead_methods(t):
    methods = METHODS(t).select(F.col("id").alias("key"), "visibility", "has_body", code.is_entry_point("annotations", ("Test",), (".Main",)).alias("is_entry"))
    return graph.dead_methods(methods, t.lineitem.where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("callee"))).select("key", "usage", "dead")


@query(f"SELECT id, list_contains(annotations, 'Test') OR list_contains(annotations, '@org.x.Secured') AS entry FROM {METHODS.sql}")
def entry_points(t):
    return METHODS(t).select("id", code.is_entry_point("annotations", ("Test",), (".Secured",)).alias("entry"))


CLASSES = Made("part", "p_partkey AS id", "p_partkey % 8 = 0 AS nested", "CASE p_partkey % 5 WHEN 0 THEN replace('/app/src/test/java/A.java', '/', chr(92)) WHEN 1 THEN 'src/test/x/A.java' WHEN 2 THEN NULL WHEN 3 THEN 'asrc/test/A.java' ELSE 'src/main/java/A.java' END AS path", "CASE p_size % 6 WHEN 0 THEN 'com.a.LoadTest' WHEN 1 THEN 'com.Test.util.A' WHEN 2 THEN NULL ELSE 'com.a.Testing' END AS fqn")


@query(f"SELECT id FROM {CLASSES.sql} JOIN part ON id = p_partkey WHERE NOT nested AND id % 5 > 1 AND p_size % 6 > 1")
def main_classes(t):
    return CLASSES(t).where(code.is_main_class("nested", "path", "fqn")).select("id")


CONSTRUCTED = Made("part", "p_partkey AS id", "'C' || replace(p_name, ' ', '_') AS simple", "CASE p_partkey % 3 WHEN 0 THEN '<init>' WHEN 1 THEN 'C' || replace(p_name, ' ', '_') ELSE p_name END AS name", "CASE WHEN p_size % 4 < 2 THEN 0 WHEN p_size % 4 = 2 THEN p_size END AS parameters", "CASE WHEN p_retailprice > 1200 THEN p_size WHEN p_retailprice > 1000 THEN 0 WHEN p_retailprice > 950 THEN -1 END AS loc")


@query(f"SELECT id FROM {CONSTRUCTED.sql} WHERE (name = '<init>' OR name = simple) AND coalesce(parameters, 0) = 0 AND coalesce(loc, 0) <= 0")
def implicit_constructors(t):
    return CONSTRUCTED(t).where(code.is_implicit_constructor("name", "simple", "parameters", "loc")).select("id")


GUARDED = Made(
    "part", "p_partkey AS id", "'com.' || replace(p_name, ' ', '.') || '.C' AS fqn",
    "CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '') WHEN 1 THEN 'do' ELSE 'get' END || CASE p_size WHEN 1 THEN 'Password' WHEN 2 THEN 'secrets' WHEN 3 THEN 'TokenOf' WHEN 4 THEN 'Credential' WHEN 5 THEN 'Encrypted' WHEN 6 THEN 'decrypt' WHEN 7 THEN 'authenticateAll' "
    "WHEN 8 THEN 'Authorize' WHEN 9 THEN 'ApiKey' WHEN 10 THEN 'privateKey' WHEN 11 THEN 'SignIn' WHEN 12 THEN 'signOut' WHEN 13 THEN 'LoginUser' WHEN 14 THEN 'LOGOUT' WHEN 15 THEN 'Key' WHEN 16 THEN 'Sign' WHEN 17 THEN 'Log' ELSE p_type END AS name",
    "ARR('Override', CASE p_partkey % 13 WHEN 0 THEN '@PreAuthorize(\"hasRole(''a.X'')\")' WHEN 1 THEN 'org.sec.Secured' WHEN 2 THEN '@a.b.RolesAllowed({\"x\"})' WHEN 3 THEN '@PermitAll' WHEN 4 THEN '@x.DenyAll()' WHEN 5 THEN '@NotSecured' WHEN 6 THEN '@Other(value = Secured)' WHEN 7 THEN '@PostAuthorize' "
    "WHEN 8 THEN '@Encrypt(1)' WHEN 9 THEN 'Decrypt' WHEN 10 THEN '@x.Secured.Not' WHEN 11 THEN NULL ELSE '@SecuredBy' END) AS annotations",
)


@query(
    f"""SELECT DISTINCT unnest([CAST(id AS VARCHAR), fqn || '#' || name]) AS method_id FROM {GUARDED.sql} WHERE regexp_matches(lower(name), 'password|secret|token|credential|encrypt|decrypt|authenticate|authorize|apikey|privatekey|signin|signout|login|logout')
    OR len(list_filter(annotations, lambda a: regexp_matches(a, '^@?([^(]*\\.)?(PreAuthorize|PostAuthorize|Secured|RolesAllowed|PermitAll|DenyAll|Encrypt|Decrypt)(\\(.*)?$'))) > 0"""
)
def sensitive_methods(t):
    rows = GUARDED(t).where(code.is_sensitive("name", "annotations"))
    return rows.select(F.explode(code.sensitive_ids("fqn", "name", F.col("id").cast("string"))).alias("method_id")).distinct()


IMPORTS = Made(
    "part", "p_partkey AS id",
    "ARR(CASE p_partkey % 9 WHEN 0 THEN 'javax.xml.bind.JAXB' WHEN 1 THEN 'static javax.activation.A.b' WHEN 2 THEN 'javax.xml.bindings.X' WHEN 3 THEN 'import javax.xml.ws.*' ELSE 'java.util.List' END) AS imports",
    "ARR(CASE p_size % 7 WHEN 0 THEN 'List<javax.xml.bind.Element>' WHEN 1 THEN 'my.javax.xml.bind.X' WHEN 2 THEN 'Map<String, ? extends javax.activation.DataSource>' ELSE 'int' END) AS types",
)


@query(f"SELECT id FROM {IMPORTS.sql} WHERE id % 9 IN (0, 1, 3) OR types[1] IN ('List<javax.xml.bind.Element>', 'Map<String, ? extends javax.activation.DataSource>')")
def removed_apis(t):
    return IMPORTS(t).where(code.uses_removed_api("imports", "types")).select("id")


BLANKED = r"""'"(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])*''|//[^\n]*|/\*[\s\S]*?\*/'"""


@query(
    rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, {BLANKED}, ' ', 'g'), '[^\x00-\x7F]', 'z', 'g') AS x FROM pages), c AS (SELECT page_id, x, len(regexp_extract_all(x, '\b(?:if|for|while|catch|case|default)\b|\?[^;?:]*:')) AS n,
      list_transform(regexp_extract_all(x, '[{{}}]'), lambda c: CASE WHEN c = '{{' THEN 1 ELSE -1 END) AS steps FROM b)
    SELECT page_id, regexp_matches(x, '\b(?:for|while|do)\b') AS loops, regexp_matches(x, '\b(?:if|switch|case)\b|\?[^;?]*:') AS conditionals, CAST(1 + n AS BIGINT) AS cyclomatic,
    CAST(greatest(0, coalesce(list_max(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))), 0) - 1) AS BIGINT) AS nesting FROM c"""
)
def method_metrics(t):
    return t.pages.select("page_id", code.has_loops("html").alias("loops"), code.has_conditionals("html").alias("conditionals"), code.cyclomatic("html").alias("cyclomatic"), code.nesting("html").alias("nesting"))


BODIES = Made("part", "p_partkey AS id", "'if (x > ' || " + N + """ || ') { throw new E("if (a) return"); } if (a.b(c)) return 1; ' || CASE WHEN p_size % 2 = 0 THEN 'if (a.b(c)) { return 1; }' ELSE 'if (z) go(); // if (y) return' END AS body""")


@query(f"SELECT id, 'throw x > ' || CAST(id % 7 AS VARCHAR) || '|return a.b(c)' AS guards, 2 AS n FROM {BODIES.sql}")
def branch_guards(t):
    found = code.guards("body")
    return BODIES(t).select("id", F.array_join(found, "|").alias("guards"), F.size(found).alias("n"))


CODE = Made("part", "p_partkey AS id", """'int a  =  1; // it''s ' || p_name || chr(10) || 'String s = "a  b' || chr(92) || '"  c"; /* " ' || p_type || ' */ char c = '' ''; ' || """ + N + " AS body")


@query("""SELECT p_partkey AS id, sha256('inta=1;//it''s' || replace(p_name, ' ', '') || 'Strings="a  b' || chr(92) || '"  c";/*"' || p_type || '*/charc='' '';' || CAST(p_partkey % 7 AS VARCHAR)) AS hash FROM part""")
def code_hashes(t):
    return CODE(t).select("id", code.code_hash("body").alias("hash"))


TYPES = Made("part", "p_partkey AS id", f"'Map<String, List<Map<A, Set<List<B<C, D' || {N} || '>>>>>> m, final java.util.List<x.Y> ' || lower(p_type) || ', @N(a) int[] n, String...' AS csv")


@query(
    f"""SELECT id, 'Map<String, List<Map<A, Set<List<B<C, D' || CAST(id % 7 AS VARCHAR) || '>>>>>> m|final java.util.List<x.Y> ' || lower(p_type) || '|@N(a) int[] n|String...' AS parts, 'Map|List|n|String' AS simple,
    'map<string,list<map<a,set<list<b<c,d' || CAST(id % 7 AS VARCHAR) || '>>>>>>|list<y>|int[]|string...' AS types FROM part JOIN {TYPES.sql} ON id = p_partkey"""
)
def type_names(t):
    parts = code.split_top_level("csv")
    simple = F.transform(parts, lambda x: F.when(x.startswith("final"), code.simple_type(F.regexp_replace(x, "^final ", ""))).otherwise(F.when(x.startswith("@"), F.regexp_replace(x, r"^.* ", "")).otherwise(code.simple_type(x))))
    return TYPES(t).select("id", F.array_join(parts, "|").alias("parts"), F.array_join(simple, "|").alias("simple"), F.array_join(F.transform(parts, code.parameter_type), "|").alias("types"))


@query(f"SELECT id, CASE WHEN id % 10 = 0 THEN '' ELSE package END AS package, simple || CASE WHEN id % 3 = 0 THEN '.Inner' ELSE '' END AS class FROM {METHODS.sql}")
def package_and_class(t):
    fqn = F.concat(F.when(F.col("id") % 10 == 0, F.col("simple")).otherwise(F.col("fqn")), F.when(F.col("id") % 3 == 0, ".Inner").otherwise(""))
    return METHODS(t).select("id", code.package_of(fqn).alias("package"), code.class_of(fqn).alias("class"))


PACKAGES = Made("part", "p_partkey AS id", "CASE p_partkey % 10 WHEN 0 THEN 'com.acme.user.service.impl' WHEN 1 THEN 'com.acme.api.Model' WHEN 2 THEN 'com.acme.legacy' WHEN 3 THEN 'com.acme.deprecatedcode.util' WHEN 4 THEN '(default)' WHEN 5 THEN 'com.acme.test.web' WHEN 6 THEN 'com.acme' WHEN 7 THEN 'com.acme.dao.legacy' WHEN 8 THEN 'com.acme.x.Config' ELSE ' ' END AS package")


@query(
    f"""SELECT package, CASE id % 10 WHEN 0 THEN 'service' WHEN 1 THEN 'domain' WHEN 2 THEN 'legacy' WHEN 3 THEN 'utility' WHEN 4 THEN 'default' WHEN 5 THEN 'entry' WHEN 6 THEN 'core' WHEN 7 THEN 'data' WHEN 8 THEN 'infra' ELSE 'default' END AS role, count(*) AS n FROM {PACKAGES.sql} GROUP BY ALL"""
)
def package_roles(t):
    return PACKAGES(t).groupBy("package", code.package_role("package").alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT CASE WHEN id % 10 IN (4, 9) THEN 'default' WHEN id % 10 = 6 THEN 'acme' ELSE split_part(lower(package), '.', 3) END AS cluster, count(*) AS n FROM {PACKAGES.sql} GROUP BY 1"""
)
def package_clusters(t):
    rows = PACKAGES(t)
    prefix = rollup.common_prefix(rows.where("trim(package) <> '' and package <> '(default)'"), "package")
    return rows.groupBy(rollup.package_cluster("package", prefix).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN floor(value) - 20 > 0 THEN CAST(floor(value) - 20 AS BIGINT) ELSE CAST(greatest(floor(value) - 5, 0) + CASE WHEN event_type = 'view' THEN 3 ELSE 0 END AS BIGINT) END AS total FROM events")
def effective_tokens(t):
    v = F.floor("value")
    return t.events.select("event_id", rules.effective_total(v - 20, v - 5, F.when(F.col("event_type") == "view", 3).when(F.col("event_type") == "click", -4)).cast("long").alias("total"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'LOW' WHEN value / 100 >= 0.9 THEN 'HIGH' WHEN value / 100 >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS trust FROM events")
def effective_trust(t):
    verified = F.when(F.col("event_type") == "error", "False").when(F.col("event_type") == "view", "true")
    return t.events.select("event_id", rules.trust_level(F.col("value") / 100, verified).alias("trust"))


BREAKDOWNS = Made(
    "part", "p_partkey AS id",
    "CASE p_partkey % 7 WHEN 0 THEN '{\"shadow_score\": -0.5}' WHEN 1 THEN '{\"shadow_score\": 0.5, \"dynamic_reasons\": [\"low\", \"SKIP:min_conf<0.3\"]}' WHEN 2 THEN '{\"penalties\": {\"DYNAMIC_REASONS\": 0.2}}' WHEN 3 THEN '{\"penalties\": {\"DYNAMIC_REASONS\": 0}}' WHEN 4 THEN '{\"dynamic_reasons\": [\"skip\"]}' WHEN 5 THEN '{\"shadow_score\": \"x\"}' END AS breakdown",
    "CASE p_size % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS selected", "CASE p_size % 4 WHEN 0 THEN 'dynamic features' WHEN 1 THEN 'low confidence' WHEN 2 THEN 'other' END AS reason", "CAST(p_size % 5 - 1 AS DOUBLE) AS score",
)


@query(f"SELECT id, coalesce(id % 7 IN (0, 1, 2), FALSE) AS would_be, id % 7 = 2 OR coalesce(NOT selected AND (reason LIKE '%dynamic%' OR reason LIKE '%confidence%'), FALSE) OR score <= 0 AS excluded FROM {BREAKDOWNS.sql}")
def exclusions(t):
    return BREAKDOWNS(t).select("id", rules.would_be_excluded(F.col("breakdown")).alias("would_be"), rules.is_excluded(F.col("breakdown"), F.col("selected"), F.col("reason"), F.col("score")).alias("excluded"))


@query(f"SELECT id FROM {METHODS.sql} WHERE id % 3 < 2 AND name IN ('toString', 'build')")
def false_positives(t):
    raw = F.concat(F.when(F.col("id") % 3 < 2, "unknown#").otherwise("a.B#"), "name", F.when(F.col("id") % 2 == 0, "(int)").otherwise(""))
    return METHODS(t).where(code.is_false_positive(raw)).select("id")


JSON = Made("part", "p_partkey AS id", "'{ \"z\": ' || CAST(p_size AS STRING) || ', \"a\": {\"y\": [3, 1, {\"d\": null, \"c\": true}], \"b\": \"' || p_name || '\"} }' AS doc")


@query(f"SELECT id, '{{\"a\":{{\"b\":\"' || p_name || '\",\"y\":[3,1,{{\"c\":true,\"d\":null}}]}},\"z\":' || CAST(p_size AS VARCHAR) || '}}' AS canonical, sha256(CAST(length(p_name) AS VARCHAR) || ':' || p_name || CAST(length(p_type) AS VARCHAR) || ':' || p_type || '0:') AS key FROM part JOIN {JSON.sql} ON id = p_partkey")
def canonical_and_cache_keys(t):
    rows = JSON(t).join(t.part, F.col("id") == F.col("p_partkey"))
    return rows.select("id", code.canonical_json("doc").alias("canonical"), code.cache_key("p_name", "p_type", F.lit(None).cast("string")).alias("key"))


MESSAGES = Made(
    "part", "p_partkey AS id",
    f"CASE p_partkey % 5 WHEN 0 THEN 'expected: <' || {N} || '> but was: <' || {text('p_size')} || '>' WHEN 1 THEN 'x' || ' expected: ' || p_name || ' but was: null' WHEN 2 THEN 'Expecting: [1, ' || {N} || '] to be equal to: [2]' WHEN 3 THEN 'Expected: 1.5' || chr(10) || '     but: was ' || {text('p_size')} ELSE 'it broke' END AS message",
)


@query(
    f"""SELECT id, CASE id % 5 WHEN 0 THEN CAST(id % 7 AS VARCHAR) WHEN 1 THEN p_name WHEN 2 THEN '[1, ' || CAST(id % 7 AS VARCHAR) || ']' WHEN 3 THEN '1.5' END AS expected, CASE id % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN 'null' WHEN 2 THEN '[2]' WHEN 3 THEN CAST(p_size AS VARCHAR) END AS actual,
    CASE id % 5 WHEN 0 THEN 'integer' WHEN 1 THEN 'null' WHEN 2 THEN 'collection' WHEN 3 THEN 'float' END AS kind FROM {MESSAGES.sql} JOIN part ON id = p_partkey"""
)
def assertion_mismatches(t):
    return MESSAGES(t).withColumn("m", code.mismatch("message")).select("id", "m.expected", "m.actual", "m.kind")


@query(f"SELECT fqn || '#' || name AS method, simple || '_' || name || 'GeneratedTest' AS test, CASE WHEN id % 2 = 0 THEN 'Given' ELSE simple || '_' || name || '_x_GeneratedTest' END AS given, id FROM {METHODS.sql}")
def generated_names(t):
    odd = F.concat("name", F.lit("(x)"))
    return METHODS(t).select(F.concat("fqn", F.lit("#"), "name").alias("method"), code.generated_test_name("fqn", "name").alias("test"), code.generated_test_name("fqn", odd, F.when(F.col("id") % 2 == 0, "Given").otherwise(" ")).alias("given"), "id")


FIELDS = Made(
    "part", "p_partkey AS id", "CASE p_partkey % 7 WHEN 0 THEN 'com.x.UserPort' WHEN 1 THEN 'Map<String, Repo>' WHEN 2 THEN 'OrderREPOSITORY[]' WHEN 3 THEN 'Shape' WHEN 4 THEN NULL WHEN 5 THEN 'a.Clock' ELSE 'Client' END AS kind",
    "CASE WHEN p_size % 3 = 0 THEN 'private' ELSE 'public' END AS visibility", "p_size % 5 = 0 AS fixed", "p_size % 2 = 0 AS is_final", "ARR('b.Clock', 'x.Shape<T>') AS abstracts", "ARR('UserPort', 'Client', 'Shape') AS given",
)


@query(
    f"""SELECT id, CASE WHEN id % 7 IN (3, 5) THEN 'required' WHEN id % 7 IN (0, 2, 6) AND visibility = 'private' AND NOT fixed THEN 'recommended' END AS hint, id % 7 IN (0, 3, 6) AND visibility = 'private' AND NOT fixed AND is_final AS injectable FROM {FIELDS.sql}"""
)
def mock_hints(t):
    return FIELDS(t).withColumn("h", code.mock_hint("kind", "visibility", "fixed", "abstracts", "is_final", "given")).select("id", "h.hint", "h.injectable")


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'SERVICE' WHEN p_partkey % 4 = 1 THEN 'DATA_CLASS' WHEN p_size % 2 = 0 THEN 'EXCEPTION' ELSE 'GENERAL' END AS kind FROM part"""
)
def class_types(t):
    n = F.col("p_partkey") % 4
    annotations = F.array(F.when(n == 0, "@org.springframework.stereotype.Service(\"x\")").when(n == 1, "javax.persistence.Entity").otherwise("Serviceable"))
    return t.part.select(F.col("p_partkey").alias("id"), code.class_type(annotations, F.array(F.when(F.col("p_size") % 2 == 0, "java.io.IOException").otherwise("Base"))).alias("kind"))


# --- joins


@query(
    f"""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'java.lang.IllegalStateException,a.B,Custom' WHEN 1 THEN 'IOException,java.lang.Error' WHEN 2 THEN 'IllegalStateException' ELSE 'x.Y,Custom' END AS thrown FROM part"""
)
def exception_union(t):
    n = F.col("p_partkey") % 4
    first = F.when(n == 0, F.array(F.lit("IllegalStateException"), F.lit("java.lang.IllegalStateException"))).when(n == 1, F.array(F.lit("IOException"))).when(n == 2, F.array(F.lit("IllegalStateException"))).otherwise(F.array(F.lit("x.Y")))
    second = F.when(n == 0, F.array(F.lit("a.B"), F.lit("Custom"))).when(n == 1, F.array(F.lit("Error"), F.lit("java.lang.Error"))).when(n == 3, F.array(F.lit("Custom"), F.lit("x.Y")))
    return t.part.select(F.col("p_partkey").alias("id"), F.array_join(merge.union_exceptions(first, second), ",").alias("thrown"))


@query(
    """WITH a AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN p_name || '/' || p_partkey ELSE 'f' || p_partkey END AS key, p_size AS n FROM part WHERE p_partkey % 3 <> 0),
    b AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN p_name || '/' || p_partkey ELSE 'f' || p_partkey END AS key, p_size + 1 AS n FROM part WHERE p_partkey % 4 <> 0)
    SELECT coalesce(a.key, b.key) AS key, a.n AS n1, b.n AS n2 FROM a FULL OUTER JOIN b ON a.key = b.key"""
)
def classes_merged_by_name_or_path(t):
    n = F.col("p_partkey")
    rows = t.part.select(n, F.when(n % 10 != 0, F.concat(F.lit("f"), n)).when(n % 20 == 0, " ").alias("fqn"), F.concat("p_name", F.lit("/"), n).alias("file_path"), "p_size")
    a, b = (merge.keyed(rows.where(w)).select("key", v.alias("n")) for w, v in (("p_partkey % 3 <> 0", F.col("p_size")), ("p_partkey % 4 <> 0", F.col("p_size") + 1)))
    return merge.full_merge(a.withColumnRenamed("n", "n1").withColumn("n2", F.lit(None).cast("int")), b.withColumnRenamed("n", "n2").withColumn("n1", F.lit(None).cast("int")), ["key"], {"n1": merge.fill, "n2": merge.fill})


@query(
    """WITH a AS (SELECT l_orderkey AS key, count(*) AS n, list_sort(list(DISTINCT CAST(l_suppkey % 3 AS VARCHAR))) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey AS key, count(*) AS n, list_sort(list(DISTINCT CAST(l_suppkey % 3 AS VARCHAR))) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
    j AS (SELECT coalesce(a.key, b.key) AS key, a.key AS ak, b.key AS bk, a.n AS an, b.n AS bn, list_sort(list_filter(a.s, lambda x: NOT list_contains(b.s, x))) AS ao, list_sort(list_filter(b.s, lambda x: NOT list_contains(a.s, x))) AS bo FROM a FULL OUTER JOIN b ON a.key = b.key)
    SELECT key, 'only_first' AS what, '' AS first, '' AS second FROM j WHERE bk IS NULL UNION ALL SELECT key, 'only_second', '', '' FROM j WHERE ak IS NULL
    UNION ALL SELECT key, 'count', CAST(an AS VARCHAR), CAST(bn AS VARCHAR) FROM j WHERE an <> bn UNION ALL SELECT key, 's', array_to_string(ao, ','), array_to_string(bo, ',') FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND (len(ao) > 0 OR len(bo) > 0)"""
)
def engine_differences(t):
    a, b = (t.lineitem.where(f"l_returnflag = '{x}'").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.collect_set((F.col("l_suppkey") % 3).cast("string")).alias("s")) for x in "RA")
    found = merge.compare(a, b, "key", "n", ["s"])
    return found.select("key", "what", *[F.array_join(c, ",").alias(c) for c in ("first", "second")])


SIGNED = Made("part", "p_partkey AS id", "p_size AS ord", f"'C' || {text('p_partkey % 50')} AS class_name", f"CASE p_size % 4 WHEN 0 THEN 'go(int,  String)' WHEN 1 THEN 'go(int, Map<A, B>, long)' WHEN 2 THEN 'stop()' ELSE 'go(x)' END AS signature")
ASKED = Made("part", "p_partkey AS ref", f"'C' || {text('p_partkey % 60')} AS class_name", "CASE p_partkey % 5 WHEN 0 THEN 'go(int,  String)' WHEN 1 THEN 'go(int,String)' WHEN 2 THEN 'go(a, b, Map<C, D>)' WHEN 3 THEN 'stop(int)' ELSE 'halt()' END AS signature")


@query(
    f"""WITH m AS {SIGNED.sql}, a AS {ASKED.sql}, k AS (SELECT *, CASE WHEN signature LIKE 'go(int,  String)' THEN 2 WHEN signature LIKE 'go(int, Map%' THEN 3 WHEN signature LIKE 'stop%' THEN 0 ELSE 1 END AS arity, split_part(signature, '(', 1) AS name FROM m),
    w AS (SELECT *, CASE ref % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 0 END AS arity, split_part(signature, '(', 1) AS name FROM a),
    j AS (SELECT ref, id, ord, CASE WHEN w.signature = k.signature THEN 1 WHEN replace(w.signature, ' ', '') = replace(k.signature, ' ', '') THEN 2 WHEN w.arity = k.arity THEN 3 ELSE 4 END AS tier FROM w JOIN k ON w.class_name = k.class_name AND w.name = k.name)
    SELECT ref, id, CAST(tier AS INT) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY tier, ord, id) AS n FROM j) WHERE n = 1"""
)
def method_resolution(t):
    methods = SIGNED(t).withColumn("ord", F.struct("ord", "id"))
    return lookup.method_of(ASKED(t), "ref", methods)


COVERED = Made("part", f"'a.b.C' || {text('p_partkey')} || CASE p_partkey % 3 WHEN 0 THEN '$In' WHEN 1 THEN '.In' ELSE '' END AS class_name", "CAST(p_size AS BIGINT) AS covered")
WANTED = Made("part", "p_partkey AS ref", f"'a.b.C' || {text('p_partkey')} || CASE p_partkey % 4 WHEN 0 THEN '$In' WHEN 1 THEN '.In' ELSE '' END AS fqn")


@query(
    f"""SELECT ref, covered FROM (SELECT p_partkey AS ref, CAST(p_size AS BIGINT) AS covered, CASE p_partkey % 3 WHEN 0 THEN '$' WHEN 1 THEN '.' ELSE '' END AS has, CASE p_partkey % 4 WHEN 0 THEN '$' WHEN 1 THEN '.' ELSE '' END AS want FROM part) WHERE has = want OR (has <> '' AND want <> '')"""
)
def coverage_of_nested_classes(t):
    return lookup.first_known(WANTED(t), "ref", lookup.class_candidates(F.col("fqn")), COVERED(t), "class_name").select("ref", "covered")


CALLS = Made("part", "p_partkey AS call", f"CASE p_partkey % 7 WHEN 0 THEN 'k.Type' || {text('p_partkey % 40')} || '#run(int)' WHEN 1 THEN 'k$Type' || {text('p_partkey % 40')} WHEN 2 THEN 'Type' || {text('p_partkey % 40')} || '::new' WHEN 3 THEN 'item.size()' WHEN 4 THEN 'org.lib.Api#x' WHEN 5 THEN ' ' ELSE 'k.Type999' END AS raw", "CASE p_size % 6 WHEN 0 THEN 'None' WHEN 1 THEN 'lib.thing#go' END AS resolved")
KNOWN = Made("part", f"'k.Type' || {text('p_partkey % 40')} AS fqn")


@query(
    f"""WITH c AS {CALLS.sql}, k AS (SELECT DISTINCT fqn FROM {KNOWN.sql}), s AS (SELECT call, resolved IS NOT NULL AND resolved <> 'None' AS solved, CASE WHEN resolved IS NOT NULL AND resolved <> 'None' THEN 'lib.thing' ELSE regexp_replace(regexp_replace(regexp_replace(raw, '\\(.*$', ''), '#.*$', ''), '::.*$', '') END AS said FROM c),
    f AS (SELECT call, solved, said, k.fqn FROM s LEFT JOIN k ON k.fqn = said OR k.fqn = replace(said, '$', '.') OR k.fqn = 'k.' || said)
    SELECT call, coalesce(fqn, said) AS target, fqn IS NOT NULL AS internal FROM f WHERE trim(said) <> '' AND (fqn IS NOT NULL OR solved OR NOT regexp_matches(said, '^[a-z]'))"""
)
def call_targets(t):
    return lookup.class_of_call(CALLS(t), "call", KNOWN(t))


REFS = Made("part", f"CASE p_partkey % 3 WHEN 0 THEN 'k.Type' || {text('p_partkey % 60')} WHEN 1 THEN 'Type' || {text('p_partkey % 60')} ELSE 'v.Type' || {text('p_partkey % 60')} END AS ref", "CASE WHEN p_size % 2 = 0 THEN 'k' ELSE 'other' END AS package")
ALL_TYPES = Made("part", f"CASE WHEN p_partkey % 2 = 0 THEN 'k.Type' || {text('p_partkey % 40')} ELSE 'u.v.Type' || {text('p_partkey % 30')} END AS fqn")


@query(
    f"""WITH r AS (SELECT DISTINCT ref, package FROM {REFS.sql}), k AS (SELECT DISTINCT fqn FROM {ALL_TYPES.sql}), e AS (SELECT r.ref, r.package, k.fqn FROM r JOIN k ON k.fqn = r.ref OR ends_with(k.fqn, '.' || r.ref)), u AS (SELECT ref, package, min(fqn) AS fqn FROM e GROUP BY ALL HAVING count(*) = 1)
    SELECT r.ref, r.package, coalesce(x.fqn, o.fqn, u.fqn) AS fqn, CAST(CASE WHEN x.fqn IS NOT NULL THEN 1 WHEN o.fqn IS NOT NULL THEN 2 WHEN u.fqn IS NOT NULL THEN 3 ELSE 0 END AS INT) AS tier
    FROM r LEFT JOIN k x ON x.fqn = r.ref LEFT JOIN k o ON o.fqn = r.package || '.' || r.ref LEFT JOIN u ON u.ref = r.ref AND u.package = r.package"""
)
def type_references(t):
    return lookup.resolve_types(REFS(t), "ref", "package", ALL_TYPES(t), "fqn")


@query(
    f"""WITH s AS (SELECT package, name, count(*) AS n FROM {METHODS.sql} GROUP BY ALL), r AS (SELECT id, package, CASE WHEN id % 4 = 0 THEN 'gone' ELSE name END AS name FROM {METHODS.sql})
    SELECT r.id, coalesce(s.n, 0) AS overloads, s.n IS NOT NULL AS "exists" FROM r LEFT JOIN s ON s.package = r.package AND s.name = r.name"""
)
def symbol_existence(t):
    rows = METHODS(t).select("id", "package", "name")
    return lookup.symbols_exist(rows.withColumn("name", F.when(F.col("id") % 4 == 0, "gone").otherwise(F.col("name"))), lookup.symbol_index(rows), ["package", "name"]).select("id", "overloads", "exists")


@query(
    """SELECT DISTINCT 'I' || p_size AS interface, 'K' || p_partkey AS fqn FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 5 <> 0"""
)
def implementations(t):
    n = F.col("p_partkey")
    types = t.part.select(F.concat(F.lit("K"), n).alias("fqn"), (n % 3 == 0).alias("is_interface"), ((n % 3 == 2) | (n % 5 == 0)).alias("is_abstract"))
    return lookup.implementations(types, t.part.select(F.concat(F.lit("K"), n).alias("fqn"), F.concat(F.lit("I"), "p_size").alias("implements")))


@query(
    f"""WITH m AS (SELECT DISTINCT fqn, simple, replace(package, '.', '/') AS p, name, upper(name[1]) || name[2:] AS big FROM {METHODS.sql})
    SELECT fqn, NULL AS name, simple || 'Test' AS test_class, NULL AS test_method, p || '/' || simple || 'Test.java' AS path FROM (SELECT DISTINCT fqn, simple, p FROM m)
    UNION ALL SELECT fqn, NULL, simple || 'Tests', NULL, p || '/' || simple || 'Tests.java' FROM (SELECT DISTINCT fqn, simple, p FROM m)
    UNION ALL SELECT fqn, name, simple || 'Test', 'test' || big, p || '/' || simple || 'Test.java' FROM m UNION ALL SELECT fqn, name, simple || big || 'Test', NULL, p || '/' || simple || big || 'Test.java' FROM m"""
)
def test_links(t):
    methods = METHODS(t).select("fqn", "name")
    classes = lookup.test_links(methods.select("fqn").distinct()).select("fqn", F.lit(None).cast("string").alias("name"), "test_class", "test_method", "path")
    return classes.unionByName(lookup.test_links(methods, methods))


@query(
    f"""SELECT DISTINCT fqn AS class_fqn, CASE WHEN id % 4 = 0 THEN NULL ELSE name END AS method_name, simple || 'Test' AS test_class, 'p/' || simple AS path FROM {METHODS.sql} WHERE id % 5 <> 0 AND id % 7 <> 0"""
)
def registered_test_links(t):
    n = F.col("id")
    tasks = METHODS(t).select(F.col("fqn").alias("class_fqn"), F.when(n % 4 == 0, " ").otherwise(F.col("name")).alias("method_name"), F.when(n % 5 != 0, F.concat("simple", F.lit("Test"))).alias("test_class"), F.when(n % 7 != 0, F.concat(F.lit("p/"), "simple")).alias("path"))
    return lookup.registered_links(tasks)


REBOUND = Made(
    "part", "p_partkey AS id", f"'a.P' || {text('p_partkey % 30')} || '.Cls' || {text('p_size % 3')} AS class_name", f"'m' || {text('p_partkey % 4')} AS method", "ARR(CASE WHEN p_size % 2 = 0 THEN 'int' ELSE 'x.Y z' END) AS given",
)
CALLED = Made("lineitem", f"CASE WHEN l_linenumber % 3 = 0 THEN {text('l_partkey')} ELSE 'c' || {text('l_suppkey % 40')} || '-' || {text('l_linenumber')} END AS callee", f"CASE WHEN l_linenumber % 2 = 0 THEN 'A.P' || {text('l_suppkey % 40')} || '.cls' || {text('l_linenumber % 3')} ELSE 'z.Cls' || {text('l_linenumber % 3')} END AS class_name", f"'M' || {text('l_suppkey % 8')} AS method", "CASE WHEN l_linenumber % 4 = 1 THEN 'int' ELSE 'y' END AS told")


@query(
    f"""WITH m AS (SELECT CAST(id AS VARCHAR) AS key, lower(class_name) AS c, lower(split_part(class_name, '.', 3)) AS s, method AS m, CASE WHEN given[1] = 'int' THEN 'int' ELSE 'y' END AS t FROM {REBOUND.sql}),
    n AS (SELECT callee, lower(class_name) AS c, lower(split_part(class_name, '.', -1)) AS s, lower(method) AS m, told, count(*) AS n FROM {CALLED.sql} GROUP BY ALL),
    d AS (SELECT m.key, n.n FROM n JOIN m ON m.key = n.callee), l AS (SELECT n.* FROM n WHERE callee NOT IN (SELECT key FROM m)),
    e AS (SELECT l.callee, l.n, l.told, m.key, m.t FROM l JOIN m ON l.c = m.c AND l.m = m.m), f AS (SELECT l.callee, l.n, l.told, m.key, m.t FROM l JOIN m ON l.s = m.s AND l.m = m.m WHERE l.callee NOT IN (SELECT callee FROM e)),
    p AS (SELECT callee, n, count(*) AS every, min(key) AS one, count(*) FILTER (t = told) AS fit, min(key) FILTER (t = told) AS fitting FROM (SELECT * FROM e UNION ALL SELECT * FROM f) GROUP BY callee, n)
    SELECT key, CAST(sum(n) AS BIGINT) AS incoming FROM (SELECT * FROM d UNION ALL SELECT CASE WHEN every = 1 THEN one WHEN fit = 1 THEN fitting END, n FROM p) WHERE key IS NOT NULL GROUP BY 1"""
)
def incoming_calls_rebound(t):
    methods = REBOUND(t).select(F.col("id").cast("string").alias("key"), "class_name", "method", F.lit(1).alias("arity"), F.transform("given", code.parameter_type).alias("types"))
    return graph.rebound_calls(methods, CALLED(t).select("callee", "class_name", "method", F.lit(1).alias("arity"), F.array("told").alias("types")))


# --- aggregates, orders and graphs


@query("SELECT count(*) AS total, count(*) FILTER (s = 'F') AS selected, count(*) FILTER (p >= '4') AS excluded FROM (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS s, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1)")
def run_summary(t):
    tasks = t.orders.select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("selected"), (F.col("o_orderpriority") >= "4").alias("excluded"))
    return stats.run_summary(tasks, F.col("o_custkey"), [F.col("o_orderkey")])


STATUS = "CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'processed' WHEN 'view' THEN 'skipped' ELSE 'success' END"


@query(f"SELECT CAST(ts AS DATE) AS day, count(*) FILTER (s = 'success') AS succeeded, count(*) FILTER (s IN ('failure', 'processed')) AS failed, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'success') / nullif(count(*) FILTER (s <> 'skipped'), 0) AS success_rate FROM (SELECT ts, {STATUS} AS s FROM events) GROUP BY 1")
def generation_stats(t):
    return stats.generation_stats(t.events.select(F.to_date("ts").alias("day"), F.expr(STATUS).alias("status")), ["day"])


@query("SELECT day, category, count(*) AS n FROM (SELECT CAST(ts AS DATE) AS day, CASE WHEN value < 5 THEN 'compile' WHEN value < 20 THEN 'assert' END AS category FROM events) WHERE category IS NOT NULL GROUP BY ALL")
def error_categories(t):
    rows = t.events.select(F.to_date("ts").alias("day"), F.when(F.col("value") < 5, "compile").when(F.col("value") < 20, "assert").when(F.col("value") < 40, "").alias("category"))
    return stats.categories(rows, "category", ["day"])


@query(
    f"""WITH m AS {METHODS.sql} SELECT package, count(DISTINCT fqn) AS classes, count(*) AS methods, CAST(greatest(1, max(complexity)) AS INT) AS most, first(fqn ORDER BY complexity DESC, id) AS top_class, first(name ORDER BY complexity DESC, id) AS top_method FROM m GROUP BY 1"""
)
def package_complexity(t):
    return stats.top_complexity(METHODS(t), "package", "fqn", "name", "complexity", "id")


@query(
    """SELECT p_brand, count(*) FILTER (p_size % 3 = 0 OR p_size % 4 = 0) AS brittle, count(*) AS methods, count(*) FILTER (p_size % 3 = 0 OR p_size % 4 = 0) / count(*) AS rate FROM part GROUP BY 1"""
)
def brittleness_rate(t):
    size = F.col("p_size")
    source = F.concat_ws(" ", F.when(size % 3 == 0, "Instant.now( )").otherwise("x"), F.when(size % 4 == 0, "new Random (1)"))
    return stats.brittleness(t.part.select("p_brand", code.brittle_signals(source).alias("s")), "s", ["p_brand"])


SNIPPETS = Made("part", "p_partkey AS id", "CASE p_partkey % 8 WHEN 0 THEN 'LocalDateTime . now()' WHEN 1 THEN 'UUID.randomUUID()' WHEN 2 THEN 'System.getProperty(x)' WHEN 3 THEN 'new Thread(r).start()' WHEN 4 THEN 'new ServerSocket(1)' WHEN 5 THEN 'new HashSet().toString()' WHEN 6 THEN 'list.toString()' END AS source", "ARR(CASE p_size % 5 WHEN 0 THEN 'java.lang.System#nanoTime' WHEN 1 THEN 'java.util.stream.X#parallelStream' WHEN 2 THEN 'Files#readAllBytes' ELSE 'a.B#c' END) AS calls")


@query(
    f"""SELECT id, concat_ws(',', CASE WHEN id % 8 = 0 OR calls[1] LIKE '%nanoTime' THEN 'TIME' END, CASE WHEN id % 8 = 1 THEN 'RANDOM' END, CASE WHEN id % 8 = 2 THEN 'ENVIRONMENT' END, CASE WHEN id % 8 = 3 OR calls[1] LIKE '%parallelStream' THEN 'CONCURRENCY' END,
    CASE WHEN id % 8 = 4 OR calls[1] LIKE 'Files%' THEN 'IO' END, CASE WHEN id % 8 = 5 THEN 'COLLECTION_ORDER' END) AS signals FROM {SNIPPETS.sql}"""
)
def brittle_signals_of_calls(t):
    return SNIPPETS(t).select("id", F.concat_ws(",", code.brittle_signals("source", "calls")).alias("signals"))


@query(
    """SELECT l_orderkey, min(l_discount * 10) AS least, count(*) FILTER (l_returnflag = 'R') AS unresolved, count(*) FILTER (l_returnflag = 'A') AS external, CAST(CASE WHEN min(l_discount * 10) < 0.6 THEN 0.5 ELSE 0 END + count(*) FILTER (l_returnflag = 'R') * 0.25 + count(*) FILTER (l_returnflag = 'A') * 0.125 AS DOUBLE) AS penalty, min(l_discount * 10) < 0.3 AS skip,
    concat_ws(',', CASE WHEN min(l_discount * 10) < 0.6 THEN 'low_conf' END, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'unresolved' END, CASE WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'external' END, CASE WHEN min(l_discount * 10) < 0.3 THEN 'skip_low_conf' END) AS reasons FROM lineitem GROUP BY 1"""
)
def selection_penalties(t):
    status = F.when(F.col("l_returnflag") == "R", "UNRESOLVED").when(F.col("l_returnflag") == "A", "EXTERNAL").otherwise("RESOLVED")
    found = stats.selection_features(t.lineitem.select("l_orderkey", (F.col("l_discount") * 10).alias("confidence"), status.alias("status")), "l_orderkey")
    p = rules.selection_penalty(F.col("least"), F.col("unresolved"), F.col("external"), 0.5, 0.25, 0.125, 0.3)
    return found.withColumn("p", p).select("l_orderkey", "least", "unresolved", "external", "p.penalty", "p.skip", F.concat_ws(",", "p.reasons").alias("reasons"))


#: Lines by order as tasks of a run: a reason by line, returned ones fail, open ones pass; what the run came to by its first line.
REASON = "CASE (l_linenumber + l_suppkey) % 7 WHEN 0 THEN 'low_conf' WHEN 1 THEN 'spi_low_conf' WHEN 2 THEN 'unresolved' WHEN 3 THEN 'branch_candidates' WHEN 4 THEN 'external' WHEN 5 THEN 'external_not_found' END"
RUN = "CASE WHEN l_orderkey % 3 = 0 THEN 'TOO_STRICT' WHEN l_orderkey % 3 = 1 THEN 'TOO_WEAK' ELSE 'OK' END"


@query(
    f"""WITH l AS (SELECT l_orderkey AS o, {RUN} AS s, {REASON} AS r, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END AS f, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0 END AS p FROM lineitem),
    g AS (SELECT o, s, r, avg(f) AS f, avg(p) AS p, count(*) AS n FROM l GROUP BY 1, 2, 3),
    w AS (SELECT o, s, coalesce(max(f) FILTER (r = 'low_conf'), 0) AS low, coalesce(max(f) FILTER (r = 'spi_low_conf'), 0) AS spi, coalesce(max(f) FILTER (r = 'unresolved'), 0) AS un, coalesce(max(p) FILTER (r = 'branch_candidates'), 0) AS br,
      arg_max(r, n * 100000 - ascii(r) * 100 - length(r)) FILTER (r IS NOT NULL AND f > 0) AS d, (o % 11) / 10.0 AS t FROM g GROUP BY 1, 2),
    a AS (SELECT o, 1 AS i, 'skip_threshold' AS name, t AS current, least(1.0, t + 0.1) AS advised, CASE WHEN low >= spi THEN 'low_conf' ELSE 'spi_low_conf' END AS trigger FROM w WHERE greatest(low, spi) > 0.3 AND t < 1.0
      UNION ALL SELECT o, 2, 'penalty_unresolved_each', 0.1, 0.1 + 0.05, 'unresolved' FROM w WHERE un > 0.3 UNION ALL SELECT o, 3, 'penalty_unresolved_each', 0.1, 0.1 - 0.02, 'branch_candidates' FROM w WHERE br > 0.7 AND un <= 0.3
      UNION ALL SELECT o, 4, 'skip_threshold', t, greatest(0.0, t - 0.1), 'too_strict' FROM w WHERE s = 'TOO_STRICT' AND t > 0 AND NOT (greatest(low, spi) > 0.3 AND t < 1.0)
      UNION ALL SELECT o, 5, CASE WHEN d = 'unresolved' THEN 'penalty_unresolved_each' WHEN d LIKE 'external%' THEN 'penalty_external_each' ELSE 'penalty_low_confidence' END, CASE WHEN d = 'unresolved' THEN 0.1 WHEN d LIKE 'external%' THEN 0.2 ELSE 0.4 END, CASE WHEN d = 'unresolved' THEN 0.2 WHEN d LIKE 'external%' THEN 0.3 ELSE 0.5 END, coalesce(d, 'too_weak') FROM w WHERE s = 'TOO_WEAK')
    SELECT o, CAST(row_number() OVER (PARTITION BY o ORDER BY i) - 1 AS INT) AS nth, name, round(CAST(current AS DOUBLE), 6) AS current, round(CAST(advised AS DOUBLE), 6) AS advised, trigger FROM a"""
)
def parameter_advice(t):
    rows = t.lineitem.selectExpr("l_orderkey AS o", f"{RUN} AS s", f"{REASON} AS r", "IF(l_returnflag = 'R', 1.0D, 0.0D) AS f", "IF(l_linestatus = 'O', 1.0D, 0.0D) AS p")
    reasons = rows.groupBy("o", "s", "r").agg(F.avg("f").alias("f"), F.avg("p").alias("p"), F.count(F.lit(1)).alias("n"))
    told = F.col("r").isNotNull()
    runs = reasons.groupBy("o", "s").agg(
        F.map_from_entries(F.collect_list(F.when(told, F.struct("r", "f")))).alias("fails"), F.map_from_entries(F.collect_list(F.when(told, F.struct("r", "p")))).alias("passes"),
        F.max_by("r", F.when(told & (F.col("f") > 0), F.col("n") * 100000 - F.ascii("r") * 100 - F.length("r"))).alias("d"),
    )
    advice = rules.parameter_advice(F.col("s"), F.col("d"), F.col("fails"), F.col("passes"), {"skip_threshold": (F.col("o") % 11) / 10.0})
    return runs.select("o", F.posexplode(advice).alias("nth", "a")).select("o", "nth", "a.name", F.round("a.current", 6).alias("current"), F.round("a.advised", 6).alias("advised"), "a.trigger")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 OR p_partkey % 4 = 1 THEN 1.0::DOUBLE WHEN p_partkey % 4 > 1 THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM part")
def service_candidates(t):
    providers = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>"))
    concrete = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("p_partkey") % 4), lambda i: i.cast("string"))
    return t.part.select("p_partkey", rules.service_confidence(providers, concrete).alias("confidence"))


@query("SELECT o_custkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_first, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS only_second FROM (SELECT o_custkey, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F'), []) AS a, coalesce(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O'), []) AS b FROM orders GROUP BY 1)")
def path_id_sets(t):
    sets = t.orders.groupBy("o_custkey").agg(*[F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))).alias(c) for s, c in (("F", "a"), ("O", "b"))])
    return sets.withColumn("s", merge.path_sets(F.col("a"), F.col("b"))).select("o_custkey", *[F.array_join(F.array_sort(f"s.{c}"), ",").alias(c) for c in ("both", "only_first", "only_second")])


@query("SELECT DISTINCT src, dst FROM (SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey UNION ALL SELECT n_nationkey, n_regionkey FROM nation UNION ALL SELECT s_nationkey, c_nationkey FROM supplier JOIN customer ON s_suppkey = c_custkey) WHERE src <> dst")
def dependency_edges(t):
    ships = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
    same = t.supplier.join(t.customer, F.col("s_suppkey") == F.col("c_custkey")).select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))
    return graph.dependency_edges(ships, t.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")), same)


NEEDS = "CASE WHEN n_nationkey % 2 = 1 AND n_nationkey + 6 < 25 THEN n_nationkey + 6 WHEN n_nationkey % 2 = 0 AND n_nationkey >= 8 THEN n_nationkey - 8 END"


@query(f"WITH RECURSIVE n AS (SELECT n_nationkey AS k, {NEEDS} AS need FROM nation), c(k, need, step) AS (SELECT k, need, 0 FROM n UNION ALL SELECT c.k, n.need, c.step + 1 FROM c JOIN n ON c.need = n.k) SELECT 'N' || k AS node, CAST(count(*) AS BIGINT) AS closure FROM c GROUP BY k")
def workflow_closure(t):
    """Driver-side, as workflows of some dozens of steps are: how many steps each needs, itself included; their order is checked on the way."""
    rows = t.nation.selectExpr("n_nationkey AS k", f"{NEEDS} AS need").orderBy("k").collect()
    nodes, needs = [f"N{r['k']}" for r in rows], {f"N{r['k']}": [f"N{r['need']}"] for r in rows if r["need"] is not None}
    order = graph.topological(nodes, needs)
    if any(order.index(x) > order.index(n) for n, xs in needs.items() for x in xs):
        raise AssertionError("not in order")
    return t._spark.createDataFrame([(n, len(graph.closure([n], needs))) for n in nodes], "node string, closure long")


TESTS = Made("part", "p_partkey AS id", "CASE p_partkey % 6 WHEN 0 THEN 'Thread.currentThread().sleep(5);' WHEN 1 THEN 'TimeUnit . SECONDS.sleep(1);' WHEN 2 THEN 'LocalDate.now(); // Thread.sleep(1)' || chr(10) WHEN 3 THEN 'x = Math.random(); String s = \"Class.forName(\";' WHEN 4 THEN 'f.setAccessible(true);' ELSE 'mockery(); a.mock(b);' END || repeat(' @Mock A a; B b = mock(B.class);', p_size % 4) || repeat(' C c = Mockito.spy(d);', p_partkey % 3) AS source")


@query(
    f"""WITH w AS (SELECT id, p_size % 4 * 2 + id % 3 * 2 AS weight FROM {TESTS.sql} JOIN part ON id = p_partkey) SELECT id, concat_ws(',', CASE WHEN id % 6 IN (0, 1) THEN 'SLEEP:ERROR' WHEN id % 6 = 2 THEN 'TIME:WARNING' WHEN id % 6 = 3 THEN 'RANDOM:WARNING' WHEN id % 6 = 4 THEN 'REFLECTION:ERROR' END, CASE WHEN weight > 6 THEN 'OVER_MOCK:ERROR' WHEN weight > 3 THEN 'OVER_MOCK:WARNING' END) AS rules FROM w"""
)
def brittle_tests(t):
    return TESTS(t).select("id", F.array_join(code.brittle_test_rules("source"), ",").alias("rules"))


@query(
    f"""WITH c AS (SELECT fqn, package, CAST(sum(loc) AS BIGINT) AS loc, count(*) AS methods, max(complexity) AS complexity FROM {METHODS.sql} GROUP BY ALL), m AS (SELECT greatest(1, max(complexity)) AS most FROM c)
    SELECT fqn, package, 'core' AS role, split_part(package, '.', 2) AS cluster, loc, methods, complexity, CAST(least(100, greatest(8, floor(complexity * 62.0::DOUBLE / most + least(22.0::DOUBLE, loc / 18.0::DOUBLE) + least(16.0::DOUBLE, methods * 1.5::DOUBLE) + 0.5))) AS BIGINT) AS risk FROM c, m"""
)
def overview_snapshot(t):
    classes = METHODS(t).groupBy("fqn", "package").agg(F.sum("loc").alias("loc"), F.count(F.lit(1)).alias("methods"), F.max("complexity").alias("complexity"))
    return rollup.snapshot(classes, rollup.common_prefix(classes, "package"))


@query(
    f"""WITH m AS (SELECT id, fqn AS class_name, package, complexity * 2.0::DOUBLE + loc * 0.1::DOUBLE + CASE WHEN flag THEN 100.0::DOUBLE ELSE 0 END AS score FROM {METHODS.sql} WHERE name NOT IN ('getToken', 'toString') AND has_body),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY score DESC, id) AS n FROM m) WHERE n <= 2), p AS (SELECT * FROM (SELECT * EXCLUDE n, row_number() OVER (PARTITION BY package ORDER BY score DESC, id) AS n FROM c) WHERE n <= 5)
    SELECT id, class_name, package, score FROM p ORDER BY score DESC, id LIMIT 50"""
)
def selected_targets(t):
    methods = METHODS(t).withColumnRenamed("fqn", "class_name")
    score = F.col("complexity") * 2.0 + F.col("loc") * 0.1 + F.when(F.col("flag"), 100.0).otherwise(0.0)
    return rollup.select_targets(methods, score, ~F.col("name").isin("getToken", "toString") & F.col("has_body"), 2, 5, 50).select("id", "class_name", "package", "score")
