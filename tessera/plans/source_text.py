"""Queries over source text: tokens of pages, branches of methods made up from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import code
from tessera.operators import classes, constants, lookup, symbols, syntax
from tessera.plans.catalog import query

WORD, ASKED = "lower(split_part(p_name, ' ', 1))", "CAST(p_size AS STRING)"
#: Methods of up to six statements, names and figures from the part.
BODY = f"""'public int m' || CAST(p_partkey AS STRING) || '(int size, String {{w}}) {{ int count = 0; '
 || CASE WHEN p_size % 2 = 0 THEN 'if (size < ' || {ASKED} || ') {{ throw new E("' || p_name || '"); }} ' ELSE '' END
 || CASE WHEN p_partkey % 3 = 0 THEN 'for (int i = ' || {ASKED} || '; i < size; i++) {{ if ({{w}}.isEmpty()) {{ continue; }} }} ' ELSE '' END
 || CASE WHEN p_partkey % 4 = 0 THEN 'switch (size) {{ case ' || {ASKED} || ': return 1; case 99: return 2; default: break; }} ' ELSE '' END
 || CASE WHEN p_size % 5 = 0 THEN 'while (count > ' || {ASKED} || ') {{ if ({{w}}.length() == count) {{ count--; }} }} ' ELSE '' END
 || CASE WHEN p_partkey % 7 < 3 THEN 'if ({{w}} == null) {{ return ' || {ASKED} || '; }} ' ELSE '' END
 || CASE WHEN p_type LIKE '%BRASS%' OR p_size > 40 THEN '/* if (no) {{ */ if (count > 0 && {{w}} != "if (") {{ use({{w}}); }} ' ELSE '' END || 'return count; }}'""".replace("{{", "{").replace("}}", "}").replace("{w}", f"' || {WORD} || '")
CLEAN = r"""regexp_replace(regexp_replace(body, '/\*.*?\*/', '', 'g'), '"if \("', '""', 'g')"""


@query(
    f"""WITH b AS (SELECT p_partkey AS id, {BODY} AS body FROM part), c AS (SELECT id, {CLEAN} AS x, regexp_replace(body, '/\\*.*?\\*/', '', 'g') AS y FROM b),
    s AS (SELECT id, x, y, unnest(regexp_extract_all(x, '[{{}}]')) AS t, generate_subscripts(regexp_extract_all(x, '[{{}}]'), 1) AS i FROM c),
    d AS (SELECT id, max(n) - 1 AS nesting FROM (SELECT id, sum(CASE t WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY id ORDER BY i) AS n FROM s) GROUP BY 1),
    g AS (SELECT id, x, y, regexp_extract_all(x, 'if \\(([^{{}}]*)\\) \\{{ (?:throw|return|continue)', 1) AS guards,
      list_concat(regexp_extract_all(y, '(?:if|while) \\(([^{{}}]*)\\) \\{{', 1), list_concat(regexp_extract_all(x, 'for \\([^;]*; ([^;]*);', 1), regexp_extract_all(y, '[\\w.]+(?:\\(\\))? (?:==|!=|<|>) (?:\\w+|"[^"]*")'))) AS predicates,
      regexp_extract_all(x, 'case (\\d+):', 1) AS cases FROM c)
    SELECT id, CAST(1 + len(regexp_extract_all(x, '\\b(?:if|for|while|case|default)\\b')) AS BIGINT) AS complexity, CAST(nesting AS BIGINT) AS nesting, array_to_string(guards, ' | ') AS guards,
      array_to_string(list_sort(list_distinct(predicates)), ' | ') AS predicates, CASE WHEN len(cases) > 0 THEN 'size: ' || array_to_string(cases, '/') || '/default' ELSE '' END AS switches,
      CAST(len(guards) + len(cases) + CASE WHEN len(cases) > 0 THEN 1 ELSE 0 END + CASE WHEN len(guards) + len(cases) + len(edges) > 0 THEN 1 ELSE 0 END + len(edges) AS BIGINT) AS paths
    FROM (SELECT *, list_filter(list_distinct(regexp_extract_all(y, '(?:if|&&) \\(?(\\w+(?:\\.\\w+\\(\\))? (?:==|!=|<|>) (?:\\w+|"[^"]*"))', 1)), lambda e: NOT list_contains(guards, e) AND e NOT LIKE 'count %') AS edges FROM g) JOIN d USING (id)"""
)
def method_branches(t):
    made = t.part.selectExpr("p_partkey AS id", BODY + " AS body")
    found = syntax.branches(made, "id", "body")
    return found.select(
        "id", "complexity", "nesting", F.array_join(F.transform("guards", lambda g: g["condition"]), " | ").alias("guards"), F.array_join(F.sort_array("predicates"), " | ").alias("predicates"),
        F.array_join("switches", " | ").alias("switches"), F.size("paths").cast("long").alias("paths"),
    )


@query(
    "WITH a AS (SELECT page_id, list_filter(regexp_extract_all(html, '{0}'), lambda x: NOT (starts_with(x, '//') OR starts_with(x, '/*'))) AS l FROM pages), "
    "t AS (SELECT page_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM a), "
    "d AS (SELECT *, sum(CASE WHEN x IN ('(', '[', '{{') THEN 1 ELSE 0 END) OVER w - coalesce(sum(CASE WHEN x IN (')', ']', '}}') THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM t WINDOW w AS (PARTITION BY page_id ORDER BY i)) "
    "SELECT page_id, count(*) AS tokens, count(DISTINCT x) AS distinct_tokens, count(*) FILTER (regexp_matches(x, '^[A-Za-z_$]')) AS words, count(*) FILTER (regexp_matches(x, '^[0-9]')) AS numbers, "
    "count(*) FILTER (regexp_matches(x, '^[\"'']') AND length(x) > 1) AS literals, CAST(max(depth) AS INT) AS deepest FROM d GROUP BY 1".format(syntax.LEXER.replace("'", "''"))
)
def page_tokens(t):
    found = syntax.tokens(t.pages, "page_id", "html")
    return found.groupBy(F.col("key").alias("page_id")).agg(
        F.count(F.lit(1)).alias("tokens"), F.countDistinct("token").alias("distinct_tokens"), F.count_if(F.col("kind") == "word").alias("words"), F.count_if(F.col("kind") == "number").alias("numbers"),
        F.count_if(F.col("kind") == "text").alias("literals"), F.max("depth").alias("deepest"),
    )


# --- coverage of methods

PLACE = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey"
#: A class for each part: plain, nested, nested twice. A method for each line, its types told by its figures.
CLASS = "CASE l_partkey % 3 WHEN 0 THEN 'com.shop.P' || CAST(l_partkey AS STRING) WHEN 1 THEN 'com.shop.P' || CAST(l_partkey AS STRING) || '$In' ELSE 'com.P' || CAST(l_partkey AS STRING) || '$In$Most' END"
COVERED = (f"{CLASS} AS class", """CASE WHEN l_linenumber < 3 THEN 'load' ELSE 'm' || CAST(l_linenumber AS STRING) END AS method""",
 """'(' || CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN '' WHEN 1 THEN 'I' WHEN 2 THEN 'Ljava/util/List;J' WHEN 3 THEN '[[ZLjava/util/Map$Entry;' ELSE '[Ljava/lang/String;D' END || CASE WHEN l_suppkey % 2 = 0 THEN 'Lcom/s/S' || CAST(l_suppkey % 9 AS STRING) || ';' ELSE '' END || ')V' AS descriptor""",
 f"{PLACE} AS ord", "CAST(l_quantity AS BIGINT) % 4 AS line_missed", "CAST(l_quantity AS BIGINT) % 3 AS line_covered", "CAST(l_suppkey % 2 AS BIGINT) AS branch_missed", "CAST(l_partkey % 2 AS BIGINT) AS branch_covered")
#: What is asked: the same classes by other names, the same types as a source writes them.
ASKED_OF = (f"{PLACE} AS ref", f"""CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN {CLASS} WHEN l_tax > 0.07 THEN 'com.gone.X' ELSE replace({CLASS}, '$', '.') END AS class_name""",
 """CASE WHEN l_discount > 0.08 THEN 'public void ' WHEN l_discount > 0.06 THEN 'C#' ELSE '' END || CASE WHEN l_linenumber < 3 THEN 'load' ELSE 'm' || CAST(l_linenumber AS STRING) END ||
 CASE WHEN l_tax = 0.01 THEN '' ELSE '(' || CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN '' WHEN 1 THEN 'final int x' WHEN 2 THEN 'List<Map<String, A>> xs, long n' WHEN 3 THEN 'boolean[][] b, java.util.Map$Entry e' ELSE '@Ann(1) String... s, double d' END ||
 CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN CAST(l_quantity AS INT) % 5 = 0 THEN '' ELSE ', ' END || CASE WHEN l_suppkey % 3 = 0 THEN 'com.s.' ELSE '' END || 'S' || CAST(l_suppkey % 9 AS STRING) || CASE WHEN l_suppkey % 4 = 0 THEN '<B, C> s' ELSE '' END ELSE '' END || ')' END AS signature""")  # fmt: skip
SIMPLE = "list_transform({0}, lambda t: regexp_replace(t, '^.*[.$]', ''))"


@query(
    f"""WITH k AS (SELECT {", ".join(COVERED)} FROM lineitem), d AS (SELECT *, list_transform(regexp_extract_all(regexp_extract(descriptor, '\\((.*)\\)', 1), '\\[*(?:L[^;]*;|[A-Z])'), lambda t: CASE
        WHEN t LIKE '%;' THEN replace(regexp_extract(t, 'L(.*);', 1), '/', '.') WHEN t LIKE '%I' THEN 'int' WHEN t LIKE '%J' THEN 'long' WHEN t LIKE '%Z' THEN 'boolean' WHEN t LIKE '%D' THEN 'double' END || repeat('[]', length(regexp_extract(t, '^\\[*')))) AS types,
        CASE WHEN line_missed + line_covered > 0 THEN line_covered * 100.0 / (line_missed + line_covered) WHEN branch_missed + branch_covered > 0 THEN branch_covered * 100.0 / (branch_missed + branch_covered) ELSE -1 END AS percent FROM k),
    w AS (SELECT class, method, ord, percent, 0 AS way, types FROM d UNION ALL SELECT class, method, ord, percent, 1, {SIMPLE.format('types')} FROM d),
    f AS (SELECT class, method, way, types, arg_min(percent, ord) AS percent FROM w GROUP BY ALL),
    r AS (SELECT {", ".join(ASKED_OF)} FROM lineitem), s AS (SELECT ref, class_name, regexp_extract(signature, '([A-Za-z0-9]+)\\(', 1) AS method, regexp_replace(regexp_replace(regexp_extract(signature, '\\((.*)\\)$', 1), '<(?:[^<>]|<[^<>]*>)*>', '', 'g'), '@Ann\\(1\\) ', '', 'g') AS inside FROM r WHERE signature LIKE '%)'),
    t AS (SELECT ref, class_name, method, list_transform(list_filter(string_split(inside, ', '), lambda x: x <> ''), lambda x: replace(regexp_extract(x, '^(?:final )?(\\S+)', 1), '...', '[]')) AS types, string_split(class_name, '.') AS p FROM s),
    c AS (SELECT ref, method, types, 0 AS n, class_name AS class FROM t UNION ALL SELECT ref, method, types, 1, replace(class_name, '$', '.') FROM t WHERE contains(class_name, '$')
      UNION ALL SELECT ref, method, types, CASE WHEN contains(class_name, '$') THEN 2 ELSE 1 END + i - 1, array_to_string(p[:i], '.') || '.' || array_to_string(p[i + 1:], '$') FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS i FROM t) WHERE array_to_string(p[:i], '.') || '.' || array_to_string(p[i + 1:], '$') <> class_name),
    a AS (SELECT ref, n * 2 AS tier, class, method, 0 AS way, types FROM c UNION ALL SELECT ref, n * 2 + 1, class, method, 1, {SIMPLE.format('types')} FROM c),
    b AS (SELECT ref, arg_min(percent, tier) AS percent, min(tier) AS tier FROM a JOIN f USING (class, method, way, types) GROUP BY 1)
    SELECT r.ref, coalesce(percent, -1.0)::DOUBLE AS percent, CAST(tier AS INT) AS tier FROM r LEFT JOIN b USING (ref)"""
)
def method_coverage_lookup(t):
    return lookup.coverage_of(t.lineitem.selectExpr(*ASKED_OF), "ref", t.lineitem.selectExpr(*COVERED))


# --- symbols

HOME = "'com.p' || CAST({0} % 40 AS STRING) || '.C' || CAST({1} AS STRING)"
HOMES = (f"{HOME.format('p_partkey', 'p_size')} AS class_fqn",)
DECLARED = (
    f"{HOME.format('p_partkey', 'p_size')} AS class_fqn", "'m' || CAST(p_partkey % 6 AS STRING) AS name",
    "CASE p_partkey % 3 WHEN 0 THEN 'm' || CAST(p_partkey % 6 AS STRING) || '(' || p_brand || ')' WHEN 1 THEN ' ' END AS signature", "CASE WHEN p_partkey % 7 > 0 THEN CAST(p_partkey % 5 AS INT) - 1 END AS arity",
)
HELD_IN = (f"{HOME.format('s_suppkey', 's_nationkey')} AS class_fqn", "'f' || CAST(s_suppkey % 4 AS STRING) AS name", "CASE WHEN s_nationkey % 3 > 0 THEN 'T' || CAST(s_suppkey % 7 AS STRING) END AS type")
USED = (
    "p_partkey AS ref", f"CASE p_partkey % 5 WHEN 0 THEN {HOME.format('p_partkey', 'p_size')} WHEN 1 THEN 'x.C' || CAST(p_size AS STRING) WHEN 2 THEN 'C' || CAST(p_size % 60 + p_partkey % 9 AS STRING) WHEN 3 THEN 'no.Such' END AS class_name",
    "CASE WHEN p_size % 9 > 0 THEN 'm' || CAST(p_size % 8 AS STRING) END AS method", "CASE WHEN p_partkey % 8 > 0 THEN CAST(p_size % 6 AS INT) - 1 END AS arity", "'m' || CAST(p_partkey % 6 AS STRING) || '(' || p_brand || ')' AS signature", "'f' || CAST(p_size % 5 AS STRING) AS field",
)


@query(
    f"""WITH m AS (SELECT {", ".join(DECLARED)} FROM part), f AS (SELECT {", ".join(HELD_IN)} FROM supplier), c AS (SELECT DISTINCT class_fqn AS c, string_split(class_fqn, '.')[-1] AS s FROM m), r AS (SELECT {", ".join(USED)} FROM part),
    k AS (SELECT ref, c, TRUE AS own FROM r JOIN c ON c = class_name UNION ALL SELECT ref, c, FALSE FROM r JOIN c ON s = string_split(class_name, '.')[-1] WHERE class_name NOT IN (SELECT c FROM c)),
    o AS (SELECT n.class_fqn, n.name, CASE WHEN count(DISTINCT s.signature) > 0 THEN count(DISTINCT s.signature) WHEN count(DISTINCT n.arity) FILTER (n.arity >= 0) > 0 THEN count(DISTINCT n.arity) FILTER (n.arity >= 0) ELSE 1 END AS overloads FROM m n LEFT JOIN m s ON s.class_fqn = n.class_fqn AND s.signature LIKE n.name || '(%' GROUP BY 1, 2),
    q AS (SELECT ref, bool_or(c IS NOT NULL) AS has_class, bool_or(o.name IS NOT NULL) AS m, max(overloads) AS n FROM r LEFT JOIN k USING (ref) LEFT JOIN o ON o.class_fqn = c AND o.name = method GROUP BY 1),
    a AS (SELECT DISTINCT ref FROM r JOIN k USING (ref) JOIN m ON m.class_fqn = c AND m.name = method AND m.arity = r.arity WHERE r.arity >= 0), g AS (SELECT DISTINCT ref FROM r JOIN k USING (ref) JOIN m ON m.class_fqn = c AND m.signature = r.signature),
    h AS (SELECT ref, max(CASE WHEN own THEN t END) AS field_type FROM r JOIN k USING (ref) JOIN (SELECT class_fqn, name, CASE WHEN count(DISTINCT coalesce(type, '')) > 1 THEN 'ambiguous' ELSE max(coalesce(type, '')) END AS t FROM f GROUP BY 1, 2) x ON x.class_fqn = c AND x.name = field GROUP BY 1)
    SELECT r.ref, has_class, w AS has_method, CASE WHEN r.arity >= 0 THEN a.ref IS NOT NULL ELSE w END AS has_arity, g.ref IS NOT NULL AS has_signature, h.ref IS NOT NULL OR (NOT has_class AND field IN (SELECT name FROM f)) AS has_field, coalesce(r.n, 0) AS overloads, field_type
    FROM (SELECT r.*, has_class, q.n, coalesce(CASE WHEN has_class THEN m ELSE method IN (SELECT name FROM m) END, FALSE) AS w FROM r JOIN q USING (ref)) r LEFT JOIN a USING (ref) LEFT JOIN g USING (ref) LEFT JOIN h USING (ref)"""
)
def symbol_lookups(t):
    known = symbols.index(t.part.selectExpr(*HOMES), t.part.selectExpr(*DECLARED), t.supplier.selectExpr(*HELD_IN))
    return symbols.look_up(t.part.selectExpr(*USED), "ref", symbols.store(known))


# --- calls

K = "CAST(p_partkey % {} AS STRING)"
CALLER = ("p_partkey AS id", f"'com.o.C' || {K.format(50)} AS owner", f"""'void m(Helper' || {K.format(5)} || ' helper, int n) {{ load(n, ' || CAST(p_size AS STRING) || '); helper.run("' || p_name || '", -3, "' || p_name || '"); this.put' || {WORD} || '(n); Missing' || {K.format(3)} ||
 '.make(true); Helper' || {K.format(9)} || ' x = new Helper' || {K.format(9)} || '(null, n); x.close(); if (n > 1) {{ free.call(n, "' || p_type || '"); }} }}' AS body""")  # fmt: skip
CLASSES_OF = (f"explode(array('com.h.Helper' || {K.format(6)}, 'com.o.C' || {K.format(50)})) AS class_fqn",)


@query(
    f"""WITH b AS (SELECT {", ".join(CALLER)} FROM part), c AS (SELECT DISTINCT unnest(['com.h.Helper' || {K.format(6)}, 'com.o.C' || {K.format(50)}]) AS fqn FROM part), d AS (SELECT DISTINCT 'com.o.C' || {K.format(50)} AS fqn FROM part WHERE p_size % 2 = 0),
    x AS (SELECT id, owner, regexp_extract(body, '(Helper[0-9]) helper', 1) AS helper, regexp_extract(body, '(Helper[0-9]) x', 1) AS x, split_part(body, '{{ load', 2) AS rest FROM b), y AS (SELECT *, 'load' || rest AS said FROM x),
    m AS (SELECT id, owner, helper, x, unnest(regexp_extract_all(said, '((?:[A-Za-z0-9]+\\.)?[A-Za-z0-9]+)\\([^()]*\\)', 1)) AS name, unnest(regexp_extract_all(said, '(?:[A-Za-z0-9]+\\.)?[A-Za-z0-9]+\\(([^()]*)\\)', 1)) AS args FROM y),
    s AS (SELECT *, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) WHEN name LIKE 'Helper%' THEN name END AS scope, string_split(name, '.')[-1] AS method, list_filter(string_split(args, ', '), lambda a: a <> '') AS a FROM m),
    t AS (SELECT *, CASE WHEN scope IS NULL OR scope = 'this' THEN owner WHEN scope = 'helper' THEN helper WHEN scope = 'x' THEN x ELSE scope END AS class FROM s), r AS (SELECT t.*, c.fqn FROM t LEFT JOIN c ON c.fqn = class OR string_split(c.fqn, '.')[-1] = class)
    SELECT id, coalesce(r.fqn, class) || '#' || method || '(' || len(a) || ')' AS target, CASE WHEN scope IS NULL THEN method = 'load' AND d.fqn IS NOT NULL ELSE r.fqn IS NOT NULL END AS resolved,
      array_to_string(list_sort(list_distinct(list_filter(a, lambda v: regexp_matches(v, '^([-+]?[0-9]|"|true|null)')))), ' ') AS literals, count(*) AS n FROM r LEFT JOIN d ON d.fqn = owner GROUP BY ALL"""
)
def call_edges(t):
    declared = t.part.where("p_size % 2 = 0").selectExpr(f"'com.o.C' || {K.format(50)} AS class_fqn", "'load' AS name", "2 AS arity")
    found = syntax.calls(t.part.selectExpr(*CALLER), "id", "owner", "body", t.part.selectExpr(*CLASSES_OF), declared)
    return found.groupBy("id", "target", (F.col("status") == "RESOLVED").alias("resolved"), F.array_join(F.sort_array("literals"), " ").alias("literals")).agg(F.count(F.lit(1)).alias("n"))


# --- failed assertions

LEFT = "CASE p_size % 7 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 1 THEN CAST(p_partkey AS STRING) || '.5' WHEN 2 THEN '[1, ' || p_name || ']' WHEN 3 THEN '{{a=' || p_name || '}}' WHEN 4 THEN '\"' || p_name || '\"' WHEN 5 THEN 'NULL' ELSE p_name END".replace("{{", "{").replace("}}", "}")
RIGHT = "CASE WHEN p_size % 7 < 2 THEN CAST(p_size - 20 AS STRING) ELSE p_type END"
SAID = f"""CASE p_partkey % 6 WHEN 0 THEN 'expected: <' || {LEFT} || '> but was: <' || {RIGHT} || '>' WHEN 1 THEN 'values expected: ' || {LEFT} || ' but was: ' || {RIGHT} WHEN 2 THEN 'Expecting: ' || {LEFT} || ' to be equal to: ' || {RIGHT} || CASE WHEN p_size > 25 THEN chr(10) || 'in order' ELSE '' END
 WHEN 3 THEN 'Expected: ' || {LEFT} || chr(10) || '     but: was ' || {RIGHT} WHEN 4 THEN CASE p_size % 6 WHEN 0 THEN 'wrong list' WHEN 1 THEN 'not sorted' WHEN 2 THEN 'a String' WHEN 3 THEN 'an Exception' WHEN 4 THEN '' ELSE 'it broke' END END"""
TRACE = """'x' || chr(10) || CASE WHEN p_partkey % 5 > 0 THEN ' at org.junit.Assert.fail(Assert.java:' || CAST(p_size AS STRING) || ')' || chr(10) ELSE '' END || CASE WHEN p_partkey % 3 > 0 THEN ' at com.a.' || replace(p_name, ' ', '_') || '.run(Run.java:' || CAST(p_partkey AS STRING) || ')' || chr(10) ELSE '' END
 || CASE WHEN p_partkey % 4 > 0 THEN ' at com.a.B' || CASE WHEN p_partkey % 4 = 1 THEN 'Test' ELSE 'x' END || '.go(B.java:7)' ELSE '' END"""
NUMBERS = r"regexp_matches(e, '^[+-]?[0-9]+(\.[0-9]+)?$') AND regexp_matches(a, '^[+-]?[0-9]+(\.[0-9]+)?$')"


@query(
    f"""WITH b AS (SELECT p_partkey AS id, {SAID} AS m, {TRACE} AS t FROM part), p AS (SELECT *, CASE WHEN regexp_matches(m, 'expected: <[^>]*> but was: <[^>]*>') THEN regexp_extract(m, 'expected: <([^>]*)> but was: <([^>]*)>', ['e', 'a']) WHEN contains(m, 'expected: ') THEN regexp_extract(m, 'expected: (.*) but was: (.*)', ['e', 'a'])
      WHEN starts_with(m, 'Expecting: ') THEN regexp_extract(m, 'Expecting: (.*) to be equal to: ([^\n]*)', ['e', 'a']) WHEN starts_with(m, 'Expected: ') THEN regexp_extract(m, 'Expected: ([^\n]*)\n +but: was ([^\n]*)', ['e', 'a']) END AS v, regexp_extract_all(t, 'at ([A-Za-z_.]+\\([A-Za-z]+\\.java:[0-9]+\\))', 1) AS f FROM b),
    r AS (SELECT id, m, v.e AS e, v.a AS a, f, list_filter(f, lambda x: NOT starts_with(x, 'org.junit.')) AS o FROM p),
    k AS (SELECT *, CASE WHEN m IS NULL OR m = '' THEN 'UNKNOWN' WHEN regexp_matches(m, '(?i)\\bnull\\b') THEN 'NULL_MISMATCH' WHEN contains(lower(m), 'exception') THEN 'EXCEPTION_MESSAGE' WHEN {NUMBERS} AND NOT contains(e || a, '.') THEN 'NUMERIC' WHEN {NUMBERS} THEN 'FLOAT_TOLERANCE'
      WHEN e LIKE '[%' THEN CASE WHEN contains(m, 'order') THEN 'ORDERING' ELSE 'COLLECTION' END WHEN e LIKE '{{%' THEN 'MAP' WHEN e LIKE '"%' THEN 'STRING' WHEN contains(m, 'list') THEN 'COLLECTION' WHEN contains(m, 'order') OR contains(m, 'sorted') THEN 'ORDERING' WHEN contains(m, 'String') THEN 'STRING' WHEN e IS NOT NULL THEN 'OBJECT_EQUALS' ELSE 'UNKNOWN' END AS type FROM r)
    SELECT id, type, e AS expected, a AS actual, CASE type WHEN 'NUMERIC' THEN CAST(abs(CAST(e AS BIGINT) - CAST(a AS BIGINT)) AS VARCHAR) WHEN 'FLOAT_TOLERANCE' THEN printf('%.6f', abs(CAST(e AS DOUBLE) - CAST(a AS DOUBLE))) END AS delta,
      coalesce(list_filter(o, lambda x: contains(x, 'Test.'))[1], o[1]) AS location, TRY_CAST(regexp_extract(f[1], ':([0-9]+)\\)', 1) AS INT) AS line FROM k"""
)
def mismatch_details(t):
    return t.part.selectExpr("p_partkey AS id", f"{SAID} AS m", f"{TRACE} AS t").select("id", code.mismatch_details("m", "t").alias("d")).select("id", "d.*")


# --- kinds of classes

OWNER = "'com.k.C' || CAST(CAST(floor(p_partkey / 4) AS INT) AS STRING)"
NTH = "CAST(floor(p_partkey / 4) AS INT)"
KINDS_OF = (
    f"{OWNER} AS class_fqn", f"CASE {NTH} % 12 WHEN 0 THEN ARR('@org.x.Service') WHEN 1 THEN ARR('Override', '@Entity') WHEN 2 THEN ARR('@Services') END AS annotations",
    f"CASE {NTH} % 9 WHEN 3 THEN ARR('RuntimeException') WHEN 4 THEN ARR('Base') END AS extends", f"{NTH} % 4 AS fields",
)
MEMBERS = (
    f"{OWNER} AS class_fqn", f"CASE (p_partkey * 7 + p_size) % 13 WHEN 0 THEN 'getName' WHEN 1 THEN 'isOpen' WHEN 2 THEN 'setName' WHEN 3 THEN 'withName' WHEN 4 THEN 'build' WHEN 5 THEN 'toString' WHEN 6 THEN '<init>' WHEN 7 THEN 'C' || CAST({NTH} AS STRING) WHEN 8 THEN 'hashCode' WHEN 9 THEN 'hasMore' WHEN 10 THEN 'run' WHEN 11 THEN NULL ELSE 'set' END AS name",
    "CASE WHEN p_size % 2 = 0 THEN 'private' ELSE 'public' END AS visibility", f"{NTH} % 3 = 0 OR p_size % 5 = 0 AS is_static", f"CASE WHEN p_size % 3 > 0 THEN 'C' || CAST({NTH} AS STRING) || ' of(String)' END AS signature",
)


def listed(columns: tuple[str, ...], by: str) -> list[str]:
    return [c.replace("ARR(", by) for c in columns]


@query(
    f"""WITH c AS (SELECT DISTINCT {", ".join(listed(KINDS_OF, "list_value("))} FROM part), m AS (SELECT {", ".join(MEMBERS)} FROM part), s AS (SELECT *, string_split(class_fqn, '.')[-1] AS s, name IN ('<init>', string_split(class_fqn, '.')[-1]) AS made FROM m WHERE name IS NOT NULL),
    a AS (SELECT class_fqn, sum(CASE WHEN made AND visibility = 'private' THEN 1 ELSE 0 END) AS private, sum(CASE WHEN NOT made AND is_static THEN 1 ELSE 0 END) AS st, sum(CASE WHEN NOT made AND NOT is_static THEN 1 ELSE 0 END) AS inst, sum(CASE WHEN name = 'build' THEN 1 ELSE 0 END) AS b, sum(CASE WHEN contains(signature, s) AND regexp_matches(name, '^(set|with)') THEN 1 ELSE 0 END) AS fl,
      sum(CASE WHEN regexp_matches(name, '^(get|is)') THEN 1 ELSE 0 END) AS g, sum(CASE WHEN name LIKE 'set%' THEN 1 ELSE 0 END) AS w, sum(CASE WHEN name IN ('toString', 'hashCode') THEN 1 ELSE 0 END) AS o, sum(CASE WHEN name IN ('run', 'build', 'withName') THEN 1 ELSE 0 END) AS act FROM s GROUP BY 1)
    SELECT c.class_fqn, CASE WHEN annotations[1] = '@org.x.Service' THEN 'SERVICE' WHEN annotations[2] = '@Entity' THEN 'DATA_CLASS' WHEN extends[1] = 'RuntimeException' THEN 'EXCEPTION' WHEN coalesce(inst, 0) = 0 AND (st >= 2 OR (private > 0 AND st > 0)) THEN 'UTILITY' WHEN b > 0 OR fl >= 2 THEN 'BUILDER'
      WHEN fields >= 2 AND (g >= 2 OR w >= 2 OR o > 0) THEN CASE WHEN act > 0 THEN 'SERVICE' ELSE 'DATA_CLASS' END ELSE 'GENERAL' END AS class_type FROM c LEFT JOIN a USING (class_fqn)"""
)
def class_kinds(t):
    return classes.class_types(t.part.selectExpr(*listed(KINDS_OF, "array(")).distinct(), t.part.selectExpr(*MEMBERS))


# --- string constants

#: Nodes of each part's expressions: number, kind, value, arguments, and which parts have them.
EXPRESSIONS = [
    (1, "literal", "p_name", [], "TRUE"), (2, "literal", "p_type", [], "TRUE"), (3, "literal", "p_brand", [], "TRUE"), (4, "concat", "NULL", [1, 2], "TRUE"), (5, "name", "'a'", [], "TRUE"),
    (6, "format", "CASE p_size % 4 WHEN 0 THEN '%s-%s' WHEN 1 THEN '%s%%%s!' WHEN 2 THEN '%s%d' ELSE 'x%s' END", [3, 4], "TRUE"), (7, "join", "NULL", [3, 5, 1], "TRUE"), (8, "name", "'b'", [], "TRUE"), (9, "concat", "NULL", [8, 1], "TRUE"),
    (10, "valueof", "NULL", [1], "TRUE"), (11, "valueof", "NULL", [4], "TRUE"), (12, "format", "'%s'", [1], "p_size > 10"), (13, "concat", "NULL", [13, 1], "TRUE"), (14, "name", "'free'", [], "TRUE"), (15, "config", "NULL", [1], "TRUE"), (16, "join", "NULL", [1], "TRUE"),
    *[(20 + k, "literal", f"p_name || '{k % 7}' || CAST(p_size % {k + 2} AS STRING)", [], "p_partkey % 5 = 0") for k in range(9)], *[(30 + k, "concat", "NULL", [29 + k if k else 1, 3], "p_partkey % 10 = 0") for k in range(13)],
]
GIVEN = [("a", 1, 4, "TRUE"), ("a", 2, 3, "p_size % 3 = 0"), ("b", 1, 1, "p_partkey % 5 > 0"), ("b", 2, 6, "p_partkey % 5 = 1"), *[("b", k, 20 + k, "p_partkey % 5 = 0") for k in range(9)]]
NODES = " UNION ALL ".join(f"SELECT p_partkey AS scope, p_partkey * 100 + {j} AS id, '{kind}' AS kind, {value} AS value, {'ARR(' + ', '.join(f'p_partkey * 100 + {a}' for a in args) + ')' if args else 'NULL'} AS args FROM part WHERE {when}" for j, kind, value, args, when in EXPRESSIONS)
ASSIGNED = " UNION ALL ".join(f"SELECT p_partkey AS scope, '{name}' AS name, {at} AS ord, p_partkey * 100 + {j} AS id FROM part WHERE {when}" for name, at, j, when in GIVEN)
OUTSIDE = "SELECT p_name AS key, max(CASE WHEN p_size % 2 = 0 THEN p_type ELSE ' ' END) AS value FROM part GROUP BY p_name"
ROUND = """, w{n} AS MATERIALIZED (SELECT e.id, e.kind, e.value AS own, len(any_value(e.args)) AS wanted, list(k.value ORDER BY e.pos) AS v, bool_and(k.literal) AS literal, max(k.height) AS height FROM e JOIN k{m} k ON k.id = e.arg AND k.value IS NOT NULL WHERE e.id NOT IN (SELECT id FROM k{m}) GROUP BY 1, 2, 3 HAVING count(*) = len(any_value(e.args))),
    k{n} AS MATERIALIZED (SELECT * FROM k{m} UNION ALL SELECT * FROM (SELECT w.id, CASE kind WHEN 'name' THEN CASE WHEN len(list_distinct(v)) = 1 THEN v[1] END WHEN 'concat' THEN array_to_string(v, '') WHEN 'join' THEN CASE WHEN len(v) > 1 THEN list_reduce(v[2:], lambda p, x: p || v[1] || x) END WHEN 'valueof' THEN CASE WHEN literal THEN v[1] END WHEN 'config' THEN CASE WHEN trim(c.value) <> '' THEN c.value END
      WHEN 'format' THEN CASE own WHEN '%s-%s' THEN v[1] || '-' || v[2] WHEN '%s%%%s!' THEN v[1] || '%' || v[2] || '!' WHEN '%s' THEN v[1] END END AS value,
      CASE WHEN kind = 'name' AND len(list_distinct(v)) > 1 THEN [x.v FOR x IN list_sort([{{'i': list_position(v, x), 'v': x}} FOR x IN list_distinct(v)])] END AS candidates, kind IN ('format', 'valueof') AND literal AS literal, height + CASE WHEN kind = 'name' THEN 0 ELSE 1 END AS height FROM w{n} w LEFT JOIN c ON kind = 'config' AND c.key = v[1]) WHERE height <= 10 AND (value IS NOT NULL OR candidates IS NOT NULL))"""


@query(
    f"""WITH n AS ({NODES.replace("ARR(", "list_value(")}), g AS ({ASSIGNED}), c AS ({OUTSIDE}), h AS (SELECT scope, name, list(id ORDER BY ord) AS ids FROM g GROUP BY 1, 2), q AS MATERIALIZED (SELECT n.id, n.kind, n.value, coalesce(h.ids, n.args) AS args FROM n LEFT JOIN h ON kind = 'name' AND h.scope = n.scope AND h.name = n.value),
    e AS MATERIALIZED (SELECT id, kind, value, args, unnest(args) AS arg, unnest(range(len(args))) AS pos FROM q WHERE len(args) > 0), k0 AS MATERIALIZED (SELECT id, value, NULL::VARCHAR[] AS candidates, TRUE AS literal, 0 AS height FROM q WHERE kind = 'literal'){"".join(ROUND.format(n=i + 1, m=i) for i in range(14))}
    SELECT id, value, array_to_string(candidates[:8], '|') AS candidates, coalesce(len(candidates) > 8, FALSE) AS truncated, CASE WHEN candidates IS NOT NULL THEN 0.6 WHEN literal THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence FROM k14"""
)
def string_constants(t):
    t.part.createOrReplaceTempView("part")
    nodes, assigned, config = (t._spark.sql(x.replace("ARR(", "array(")) for x in (NODES, ASSIGNED, OUTSIDE))
    t._spark.catalog.dropTempView("part")
    found = constants.resolve(nodes, assigned, config)
    return found.select("id", "value", F.array_join("candidates", "|").alias("candidates"), "truncated", "confidence")
