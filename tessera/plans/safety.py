"""Queries over the detectors of secrets and the masking of text, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import redaction
from tessera.operators import dictionary
from tessera.plans.catalog import query
from tessera.sources import writers
from tessera.sources.shared import scratch

# The patterns of keys and of addresses, in the words of RE2.
KEY = r"(?i)\b[A-Z0-9_-]*(?:api[_-]?key|token|secret|password)[A-Z0-9_-]*\b\s*[:=]\s*"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
#: Digits of a list of candidates, doubled from the right, added up by tens.
LUHN = "list_sum([CASE WHEN i % 2 = 1 THEN CAST(reverse(d)[i] AS INT) ELSE 2 * CAST(reverse(d)[i] AS INT) - CASE WHEN CAST(reverse(d)[i] AS INT) > 4 THEN 9 ELSE 0 END END FOR i IN range(1, length(d) + 1)]) % 10 = 0"
#: What is no digit is doubled first, so that a match that takes the one after it leaves one before the next.
RUNS = r"regexp_extract_all(regexp_replace(text, '([^0-9])', '\1\1', 'g'), '(?:^|[^0-9])((?:[0-9][ -]*){12,18}[0-9])(?:[^0-9]|$)', 1)"
CARDS = f"len([1 FOR d IN [regexp_replace(c, '[^0-9]', '', 'g') FOR c IN {RUNS}] IF {LUHN}])"
COUNTS = rf"""SELECT doc_id, len(regexp_extract_all(text, '(?i)-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z ]+ )?PRIVATE KEY-----')) AS n_pem_key, len(regexp_extract_all(text, '(?i)\bAuthorization\s*:\s*Bearer\s+[A-Z0-9._+/=-]+')) AS n_auth_bearer,
    len(regexp_extract_all(text, '{KEY}(?:"[^"]*"|''[^'']*''|[^\s''";]+)')) AS n_key_value, len(regexp_extract_all(text, '{EMAIL}')) AS n_email, {CARDS} AS n_credit_card, len(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9_-])', '\1\1', 'g'), '(?:^|[^A-Za-z0-9_-])[A-Za-z0-9_-]{{10,}}\.\.[A-Za-z0-9_-]{{10,}}\.\.[A-Za-z0-9_-]{{8,}}')) AS n_jwt FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"""
KINDS = tuple(d[0] for d in redaction.DETECTORS)


@query(COUNTS)
def redaction_counts(t):
    return t.documents.select("doc_id", redaction.counts(redaction.detect("text"), KINDS).alias("n")).select("doc_id", "n.*")


@query(
    f"""SELECT c.*, d.request_chars, d.request_sha256, d.outcome FROM ({COUNTS}) c JOIN (SELECT doc_id, length(text) AS request_chars, sha256(text) AS request_sha256, CASE WHEN lang IS NULL THEN 'failed' ELSE 'answered' END AS outcome FROM documents) d USING (doc_id)"""
)
def audit_with_redactions(t):
    """Records of documents as requests: what was found in them, but not what it was."""
    path = scratch(t._spark, "audit")
    writers.audit(t.documents.select("doc_id", F.col("text").alias("request"), F.col("lang").alias("response")), path, KINDS)
    kinds = ", ".join(f"n_{k.lower()} long" for k in KINDS)
    read = t._spark.read.schema(f"doc_id long, request_chars long, request_sha256 string, outcome string, redactions struct<{kinds.replace(' long', ':bigint')}>").json(path)
    return read.select("doc_id", "request_chars", "request_sha256", "outcome", "redactions.*")


# --- every kind of secret, written into a text, so that each detector is looked at


MADE = "p_name || ' Authorization : Bearer  abc.' || p_type || '/x ; secret_key=k' || CAST(p_size AS STRING) || ' client-secret-value: \"s 3\" mail ' || p_type || '@ex.co.uk, card 4111 1111 1111 1111; no card 4111-1111-1111-1112. ' || 'aaaaaaaaaa.bbbbbbbbbb.cccccccc'"


@query(
    """SELECT p_partkey AS id, 6 AS n, TRUE AS blocked, p_name || ' Authorization : Bearer  [REDACTED] ; secret_key=[REDACTED] client-secret-value: "[REDACTED]" mail [REDACTED], card [REDACTED]; no card 4111-1111-1111-1112. [REDACTED]' AS text,
    p_name || ' Authorization : Bearer  [REDACTED] ; secret_key=[REDACTED] client-secret-value: "[REDACTED]" mail [REDACTED], card [REDACTED]; no card 4111-1111-1111-1112. [REDACTED]' AS in_turn FROM part"""
)
def pii_masked(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.expr(MADE).alias("said")).withColumn("kept", redaction.resolve_overlaps(redaction.detect("said")))
    return rows.select("id", F.size("kept").alias("n"), redaction.policy("said", F.col("kept")).alias("p"), redaction.mask_in_turn("said").alias("in_turn")).select("id", "n", "p.blocked", "p.text", "in_turn")


# --- whole documents

PEM = r"(?i)-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z ]+ )?PRIVATE KEY-----"
BEARER = r"(?i)(\bAuthorization\s*:\s*Bearer\s+)[A-Z0-9._+/=-]+"
HELD = r"(?i)((?:api[_-]?key|token|secret|password)[A-Z0-9_-]*\b\s*[:=]\s*)"
TOKEN = r"(^|[^A-Za-z0-9_-])([A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{8,})"
TURNS = [(PEM, "[REDACTED]"), (BEARER, r"\1[REDACTED]"), (HELD + '"[^"]*"', r'\1"[REDACTED]"'), (HELD + "''[^'']*''", r"\1''[REDACTED]''"), (HELD + r"[^\s''\";]+", r"\1[REDACTED]"), (TOKEN, r"\1[REDACTED]"), (EMAIL, "[REDACTED]")]
IN_TURN = "coalesce(text, '')"
for _p, _by in TURNS:
    IN_TURN = f"regexp_replace({IN_TURN}, '{_p}', '{_by}', 'g')"
DIGITS = "regexp_replace(c, '[^0-9]', '', 'g')"


@query(
    rf"""WITH a AS (SELECT doc_id, coalesce(text, '') AS said, {IN_TURN} AS text FROM documents),
    c AS (SELECT doc_id, said, text, [regexp_replace(c, '([^0-9])[^0-9]', '\1', 'g') FOR c IN {RUNS} IF {LUHN.replace("(d)", f"({DIGITS})")}] AS cards FROM a),
    m AS (SELECT doc_id, said, CASE WHEN len(cards) > 0 THEN list_reduce(list_prepend(text, cards), lambda t, c: replace(t, c, '[REDACTED]')) ELSE text END AS t FROM c)
    SELECT doc_id, t = said AS same, sha256(t) AS masked_sha256 FROM m"""
)
def documents_masked_in_turn(t):
    masked = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("said"), redaction.mask_in_turn("text").alias("t"))
    return masked.select("doc_id", (F.col("t") == F.col("said")).alias("same"), F.sha2("t", 256).alias("masked_sha256"))


O, S, C = redaction.OPENS, redaction.SPLITS, redaction.CLOSES
#: Kind, confidence, pattern, and what stands before the secret.
LOOKED = [("PEM_KEY", 1.0, f"({PEM})", ""), ("AUTH_BEARER", 0.95, BEARER, r"\1"), ("KEY_VALUE", 0.85, HELD + r"""(?:"[^"]*"|''[^'']*''|[^\s''";]+)""", r"\1"), ("EMAIL", 0.9, EMAIL, "")]
MARKED = [(k, c, rf"regexp_replace(text, '{p}', '{O}{before}{S}\0{C}', 'g')") for k, c, p, before in LOOKED]
MARKED.append(("JWT", 0.95, rf"regexp_replace(text, '{TOKEN}', '\1{O}{S}\2{C}', 'g')"))
CARD = f"(^|[^0-9{S}])((?:[0-9][ -]*){{13,19}})([^0-9]|$)"
MARKED.append(("CREDIT_CARD", 0.98, rf"regexp_replace(regexp_replace(text, '{CARD}', '\1{O}{S}\2{C}\3', 'g'), '{CARD}', '\1{O}{S}\2{C}\3', 'g')"))
NTH = [d[0] for d in redaction.DETECTORS]
FOUND = " UNION ALL ".join(f"SELECT doc_id AS o, '{k}' AS k, {c} AS c, {NTH.index(k)} AS kind, {m} AS m FROM t WHERE contains({m}, '{O}')" for k, c, m in MARKED)
DOCUMENT_SPANS = f"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f0 AS ({FOUND}), f1 AS (SELECT o, k, c, kind, string_split(m, '{O}') AS l FROM f0),
    f2 AS (SELECT o, k, c, kind, length(l[1]) AS base, unnest(l[2:]) AS p, unnest(range(1, len(l))) AS i FROM f1),
    f3 AS (SELECT o, k, c, kind, i, base, length(split_part(p, '{S}', 1)) AS head, split_part(split_part(p, '{C}', 1), '{S}', 2) AS found, length(split_part(p, '{C}', 2)) AS rest FROM f2),
    f4 AS (SELECT *, CAST(base + coalesce(sum(length(found) + rest) OVER (PARTITION BY o, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p, CASE WHEN k = 'KEY_VALUE' AND substr(found, head + 1, 1) IN ('"', '''') THEN 1 ELSE 0 END AS q, regexp_replace(found, '[^0-9]', '', 'g') AS d FROM f3),
    s AS (SELECT o, p + head + q AS a, p + length(found) - q AS b, c, k, kind * 1000000 + i AS i FROM f4 WHERE k <> 'CREDIT_CARD' OR {LUHN}),
    n AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY a, c DESC, i) AS r FROM s),
    f(o, r, kept) AS (SELECT o, r, [{{'k': k, 'a': a, 'b': b, 'c': c}}] FROM n WHERE r = 1 UNION ALL SELECT f.o, n.r, CASE WHEN n.a >= f.kept[-1].b OR n.b <= f.kept[-1].a THEN list_append(f.kept, {{'k': n.k, 'a': n.a, 'b': n.b, 'c': n.c}}) WHEN n.c > f.kept[-1].c THEN list_append(f.kept[:-2], {{'k': n.k, 'a': n.a, 'b': n.b, 'c': n.c}}) ELSE f.kept END FROM f JOIN n ON n.o = f.o AND n.r = f.r + 1),
    g AS (SELECT o, arg_max(kept, r) AS m FROM f GROUP BY o)"""
KIND_COUNTS = ", ".join(f"CAST(len(list_filter(coalesce(m, []), lambda x: x.k = '{k}')) AS BIGINT) AS n_{k.lower()}" for k in KINDS)


@query(
    f"""{DOCUMENT_SPANS} SELECT doc_id, {KIND_COUNTS}, coalesce(len(list_filter(m, lambda x: x.c >= 0.9)) > 0, FALSE) AS blocked, coalesce(list_aggregate([x.k || ':' || x.a || '-' || x.b FOR x IN m], 'string_agg', ','), '') AS spans,
    sha256(coalesce(list_aggregate([substr(text, CASE WHEN i = 1 THEN 1 ELSE m[i - 1].b + 1 END, m[i].a - CASE WHEN i = 1 THEN 0 ELSE m[i - 1].b END) || '[REDACTED]' FOR i IN range(1, len(m) + 1)], 'string_agg', ''), '') || substr(text, coalesce(m[-1].b, 0) + 1)) AS masked_sha256
    FROM t LEFT JOIN g ON doc_id = o"""
)
def documents_masked(t):
    """Every document with its findings, overlaps resolved, masked."""
    rows = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("kept", redaction.resolve_overlaps(redaction.detect("text")))
    rows = rows.select("doc_id", redaction.counts(F.col("kept"), KINDS).alias("n"), "kept", redaction.policy("text", F.col("kept")).alias("p"))
    told = F.array_join(F.transform("kept", lambda s: F.concat(s["type"], F.lit(":"), s["start"], F.lit("-"), s["end"])), ",")
    return rows.select("doc_id", "n.*", "p.blocked", told.alias("spans"), F.sha2("p.text", 256).alias("masked_sha256"))


# Lines of an order as spans of a text: they overlap in every way.
SPANS = "WITH RECURSIVE s AS (SELECT l_orderkey AS o, CAST(l_quantity AS INT) AS a, CAST(l_quantity AS INT) + 1 + l_suppkey % 9 AS b, CASE l_returnflag WHEN 'R' THEN 0.9 WHEN 'A' THEN 0.7 ELSE 0.5 END AS c, 'T' || l_linenumber AS k, l_linenumber AS i FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY a, c DESC, i, b) AS r FROM s), f(o, r, kept) AS (SELECT o, r, [{'k': k, 'a': a, 'b': b, 'c': c}] FROM n WHERE r = 1 UNION ALL SELECT f.o, n.r, CASE WHEN n.a >= f.kept[-1].b OR n.b <= f.kept[-1].a THEN list_append(f.kept, {'k': n.k, 'a': n.a, 'b': n.b, 'c': n.c}) WHEN n.c > f.kept[-1].c THEN list_append(f.kept[:-2], {'k': n.k, 'a': n.a, 'b': n.b, 'c': n.c}) ELSE f.kept END FROM f JOIN n ON n.o = f.o AND n.r = f.r + 1), g AS (SELECT o, arg_max(kept, r) AS kept FROM f GROUP BY o)"


def spans(t):
    one = F.struct(F.concat(F.lit("T"), "l_linenumber").alias("type"), F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity").cast("int") + 1 + F.col("l_suppkey") % 9).cast("int").alias("end"), F.when(F.col("l_returnflag") == "R", 0.9).when(F.col("l_returnflag") == "A", 0.7).otherwise(0.5).alias("confidence"))
    listed = t.lineitem.groupBy(F.col("l_orderkey").alias("o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("s")))), lambda x: x["s"]).alias("found"))
    return listed.select("o", "found", redaction.resolve_overlaps(F.col("found")).alias("kept"))


@query(f"{SPANS} SELECT o, list_aggregate([x.k || ':' || x.a || '-' || x.b FOR x IN kept], 'string_agg', ',') AS kept FROM g")
def overlap_resolution(t):
    return spans(t).select("o", F.array_join(F.transform("kept", lambda s: F.concat(s["type"], F.lit(":"), s["start"], F.lit("-"), s["end"])), ",").alias("kept"))


TEXT = "repeat('abcdefghij', 7)"


@query(
    f"""{SPANS}, m AS (SELECT o, kept, [x FOR x IN kept IF x.c >= 0.6] AS m FROM g)
    SELECT o, len([x FOR x IN kept IF x.c >= 0.9]) > 0 AS blocked, coalesce(list_aggregate([substr({TEXT}, CASE WHEN i = 1 THEN 1 ELSE m[i - 1].b + 1 END, m[i].a - CASE WHEN i = 1 THEN 0 ELSE m[i - 1].b END) || '[REDACTED]' FOR i IN range(1, len(m) + 1)], 'string_agg', ''), '') || substr({TEXT}, coalesce(m[-1].b, 0) + 1) AS text, {TEXT} AS reported FROM m"""
)
def redaction_policy(t):
    rows = spans(t).withColumn("said", F.expr(TEXT))
    p, off = redaction.policy("said", F.col("kept")), redaction.policy("said", F.col("kept"), "report")
    return rows.select("o", p.alias("p"), off.alias("q")).select("o", "p.blocked", "p.text", F.col("q.text").alias("reported"))


@query(
    f"""{SPANS} SELECT o, len([x FOR x IN kept IF substr({TEXT}, x.a + 1, x.b - x.a) NOT IN ('ab', 'abc', 'j')]) AS n FROM g"""
)
def allowlist(t):
    rows = spans(t).withColumn("said", F.expr(TEXT))
    return rows.select("o", F.size(redaction.without_allowed("said", F.col("kept"), ("ab", "abc", "j"))).cast("long").alias("n"))


@query(f"SELECT p_partkey, {LUHN} AS passes FROM (SELECT p_partkey, CAST(4000000000000 + p_partkey * 7919 AS VARCHAR) AS d FROM part)")
def luhn(t):
    return t.part.select("p_partkey", F.call_function("luhn_check", (F.col("p_partkey") * 7919 + 4000000000000).cast("string")).alias("passes"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(p_name, 'ring$') THEN 1 ELSE 0 END AS n FROM part")
def registered_detectors(t):
    """A detector of one's own beside those there are."""
    own = {"COLOUR": "red", "SHAPE": "ring$"}
    try:
        for name, pattern in own.items():
            redaction.register(name, lambda text, name=name, pattern=pattern: redaction.spans_of(text, name, pattern, 0.5))
        found = redaction.detect("p_name", tuple(own))
    finally:
        for name in own:
            redaction.unregister(name)
    return t.part.select("p_partkey", F.size(found).alias("n"))


#: Words of the benchmark and names of parts, without endings that are allowed; every place of each in every document.
WORDS = "SELECT DISTINCT lower(trim(w)) AS term FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark UNION ALL SELECT p_name FROM part) WHERE trim(w) <> '' AND NOT starts_with(trim(w), '#')"


def found_terms(t, words: bool, sent: int = dictionary.SENT):
    rows = t.benchmark.select(F.explode(F.split("text", " ")).alias("w")).unionByName(t.part.select(F.col("p_name").alias("w")))
    terms = dictionary.terms_of(rows, "w", t.part.select(F.substring_index("p_name", " ", -1)))
    found = dictionary.find(t.documents, "doc_id", "text", terms, words, sent=sent)
    told = F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return found.select("doc_id", F.size("spans").cast("long").alias("n"), F.sha2(told, 256).alias("places_sha256"))


DICTIONARY = """WITH a AS (SELECT DISTINCT lower(string_split(p_name, ' ')[-1]) AS term FROM part), t AS (SELECT * FROM ({words}) WHERE term NOT IN (SELECT term FROM a)), z AS (SELECT DISTINCT length(term) AS size FROM t),
    d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?s).{{1,64}}') AS l FROM documents), p AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM d),
    y AS (SELECT doc_id, (n - 1) * 64 AS o, length(l[n]) AS own, l[n] || coalesce(l[n + 1], '') AS y, CASE WHEN n > 1 THEN right(l[n - 1], 1) ELSE '' END AS behind FROM p),
    w AS (SELECT doc_id, o, y, behind, i, size, substr(y, i, size) AS term FROM (SELECT *, unnest(range(1, own + 1)) AS i FROM y), z WHERE i + size <= length(y) + 1),
    h AS (SELECT doc_id, o + i - 1 AS a, o + i - 1 + size AS b FROM w JOIN t USING (term){where})
    SELECT doc_id, count(a) AS n, sha256(coalesce(string_agg(a || '-' || b, ',' ORDER BY a, b), '')) AS places_sha256 FROM d LEFT JOIN h USING (doc_id) GROUP BY doc_id"""


@query(DICTIONARY.format(words=WORDS, where=""))
def dictionary_of_thousands(t):
    return found_terms(t, False)


WORDY = r"regexp_matches({}, '^[\p{{L}}\p{{Nd}}_]$')"
EDGES = " AND ".join(f"{WORDY.format(a)} <> {WORDY.format(b)}" for a, b in (("CASE WHEN i > 1 THEN substr(y, i - 1, 1) ELSE behind END", "substr(y, i, 1)"), ("substr(y, i + size - 1, 1)", "substr(y, i + size, 1)")))


@query(DICTIONARY.format(words=WORDS, where=f" WHERE {EDGES}"))
def dictionary_of_words(t):
    return found_terms(t, True)
