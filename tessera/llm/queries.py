"""The queries of these operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, decontam, lang_id, licenses, lm_score, merkle, mixing, pii, sentence_pieces, simhash, token_file, toxicity, trie
from tessera.llm._common import scratch

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    return lang_id.predict(docs, model).withColumn("held_out", lang_id.held_out())


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def tokens(docs: DataFrame, remembered: int = token_file.REMEMBERED) -> DataFrame:
    path = scratch(docs.sparkSession, "tokens")
    token_file.write(docs, path, public_tokenizers.path(TOKENIZER), remembered=remembered)
    return token_file.scan(docs.sparkSession, path)


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"))


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECES)
    found = sentence_pieces.decode(sentence_pieces.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie.trie(trie.rebuilt(trie.turns(table(spark, sf_dir, "conversations"))))
    return found.drop("preorder", "subtree_end")


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(merkle.leaves(docs, {"text": tampered}))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id,
    "op2_toxicity": toxic,
    "op3_nearest_neighbours": neighbours,
    "op4_lm_scoring": language_model,
    "op5_personal_data": personal_data,
    "op6_token_file": token_ids,
    "op7_decontamination": benchmark_overlap,
    "op8_mixing": mixture,
    "op9_simhash": near_duplicates,
    "op10_license_scan": license_scan,
    "op11_sentence_pieces": pieces,
    "op12_prefix_trie": prefix_trie,
    "op13_merkle_manifest": dataset_manifest,
}


def _canonical_sql(x: str) -> str:
    x = f"regexp_replace(lower({x}), '(?m)^[^\\p{{L}}\\n]{{0,40}}(?:copyright\\b|\\(c\\)|©).*$', ' ', 'g')"
    x = f"' ' || regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    for a, b in licenses.SPELLINGS:
        pad = " " if " " in a.strip() else ""
        x = f"replace({x}, '{pad}{a}{pad}', '{pad}{b}{pad}')"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


def _license_sql() -> str:
    known = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in licenses.KNOWN)
    return f"""WITH k(license_id, t) AS (VALUES {known}), d AS (SELECT DISTINCT license_id, sha256({_canonical_sql("t")}) AS digest FROM k),
    l AS (SELECT doc_id, text, string_split(replace(text, chr(13), ''), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, 'text' AS unit, NULL::INT AS line, text AS part FROM l UNION ALL
      SELECT doc_id, 'line', CAST(n - 1 AS INT), lines[n] FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS n FROM l WHERE len(lines) > 1)),
    c AS (SELECT doc_id, unit, line, {_canonical_sql("part")} AS c FROM u)
    SELECT doc_id, license_id, unit, line FROM c JOIN d ON sha256(c) = digest WHERE c <> ''"""


#: The CRC-32 of a number's digits, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST({0} AS VARCHAR), '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


#: Levels of trees by recursion, each node's siblings left and right of it, and leaves folded along them.
MANIFEST_SQL = f"""WITH RECURSIVE d AS (SELECT *, CASE WHEN {_CRC.format("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents), l AS (SELECT doc_id, coalesce('s' || source, '') AS s, {_leaf_sql("text")} AS leaf, {_leaf_sql("now")} AS cur FROM d),
    p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM l),
    t(level, s, i, h, n) AS (SELECT 0, s, i, leaf, n FROM p UNION ALL SELECT level + 1, s, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY level, s, i // 3, n),
    r AS (SELECT s, h, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
    u(level, i, h, n) AS (SELECT 0, i, h, n FROM r UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, i // 3, n),
    a AS (SELECT level, s, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY level, s, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS x, coalesce(string_agg(h, '') OVER (PARTITION BY level, s, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS y FROM t
      UNION ALL SELECT level, NULL, i, n, coalesce(string_agg(h, '') OVER (PARTITION BY level, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), coalesce(string_agg(h, '') OVER (PARTITION BY level, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') FROM u),
    w AS (SELECT p.s, p.i, list({{'x': a.x, 'y': a.y}} ORDER BY a.level) AS w FROM p JOIN a ON a.s = p.s AND a.n > 1 AND a.i = p.i // CAST(pow(3, a.level) AS BIGINT) GROUP BY 1, 2),
    v AS (SELECT r.s, list({{'x': a.x, 'y': a.y}} ORDER BY a.level) AS v FROM r JOIN a ON a.s IS NULL AND a.n > 1 AND a.i = r.i // CAST(pow(3, a.level) AS BIGINT) GROUP BY 1),
    z AS (SELECT p.doc_id, p.leaf, p.cur, r.h AS subroot, list_concat(coalesce(w.w, []), coalesce(v.v, [])) AS path FROM p JOIN r USING (s) LEFT JOIN w ON w.s = p.s AND w.i = p.i LEFT JOIN v ON v.s = p.s),
    f AS (SELECT *, list_reduce(list_prepend({{'x': cur, 'y': ''}}, path), lambda h, e: {{'x': sha256(e.x || h.x || e.y), 'y': ''}}).x AS folded_root FROM z), q AS (SELECT h AS root FROM u WHERE n = 1)
    SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string([e.x || e.y FOR e IN path], ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f, q"""
#: Prefixes as lists of digests; what is in a subtree by each node's prefixes.
TRIE_SQL = f"""WITH o AS (SELECT conv_id AS c, length(coalesce(text, '')) AS chars, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
    s AS (SELECT c, list({{'x': x, 'n': chars}} ORDER BY turn NULLS FIRST, x) AS own, {_CRC.format("c")} % 6 AS h FROM o GROUP BY c),
    b AS (SELECT s.c, list_concat(coalesce(p.own[:s.h], []), s.own[s.h + 1:]) AS t FROM s LEFT JOIN s AS p ON p.c = s.c - s.c % 100),
    m AS (SELECT c, t[:k] AS t, len(t) = k AS done FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS k FROM b)), y AS (SELECT c, [e.x FOR e IN t] AS key, done, coalesce(t[-1].n, 0) AS chars FROM m),
    n AS (SELECT key, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (done), '') AS ends FROM y GROUP BY key),
    k AS (SELECT key[:-2] AS key, count(*) AS n_children FROM n WHERE len(key) > 0 GROUP BY 1),
    e AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.key = n.key),
    g AS (SELECT key[:j] AS key, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, len(key) + 1)) AS j FROM e) GROUP BY 1)
    SELECT e.conv_id, CAST(len(e.key) AS BIGINT) AS depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, g.n_leaves, g.saved_tokens, sha256(e.ends) AS ends_sha256 FROM e JOIN g ON g.key = e.key LEFT JOIN e AS p ON len(e.key) > 0 AND p.key = e.key[:-2]"""

#: The others need a library's tokenizer or hash, a trained model, offsets of matches or a search: they are tested by brute force.
ORACLE_SQL: dict[str, str] = {"op10_license_scan": _license_sql(), "op12_prefix_trie": TRIE_SQL, "op13_merkle_manifest": MANIFEST_SQL}
