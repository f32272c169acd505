"""The pipeline's stages and its run against brute force on the smallest tables, and on odd ones."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from test_operators import CLASHES, ODD, hashes_of, overlaps, print_by_hand, schedule_by_hand, texts_of
from tokenizers import Tokenizer

from tessera.llm import lang_id, queries


def one_of_each_group(rows):
    """Rows of the smallest id of each group linked by all pairs."""
    prints = [print_by_hand(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    best = {}
    for i, r in enumerate(rows):
        if top(i) not in best or r["doc_id"] < rows[best[top(i)]]["doc_id"]:
            best[top(i)] = i
    return [rows[i] for i in best.values()]


@pytest.fixture(scope="module")
def by_hand(spark):
    """The rows after each stage."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = lang_id.fit(docs.where(~lang_id.held_out()))
    rows = docs.collect()
    known = [r for r, s in zip(rows, lang_id._stays(model, model.symbols(), [r["text"] or "" for r in rows], [r["lang"] for r in rows])) if s]
    alone = one_of_each_group(known)
    bench = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = [r for r in alone if not any(overlaps(r["text"] or "", x) for x in bench)]
    copies = schedule_by_hand([(r["doc_id"], r["source"], r["text"]) for r in clean], hashes_of(spark, docs))
    return {"language_id": known, "simhash_dedup": alone, "decontamination": clean, "mixing": [r for r, n in zip(clean, copies) for _ in range(n)]}


def test_stages_are_those_of_brute_force(spark, by_hand):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SMALL)
        assert found.columns == docs.columns
        assert sorted(map(repr, found.collect())) == sorted(map(repr, by_hand[name])), name
        docs = spark.createDataFrame(by_hand[name], docs.schema)
    assert len(by_hand["simhash_dedup"]) < len(by_hand["language_id"]) and len(by_hand["decontamination"]) < len(by_hand["simhash_dedup"])


def test_run_encodes_what_the_stages_leave(spark, by_hand):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(queries.TOKENIZER)))
    want, start = [], 0
    for r in sorted(by_hand["mixing"], key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns pass through all stages; an empty table gives an empty result."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    odd = spark.createDataFrame([(*r[:5], *[f"{c}{r[0]}" for c in CLASHES]) for r in ODD], schema)
    for table, least in ((odd, 3), (odd.limit(0), 0)):
        where = str(tmp_path / f"in{least}")
        table.write.parquet(f"{where}/documents.parquet")
        spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{where}/benchmark.parquet")
        docs, known = table, {tuple(r) for r in table.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, where).collect(), table.schema)
            assert {tuple(r) for r in docs.collect()} <= known, name
        assert set(texts_of(docs)) == ({4, 6, None} if least else set())
        rows = corpus_pipeline.run(spark, where).collect()
        assert {r["doc_id"] for r in rows} == set(texts_of(docs)) and len(rows) >= least
