"""Places of the terms of a dictionary in texts, all of them, overlapping ones too, at a cost that does not grow with the number of terms.

Terms are folded (lower case, full-width letters and digits made half-width), as the texts are. A dictionary of up to ``SENT`` code points is one automaton, which is sent to the
tasks and passes each text once. A larger one stays a table: texts are cut into pieces, each with what follows and precedes it, every window of a length that some term has is
a row, and an equi-join keeps those that are terms. Both give the same spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.redaction import SPAN, fold_width

#: Code points of all terms together up to which the automaton is sent.
SENT = 4_000_000
#: Code points of a piece of text whose windows are made together.
PIECE = 256
CONFIDENCE = 0.80


def terms_of(rows: DataFrame, column: str, allowed: DataFrame | None = None) -> DataFrame:
    """Distinct folded ``term``, ``size``: without blanks around them, empty ones, comments (``#``), and those that are allowed."""

    def folded(df: DataFrame, c: str) -> DataFrame:
        return df.select(F.trim(c).alias("t")).where("t <> '' AND NOT startswith(t, '#')").select(fold_width("t").alias("term")).distinct()

    terms = folded(rows, column)
    if allowed is not None:
        terms = terms.join(folded(allowed, allowed.columns[0]), "term", "left_anti")
    return terms.withColumn("size", F.char_length("term"))


def _wordy(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"


def _edge(text: str, at: int) -> bool:
    """Whether one side of a place is in a word and the other is not."""
    return (at > 0 and _wordy(text[at - 1])) != (at < len(text) and _wordy(text[at]))


def find(texts: DataFrame, key: str, text: str, terms: DataFrame, words: bool = False, confidence: float = CONFIDENCE, sent: int = SENT) -> DataFrame:
    """``key`` and ``spans`` of every row, in order of start and end; ``terms`` is what ``terms_of`` gives, ``key`` tells rows apart.

    With ``words`` a term must begin and end where a word does, and places of the same term do not overlap: the first counts. A null text has no spans.
    """
    told = terms.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()
    rows = texts.select(F.col(key).alias("key"), fold_width(text).alias("text"))
    found = _sent(rows, terms, words) if told["n"] <= sent else _joined(rows, terms, words)
    span = F.transform("places", lambda p: F.struct(F.lit("DICTIONARY").alias("type"), p["start"].alias("start"), p["end"].alias("end"), F.lit(confidence).alias("confidence")))
    return found.select(F.col("key").alias(key), F.coalesce(span, F.array()).cast(SPAN).alias("spans"))


def _sent(rows: DataFrame, terms: DataFrame, words: bool) -> DataFrame:
    known = rows.sparkSession.sparkContext.broadcast([r["term"] for r in terms.select("term").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in known.value:
            automaton.add_word(t, len(t))
        if known.value:
            automaton.make_automaton()
        for batch in batches:
            flat, sizes = [np.zeros((0, 2), np.int32)], [0]
            for text in batch.column("text").to_pylist():
                places, taken = [], {}
                for last, size in automaton.iter(text) if text and known.value else ():
                    start, end = last + 1 - size, last + 1
                    if words:
                        if not (_edge(text, start) and _edge(text, end)):
                            continue
                        term = text[start:end]
                        if start < taken.get(term, 0):
                            continue
                        taken[term] = end
                    places.append((start, end))
                places.sort()
                if places:
                    flat.append(np.array(places, np.int32))
                sizes.append(len(places))
            both = np.concatenate(flat)
            ends = pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), ends)], names=["key", "places"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, places array<struct<start:int,end:int>>")


def _joined(rows: DataFrame, terms: DataFrame, words: bool) -> DataFrame:
    sizes = terms.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("size").alias("m")).first()["m"]
    more = -(-most // PIECE)
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    cut = rows.select("key", F.posexplode(pieces.alias("p")).alias("nth", "piece"), pieces.alias("all"))
    ahead = F.array_join(F.slice("all", F.col("nth") + 1, more + 2), "")
    cut = cut.select("key", (F.col("nth") * PIECE).alias("at"), F.length("piece").alias("n"), F.substring(ahead, F.lit(1), F.length("piece") + most + 1).alias("ahead"), F.when(F.col("nth") > 0, F.substring(F.get("all", F.col("nth") - 1), -1, 1)).otherwise("").alias("behind"))
    lengths = sizes.agg(F.sort_array(F.collect_list("size")).alias("lengths"))  # one row, of lengths up to the longest term's
    cut = cut.crossJoin(F.broadcast(lengths)).select("*", F.explode(F.sequence(F.lit(1), "n")).alias("from")).select("*", F.explode("lengths").alias("size"))

    def wordy(c):
        return F.coalesce(c.rlike(r"^[\p{L}\p{Nd}_]$"), F.lit(False))

    def char(at):
        return F.when(at > 0, F.substring("ahead", at, F.lit(1))).otherwise(F.col("behind"))

    first, after = F.col("from"), F.col("from") + F.col("size")
    cut = cut.withColumn("term", F.substring("ahead", F.col("from"), F.col("size"))).where(F.char_length("term") == F.col("size"))
    if words:
        cut = cut.where((wordy(char(first - 1)) != wordy(char(first))) & (wordy(char(after - 1)) != wordy(char(after))))
    start = (F.col("at") + F.col("from") - 1).cast("int")
    hits = cut.select("key", "term", start.alias("start"), (start + F.col("size")).cast("int").alias("end")).join(terms.select("term"), "term")
    if words:
        kept = F.aggregate(F.sort_array(F.collect_list(F.struct("start", "end"))), F.array().cast("array<struct<start:int,end:int>>"), lambda a, p: F.when((F.size(a) == 0) | (p["start"] >= F.element_at(a, -1)["end"]), F.array_append(a, p)).otherwise(a))
        hits = hits.groupBy("key", "term").agg(kept.alias("kept")).select("key", F.explode("kept").alias("p")).select("key", "p.start", "p.end")
    placed = hits.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("places"))
    return rows.select("key").join(placed, "key", "left")
