"""Language-model scoring by cross-entropy difference.

Two bigram models, one of target documents (labelled good and not toxic) and one of all documents, share
one vocabulary, one set of kept bigrams and one smoothing, so that they differ in counts alone. A document's
score is the mean over its words of loss under the target model less loss under the background model: the
lower, the closer to the target. A word, or pair, is in the model if it comes at least LEAST times, whatever the
size of the corpus; words that come less often are one unknown word, other pairs back off to their second word.

The model grows with the corpus and is never in one place. Texts are packed, compressed, into runs of about RUN
code points, rows of a table in the shared folder. Each run asks for the counts of its distinct words and pairs, as
sorted hashes that are cut into buckets by range; together with the question goes what the run itself
adds. Whoever holds a bucket adds up all runs' counts and answers each run in the order of its question; where there are many runs, parts of
them are added up first and answered together. The runs
then meet their answers and are scored. So a key crosses the network once for each run it stands in, however
often it comes there, a hot word is one key of a run like any other, and no model is broadcast or joined. A run
that does not get an answer for each of its keys raises an error.

Hashes of words and pairs have 56 bits: at 10^13 distinct pairs about one in 15,000 shares its hash.

Defined results: a null or empty text has no words, losses and score null; without target documents the
target model is the background model and all scores are 0; repeated rows each count and each get their row;
empty tables give an empty result; several labels of a document count as good if all are; a null id has no label; other
columns of the inputs are not read. A text of any length is scored whole, in the memory of one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import scratch
from tessera.llm._words import joined, slices, split

#: A word or pair stays in the model if it comes so often.
LEAST = 2
#: Weight of the bigram estimate; added to unigram counts.
BIGRAM, ADDED = 0.7, 0.5
#: Code points of a run, bytes of text to a bucket, and to a partition of the two shuffles.
RUN, BUCKET, PARTITION = 12_000_000, 4_000_000, 64_000_000
#: Rows of a bucket that are added up together in a task.
GROUPED = 1024
#: Target documents up to which their ids are broadcast, 8 bytes each; beyond, texts are joined to labels by a shuffle.
BROADCAST = 4_000_000
#: In place of a word before the first of a text.
START = 0
#: What is said of a document in a run: it counts, is scored, is a target, has no id.
COUNTED, WANTED, TARGET, NO_ID = 1, 2, 4, 8
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """What xxhash64 makes of two longs in Spark."""
    x = np.full(len(first), 42, np.uint64)
    for part in (first, second):
        x = x + _P5 + np.uint64(8)
        x ^= _turned(part.view(np.uint64) * _P2, 31) * _P1
        x = _turned(x, 27) * _P1 + _P4
        x = (x ^ (x >> np.uint64(33))) * _P2
        x = (x ^ (x >> np.uint64(29))) * _P3
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


# --- bytes of sorted keys and of small numbers


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 on, a byte each, those over 254 once more in full at the end."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes()


class _Reader:
    """Reads what was put together, from the left."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.raw, kind, n, self.at)
        self.at += out.nbytes
        return out

    def small(self, n: int) -> np.ndarray:
        out = self.take("u1", n).astype(np.int64)
        large = np.flatnonzero(out == 255)
        out[large] = self.take("<i8", len(large))
        return out

    def keys(self, n: int) -> np.ndarray:
        low = self.take("<u4", n).astype(np.int64)
        return (np.cumsum(self.small(n)) << 32) | low


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: the low 32 bits in full, of the high ones what each adds to the one before."""
    return (keys & 0xFFFFFFFF).astype("<u4").tobytes() + _small(np.diff(keys >> 32, prepend=0))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the keys, which have 56 bits."""
    return (keys >> 24) * buckets >> 32


# --- runs


def _packing(targets):
    """``_runs`` that knows the ids of target documents, sorted, if they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _runs(batches, targets.value if targets else np.zeros(0, np.int64))

    return run


def _runs(batches: Iterator[pa.RecordBatch], targets: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of doc_id, text, say: rows of many compressed texts with their ends, ids and what is said of them."""
    nth, held, size = 0, [], 0

    def run(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal nth
        table = pa.Table.from_batches(parts)
        raw, ends = joined(table.column("text").to_pylist())
        ids, said = table.column("doc_id"), table.column("say").to_numpy().astype(np.uint8)
        none, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
        said = said | np.where(none, np.uint8(NO_ID), np.uint8(0))
        if len(targets):
            hit = targets[np.minimum(np.searchsorted(targets, ids), len(targets) - 1)] == ids
            said = said | np.where(hit & ~none & (said & COUNTED > 0), np.uint8(TARGET), np.uint8(0))
        number, nth = (TaskContext.get().partitionId() << 33) + nth, nth + 1
        row = [number, len(raw), pa.compress(raw, codec="zstd", asbytes=True), ends.tobytes(), ids.tobytes(), said.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["run", "size", "texts", "ends", "ids", "said"])

    for batch in batches:
        sizes = pa.compute.utf8_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).tolist()
        for a, b in slices(sizes, RUN - size) if sizes else []:
            held.append(batch.slice(a, b - a))
            size += sum(sizes[a:b])
            if size >= RUN:
                yield run(held)
                held, size = [], 0
    if held:
        yield run(held)


class _Run:
    """The words of a run, its distinct words and pairs in order, and where each word and pair is among them."""

    def __init__(self, row: dict):
        raw = pa.decompress(row["texts"], decompressed_size=row["size"], codec="zstd", asbytes=True)
        self.ids, self.said = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["said"], np.uint8)
        words, self.owner = split(raw, np.frombuffer(row["ends"], np.int64))
        words = (words >> np.uint64(8)).view(np.int64)
        before = np.full(len(words), START, np.int64)
        before[1:] = words[:-1]
        self.first = np.ones(len(words), bool)
        self.first[1:] = self.owner[1:] != self.owner[:-1]
        before[self.first] = START
        self.pair_order, self.pair_at, self.pairs = _distinct((pair_keys(before, words).view(np.uint64) >> np.uint64(8)).view(np.int64))
        # The start of texts is one more word, before all others.
        self.word_order, self.word_at, self.words = _distinct(np.append(words, START))
        self.word_of = np.empty(len(words) + 1, np.int64)
        self.word_of[self.word_order] = np.repeat(np.arange(len(self.words)), np.diff(self.word_at, append=len(words) + 1))

    def before_of(self, at: np.ndarray) -> np.ndarray:
        """Which of the distinct words stands before these words."""
        return np.where(self.first[at], self.word_of[-1], self.word_of[at - 1])

    def asked(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """By bucket the keys and what this run adds to their counts: all and in target documents, and of words how often they end a text."""
        counted = (self.said & COUNTED > 0).astype(np.int64)
        counts = [counted[self.owner], (counted * (self.said & TARGET > 0))[self.owner]]
        last = np.append(self.first[1:], True) if len(self.first) else self.first
        texts = [int(x[self.first].sum()) for x in counts]
        of_words = [np.append(x, n) for x, n in zip(counts, texts)] + [np.append(x * last, 0) for x in counts]
        of_words = [np.add.reduceat(x[self.word_order], self.word_at) for x in of_words]
        of_pairs = [np.add.reduceat(x[self.pair_order], self.pair_at) if len(self.pairs) else x for x in counts]
        w, p = (np.searchsorted(_bucket(x, buckets), np.arange(buckets + 1)) for x in (self.words, self.pairs))
        for b in np.flatnonzero((w[1:] > w[:-1]) | (p[1:] > p[:-1])):
            ws, ps = slice(w[b], w[b + 1]), slice(p[b], p[b + 1])
            parts = [np.array([w[b + 1] - w[b], p[b + 1] - p[b]], "<u4").tobytes(), _packed_keys(self.words[ws]), *[_small(x[ws]) for x in of_words], _packed_keys(self.pairs[ps]), *[_small(x[ps]) for x in of_pairs]]
            yield int(b), b"".join(parts)

    def scored(self, answers: list[tuple[int, bytes]], model: dict) -> pa.RecordBatch:
        """Losses of the wanted documents."""
        parts: list[list[np.ndarray]] = [[], []]
        for _, body in sorted(answers):
            read = _Reader(body)
            sizes = read.take("<u4", 2)
            for k, columns in enumerate((4, 2)):
                parts[k].append(np.stack([read.small(int(sizes[k])) for _ in range(columns)]))
        of_words, of_pairs = (np.concatenate([np.zeros((columns, 0), np.int64), *x], axis=1) for x, columns in zip(parts, (4, 2)))
        if of_words.shape[1] != len(self.words) or of_pairs.shape[1] != len(self.pairs):
            raise RuntimeError("a run did not get an answer for each of its words and pairs")
        n = np.bincount(self.owner, minlength=len(self.ids))
        at = self.pair_order[self.pair_at] if len(self.pairs) else np.zeros(0, np.int64)
        word, before, kept = self.word_of[at], self.before_of(at), of_pairs[0] > 0
        pair_of = np.empty(len(self.owner), np.int64)
        pair_of[self.pair_order] = np.repeat(np.arange(len(self.pairs)), np.diff(self.pair_at, append=len(self.owner)))
        sums = []
        for k in (0 if not model["targets"] else 1, 0):
            low = np.where(of_words[0] > 0, (1 - BIGRAM) * (of_words[k] + ADDED), (1 - BIGRAM) * (model["rare"][k] + ADDED)) / (model["total"][k] + ADDED * model["size"])
            heads = np.maximum(of_words[k] - of_words[2 + k], 1)
            loss = -np.log2(low[word] + np.where(kept, BIGRAM * of_pairs[k] / heads[before], 0.0))
            sums.append(np.bincount(self.owner, loss[pair_of], len(self.ids)))
        wanted = self.said & WANTED > 0
        some, ids = n[wanted] > 0, pa.array(self.ids[wanted], mask=self.said[wanted] & NO_ID > 0)
        target, background = (x[wanted] / np.maximum(n[wanted], 1) for x in sums)
        return pa.RecordBatch.from_arrays([ids, pa.array(n[wanted]), *[pa.array(x, mask=~some) for x in (target, background, target - background)]], OUT)


OUT = ["doc_id", "n_words", "loss_target", "loss_background", "score"]
ANSWER = "run long, bucket int, body binary, known long, known_n long, known_target long, rare_n long, rare_target long"


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys, where each distinct one begins in it, and the distinct ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    return order, at, ordered[at]


def _asking(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                bucket, body = zip(*_Run(row).asked(buckets))
                # Handed on some megabytes at a time.
                each = max(1, 4_000_000 * len(body) // (sum(map(len, body)) + 1))
                for a in range(0, len(body), each):
                    some = body[a : a + each]
                    yield pa.RecordBatch.from_arrays([pa.array([row["run"]] * len(some), pa.int64()), pa.array(bucket[a : a + each], pa.int32()), pa.array(some, pa.binary())], ["run", "bucket", "body"])

    return run


def _by(column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows that follow each other with one value of the column, together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[column] != held[0][column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _counted(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of what is asked of a bucket the numbers of words and pairs of each row, all keys and all counts, words first."""
    sizes, keys, counts = [], ([], []), ([], [])
    for row in rows:
        read = _Reader(row["body"])
        sizes.append(read.take("<u4", 2).astype(np.int64))
        for k, columns in enumerate((4, 2)):
            m = int(sizes[-1][k])
            keys[k].append(read.keys(m))
            counts[k].append(np.stack([read.small(m) for _ in range(columns)]))
    return np.array(sizes), [np.concatenate(x) for x in keys], [np.concatenate(x, axis=1) for x in counts]


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_distinct`` of the keys, and what each distinct one's counts add up to."""
    order, at, distinct = _distinct(keys)
    return order, at, distinct, np.add.reduceat(counts[:, order], at, axis=1) if len(order) else counts


def _answers(sizes: np.ndarray, told: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[bytes]:
    """What each row is answered: the totals (order, at, total) of its own keys, in their order."""
    parts = []
    for k, (order, at, total) in enumerate(told):
        whole = np.empty((len(total), len(order)), np.int64)
        whole[:, order] = np.repeat(total, np.diff(at, append=len(order)), axis=1)
        parts.append(np.split(whole, np.cumsum(sizes[:, k])[:-1], axis=1))
    return [b"".join([s.astype("<u4").tobytes(), *[_small(x) for x in w], *[_small(x) for x in p]]) for s, w, p in zip(sizes, *parts)]


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the counts of a bucket and answer each run; one more row, without a run, says what all words come to."""
    for rows in _by("bucket", batches):
        sizes, keys, counts = _counted(rows)
        told, sums = [], []
        for k in (0, 1):
            order, at, distinct, total = _added(keys[k], counts[k])
            known = total[0] >= LEAST
            if k == 0:
                real = distinct != START
                sums = [int((real & known).sum()), *[int(total[c][real & who].sum()) for who in (known, ~known) for c in (0, 1)]]
                known |= ~real
            told.append((order, at, np.where(known, total, 0)))
        arrays = [pa.array([r["run"] for r in rows] + [None], pa.int64()), pa.array([r["bucket"] for r in rows] + [None], pa.int32()), pa.array([*_answers(sizes, told), None], pa.binary())]
        arrays += [pa.array([None] * len(rows) + [x], pa.int64()) for x in sums]
        yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in ANSWER.split(", ")])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part of a bucket to one that asks for all of their keys, with what all of them add."""
    for rows in _by("key", batches):
        sizes, keys, counts = _counted(rows)
        (_, _, words, of_words), (_, _, pairs, of_pairs) = (_added(k, c) for k, c in zip(keys, counts))
        body = [np.array([len(words), len(pairs)], "<u4").tobytes(), _packed_keys(words), *[_small(x) for x in of_words], _packed_keys(pairs), *[_small(x) for x in of_pairs]]
        yield pa.RecordBatch.from_arrays([pa.array([rows[0]["key"]["part"]], pa.int64()), pa.array([rows[0]["key"]["bucket"]], pa.int32()), pa.array([b"".join(body)], pa.binary())], ["run", "bucket", "body"])


def _handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answer to a part of a bucket, which comes first, handed to each of its rows."""
    for first, *rows in _by("key", batches):
        if first["run"] is not None or not rows:
            raise RuntimeError("a part of a bucket did not get one answer")
        sizes, keys, _ = _counted(rows)
        read, told = _Reader(first["body"]), []
        given = read.take("<u4", 2)
        for k, columns in enumerate((4, 2)):
            order, at, distinct = _distinct(keys[k])
            if len(distinct) != given[k]:
                raise RuntimeError("an answer is for other keys")
            told.append((order, at, np.stack([read.small(len(distinct)) for _ in range(columns)])))
        arrays = [pa.array([r["run"] for r in rows], pa.int64()), pa.array([first["key"]["bucket"]] * len(rows), pa.int32()), pa.array(_answers(sizes, told), pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["run", "bucket", "body"])


def _ask(asked: DataFrame, rows: int, parts: int) -> DataFrame:
    """Answers to (run, bucket, body), and the sums, from the shared folder. A bucket has at most ``rows`` rows.

    Where that is over GROUPED, runs are dealt to parts of about so many, which ask as one, in the same way, and hand on what they are told: a word that stands
    in every run meets GROUPED rows in a task, however many runs there are.
    """
    spark = asked.sparkSession

    def stored(found: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        found.write.option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)

    if rows <= GROUPED:
        return stored(asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_answered, ANSWER), "answers")
    groups = -(-rows // GROUPED)
    key = F.struct("bucket", "part").alias("key")
    held = stored(asked, "asked").withColumn("part", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("long"))
    sums = held.repartition(parts, "bucket", "part").sortWithinPartitions("bucket", "part").select(key, "body").mapInArrow(_summed, "run long, bucket int, body binary")
    above = _ask(sums, groups, parts)
    both = held.select("bucket", "part", "run", "body").union(above.where("run is not null").select("bucket", "run", F.lit(None).cast("long"), "body"))
    told = both.repartition(parts, "bucket", "part").sortWithinPartitions("bucket", "part", F.col("run").asc_nulls_first()).select(key, "run", "body").mapInArrow(_handed, "run long, bucket int, body binary")
    return stored(told.unionByName(above.where("run is null"), allowMissingColumns=True), "answers")


def _scoring(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by("run", batches):
            texts = [r for r in rows if r["texts"] is not None]
            if len(texts) != 1:
                raise RuntimeError("answers without their run")
            yield _Run(texts[0]).scored([(r["bucket"], r["body"]) for r in rows if r["texts"] is None], model)

    return run


def _marked(docs: DataFrame, good: DataFrame | None, say: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if good is None or not say & COUNTED:
        return rows.withColumn("say", F.lit(say))
    told = good.withColumn("good", F.lit(TARGET)).hint("shuffle_hash")
    return rows.join(told, rows["doc_id"] == F.col("id"), "left").select("doc_id", "text", (F.lit(say) + F.coalesce("good", F.lit(0))).alias("say"))


def score(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background (bits a word) and score, their difference, of every row of ``docs``.

    The models are counted on ``corpus``, with its targets by ``labels``; by default that is ``docs``.
    """
    spark = docs.sparkSession
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good")).where("good").select("id")
    targets = None
    if good.count() <= BROADCAST:
        targets, good = spark.sparkContext.broadcast(np.sort(good.toPandas()["id"].to_numpy(np.int64))), None
    if corpus is None:
        rows = _marked(docs, good, COUNTED | WANTED)
    else:
        rows = _marked(docs, good, WANTED).union(_marked(corpus, good, COUNTED))
    path = scratch(spark, "runs")
    rows.mapInArrow(_packing(targets), "run long, size long, texts binary, ends binary, ids binary, said binary").write.option("compression", "none").parquet(path)
    runs = spark.read.parquet(path)
    size = runs.agg(F.sum("size")).first()[0] or 0
    buckets = -(-size // BUCKET) or 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    answers = _ask(runs.mapInArrow(_asking(buckets), "run long, bucket int, body binary"), runs.count(), parts)
    sums = answers.where("run is null").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("known", "known_n", "known_target", "rare_n", "rare_target")]).first()
    model = {"size": sums["known"] + 2, "rare": (sums["rare_n"], sums["rare_target"]), "total": (sums["known_n"] + sums["rare_n"], sums["known_target"] + sums["rare_target"])}
    model["targets"] = model["total"][1] > 0
    both = runs.unionByName(answers.where("run is not null").select("run", "bucket", "body"), allowMissingColumns=True)
    return both.repartition(parts, "run").sortWithinPartitions("run").mapInArrow(_scoring(model), "doc_id long, n_words long, loss_target double, loss_background double, score double")
