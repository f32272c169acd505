"""Token ids in a compressed binary file: canonical, length-limited Huffman codes in independent blocks.

Writing: (1) one pass encodes the texts and deals the documents to ranges of ascending doc_id, (2) the ids
are counted over all documents and the code is laid out on the driver, whose only input is one count
for each id of the vocabulary, (3) each stored range is cut into blocks of whole documents, which are
coded apart. A block needs nothing but the code to be read; checkpoints hold the bit offset of every
``STRIDE``-th id, so its parts are decoded side by side by a table of all prefixes of ``LONGEST`` bits.

The file is a folder: ``code`` (one row: the code length of each id as bytes, the rest of a canonical code
follows) and ``blocks``, one row for each block: ``part``, ``first`` and ``crc`` for its place, ``nth`` (its number), ``doc_ids`` and
``sizes`` of its documents, ``offsets`` (bit offsets of the checkpoints) and ``bits``. Spark writes
and reads it, so it can be in any store, and the commit of a lost executor's task is repeated.

Defined results: a null text counts as empty and has the end id alone; null doc_ids come first; rows that
repeat a doc_id follow one another, in each part of the file ordered by their ids' checksum, and fill several parts if there are so many; an empty table makes a file without
blocks; other columns of the input are not read.
"""

from __future__ import annotations

import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import give_back, remove, scratch
from tessera.llm._words import slices

END = 1
#: Longest code in bits; raised where a vocabulary needs more.
LONGEST = 18
#: Ids between checkpoints; ids in a block, as far as whole documents allow.
STRIDE, BLOCK = 256, 1 << 17
#: Words whose ids a worker remembers at a time, of up to so many characters.
REMEMBERED, WORD = 500_000, 100
#: Stands for a null id where ranges are told.
LEAST_ID = -(1 << 63)
#: Bytes of input to a part of the file, whose ranges of ids are sorted in one task each.
PART = 128_000_000
#: Code points encoded at a time; words whose ids are put in place at a time; different punctuation that is remembered.
SLICE, GATHER, TAILS = 6_000_000, 1 << 20, 10_000
#: Latin-1 letters, then ASCII punctuation, but no apostrophe, which may begin a contraction.
PLAIN = "^(?P<stem>[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)(?P<tail>[!-&(-/:-@\\[-`{-~]*)$"


# --- text to ids


class Words:
    """Ids of texts by a tokenizer whose pre-tokenizer drops white space, so that words can be encoded apart and remembered.

    Texts are cut at ASCII white space by Arrow, which also numbers the distinct words of a slice, parts those that are
    Latin-1 letters with punctuation after them, as the pre-tokenizer does too, and numbers the distinct lower-case letters and the distinct
    punctuation; only these become Python objects. New letters go to the library's model, in the
    alphabet of bytes it knows, and punctuation is encoded once. Other new words go through the whole of the
    library, together, told apart by the offsets of their tokens.
    """

    def __init__(self, path: str, end: int, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.remembered = Tokenizer.from_file(path), {}, remembered
        self.model = self.tokenizer.model
        self.end = np.array([end], np.uint32).tobytes()
        self.tails = {"": b""}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {c: 256 + k for k, c in enumerate(c for c in range(256) if c not in shown)}

    def _learn(self, words: list[str]) -> None:
        known = self.known
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in some])
            where = np.searchsorted(np.array([a for a, _ in found.offsets], np.int64), starts)
            raw, where = np.array(found.ids, np.uint32).tobytes(), (where * 4).tolist()
            for w, a, b in zip(some, where, where[1:]):
                known[w] = raw[a:b]

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of lower-case letters."""
        known, tokenize, alphabet = self.known, self.model.tokenize, self.alphabet
        out = list(map(known.get, stems))
        for i, ids in enumerate(out):
            if ids is None:
                low = stems[i]
                told = low if low.isascii() else low.encode().decode("latin-1").translate(alphabet)
                out[i] = known[low] = array("I", [t.id for t in tokenize(told)]).tobytes()
        return out

    def _marks(self, tails: list[str]) -> list[bytes]:
        """Ids of punctuation."""
        out = []
        for marks in tails:
            found = self.tails.get(marks)
            if found is None:
                found = np.array(self.tokenizer.encode(marks, add_special_tokens=False).ids, np.uint32).tobytes()
                if len(self.tails) < TAILS:
                    self.tails[marks] = found
            out.append(found)
        return out

    def _rest(self, words: list[str]) -> list[bytes]:
        """Ids of other words; the empty word is the end of a text."""
        known = self.known
        self._learn([w for w in words if w and w not in known])
        return [known[w] if w else self.end for w in words]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of distinct words the ids, one after the other, and how many each has."""
        parts = pc.extract_regex(words, PLAIN)
        plain = np.flatnonzero(parts.is_valid().to_numpy(zero_copy_only=False))
        other = np.flatnonzero(parts.is_null().to_numpy(zero_copy_only=False))
        parts = parts.drop_null()
        stems, tails = pc.utf8_lower(parts.field("stem")).dictionary_encode(), parts.field("tail").dictionary_encode()
        pieces = []
        for found, codes, of in ((self._stems(stems.dictionary.to_pylist()), stems.indices, plain), (self._marks(tails.dictionary.to_pylist()), tails.indices, plain), (self._rest(words.take(pa.array(other)).to_pylist()), np.arange(len(other)), other)):
            count = np.fromiter(map(len, found), np.int64, len(found)) // 4
            pieces.append((np.frombuffer(b"".join(found), np.uint32), np.cumsum(count) - count, count, np.asarray(codes), of))
        sizes = np.zeros(len(words), np.int64)
        for _, _, count, codes, of in pieces:
            sizes[of] += count[codes]
        at, out = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), np.uint32)
        for flat, first, count, codes, of in pieces:
            each = count[codes]
            step = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            out[np.repeat(at[of], each) + step] = flat[np.repeat(first[codes], each) + step]
            at[of] += each
        for long in (stems.dictionary, words.take(pa.array(other))):
            for w in pc.filter(long, pc.greater(pc.utf8_length(long), WORD)).to_pylist():
                self.known.pop(w, None)
        return out, sizes

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and where each ends."""
        if len(self.known) > self.remembered:
            self.known.clear()
        # White space after a text leaves one empty word behind it, as a text without words does: its end.
        plain = [t.encode("utf-8", "replace").strip() for t in texts]
        split = pc.ascii_split_whitespace(pa.array([p + b" " if p else p for p in plain], pa.large_binary()).cast(pa.large_string()))
        last, coded = split.offsets.to_numpy()[1:] - 1, split.values.dictionary_encode()
        codes = coded.indices.to_numpy()
        flat, count = self._distinct(coded.dictionary)
        first = np.cumsum(count) - count
        upto = np.cumsum(count[codes])
        out = np.empty(int(upto[-1]) if len(upto) else 0, np.uint32)
        for at in range(0, len(codes), GATHER):
            some = codes[at : at + GATHER]
            each, begin = count[some], int(upto[at - 1]) if at else 0
            ends = upto[at : at + GATHER] - begin
            out[begin : begin + int(ends[-1])] = flat[np.arange(ends[-1]) - np.repeat(ends - each - first[some], each)]
        return out, upto[last]


def _remembered(path: str, end: int, remembered: int) -> Words:
    """The worker's own Words: the process keeps it from task to task, as a module of its own, since functions come anew with each task."""
    kept = sys.modules.setdefault("tessera_worker_words", types.ModuleType("tessera_worker_words")).__dict__
    if (path, end, remembered) not in kept:
        kept[path, end, remembered] = Words(path, end, remembered)
    return kept[path, end, remembered]


def _places(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a number that Spark's hash sends there, so that parts meet in no task by chance."""
    told = spark.range(64 * n).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k"))
    found = {r["p"]: r["k"] for r in told.collect()}
    return [found.get(p, p) for p in range(n)]


def _parts(docs: DataFrame) -> int:
    """Shuffle partitions as set, or more if Spark expects so many bytes."""
    size = float(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size / PART) if size < 1e17 else 0)


def _encode(path: str, bounds: list[int], places: list[int], end: int, remembered: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, nth = _remembered(path, end, remembered), 0
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in slices([len(t) for t in texts], SLICE):
                x = batch["doc_id"].iloc[a:b]
                flat, ends = words.ids(texts[a:b])
                cuts = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
                raw = memoryview(flat).cast("B")
                ids = x.where(x.notna(), LEAST_ID).astype("int64")
                low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
                # An id that fills several parts is dealt to them in turn.
                part = np.where(high - low > 1, low + 1 + (nth + np.arange(len(ids))) % np.maximum(high - low, 1), high)
                nth += len(ids)
                yield pd.DataFrame({"doc_id": x.astype("Int64"), "part": part, "place": np.array(places)[part], "crc": [zlib.crc32(raw[4 * i : 4 * j]) for i, j in cuts], "ids": [_narrow(flat[i:j]) for i, j in cuts]})
        give_back()

    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes for each id where that holds them, told by a leading 2."""
    return b"\2" + ids.astype(np.uint16).tobytes() if ids.max() < 65536 else b"\4" + ids.tobytes()


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.uint16 if ids[0] == 2 else np.uint32, offset=1).astype(np.uint32) if ids[0] == 2 else np.frombuffer(ids[1:], np.uint32)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(1, np.int64)
    for x in batches:
        for a, b in slices([len(ids) for ids in x["ids"]], 4 * GATHER):
            some = np.bincount(np.concatenate([_wide(ids) for ids in x["ids"].iloc[a:b]]))
            if len(some) > len(total):
                total = np.concatenate([total, np.zeros(len(some) - len(total), np.int64)])
            total[: len(some)] += some
    at = np.flatnonzero(total)
    yield pd.DataFrame({"id": at.astype(np.int64), "n": total[at]})


# --- the code


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``longest`` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids do not fit in {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    coins = counts[order].astype(np.float64)
    # A package is known by its weight; how many leaves the first m items of each level hold tells the lengths.
    leaves, weights = [], coins
    for _ in range(longest):
        if len(leaves):
            packed = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([coins, packed])
        else:
            both = coins
        at = np.argsort(both, kind="stable")
        leaves.append(at < len(coins))
        weights = both[at]
    take = 2 * (len(coins) - 1)
    for leaf in reversed(leaves):
        n = int(leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes: by length, then id, each the one before plus one."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    of = lengths[order].astype(np.int64)
    if len(of):
        top = int(of.max())
        steps = np.concatenate([[0], np.cumsum(1 << (top - of))[:-1]])
        codes[order] = (steps >> (top - of)).astype(np.uint64)
    return codes


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical(lengths)
        self.bits = int(self.lengths.max(initial=1))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For every prefix of ``bits`` bits, the id it starts with and the length of its code."""
        order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        times = 1 << (self.bits - self.lengths[order])
        ids, sizes = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.uint8)
        ids[: times.sum()], sizes[: times.sum()] = np.repeat(order, times), np.repeat(self.lengths[order], times)
        return ids, sizes

    def write(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the offset of every STRIDE-th id."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        words = np.zeros((int(ends[-1]) >> 5) + 2, np.uint64)
        at, shift = starts >> 5, (64 - (starts & 31) - sizes).astype(np.uint64)
        value = self.codes[ids] << shift
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        high, low = np.bitwise_or.reduceat(value >> np.uint64(32), first), np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)
        words[at[first]] |= high
        words[at[first] + 1] |= low
        return words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::STRIDE]


def read(tables: tuple[np.ndarray, np.ndarray], bits: int, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
    """The ids of blocks of (bits, offsets, number of ids): all parts between checkpoints advance together."""
    ids, sizes = tables
    data, lanes, left, at = [], [], [], 0
    for raw, offsets, n in blocks:
        data.append(raw + b"\0" * 8)
        lanes.append(offsets + 8 * at)
        left.append(np.minimum(STRIDE, n - STRIDE * np.arange(len(offsets))))
        at += len(raw) + 8
    raw = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    # Four bytes from every byte on: any code with the bits before it in its first byte fits.
    window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    at, left = np.concatenate(lanes), np.concatenate(left)
    order = np.argsort(-left, kind="stable")
    at, out = at[order], np.zeros((STRIDE, len(order)), np.uint32)
    live = np.searchsorted(-left[order], -np.arange(STRIDE), side="left")
    for step in range(STRIDE):
        n = live[step]
        if not n:
            break
        here = at[:n]
        code = (window[here >> 3] >> (32 - bits - (here & 7)).astype(np.uint32)) & np.uint32((1 << bits) - 1)
        out[step, :n] = ids[code]
        at[:n] = here + sizes[code]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    flat, whole, found = out.T[back], 0, []
    for _, offsets, n in blocks:
        found.append(flat[whole : whole + len(offsets)].reshape(-1)[:n])
        whole += len(offsets)
    return found


# --- the file


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, longest: int = LONGEST, remembered: int = REMEMBERED) -> None:
    """Write the ids of all ``docs`` to ``path``; a worker remembers about ``remembered`` words, which changes its speed and memory alone."""
    spark = docs.sparkSession
    shared = scratch(spark, "ids")
    n = _parts(docs)
    cuts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("d")).agg(F.percentile_approx("d", [i / n for i in range(1, n)] or [0.5], 10_000).alias("q")).first()["q"] or []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.mapInPandas(_encode(tokenizer, sorted(cuts), _places(spark, n), end, remembered), "doc_id long, part int, place int, crc long, ids binary")
    rows.repartition(n, "place").drop("place").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "crc").write.option("compression", "zstd").parquet(shared)
    stored = spark.read.parquet(shared)
    found = stored.select("ids").mapInPandas(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"]] = found["n"]
    used = int((counts > 0).sum())
    code = code_lengths(counts, max(longest, (used - 1).bit_length() + 1 if used > 1 << longest else longest))
    if code.max(initial=0) > 24:
        raise ValueError("codes of over 24 bits do not fit the decoder's window")
    spark.createDataFrame([(bytearray(code.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    schema = "part int, first long, crc long, doc_ids array<long>, sizes array<long>, offsets array<long>, bits binary"
    # The number of a block is written with it, so that blocks of equal documents are told apart when read.
    stored.mapInPandas(_pack(code.tobytes()), schema).withColumn("nth", F.monotonically_increasing_id()).write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, shared)


def _pack(lengths: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, held, size = Code(np.frombuffer(lengths, np.uint8)), [], 0

        def block() -> pd.DataFrame:
            ids = np.concatenate([x[3] for x in held])
            bits, offsets = code.write(ids)
            first = held[0]
            docs = [None if pd.isna(x[0]) else int(x[0]) for x in held]
            return pd.DataFrame({"part": [first[1]], "first": pd.array([docs[0]], "Int64"), "crc": [first[2]], "doc_ids": [docs], "sizes": [[len(x[3]) for x in held]], "offsets": [offsets], "bits": [bits]})

        for batch in batches:
            for doc, part, crc, ids in zip(batch["doc_id"].astype("Int64"), batch["part"], batch["crc"], batch["ids"]):
                if held and (size >= BLOCK or held[0][1] != part):
                    yield block()
                    held, size = [], 0
                ids = _wide(ids)
                held.append((doc, part, crc, ids))
                size += len(ids)
        if held:
            yield block()

    return run


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Read a file back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Sums by part go to the driver, as many as the file has parts; within a part a window adds up blocks.
    """
    lengths = bytes(spark.read.parquet(f"{path}/code").first()["lengths"])
    blocks = spark.read.schema("part int, first long, crc long, doc_ids array<long>, sizes array<long>, offsets array<long>, bits binary, nth long").parquet(f"{path}/blocks")
    slim = blocks.select("part", "nth", "first", "crc", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"), F.element_at("doc_ids", -1).alias("last"))
    sums, before = {}, 0
    for row in slim.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        sums[row["part"]], before = before, before + row["n"]
    parts = spark.createDataFrame(list(sums.items()), "part int, base long")
    order = Window.partitionBy("part").orderBy(F.asc_nulls_first("first"), F.asc_nulls_first("last"), "crc", "nth").rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.join(F.broadcast(parts), "part").select("nth", (F.col("base") + F.coalesce(F.sum("n").over(order), F.lit(0))).alias("start"))
    rows = blocks.mapInPandas(_unpack(lengths), "nth long, doc_id long, n_tokens long, ids_crc32 long, before long")
    return rows.join(starts, "nth").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _unpack(lengths: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Code(np.frombuffer(lengths, np.uint8))
        tables = code.table()
        for batch in batches:
            for at in range(0, len(batch), 16):
                some = batch.iloc[at : at + 16]
                sizes = [np.asarray(x, np.int64) for x in some["sizes"]]
                found = read(tables, code.bits, [(b, np.asarray(o, np.int64), int(n.sum())) for b, o, n in zip(some["bits"], some["offsets"], sizes)])
                for ids, n, docs, nth in zip(found, sizes, some["doc_ids"], some["nth"]):
                    ends = np.cumsum(n)
                    raw = memoryview(np.ascontiguousarray(ids, np.uint32)).cast("B")
                    sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
                    yield pd.DataFrame({"nth": nth, "doc_id": pd.array(list(docs), "Int64"), "n_tokens": n, "ids_crc32": sums, "before": ends - n})

    return run


def ids_of(spark: SparkSession, path: str) -> DataFrame:
    """Read a file back whole: doc_id and ``ids``, an array of ids."""
    lengths = bytes(spark.read.parquet(f"{path}/code").first()["lengths"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Code(np.frombuffer(lengths, np.uint8))
        tables = code.table()
        for batch in batches:
            for _, x in batch.iterrows():
                n = np.asarray(x["sizes"], np.int64)
                ids = read(tables, code.bits, [(x["bits"], np.asarray(x["offsets"], np.int64), int(n.sum()))])[0]
                yield pd.DataFrame({"doc_id": pd.array(list(x["doc_ids"]), "Int64"), "ids": np.split(ids.astype(np.int64), np.cumsum(n)[:-1])})

    return spark.read.parquet(f"{path}/blocks").mapInPandas(run, "doc_id long, ids array<long>")
