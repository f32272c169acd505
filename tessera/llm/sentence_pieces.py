"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece holds a marker of white space after another character, no merge crosses from a word to the marker
after it, and where no longer piece holds a line break, none crosses that. A text is therefore cut before each run of
markers and around line breaks; each distinct chunk of a slice of texts goes through the library once, is remembered
for the slices after it, and the ids are put in place by the chunks' numbers. The model is checked for both conditions,
and for plain normalisation (a marker before the text, a marker for each space, nothing else); others raise an error.

The library itself decodes, many rows at a time.

Defined results: a null or empty text has no ids and decodes to the empty text; rows are taken one by one, so repeated
rows and null ids come back as they are; an empty table gives no rows; no other column is read. A marker that stands in
the text itself is encoded, and so decoded, as a space, as the library does.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._common import give_back
from tessera.llm._words import slices

MARK = "▁"
#: Chunks that a worker remembers at a time, of up to so many bytes.
REMEMBERED, CHUNK = 400_000, 64
#: Code points encoded at a time; ids decoded at a time.
SLICE, IDS = 4_000_000, 1 << 20


class Chunks:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.model, self.remembered, self.known = SentencePieceProcessor(model_file=path), remembered, {}
        told = ModelProto.FromString(self.model.serialized_model_proto())
        pieces, plain = [p.piece for p in told.pieces], told.normalizer_spec
        if plain.precompiled_charsmap or not plain.add_dummy_prefix or plain.remove_extra_whitespaces or not plain.escape_whitespaces or told.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model's normalisation changes texts: they cannot be cut")
        if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in pieces) or any(p.type == p.USER_DEFINED for p in told.pieces):
            raise ValueError("pieces of the model cross markers or line breaks: texts cannot be cut")
        self.lead = len(self.model.encode("\n"))

    def _table(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks; a line break goes before each, so that the library's own marker does not touch it."""
        found = list(map(self.known.get, chunks))
        new = [i for i, ids in enumerate(found) if ids is None]
        if len(self.known) + len(new) > self.remembered:
            self.known.clear()
        for at in range(0, len(new), 8192):
            some = new[at : at + 8192]
            for i, ids in zip(some, self.model.encode([b"\n" + chunks[i] for i in some], num_threads=1)):
                found[i] = np.array(ids[self.lead :], np.int32).tobytes()
                if len(chunks[i]) <= CHUNK:
                    self.known[chunks[i]] = found[i]
        return found

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text begins and the last ends."""
        parts = [(" " + t.replace(MARK, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        raw, first = b"".join(parts), np.cumsum(sizes) - sizes
        del parts
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        b = np.frombuffer(raw, np.uint8)
        space, line = b == 32, b == 10
        cut = space | line
        cut[1:] &= ~(space[1:] & space[:-1])
        cut[1:] |= line[:-1]
        cut[first[sizes > 0]] = True
        at = np.flatnonzero(cut)
        ends = pa.py_buffer(np.append(at, len(raw)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, ends, pa.py_buffer(raw)]).dictionary_encode()
        table = pa.array(self._table(coded.dictionary.to_pylist()), pa.large_binary())
        placed = table.take(coded.indices)
        flat = np.frombuffer(placed.buffers()[2], np.int32) if placed.buffers()[2] else np.zeros(0, np.int32)
        offsets = np.frombuffer(placed.buffers()[1], np.int64)[: len(at) + 1] // 4
        return flat[: offsets[-1]], offsets[np.append(np.searchsorted(at, first), len(at))]


def _worker(path: str, remembered: int) -> Chunks:
    """The worker's own table, which the process keeps from task to task."""
    kept = sys.modules.setdefault("tessera_worker_chunks", types.ModuleType("tessera_worker_chunks")).__dict__
    if (path, remembered) not in kept:
        kept[path, remembered] = Chunks(path, remembered)
    return kept[path, remembered]


def encode(docs: DataFrame, path: str, remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id`` and ``ids``, the ids of the whole text, without begin and end ids."""
    Chunks(path, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _worker(path, remembered)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices([len(t) for t in texts], SLICE):
                flat, ends = chunks.ids(texts[a:b])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), ids], names=["doc_id", "ids"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` and the ``text`` that the library decodes them to; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker(path, REMEMBERED).model
        for batch in batches:
            ids = batch.column("ids")
            sizes = ids.value_lengths().fill_null(0).to_pylist()
            for a, b in slices(sizes, IDS):
                some = [x or [] for x in ids.slice(a, b - a).to_pylist()]
                texts = pa.array(model.decode(some, num_threads=1), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), ids.slice(a, b - a), texts], names=["doc_id", "ids", "text"])
        give_back()

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
