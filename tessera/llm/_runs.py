"""Prefix sums and dense ranks over a sorted table, however its groups lie across partitions.

Rows are dealt to ranges of group and order and sorted, and that is kept. One pass tells of each partition its
first and last group, how often the group changes and what its last group sums up to; the driver, which gets a
row a partition, adds these up, and a second pass over the same partitions begins where the ones before end.
No group has to fit in a task, and none is moved for its size.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import durable


def _codes(column) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


class _Scan:
    """Goes over the batches of a partition: where groups begin, and running sums and exclusive ors within them."""

    def __init__(self, group: list[str], sums: list[str], xors: list[str]):
        self.group, self.sums, self.xors = group, sums, xors
        self.first = self.last = None
        self.changes, self.tail = 0, [0] * len([*sums, *xors])

    def step(self, batch) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of each row how many groups began after the partition's first one, and its running values."""
        n = batch.num_rows
        new = np.zeros(n, bool)
        for c in self.group:
            codes = _codes(batch.column(c))
            new[1:] |= codes[1:] != codes[:-1]
        head = tuple(batch.column(c)[0].as_py() for c in self.group)
        if self.first is None:
            self.first = self.last = head
        new[0] = head != self.last
        self.last = tuple(batch.column(c)[n - 1].as_py() for c in self.group)
        nth = self.changes + np.cumsum(new)
        self.changes = int(nth[-1])
        begun = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        inside, out = begun >= 0, []
        for k, c in enumerate([*self.sums, *self.xors]):
            v = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(v) if k < len(self.sums) else np.bitwise_xor.accumulate(v)
            carry = np.int64(self.tail[k])
            if k < len(self.sums):
                run = np.where(inside, upto - (upto - v)[begun], upto + carry)
            else:
                run = np.where(inside, upto ^ (upto ^ v)[begun], upto ^ carry)
            self.tail[k] = int(run[-1])
            out.append(run)
        return nth, out


def _told(key: tuple) -> bytes:
    return hashlib.sha256(pickle.dumps(key, 4)).digest()


def running(rows: DataFrame, group: list[str], order: list[str], sums: list[str] = (), xors: list[str] = ()) -> DataFrame:
    """The rows sorted by group and order, nulls first, with ``__nth``, the number of groups before, and ``run_<c>``, what ``c`` comes to from the group's first row up to here.

    ``sums`` and ``xors`` are long columns without nulls. The rows come back partition by partition in that order.
    Rows that agree in group and order stay in one task, so the order should tell rows apart.
    """
    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    kept = durable(rows.repartitionByRange(*by).sortWithinPartitions(*by))
    return marked(kept, list(group), list(sums), list(xors))


def marked(kept: DataFrame, group: list[str], sums: list[str], xors: list[str]) -> DataFrame:
    """``running`` over sorted partitions that are stored."""
    width = len([*sums, *xors])

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scan = _Scan(group, sums, xors)
        for batch in batches:
            if batch.num_rows:
                scan.step(batch)
        if scan.first is not None:
            row = {"part": TaskContext.get().partitionId(), "first": _told(scan.first), "last": _told(scan.last), "changes": scan.changes, "tail": scan.tail}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("changes", pa.int64()), ("tail", pa.list_(pa.int64()))]))

    parts = kept.mapInArrow(summary, "part int, first binary, last binary, changes long, tail array<long>").collect()
    begin, nth, key, tail = {}, -1, None, np.zeros(width, np.int64)
    for p in sorted(parts, key=lambda r: r["part"]):
        same = key == bytes(p["first"])
        nth, carry = nth if same else nth + 1, tail if same else np.zeros(width, np.int64)
        begin[p["part"]] = nth, carry.tolist()
        tail, nth, key = np.array(p["tail"], np.int64), nth + p["changes"], bytes(p["last"])
        if not p["changes"]:
            tail = np.concatenate([tail[: len(sums)] + carry[: len(sums)], tail[len(sums) :] ^ carry[len(sums) :]])
    starts = kept.sparkSession.sparkContext.broadcast(begin)
    names = [f"run_{c}" for c in [*sums, *xors]]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scan = _Scan(group, sums, xors)
        nth, carry = starts.value.get(TaskContext.get().partitionId(), (0, [0] * width))
        scan.tail = list(carry)
        for batch in batches:
            if batch.num_rows:
                at, runs = scan.step(batch)
                columns = [*batch.columns, pa.array(nth + at), *map(pa.array, runs)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__nth", *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "__nth long", *(f"{c} long" for c in names)])
    return kept.mapInArrow(mark, schema)
