"""What the operators share: the shared folder, durable cuts of the lineage, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import durable, scratch, shared_dir

__all__ = ["components", "durable", "give_back", "held", "remove", "row_key", "scratch", "shared_dir", "size_of", "small_batches", "unpacked"]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python no more than ``rows`` rows at a time from here on in this session.

    A batch of whole texts is held off the heap and again by the worker; jobs of several stages need it small.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, rows)


def held(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole rows as one column ``__row``, beside it only the columns named, so that no other can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *columns)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that ``held`` packed."""
    return rows.select(*[F.col("__row").getField(c).alias(c) for c in columns])


def row_key(columns: list[Column]) -> list[Column]:
    """Two hashes that tell rows apart by these columns; where nulls stand counts, which a hash alone leaves out."""
    nulls = [c.isNull() for c in columns]
    return [F.xxhash64(F.lit(k), *columns, *nulls) for k in range(2)]


def give_back() -> None:
    """Hand memory that a worker has freed back to the system, so that it does not stay with a process that is kept for other stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def size_of(df: DataFrame) -> tuple:
    """Count and an order-free digest of the rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star and small-star.

    ``edges`` has long columns ``a`` and ``b``; the result has ``node`` and ``root``, the smallest
    node reachable, for every node with an edge to another node. Every round is two partial
    aggregates and two equi-joins, all of them splittable by skew handling; no neighbour list is
    ever gathered in one place, and each round is checkpointed. Self loops and repeated edges do
    not matter; null ends are ignored; no edges give no rows.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = size_of(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        before, seen = seen, size_of(now)
        if before == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
