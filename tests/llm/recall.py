"""Recall of the search against brute force, by blocks: python tests/llm/recall.py FOLDER [STEP].

Queries are the rows of ``embeddings`` whose id is divisible by STEP (20, as in the registered query). Not a test: it is run by hand on larger tables.
"""

import os
import sys

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tessera.llm import ann  # noqa: E402


def main(folder: str, step: int = 20) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    found: dict[int, set[int]] = {}
    for r in ann.search(vectors, vectors.where(f"vec_id % {step} = 0")).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = ann.usable(vectors).toPandas().drop_duplicates("vec_id").sort_values("vec_id")
    ids, every = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(np.float64)
    asked, hits, total = np.flatnonzero(ids % step == 0), 0, 0
    for at in range(0, len(asked), 256):
        some = asked[at : at + 256]
        scores = every[some] @ every.T
        scores[np.arange(len(some)), some] = -np.inf
        for i, best in zip(some, np.argsort(-scores, axis=1, kind="stable")[:, : ann.K]):
            hits, total = hits + len(found.get(int(ids[i]), set()) & set(ids[best].tolist())), total + len(best)
    print(f"{len(ids)} vectors, {len(asked)} queries, recall {hits / max(1, total):.4f}")


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:]))
