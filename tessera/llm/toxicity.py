"""Toxicity by a classifier chain over hashed words.

The categories are predicted in order; each linear model sees the words of the text and the probabilities of
the categories before it. It is trained on probabilities that were predicted out of fold: for
each category, FOLDS models, each trained without one fold, give what the later models learn from, and
a model trained on all gives what they see when they predict.

The categories are conditions on the table of labels, by default those it holds: documents of low quality, then
toxic ones. Each is learned from the documents that have a label for it.

Features of a text are its distinct words, and the first four and five bytes of longer ones, hashed.
The fit is on a bounded sample of labelled documents (SAMPLE, those of smallest hash); the prediction
reads every text whole, and its model, of fixed size, is broadcast.

Defined results: null and empty texts have no words and get the chain's bias alone; a category without labels of both
kinds has probability 0 everywhere; labels without a document are not used; several labels of a document count
as the category if one does; of several documents with one id the smallest text is learned from; repeated rows each get their row; an empty table gives an empty result; other
columns of the inputs are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._words import hashed, slices

#: Labelled documents that are learned from at most.
SAMPLE = 6_000
SIZE = 1 << 18
PREFIXES = (4, 5)
FOLDS, STEPS, RATE, DECAY = 3, 50, 0.1, 1e-3
#: Code points taken at a time.
SLICE = 4_000_000
#: Features in fewer sample documents are left out.
SEEN = 6
#: Categories in the order of the chain, each with its condition on a row of labels.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts, and the number of the text of each: three for each distinct word, SIZE where a word has no such prefix."""
    words, owner, *prefixes = hashed(texts, PREFIXES)
    # Distinct words of a text: sorted by text, then hash.
    order = np.lexsort((words, owner))
    words, owner = words[order], owner[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    at = order[new]
    columns = [words[new] % np.uint64(SIZE)] + [np.where(p[at] > 0, p[at] % np.uint64(SIZE), np.uint64(SIZE)) for p in prefixes]
    return np.column_stack(columns).astype(np.int64), owner[new]


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        texts = list(x["text"])
        for a, b in slices([len(t or "") for t in texts], SLICE):
            found, owner = features(texts[a:b])
            ends = np.searchsorted(owner, np.arange(1, b - a))
            yield x.iloc[a:b].drop(columns="text").assign(features=[v[v < SIZE].astype(np.int32) for v in np.split(found, ends)])


class _Rows:
    """Sparse rows of ones, repeated where a feature repeats."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self.n, self.size = len(rows), size
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32)
        self.owner = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.at], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, r[self.owner], self.size)


def _train(rows: _Rows, more: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression with decay, by Adam over whole batches; the weights, and those of bias and earlier categories."""
    w, v = np.zeros(rows.size), np.zeros(more.shape[1] + 1)
    dense = np.column_stack([np.ones(rows.n), more])
    both = [[w, np.zeros_like(w), np.zeros_like(w)], [v, np.zeros_like(v), np.zeros_like(v)]]
    n = max(1, int(on.sum()))
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(rows.times(w) + dense @ v, -30, 30)))
        r = np.where(on, p - y, 0.0) / n
        for (x, m, s), g in zip(both, (rows.back(r) + DECAY * w, dense.T @ r)):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return w, v


def _odds(rows: _Rows, more: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.clip(rows.times(w) + v[0] + more @ v[1:], -8, 8)


def _p(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


def chain(rows: list[np.ndarray], labels: dict[str, np.ndarray], folds: np.ndarray) -> dict:
    """The models of all categories in order, and the threshold of each that is best out of fold; labels may be nan. None for a category without both kinds."""
    seen = np.bincount(np.concatenate([np.unique(r) for r in rows] or [np.zeros(0, int)]), minlength=SIZE)
    rows = _Rows([r[seen[r] >= SEEN] for r in rows], SIZE)
    model, before = {"weights": [], "dense": [], "thresholds": []}, np.zeros((rows.n, 0))
    for y in labels.values():
        told, held = ~np.isnan(y), np.full(rows.n, -np.inf)
        y = np.where(told, y, 0.0)
        if len(np.unique(y[told])) < 2:
            model["weights"].append(np.zeros(SIZE))
            model["dense"].append(None)
            model["thresholds"].append(1.0)
        else:
            for k in range(FOLDS):
                w, v = _train(rows, before, y, told & (folds != k))
                held[folds == k] = _odds(rows, before, w, v)[folds == k]
            w, v = _train(rows, before, y, told)
            model["weights"].append(w)
            model["dense"].append(v)
            model["thresholds"].append(_threshold(held[told], y[told]))
        before = np.column_stack([before, _p(held)])
    return model


def _threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on calling out is best by F1, halfway to the next lower one."""
    order = np.argsort(-odds)
    hits = np.cumsum(y[order])
    if not len(y) or not hits[-1]:
        return 0.5
    best = int(np.argmax(2 * hits / (np.arange(1, len(y) + 1) + hits[-1])))
    odd = odds[order][best] if best + 1 >= len(y) else (odds[order][best] + odds[order][best + 1]) / 2
    # Models trained on all are surer than those out of fold: keep the threshold where both agree.
    return float(np.clip(1 / (1 + np.exp(-odd)), 0.3, 0.6))


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES) -> dict:
    """The chain; what goes to the driver is SAMPLE documents' features at most."""
    told = [F.max(F.expr(f"cast({condition} as int)")).cast("double").alias(f"y{k}") for k, condition in enumerate(categories.values())]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(*told)
    names = [f"y{k}" for k in range(len(categories))]
    some = known.where(F.coalesce(*names).isNotNull()).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)
    joined = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("__id"))
    joined = joined.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.max(x).alias(x) for x in names])
    found = joined.mapInPandas(_sampled, f"doc_id long, {', '.join(x + ' double' for x in names)}, features array<int>").toPandas().sort_values("doc_id")
    folds = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in found["doc_id"]], np.int64)
    rows, labelled = [np.asarray(r, np.int32) for r in found.pop("features")], {c: found[x].to_numpy(float) for c, x in zip(categories, names)}
    model = chain(rows, labelled, folds)
    return {"names": list(categories), "weights": np.column_stack(model["weights"]).astype(np.float32), "dense": model["dense"], "thresholds": model["thresholds"]}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, the probability of each category as p_<name>, and whether it is as probable as its threshold, as is_<name>, of every row."""
    sent, names = docs.sparkSession.sparkContext.broadcast(model), model["names"]
    columns = [f"p_{c} double" for c in names] + [f"is_{c} boolean" for c in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned = sent.value
        weights = np.vstack([learned["weights"], np.zeros((1, len(names)), np.float32)])
        for batch in batches:
            sums, texts = np.zeros((len(batch), len(names))), list(batch["text"])
            for a, b in slices([len(t or "") for t in texts], SLICE):
                found, owner = features(texts[a:b])
                for k in range(len(names)):
                    sums[a:b, k] = np.bincount(owner, weights[found, k].sum(axis=1), b - a)
            out, before = {"doc_id": batch["doc_id"].astype("Int64")}, np.zeros((len(batch), 0))
            for k, (name, v) in enumerate(zip(names, learned["dense"])):
                p = np.zeros(len(batch)) if v is None else _p(np.clip(sums[:, k] + v[0] + before @ v[1:], -8, 8))
                before = np.column_stack([before, p])
                out[f"p_{name}"], out[f"is_{name}"] = p, (p >= learned["thresholds"][k]) & (v is not None)
            yield pd.DataFrame(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, f"doc_id long, {', '.join(columns)}")
