"""Language identification by cross-parsing entropy.

For each language a bounded sample of labelled text is made into a suffix automaton. A text is parsed
against it from the left: each phrase is the longest match from where the last one ended. The number
of phrases, times the bits that name a place in the sample, over the length of the text, estimates
the cross entropy; the language with the least wins, ties going to the first in order.

All automata are laid out as one table from (state, symbol) to the next state, with failures already
resolved to the start of the next phrase, so that a batch of texts advances in step. The DENSE most common letters
have columns of that table, all others of the sample are found by search. Long texts are cut into blocks that are
parsed side by side as if each began a phrase; then each is parsed again from the state in which the one before it really ended,
until both ways begin a phrase at one place, from where on they are the same. So the count is that of the
whole text, parsed from its start.
Symbols are lower-case letters; all else, however much, is one gap; letters that the sample lacks are one symbol.

Defined results: a null text, or one without letters, is ``und`` with score 0; so is every text if
nothing was learned; repeated rows each get their row; an empty table gives an empty result; other
columns of the input are not read. With one language learned the score is 1.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm._common import give_back
from tessera.llm._words import slices

#: The sample: documents of a language at most, code points of a document, and of all languages together, which each get the same part; languages.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ALL, LANGUAGES = 200, 2000, 320_000, 1000
DENSE = 62
#: Symbols of a block; those of its beginning in which two ways to parse it are looked at for a common phrase.
BLOCK, MEET = 512, 64
#: Code points that are parsed at a time, alone and among other stages.
BATCH, SLICE = 4_000_000, 1_000_000
#: A document whose label is another language is rejected if that language takes so many bits more than the best, in all and as a part.
CONTRADICTED_BITS, CONTRADICTED_PART = 250.0, 0.48
#: For that, a phrase longer than this counts as several: a passage that a sample happens to hold is no evidence of a language.
COPIED = 20


def automaton(symbols: list[int], dense: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton as a table of ``dense`` columns: twice the next state, plus 1 where the symbol begins a phrase;
    for symbols from ``dense`` on, (state, symbol) as sorted keys, with what the table would hold.

    A symbol that the sample lacks is a phrase of its own and leads back to the start, where any symbol begins one.
    """
    following, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        now, p = len(following), last
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in following[p]:
            following[p][c] = now
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    start = np.ones(dense, np.int32)
    for c, s in following[0].items():
        if c < dense:
            start[c] = 2 * s + 1
    table = np.tile(start, (len(following), 1))
    sparse = {}
    for s, out in enumerate(following):
        for c, to in out.items():
            if c < dense:
                table[s, c] = 2 * to
            else:
                sparse[(s << 21) | c] = 2 * to
    table[0] = start
    # From the start every symbol begins a phrase.
    sparse.update({c: 2 * to + 1 for c, to in following[0].items() if c >= dense})
    keys = np.array(sorted(sparse), np.int64)
    return table, keys, np.array([sparse[k] for k in keys.tolist()], np.int64)


class Model:
    """What was learned: languages, symbols of code points, one table for all languages."""

    def __init__(self, texts: dict[str, str]):
        texts = {k: v.lower() for k, v in sorted(texts.items())}
        counts = Counter(c for v in texts.values() for c in v if c.isalpha())
        self.letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        self.size = min(len(self.letters), DENSE) + 2
        self.languages, self.bits, tables, keys, values, self.starts, at = [], [], [], [], [], [], 0
        symbol = self.symbols()
        for k, v in texts.items():
            s = _gaps(symbol[_points(v)])[0].tolist()
            if not any(s):
                continue
            table, key, value = automaton(s, self.size)
            self.languages.append(k)
            self.bits.append(np.log2(len(s) + 1))
            tables.append(table + 2 * at)
            keys.append(key + (at << 21))
            values.append(value + 2 * at)
            self.starts.append(at)
            at += len(table)
        self.table = np.concatenate(tables).reshape(-1) if tables else np.zeros(0, np.int32)
        self.keys, self.values = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (keys, values))

    @classmethod
    def of(cls, parts: dict) -> Model:
        model = cls.__new__(cls)
        model.__dict__.update(parts)
        return model

    def symbols(self) -> np.ndarray:
        """By code point: 0 a gap, 1 an unknown letter, from 2 on the letters."""
        of = np.zeros(sys.maxunicode + 1, np.int32)
        of[[i for i in range(sys.maxunicode + 1) if chr(i).isalpha()]] = 1
        for k, c in enumerate(self.letters):
            of[ord(c)] = k + 2
            for upper in {c.upper(), c.title()}:
                if len(upper) == 1:
                    of[ord(upper)] = k + 2
        return of

    def go(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Twice the next states, plus 1 where the symbol begins a phrase; all states are of one language in a row, rows in order."""
        rare = symbol >= self.size
        if not rare.any():
            return self.table[state * self.size + symbol]
        out = self.table[state * self.size + np.where(rare, 1, symbol)].astype(np.int64)
        at = np.flatnonzero(rare)
        some, sign = state[:, at], symbol[at].astype(np.int64)
        first = np.array(self.starts, np.int64)[:, None]

        def found(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = (states << 21) | sign
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return self.values[where], self.keys[where] == key

        on, hit = found(some)
        # What does not go on begins a phrase: from the start, or, if the language lacks the letter, as column 1, a letter all lack, does.
        anew, known = found(np.broadcast_to(first, some.shape))
        out[:, at] = np.where(hit, on, np.where(known, anew, out[:, at]))
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _gaps(symbols: np.ndarray, firsts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Drop all but the first gap of a run, and gaps at a text's start; what is kept."""
    keep = np.empty(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    if len(symbols):
        keep[0] = symbols[0] != 0
    if firsts is not None:
        keep[firsts] = symbols[firsts] != 0
    return symbols[keep], keep


def phrases(model: Model, symbol: np.ndarray, texts: list[str], longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By language and text the number of phrases, longer ones than ``longest`` counting for each such piece; by text its length in symbols and its letters."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = symbol[_points("".join(texts))]
    ends = np.cumsum(sizes)
    full = sizes > 0
    flat, keep = _gaps(flat, (ends - sizes)[full])
    upto = np.concatenate([[0], np.cumsum(keep)])
    kept = upto[ends] - upto[ends - sizes]
    some = np.concatenate([[0], np.cumsum(flat != 0)])
    begin = np.cumsum(kept) - kept
    letters = some[begin + kept] - some[begin]
    blocks = (kept + BLOCK - 1) // BLOCK
    owner = np.repeat(np.arange(len(texts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = begin[owner] + nth * BLOCK
    length = np.minimum(BLOCK, kept[owner] - nth * BLOCK)
    start = np.repeat(np.array(model.starts, np.int64)[:, None], len(at), axis=1)
    total = np.zeros((len(model.languages), len(texts)))
    if longest is None:
        marks = np.zeros((*start.shape, MEET), np.uint8)
        ends, count = _counted(model, flat, at, length, start, marks)
    else:
        begins = np.zeros((len(model.languages), len(flat)), np.uint8)
        ends, _ = _parsed(model, flat, begins, at, length, start)
    # Blocks but a text's first again, from where the one before them ended, while that is news.
    again = np.flatnonzero(nth > 0)
    while len(again):
        before = ends[:, again].copy()
        if longest is None:
            _met(model, flat, at, length, ends, count, marks, again)
        else:
            redone, met = _parsed(model, flat, begins, at[again], length[again], ends[:, again - 1], meet=True)
            ends[:, again] = np.where(met, before, redone)
        after = again[(ends[:, again] != before).any(axis=0)] + 1
        after = after[after < len(at)]
        again = after[nth[after] > 0]
    some = kept > 0
    if longest is None:
        for k, row in enumerate(count):
            total[k] = np.bincount(owner, row, len(texts))
    elif some.any():
        for k, row in enumerate(begins):
            # Every text begins with a phrase.
            first = np.flatnonzero(row)
            pieces = -(-np.diff(first, append=len(flat)) // longest)
            total[k, some] = np.add.reduceat(pieces, np.searchsorted(first, begin[some]))
    return total, kept, letters


def _counted(model: Model, flat: np.ndarray, at: np.ndarray, length: np.ndarray, start: np.ndarray, marks: np.ndarray | None = None, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Parse blocks side by side from their place ``first``: last states and phrases begun; in ``marks``, where within the first MEET symbols they begin."""
    order = np.argsort(-length, kind="stable")
    begin, size, state = at[order], length[order], start[:, order].copy()
    count = np.zeros(state.shape, np.int64)
    live = np.searchsorted(-size, -np.arange(first, BLOCK), side="left")
    told = None if marks is None else np.zeros((MEET, *state.shape), np.uint8)
    for step, n in enumerate(live, first):
        if not n:
            break
        go = model.go(state[:, :n], flat[begin[:n] + step])
        new = go & 1
        count[:, :n] += new
        if told is not None and step < MEET:
            told[step, :, :n] = new
        state[:, :n] = go >> 1
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    if told is not None:
        marks[:] = told.transpose(1, 2, 0)[:, back]
    return state[:, back], count[:, back]


def _met(model: Model, flat: np.ndarray, at: np.ndarray, length: np.ndarray, ends: np.ndarray, count: np.ndarray, marks: np.ndarray, again: np.ndarray) -> None:
    """Parse these blocks again from where the ones before them ended.

    From the first place on at which a phrase would begin both ways, what is known stands: marks and counts before it are put right.
    Blocks that do not meet within the first MEET symbols are parsed to their end.
    """
    state, was = ends[:, again - 1].copy(), marks[:, again]
    now, met = was.copy(), np.zeros(state.shape, bool)
    for step in range(int(min(MEET, length[again].max()))):
        on = np.flatnonzero((length[again] > step) & ~met.all(axis=0))
        if not len(on):
            break
        go = model.go(state[:, on], flat[at[again[on]] + step])
        new = (go & 1).astype(np.uint8)
        met[:, on] |= (was[:, on, step] & new).astype(bool)
        now[:, on, step] = np.where(met[:, on], was[:, on, step], new)
        state[:, on] = go >> 1
    marks[:, again] = now
    change = now.sum(axis=2, dtype=np.int64) - was.sum(axis=2, dtype=np.int64)
    apart = np.flatnonzero(~met.all(axis=0))
    count[:, again] += np.where(met, change, 0)
    if len(apart):
        blocks, far = again[apart], ~met[:, apart]
        rest = length[blocks] > MEET
        last, more = state[:, apart].copy(), np.zeros((len(state), len(apart)), np.int64)
        if rest.any():
            last[:, rest], more[:, rest] = _counted(model, flat, at[blocks[rest]], length[blocks[rest]], state[:, apart[rest]], first=MEET)
        count[:, blocks] = np.where(far, now[:, apart].sum(axis=2, dtype=np.int64) + more, count[:, blocks])
        ends[:, blocks] = np.where(far, last, ends[:, blocks])


def _parsed(model: Model, flat: np.ndarray, begins: np.ndarray, at: np.ndarray, length: np.ndarray, start: np.ndarray, meet: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Parse blocks of ``flat`` side by side from these states, writing where phrases begin: by language and block the last state.

    With ``meet`` a language's parse of a block keeps what is written there from the first place on at which it would begin a phrase as well; whether it did.
    """
    order = np.argsort(-length, kind="stable")
    last, met = start.copy(), np.zeros(start.shape, bool)
    step = 0
    while len(order):
        begin, size, state, here = at[order], length[order], last[:, order], met[:, order]
        until = min(BLOCK, step + 32)
        live = np.searchsorted(-size, -np.arange(step, until), side="left")
        for n in live:
            if not n:
                break
            where = begin[:n] + step
            go = model.go(state[:, :n], flat[where])
            now = (go & 1).astype(np.uint8)
            if meet:
                was = begins[:, where]
                here[:, :n] |= (was & now).astype(bool)
                now = np.where(here[:, :n], was, now)
            begins[:, where] = now
            state[:, :n] = go >> 1
            step += 1
        last[:, order], met[:, order] = state, here
        # Blocks that are over, or that have met in every language, are done.
        order = order[(size > until) & ~here.all(axis=0)] if step == until else order[:0]
    return last, met


def fit(docs: DataFrame) -> Model:
    """Learn from ``text`` and ``lang`` of a sample of bounded size: the documents of smallest hash, by language, of the LANGUAGES most common ones.

    Only ids go through the window; the texts of the chosen few are fetched by a semi-join and cut by
    a hash of the id. Rows that share an id and a language count once, with the smallest text.
    """
    learned = docs.where("lang is not null and text is not null")
    common = [r["lang"] for r in learned.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    chars = SAMPLE_ALL // max(1, len(common))
    each = max(1, min(SAMPLE_DOCS, chars // 200))
    rows = learned.where(F.col("lang").isin(common)).select(F.xxhash64("doc_id", "lang").alias("h"), "lang", "text")
    chosen = rows.select("lang", "h").withColumn("n", F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= each).select("lang", "h").distinct()
    start = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)).cast("int") + 1
    found = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min(F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS))).alias("text"))
    texts: dict[str, dict[str, None]] = {}
    for r in found.orderBy("lang", "h").collect():
        texts.setdefault(r["lang"], {})[r["text"]] = None
    return Model({lang: " ".join(x)[: max(1, chars)] for lang, x in texts.items()})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ``rate`` (bits a symbol in the language that won) of every row, by its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learned = Model.of(sent.value)
        symbol = learned.symbols()
        for batch in batches:
            texts, ids = [t or "" for t in batch["text"]], batch["doc_id"]
            group = np.cumsum([len(t) for t in texts]) // BATCH if texts else np.zeros(0)
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                some = [texts[i] for i in at]
                best, score, rate, _ = _decide(learned, symbol, some)
                yield pd.DataFrame({"doc_id": ids.iloc[at].astype("Int64"), "lang_pred": best, "score": score, "rate": rate})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double, rate double")


def _decide(model: Model, symbol: np.ndarray, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its language, score and rate, and by language its bits."""
    n = len(texts)
    if not model.languages:
        return ["und"] * n, np.zeros(n), np.zeros(n), np.zeros((0, n))
    count, kept, letters = phrases(model, symbol, texts)
    bits = count * np.array(model.bits)[:, None]
    rates = bits / np.maximum(kept, 1)
    best = rates.argmin(axis=0)
    ordered = np.sort(rates, axis=0)
    known = letters > 0
    score = 1 - ordered[0] / np.maximum(ordered[1], 1e-12) if len(ordered) > 1 else np.ones(n)
    return [model.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, score, 0.0), np.where(known, ordered[0], 0.0), bits


def held_out() -> F.Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are in a language: not ``und``, nor in another than their label says.

    A label is contradicted if its language takes CONTRADICTED_BITS more than the best one and CONTRADICTED_PART of its own bits
    more; a short text lacks that evidence, and a text in several languages has it for none. A label that was not learned contradicts nothing.
    If nothing was learned, no row is rejected but those without letters.
    Rows pass through as Arrow batches and are filtered there, so nothing is joined or shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vars(fit(docs.where(~held_out()))))

    def run(batches):
        learned = Model.of(sent.value)
        symbol = learned.symbols()
        for whole in batches:
            every = [t or "" for t in whole.column("text").to_pylist()]
            for a, b in slices([len(t) for t in every], SLICE):
                batch, texts = whole.slice(a, b - a), every[a:b]
                yield batch.filter(pa.array(_stays(learned, symbol, texts, batch.column("lang").to_pylist()), pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def _stays(model: Model, symbol: np.ndarray, texts: list[str], labels: list[str | None]) -> list[bool]:
    if not model.languages:
        return [any(c.isalpha() for c in t) for t in texts]
    best, _, _, bits = _decide(model, symbol, texts)
    of, stays = {k: i for i, k in enumerate(model.languages)}, [b != "und" for b in best]

    def contradicted(bits: np.ndarray, at: list[int]) -> list[int]:
        least, own = bits.min(axis=0), np.array([bits[of[labels[i]], k] for k, i in enumerate(at)])
        return [i for i, clear in zip(at, (own - least >= CONTRADICTED_BITS) & (own - least >= CONTRADICTED_PART * own)) if clear]

    told = [i for i, lang in enumerate(labels) if stays[i] and lang in of]
    doubted = contradicted(bits[:, told], told) if told else []
    if doubted:
        count, _, _ = phrases(model, symbol, [texts[i] for i in doubted], COPIED)
        for i in contradicted(count * np.array(model.bits)[:, None], doubted):
            stays[i] = False
    return stays
