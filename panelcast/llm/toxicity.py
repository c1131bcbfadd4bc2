"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words of a text, its pairs of neighbouring words, pairs with one or
two words between, and the words' stems (their first four and six characters, of longer
words) once, twice, three and five times; all are hashed to 32-bit cells, and a cell
counts once per text. Every coordinate has its own learning rate, and the L1 term holds
the weights of all but a few hundred cells at exactly 0, so the model that is broadcast
is small whatever the vocabulary is.

It is fitted on a bounded sample: at most ``LABELLED`` labelled ids, those with the
smallest hashes. The sample is dealt to groups of about ``SHARD_ROWS``; in each of
``EPOCHS`` jobs every group goes once over its rows from the common state, and the
groups' states are averaged. Cells in fewer than ``MIN_DOCS`` rows of a group take no part in it. Every
document is scored from its whole text.

Words are maximal runs of letters, digits and characters beyond ASCII, in lower case; a
script without spaces gives long words, of which only exact repeats are found again.

Defined cases: null text counts as empty, and an empty text has the score of the
intercept; labels that are null or have no document are not used; an id labelled
several times has the mean of its labels; of several documents with one id the one
with the smallest hash of its text is learnt from; without both labels in the sample
every document scores the share of toxic labels, smoothed by one row of each kind;
repeated rows are scored one by one; an empty table gives no rows; other columns are
kept, and those that bear the name of a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import small_side
from panelcast.session import stage

#: Bounds of the fit.
LABELLED, SHARD_ROWS, EPOCHS, MIN_DOCS = 16_000, 2_000, 5, 5
#: Rate, smoothing of the rate, and both penalties of FTRL-proximal.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.1
#: Documents with at least this probability are toxic.
THRESHOLD = 0.5
#: The words of a pair are at most this far apart.
GAPS = 3
#: Characters of a stem, and occurrences that have a cell of their own.
STEMS, TIMES = (4, 6), (2, 3, 5)
#: Bytes of text whose words are looked up together; words and bytes remembered.
SLICE, CACHE, CACHE_BYTES = 2 << 20, 300_000, 64 << 20

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b >= 128 or b in _KEPT else 32 for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


class WordHashes(dict):
    """Row of a word in ``table``: hashes of the word and of its stems (0: none)."""

    def __init__(self) -> None:
        self.table, self.bytes = np.zeros((1024, 1 + len(STEMS)), np.uint64), 0

    def __missing__(self, word: bytes) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        letters = word.decode("utf-8", "surrogatepass")
        stems = [xxhash.xxh3_64_intdigest(b" " + letters[:k].encode("utf-8", "surrogatepass")) if len(letters) > k else 0 for k in STEMS]
        self.table[row] = (xxhash.xxh3_64_intdigest(word), *stems)
        self[word] = row
        self.bytes += len(word)
        return row

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of all texts, and the text of each word."""
        if len(self) > CACHE or self.bytes > CACHE_BYTES:
            self.clear()
            self.bytes = 0
        lists = [words(t) for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        rows = np.fromiter((self[w] for x in lists for w in x), np.int64, int(sizes.sum()))
        return self.table[rows], np.repeat(np.arange(len(texts)), sizes)


def _mixed(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
    h = (a * _MIX[0] + b * _MIX[by]) * _MIX[1]
    return (h ^ (h >> np.uint64(29))) >> np.uint64(32)


def cells(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of words, pairs and stems, and the text of each; ``of`` is the text of
    every word, and a pair lies within one text."""
    word = hashes[:, 0]
    found, texts = [word >> np.uint64(32)], [of]
    for gap in range(1, GAPS + 1):
        same = of[gap:] == of[:-gap]
        found.append(_mixed(word[:-gap], word[gap:], gap)[same])
        texts.append(of[gap:][same])
    stems, each = hashes[:, 1:].ravel(), np.repeat(of, hashes.shape[1] - 1)
    keys = each[stems > 0].astype(np.uint64) << np.uint64(32) | stems[stems > 0] >> np.uint64(32)
    keys, counts = np.unique(keys, return_counts=True)
    stem, each = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)).astype(np.int64)
    found.append(stem)
    texts.append(each)
    for times in TIMES:
        many = counts >= times
        found.append(_mixed(stem[many], np.full(1, times, np.uint64), 0))
        texts.append(each[many])
    return np.concatenate(found).astype(np.uint32), np.concatenate(texts)


@dataclass
class Model:
    #: Cells with a weight, in order, their weights, and the intercept.
    cells: np.ndarray
    weights: np.ndarray
    intercept: float

    def log_odds(self, texts: list[str | None], hashes: WordHashes) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        flat, of = hashes.of(texts)
        if len(flat) and len(self.cells):
            near = np.zeros(1 << 16, bool)
            near[self.cells >> np.uint32(16)] = True
            cell, text = cells(flat, of)
            some = near[cell >> np.uint32(16)]
            cell, text = cell[some], text[some]
            at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
            hit = self.cells[at] == cell
            once = np.unique(text[hit] * len(self.cells) + at[hit])
            np.add.at(out, once // len(self.cells), self.weights[once % len(self.cells)])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a state; the last coordinate, the intercept, has no L1 term."""
    l1 = np.full(len(z), L1)
    l1[-1] = 0.0
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def go_over(rows: list[np.ndarray], labels: Iterable[float], z: np.ndarray, n: np.ndarray) -> None:
    """FTRL-proximal steps, row by row, in place. A row is the places of its cells,
    the intercept's among them and last."""
    for at, label in zip(rows, labels):
        zs, ns = z[at], n[at]
        w = weights_of(zs, ns)
        g = float(_sigmoid(w.sum())) - label
        after = ns + g * g
        z[at] = zs + g - (np.sqrt(after) - np.sqrt(ns)) / ALPHA * w
        n[at] = after


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn: Column) -> DataFrame:
    """The bounded sample as rows of (shard, h, y, cells), written once."""
    some = labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull())
    some = some.groupBy(F.col(key).alias("of")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    some = stage(some.withColumn("h", F.xxhash64(F.lit(3), "of")).orderBy("h", "of").limit(LABELLED), "labelled")
    texts = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(small_side(some), F.col("__key") == F.col("of"))
    rows = rows.groupBy("of", "h", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(table: pa.Table) -> pa.Table:
        hashes, found = WordHashes(), []
        order = np.argsort(table["h"].to_numpy(), kind="stable")
        table = table.take(order)
        for t in table["text"]:
            found.append(np.unique(cells(*hashes.of([t.as_py()]))[0]))
        seen, counts = np.unique(np.concatenate(found), return_counts=True)
        seen = seen[counts >= MIN_DOCS]
        kept = [pa.py_buffer(f[np.isin(f, seen, assume_unique=True)]).to_pybytes() for f in found]
        return pa.table({"shard": table["shard"], "h": table["h"], "y": table["y"], "cells": pa.array(kept, pa.binary())})

    shards = -(-some.count() // SHARD_ROWS) or 1
    dealt = rows.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "y", "text")
    return stage(dealt.groupBy("shard").applyInArrow(run, "shard int, h long, y double, cells binary"), "cells")


def fit(rows: DataFrame) -> Model:
    """A model of the sample: ``EPOCHS`` jobs with one task per shard."""
    total = rows.agg(F.count("y").alias("n"), F.sum("y").alias("toxic"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if total.n == 0 or total.lo == total.hi:
        share = ((total.toxic or 0.0) + 1) / (total.n + 2)
        return Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(share / (1 - share))))
    spark = rows.sparkSession

    def known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(c.as_py(), np.uint32) for c in b.column(0)]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.unique(np.concatenate(parts)), pa.int64())})

    # At most the cells of the bounded sample.
    cell = np.array(sorted(r.cell for r in rows.select("cells").mapInArrow(known, "cell long").distinct().toLocalIterator()), np.uint32)
    z, n = np.zeros(len(cell) + 1), np.zeros(len(cell) + 1)
    for _ in range(EPOCHS):
        state = spark.sparkContext.broadcast((cell, z, n))

        def run(table: pa.Table) -> pa.Table:
            cell, z, n = state.value
            z, n = z.copy(), n.copy()
            table = table.take(np.argsort(table["h"].to_numpy(), kind="stable"))
            at = [np.append(np.searchsorted(cell, np.frombuffer(c.as_py(), np.uint32)), len(cell)) for c in table["cells"]]
            go_over(at, table["y"].to_pylist(), z, n)
            return pa.table({"shard": table["shard"][:1], "z": pa.array([z.tobytes()]), "n": pa.array([n.tobytes()])})

        z, n, shards = np.zeros(len(z)), np.zeros(len(n)), 0
        for r in rows.groupBy("shard").applyInArrow(run, "shard int, z binary, n binary").orderBy("shard").toLocalIterator():
            z, n, shards = z + np.frombuffer(r.z), n + np.frombuffer(r.n), shards + 1
        z, n = z / shards, n / shards
        state.unpersist()
    w = weights_of(z, n)
    some = np.flatnonzero(w[:-1])
    return Model(cell[some], w[some], float(w[-1]))


def predict(docs: DataFrame, model: Model, text: str = "text", into: str = "toxic_score") -> DataFrame:
    """``docs`` with the probability that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != into]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, model = WordHashes(), shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                before = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, before + SLICE, "right")))
                p = _sigmoid(model.log_odds(texts[lo:hi].to_pylist(), hashes))
                b = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], names=[*kept, into])
                lo = hi

    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return rows.mapInArrow(run, docs.select(kept).schema.add(into, "double"))


def held_out(key: Column) -> Column:
    """Ids whose labels are never learnt from; a null id has none."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def detect(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Learn from the labels that are not held out, score all documents."""
    model = fit(sample(docs, labels, key, text, label, ~held_out(F.col(key))))
    rows = predict(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), model, into="score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
