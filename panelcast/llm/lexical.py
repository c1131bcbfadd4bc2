"""Ranked lexical search over posting lists that are blocked by document similarity.

One pass over the texts writes a forward index: per document its number of terms and
the items' terms with their counts. All later steps read only that. Tasks work on
shards of a few thousand documents, each with posting lists of its own:

* the documents of a list are clustered around pivots of the list, by the inner
  product of random projections of their weighted vectors, and cut into small blocks;
* a block keeps the coordinatewise maximum of its documents' vectors, so an item's
  weights times that summary bound the score of every document in the block;
* a block is skipped only when that bound is below a score that ``k`` documents are
  known to reach; documents of all other blocks are scored exactly.

The known score comes from documents that hold an item's rarest terms. A term's list
is not even opened for an item if that term and all weaker ones together, at their
largest impacts, stay below it. Nothing else is left out, so the ranking is exact. All
scores are whole numbers. Each task returns at most ``k`` rows per item, and only
those are shuffled.

Items are the query set: they are read in blocks of about ``ITEMS`` items or ``TERMS``
terms, so what is sent to the tasks is bounded, and every block is one run over all
documents.

Defined cases: null text has no terms; documents without terms don't count; items
without terms, or whose terms no document holds, get no rows; a term that an item
repeats counts as often; equal scores go by ascending id, nulls last; repeated rows of
documents or items are ranked one by one; other columns are ignored; an empty table on
either side gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import chunks
from panelcast.session import stage

#: Items and terms of one run over the documents.
ITEMS, TERMS = 1_000, 20_000
#: Documents and cells of a shard; documents per pivot of a list, and most in a block.
SHARD, CELLS, PER_PIVOT, BLOCK = 4_096, 16 << 20, 8, 32
#: Numbers in a document's projection, and documents that a known score rests on.
SKETCH, PROBED = 32, 400

_KEPT = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(b if b >= 128 or b in _KEPT else 32 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII;
    only A-Z are lower-cased."""
    return (text or b"").translate(_TABLE).split()


@dataclass
class Items:
    """A block of the query set."""

    keys: list
    vocabulary: dict[bytes, int]
    #: Per item its distinct terms and how often it holds each.
    terms: list[np.ndarray]
    counts: list[np.ndarray]


def read_items(items: DataFrame, key: str, text: str) -> Iterator[Items]:
    """The query set in blocks, each of a bounded expected size."""
    rows = items.select(F.col(key).alias("key"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    words = F.length(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")) / 2 + 1
    size = items.agg(F.count("*").alias("n"), F.sum(words).alias("words")).first()
    blocks = max(math.ceil(size.n / ITEMS), math.ceil((size.words or 0) / (8 * TERMS)))
    part = F.pmod(F.xxhash64("key", "text"), F.lit(max(1, blocks)))
    for b in range(blocks):
        found = Items([], {}, [], [])
        for r in rows.where(part == b).orderBy("key", "text").collect():
            own = Counter(terms(bytes(r.text)))
            if own:
                found.keys.append(r.key)
                found.terms.append(np.array([found.vocabulary.setdefault(t, len(found.vocabulary)) for t in own], np.int64))
                found.counts.append(np.array(list(own.values()), np.int64))
        if found.keys:
            yield found


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """One row (doc_id, n, terms, tfs) per document with a term, written once: the
    number of all its terms, and the terms of the vocabulary with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.get
        for b in batches:
            ids, tfs, n = [], [], []
            for t in b.column(1):
                own = terms(t.as_py())
                n.append(len(own))
                known = np.array([i for i in map(find, own) if i is not None], np.int32)
                each, count = np.unique(known, return_counts=True)
                ids.append(each.tobytes())
                tfs.append(count.astype(np.int32).tobytes())
            rows = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tfs"])
            yield rows.filter(pa.array(np.array(n, np.int64) > 0))

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.encode(F.col(text), "UTF-8").alias("text"))
    return stage(rows.mapInArrow(run, f"doc_id {kind}, n long, terms binary, tfs binary"), "forward")


def document_counts(forward: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            for t in b.column(0):
                counts[np.frombuffer(t.as_py(), np.int32)] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "value": pa.array(counts[some], pa.int64())})

    return _by_term(forward.select("terms").mapInArrow(run, "term long, value long").groupBy("term").agg(F.sum("value").alias("value")), size)


def _by_term(rows: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in rows.collect():
        out[r.term] = r.value
    return out


@dataclass
class Shard:
    """Documents in task memory: ids and a matrix of impacts (documents x terms)."""

    ids: pa.Array
    impact: np.ndarray
    #: The terms of the columns, and the column of each term (-1: none).
    terms: np.ndarray
    column: np.ndarray


class Scorer:
    """All that a task needs to score documents for the items of one block."""

    def __init__(self, items: Items, docs: int, length: int, df: np.ndarray) -> None:
        self.terms, self.docs, self.length, self.size = items.terms, docs, length, len(df)
        weight = [math.floor(1000 * math.log((2 * docs + 2) / (2 * d + 1))) for d in df.tolist()]
        self.weight = np.array(weight, np.int64)
        self.weights = [c * self.weight[t] for t, c in zip(items.terms, items.counts)]

    def shards(self, batches: Iterable[pa.RecordBatch]) -> Iterator[Shard]:
        """Shards of (doc_id, n, terms, tfs) rows."""
        rows = max(64, min(SHARD, CELLS // max(1, self.size)))
        for table in chunks(batches, rows):
            for lo in range(0, table.num_rows, rows):
                part = table.slice(lo, rows)
                ids = [np.frombuffer(x, np.int32) for x in part["terms"].to_pylist()]
                tf = np.frombuffer(b"".join(part["tfs"].to_pylist()), np.int32).astype(np.int64)
                of = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
                n = part["n"].to_numpy()
                m = 100 - 25 + (25 * n * self.docs) // self.length
                known, place = np.unique(np.concatenate(ids), return_inverse=True)
                impact = np.zeros((len(ids), len(known)), np.int32)
                impact[of, place] = (1_000_000_000 * tf) // (1000 * tf + 12 * m[of])
                column = np.full(self.size, -1, np.int64)
                column[known] = np.arange(len(known))
                yield Shard(part["doc_id"].combine_chunks(), impact, known, column)

    def totals(self, item: int, shard: Shard, rows: np.ndarray) -> np.ndarray:
        """Weights of an item times rows of impacts: scores or bounds."""
        at = shard.column[self.terms[item]]
        held = at >= 0
        return rows[:, at[held]].astype(np.int64) @ self.weights[item][held]



def known_scores(forward: DataFrame, scorer: Scorer, probes: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per item a score that ``k`` documents reach (0 if fewer hold a probed term),
    and the largest impact of every term."""
    spark = forward.sparkSession
    shared = spark.sparkContext.broadcast((scorer, probes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, probes = shared.value
        top: list[np.ndarray] = [np.zeros(0, np.int64)] * len(probes)
        most = np.zeros(scorer.size, np.int64)
        for shard in scorer.shards(batches):
            if not len(shard.terms):
                continue
            most[shard.terms] = np.maximum(most[shard.terms], shard.impact.max(axis=0))
            for i, probed in enumerate(probes):
                at = shard.column[probed]
                rows = np.flatnonzero((shard.impact[:, at[at >= 0]] > 0).any(axis=1))
                if len(rows):
                    top[i] = np.sort(np.concatenate([top[i], scorer.totals(i, shard, shard.impact[rows])]))[-k:]
        some = np.flatnonzero(most)
        items = np.repeat(np.arange(len(top)), [len(t) for t in top])
        yield pa.RecordBatch.from_pydict({
            "item": pa.array([*items, *[-1] * len(some)], pa.int64()),
            "term": pa.array([*[-1] * len(items), *some], pa.int64()),
            "value": pa.array(np.concatenate([*top, most[some]]), pa.int64()),
        })

    found = stage(forward.mapInArrow(run, "item long, term long, value long"), "known")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("value")))
    last = found.where("item >= 0").withColumn("place", place).where(F.col("place") == k)
    known = np.zeros(len(probes), np.int64)
    for r in last.collect():
        known[r.item] = r.value
    return known, _by_term(found.where("term >= 0").groupBy("term").agg(F.max("value").alias("value")), scorer.size)


def open_lists(scorer: Scorer, known: np.ndarray, most: np.ndarray) -> list[np.ndarray]:
    """Per item the terms whose lists are read. A document without any of them scores
    at most the sum of the others' largest contributions, which is below the known
    score."""
    out = []
    for t, w, score in zip(scorer.terms, scorer.weights, known):
        order = np.argsort(w * most[t], kind="stable")
        needless = np.cumsum((w * most[t])[order]) < score
        out.append(t[order][~needless])
    return out


def blocks(shard: Shard, opened: np.ndarray, weight: np.ndarray, projection: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posting lists of the opened terms, clustered: the documents of all blocks one
    after another, where each block begins, and the term of each block."""
    sketch = (shard.impact * weight[shard.terms].astype(np.float32)) @ projection[shard.terms]
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    docs, starts, of, at = [], [], [], 0
    for term in opened[shard.column[opened] >= 0].tolist():
        held = np.flatnonzero(shard.impact[:, shard.column[term]])
        if len(held) > PER_PIVOT:
            pivots = held[:: PER_PIVOT]
            near = (sketch[held] @ sketch[pivots].T).argmax(axis=1)
            held, near = held[(order := np.argsort(near, kind="stable"))], near[order]
            begin = np.flatnonzero(np.diff(near, prepend=-1))
            place = np.arange(len(held)) - np.repeat(begin, np.diff(np.append(begin, len(held))))
            begin = np.flatnonzero(place % BLOCK == 0)
        else:
            begin = np.zeros(1, np.int64)
        docs.append(held)
        starts.append(begin + at)
        of.append(np.full(len(begin), term))
        at += len(held)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(starts), np.concatenate(of)


def search_shard(shard: Shard, scorer: Scorer, readers: list[np.ndarray], known: np.ndarray, projection: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, documents, exact scores) of all blocks that the bounds don't rule out.
    ``readers`` has the items that read the list of each term."""
    opened = np.flatnonzero([len(r) > 0 for r in readers])
    docs, starts, of = blocks(shard, opened, scorer.weight, projection)
    ends = np.append(starts[1:], len(docs))
    found: dict[int, list[np.ndarray]] = {}
    step = max(1, (CELLS // 8) // (BLOCK * max(1, len(shard.terms))))
    for lo in range(0, len(starts), step):
        hi = min(lo + step, len(starts))
        summary = np.maximum.reduceat(shard.impact[docs[starts[lo] : ends[hi - 1]]], starts[lo:hi] - starts[lo], axis=0)
        wanted: dict[int, list[int]] = {}
        for b in range(lo, hi):
            for i in readers[of[b]]:
                wanted.setdefault(int(i), []).append(b)
        for i, own in wanted.items():
            own = np.array(own)
            bound = scorer.totals(i, shard, summary[own - lo])
            for b in own[(bound >= known[i]) & (bound > 0)].tolist():
                found.setdefault(i, []).append(docs[starts[b] : ends[b]])
    for i, parts in found.items():
        rows = np.unique(np.concatenate(parts))
        yield i, rows, scorer.totals(i, shard, shard.impact[rows])


def search(
    docs: DataFrame, items: DataFrame, k: int = 20,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The ``k`` best documents of every item: item key, rank, document key, score."""
    spark = docs.sparkSession
    parts = [_search_block(docs, block, k, key, text, item_key, items.schema[item_key].dataType.simpleString()) for block in read_items(items, item_key, item_text)]
    if not parts:
        kinds = [f"{item_key} {items.schema[item_key].dataType.simpleString()}", "rank int", f"{key} {docs.schema[key].dataType.simpleString()}", "score long"]
        return spark.createDataFrame([], ", ".join(kinds))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _search_block(docs: DataFrame, items: Items, k: int, key: str, text: str, item_key: str, item_kind: str) -> DataFrame:
    spark = docs.sparkSession
    forward = forward_index(docs, items.vocabulary, key, text)
    total = forward.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    size = len(items.vocabulary)
    df = document_counts(forward, size)
    scorer = Scorer(items, total.docs, max(1, total.length or 0), df)
    probes = []
    for t in items.terms:
        order = t[np.argsort(df[t], kind="stable")]
        probes.append(order[: int(np.searchsorted(np.cumsum(df[order]), PROBED)) + 1])
    known, most = known_scores(forward, scorer, probes, k)
    readers: list[list[int]] = [[] for _ in range(size)]
    for i, opened in enumerate(open_lists(scorer, known, most)):
        for t in opened.tolist():
            readers[t].append(i)
    projection = np.random.default_rng(5).choice(np.array([-1, 1], np.float32), (size, SKETCH))
    shared = spark.sparkContext.broadcast((scorer, [np.array(r, np.int64) for r in readers], known, projection))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, readers, known, projection = shared.value
        top: dict[int, tuple[pa.Array, np.ndarray]] = {}
        for shard in scorer.shards(batches):
            for i, rows, scores in search_shard(shard, scorer, readers, known, projection):
                ids = shard.ids.take(pa.array(rows))
                if i in top:
                    ids, scores = pa.concat_arrays([top[i][0], ids]), np.concatenate([top[i][1], scores])
                order = pa.compute.sort_indices(pa.table({"s": scores, "id": ids}), sort_keys=[("s", "descending"), ("id", "ascending")])[:k]
                order = order.filter(pa.array(scores[order.to_numpy()] > 0))
                top[i] = ids.take(order), scores[order.to_numpy()]
        if top:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(list(top), [len(s) for _, s in top.values()]), pa.int64()), pa.concat_arrays([ids for ids, _ in top.values()]), pa.array(np.concatenate([s for _, s in top.values()]), pa.int64())],
                names=["item", "doc", "score"],
            )

    rows = forward.mapInArrow(run, f"item long, doc {kind}, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    rows = rows.withColumn("rank", place).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items.keys)), f"item long, name {item_kind}")
    rows = rows.join(F.broadcast(names), "item")
    return rows.select(F.col("name").alias(item_key), "rank", F.col("doc").alias(key), "score")
