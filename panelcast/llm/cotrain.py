"""Quality classification by co-training of two views.

One classifier sees only the text (shapes of characters and words), the other only
the metadata (source, language, length). Both start from labelled rows; then, round by
round, each labels all documents that it is sure of for the other. A round is one job:
every task scores its documents with both views' weights and adds up what the sure ones
give to the other view's next step, two matrices and two vectors of fixed size. At
last both are calibrated on labelled rows that neither has learnt from, and their log
odds are added to score all documents.

The labelled rows are a bounded sample: at most ``LABELLED`` labelled ids, those with
the smallest hashes. The other side has no bound: every document takes part in every
round, all together with the weight of ``PSEUDO_WEIGHT`` times the labelled rows, so
the result doesn't depend on how many there are. Every document is scored from its
whole text.

Defined cases: null text counts as empty; null source, lang or length is a value of
its own; labels that are null are not used; an id labelled several times has the mean
of its labels; of several documents with a labelled id the one with the smallest hash
is learnt from; without both labels in the sample every document scores the share of
good labels (1 without any) and is kept if that is at least the threshold; repeated
rows are scored one by one; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import small_side
from panelcast.session import stage

#: Bound of the labelled rows.
LABELLED = 6_000
ROUNDS = 5
#: A view hands on rows that it is at least this sure of; together they weigh this share
#: of the labelled rows.
SURE = 0.98
PSEUDO_WEIGHT = 0.3
RIDGE = 0.02
#: Documents with a lower probability of being good are rejected.
THRESHOLD = 0.5
META_CELLS = 128

#: Shape of a byte: white space, line end, lower case, upper case, digit, some
#: marks of their own, other marks, bytes of other characters.
_MARKS = {".": 5, ",": 6, "!": 7, "?": 8, "|": 9, "*": 10, "#": 11, "$": 12, "%": 12, "&": 12, "@": 12}
SHAPES = 16


def _shape(byte: int) -> int:
    c = chr(byte)
    if byte >= 128:
        return 15
    if c in "\n\r":
        return 1
    if c.isspace():
        return 0
    if c.islower():
        return 2
    if c.isupper():
        return 3
    if c.isdigit():
        return 4
    return _MARKS.get(c, 13 if c in "\"'()[]{}<>" else 14)


_SHAPE = np.array([_shape(b) for b in range(256)], np.uint8)
TEXT_CELLS = SHAPES * SHAPES + 6


def text_view(text: str | None) -> np.ndarray:
    """Roots of the shares of neighbouring shapes; repetition and length of words."""
    out = np.zeros(TEXT_CELLS, np.float32)
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return out
    s = _SHAPE[np.frombuffer(data, np.uint8)]
    if len(s) > 1:
        pairs = np.bincount(s[:-1] * np.uint8(SHAPES) + s[1:], minlength=SHAPES * SHAPES)
        out[: SHAPES * SHAPES] = np.sqrt(pairs / (len(s) - 1))
    words = data.split()
    if words:
        n = len(words)
        kinds = len(set(words))
        again = sum(map(bytes.__eq__, words, words[1:])) / n
        out[-6:] = (1.0, kinds / n, again, min(len(data) / n, 40) / 40, np.log1p(n) / 12, max(map(len, words)) > 60)
    return out


def meta_view(source, lang, n_chars) -> np.ndarray:
    """Source and language as hashed cells, length as a step and a slope."""
    out = np.zeros(META_CELLS, np.float32)
    out[zlib.crc32(f"source={source}".encode()) % (META_CELLS - 20)] += 1
    out[zlib.crc32(f"lang={lang}".encode()) % (META_CELLS - 20)] += 1
    if n_chars is not None:
        size = np.log2(max(0, n_chars) + 1)
        out[META_CELLS - 20 + min(17, int(size))] = 1
        out[-2] = size / 20
    out[-1] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, steps: int = 15) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    scale = ridge * max(1.0, weight.sum()) / 100
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (weight * (y - p)) - scale * w
        curve = weight * p * (1 - p) + 1e-6
        move = np.linalg.solve(x.T @ (x * curve[:, None]) + scale * np.eye(x.shape[1]), gradient)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-4:
            break
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    #: Slope and offset of each view's calibrated log odds.
    text_fit: tuple[float, float]
    meta_fit: tuple[float, float]
    prior: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of a good document by text, by metadata, and by both."""
        a = (text @ self.text) * self.text_fit[0] + self.text_fit[1]
        b = (meta @ self.meta) * self.meta_fit[0] + self.meta_fit[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x = np.stack([z, np.ones(len(z))], axis=1)
    soft = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    slope, offset = _logistic(x, soft, np.ones(len(z)), ridge=1e-4)
    return max(0.0, float(slope)), float(offset)


def _odds(share: float) -> float:
    return float(np.log((share + 1e-6) / (1 - share + 1e-6)))


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log likelihood at weights ``w``, and a bound of its curvature
    that holds everywhere, so that a step never overshoots."""
    return x.T @ (y - _sigmoid(x @ w)), x.T @ x / 4


def fit(text: np.ndarray, meta: np.ndarray, label: np.ndarray, exchange=None, rounds: int = ROUNDS) -> Model:
    """Co-training from labelled rows; every fifth calibrates. ``exchange(model)``
    returns for both views the number, gradient and curvature of the documents that
    the other view is sure of, at the model's weights (None: there are none)."""
    label = label.astype(float)
    if len(label) < 20 or label.min() == label.max():
        share = min(max(label.mean() if len(label) else 1.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(TEXT_CELLS), np.zeros(META_CELLS), (0.0, _odds(share)), (0.0, _odds(share)), _odds(share))
    check = np.arange(len(label)) % 5 == 4
    views = [text.astype(float), meta.astype(float)]
    ones = np.ones(int((~check).sum()))
    weights = [_logistic(x[~check], label[~check], ones, RIDGE) for x in views]

    def model() -> Model:
        fits = [_calibrated(x[check] @ w, label[check]) for x, w in zip(views, weights)]
        return Model(weights[0], weights[1], fits[0], fits[1], _odds(label.mean()))

    for _ in range(rounds if exchange else 0):
        moved = []
        for x, w, (count, gradient, curvature) in zip(views, weights, exchange(model())):
            g, h = _sums(x[~check], label[~check], w)
            share = PSEUDO_WEIGHT * len(ones) / max(count, 1.0)
            scale = RIDGE * len(ones) * (1 + PSEUDO_WEIGHT) / 100
            step = np.linalg.solve(h + share * curvature + scale * np.eye(len(w)), g + share * gradient - scale * w)
            moved.append(w + np.clip(step, -5, 5))
        weights = moved
    return model()


def _views(batch: pa.RecordBatch, columns: tuple[str, str, str, str]) -> tuple[np.ndarray, np.ndarray]:
    text, source, lang, size = (batch.column(batch.schema.get_field_index(c)) for c in columns)
    t = np.zeros((batch.num_rows, TEXT_CELLS), np.float32)
    for i, x in enumerate(text):
        t[i] = text_view(x.as_py())
    m = np.zeros((batch.num_rows, META_CELLS), np.float32)
    for i, k in enumerate(zip(source.to_pylist(), lang.to_pylist(), size.to_pylist())):
        m[i] = meta_view(*k)
    return t, m


_NAMES = ("__text", "__source", "__lang", "__size")


def _inputs(columns: tuple[str, str, str, str]) -> list[Column]:
    return [F.col(c).alias(n) for c, n in zip(columns, _NAMES)]


def sample(docs: DataFrame, labels: DataFrame, key: str, label: str, columns: tuple[str, str, str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both views and the labels of the bounded sample, in the order of the hashes:
    one row per labelled id."""
    some = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    some = some.groupBy(F.col(key).alias("of")).agg((F.avg(F.col(label).cast("int")) >= 0.5).cast("int").alias("label"))
    some = stage(some.withColumn("h", F.xxhash64(F.lit(1), "of")).orderBy("h", "of").limit(LABELLED), "labelled")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, m = _views(b, _NAMES)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x.tobytes() for x in t]), pa.array([x.tobytes() for x in m])],
                names=["label", "h", "t", "m"],
            )

    rows = docs.select(F.col(key).alias("__key"), *_inputs(columns)).join(small_side(some), F.col("__key") == F.col("of"))
    one = F.min_by(F.struct(*_NAMES), F.xxhash64(*_NAMES)).alias("d")
    rows = rows.groupBy("of", "h", "label").agg(one).select("label", "h", "d.*")
    found = sorted(rows.mapInArrow(run, "label int, h long, t binary, m binary").collect(), key=lambda r: (r.h, r.t, r.m))
    array = lambda field, width: np.stack([np.frombuffer(r[field], np.float32) for r in found]) if found else np.zeros((0, width), np.float32)
    return array("t", TEXT_CELLS), array("m", META_CELLS), np.array([r.label for r in found])


def described(docs: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    """The text view of all documents in half precision, written once, beside what
    the metadata view needs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [text_view(x.as_py()).astype(np.float16).tobytes() for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.binary()), *b.columns[1:]], names=["__text_view", *_NAMES[1:]])

    rows = docs.select(*_inputs(columns))
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes[1:])
    return stage(rows.mapInArrow(run, f"__text_view binary, {kinds}"), "views")


def exchanged(views: DataFrame, model: Model) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For the text and the metadata view: number, gradient and curvature of all
    documents that the other one is sure of. Each task adds its own up; the sums have
    a fixed size, and their parts are added in parallel."""
    shared = views.sparkSession.sparkContext.broadcast(model)
    sizes = (TEXT_CELLS, META_CELLS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sums = [[0.0, np.zeros(n), np.zeros((n, n))] for n in sizes]
        for whole in batches:
            for lo in range(0, whole.num_rows, 2_000):
                b = whole.slice(lo, 2_000)
                text = np.stack([np.frombuffer(x.as_py(), np.float16) for x in b.column(0)]).astype(np.float32)
                meta = np.stack([meta_view(*k) for k in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))])
                by_text, by_meta, _ = model.scores(text, meta)
                for own, x, w, other in ((sums[0], text, model.text, by_meta), (sums[1], meta, model.meta, by_text)):
                    sure = (other >= SURE) | (other <= 1 - SURE)
                    g, h = _sums(x[sure], (other[sure] >= 0.5).astype(np.float32), w.astype(np.float32))
                    own[0] += float(sure.sum())
                    own[1] += g
                    own[2] += h
        for v, (count, g, h) in enumerate(sums):
            # Row 0 holds the number and the gradient, the others the curvature.
            table = np.vstack([np.append(g, count)[None, :], np.hstack([h, np.zeros((len(g), 1))])])
            yield pa.RecordBatch.from_pydict({
                "view": pa.array([v] * len(table), pa.int32()), "row": pa.array(range(len(table)), pa.int32()),
                "v": pa.array([r.tobytes() for r in table], pa.binary()),
            })

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for v, r, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                total[v, r] = total.get((v, r), 0.0) + np.frombuffer(x)
        if total:
            yield pa.RecordBatch.from_pydict({
                "view": pa.array([v for v, _ in total], pa.int32()), "row": pa.array([r for _, r in total], pa.int32()),
                "v": pa.array([x.tobytes() for x in total.values()], pa.binary()),
            })

    kinds = "view int, row int, v binary"
    parts = views.mapInArrow(run, kinds).repartition(16, "view", "row").mapInArrow(added, kinds).collect()
    out = [np.zeros((n + 1, n + 1)) for n in sizes]
    for r in parts:
        out[r.view][r.row] = np.frombuffer(r.v)
    return [(float(x[0, -1]), x[0, :-1], x[1:, :-1]) for x in out]


COLUMNS = ("text", "source", "lang", "n_chars")
SCORES = ("text_score", "meta_score", "score", "keep")


def score(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
    columns: tuple[str, str, str, str] = COLUMNS, threshold: float = THRESHOLD, prefix: str = "",
) -> DataFrame:
    """``docs`` with both views' probabilities, their combination and ``keep``. The
    new columns, named with ``prefix``, replace columns of the same names."""
    known = sample(docs, labels, key, label, columns)
    views = None

    def exchange(model: Model) -> list[tuple[float, np.ndarray, np.ndarray]]:
        nonlocal views
        views = described(docs, columns) if views is None else views
        return exchanged(views, model)

    model = fit(*known, exchange)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [prefix + n for n in SCORES]
    kept = [c for c in docs.columns if c not in names]
    schema = docs.select(kept).schema
    for n in names:
        schema = schema.add(n, "boolean" if n == names[-1] else "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                b = batch.slice(lo, 1_000)
                t, m, s = shared.value.scores(*_views(b, _NAMES))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i) for i in range(len(kept))), pa.array(t, pa.float64()), pa.array(m, pa.float64()), pa.array(s, pa.float64()), pa.array(s >= threshold)],
                    names=[*kept, *names],
                )

    return docs.select(*kept, *_inputs(columns)).mapInArrow(run, schema)
