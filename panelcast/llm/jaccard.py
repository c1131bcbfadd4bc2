"""N-gram Jaccard self-join through parity sketches.

A document's set is its distinct word shingles, as 64-bit hashes. For sizes between
two powers of two, the hash space is cut into a fixed number of parts; the parity
word of a part is the exclusive or of the hashes in it. One different shingle
changes at most one word, so two sets whose symmetric difference is at most ``d``
differ in at most ``d`` words, and share a word among the first ``d + 1`` of either
in any fixed order of words (a document has to share all but ``d``). Documents meet
on those words; a short parity sketch of single bits, whose Hamming distance is a
lower bound of the difference too, drops most false meetings, and the sets
themselves decide.

Words are ordered by how common they are in all documents (a table of fixed size
counts them), so passages shared by many documents come last and make few meetings.
Equal sets are one class, and only classes meet. A word shared by more than
``LAGS + 1`` classes links each to its neighbours and to the first; whatever such
classes belong to different components afterwards is compared in blocks by sketch,
and by set where the sketch allows a link. No candidate is dropped.

Defined cases: null, empty and blank texts have no shingles and link with nothing;
a text shorter than a shingle is one shingle; a null id never is a component_id
unless all ids of a component are null; repeated rows are equal sets; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import chunks, fixed_total
from panelcast.session import stage

WORDS = 5
PERCENT = 80
#: Bits of the short sketch that is compared first, in 64-bit cells. The wide sketch
#: has four bits per shingle or more.
CELLS = 16
#: Cells of the table that counts words, and bits of the filter of candidates.
COUNTERS = 1 << 20
FILTER = 1 << 24
#: Neighbours that a class meets on each word, besides the first class.
LAGS = 3
#: Classes of one block where all are compared.
BLOCK = 1_000
#: Bytes of text whose shingles are made together, and of words hashed like others.
SLICE, LONG_WORD = 1 << 20, 256

_U = np.uint64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, as 64-bit values."""
    odd = 0x9E3779B97F4A7C15
    base, inverse = (np.full(4 * SLICE, x, np.uint64) for x in (odd, pow(odd, -1, 1 << 64)))
    base[0] = inverse[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where they begin: of a short word a polynomial in its
    bytes, from running sums over all of ``data``."""
    if len(data) > 4 * SLICE:
        one = lambda word: (np.array([xxhash.xxh3_64_intdigest(word)], np.uint64), np.zeros(1, np.int64))
        parts = [(at, one(piece) if is_word else word_hashes(piece)) for at, piece, is_word in _pieces(data)]
        return np.concatenate([h for _, (h, _) in parts]), np.concatenate([at + s for at, (_, s) in parts])
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(_BLANK[raw], prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(raw * power[: len(raw)], out=sums[1:])
    size = (ends - starts).astype(np.uint64)
    h = _mix((sums[ends] - sums[starts]) * inverse[starts] + size * _U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h, starts


def _pieces(data: bytes) -> Iterator[tuple[int, bytes, bool]]:
    """Parts of a long text, cut at white space: where they begin, and whether they are
    one word too long to be taken with others."""
    at = 0
    while at < len(data):
        space = _SPACE.search(data, at + SLICE)
        end = space.start() if space else len(data)
        if end - at <= 4 * SLICE:
            yield at, data[at:end], False
        else:
            begin = max(at, 1 + max(data.rfind(c, at, at + SLICE) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
            yield at, data[at:begin], False
            yield begin, data[begin:end], True
        at = end


def shingle_sets(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of texts, one text after another,
    and the places where each begins and ends."""
    h, starts = word_hashes(b"\n".join(t or b"" for t in texts).lower())
    edges = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    sizes = np.diff(np.searchsorted(starts, edges))
    begin = np.cumsum(sizes) - sizes
    counts = np.where(sizes > 0, np.maximum(sizes - words + 1, 1), 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offsets[-1], np.uint64)
    if len(h) >= words:
        runs = np.full(len(h) - words + 1, words, np.uint64)
        for i in range(words):
            runs = _mix(runs * _U(0x9E3779B97F4A7C15) + h[i : i + len(runs)])
        # Runs that end in their own text, in the same order as their places.
        room = np.repeat(begin + sizes - words, sizes)[: len(runs)]
        full = np.repeat(sizes >= words, counts)
        out[full] = runs[np.arange(len(runs)) <= room]
    for i in np.flatnonzero((sizes > 0) & (sizes < words)).tolist():
        run = np.full(1, sizes[i], np.uint64)
        for x in h[begin[i] : begin[i] + sizes[i]]:
            run = _mix(run * _U(0x9E3779B97F4A7C15) + x)
        out[offsets[i]] = run[0]
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out[lo:hi].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[offsets[:-1][counts > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[offsets]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return shingle_sets([(text or "").encode("utf-8", "surrogatepass")], words)[0]


def set_ids(members: np.ndarray, offsets: np.ndarray) -> list[int | None]:
    """64-bit names of sets: equal sets have equal names, empty ones none."""
    out: list[int | None] = [None] * (len(offsets) - 1)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        at = offsets[:-1][some]
        total = np.add.reduceat(_mix(members), at) ^ np.bitwise_xor.reduceat(members, at) ^ np.diff(offsets)[some].astype(np.uint64)
        for i, name in zip(some.tolist(), _mix(total).view(np.int64).tolist()):
            out[i] = name
    return out


def set_id(s: np.ndarray) -> int:
    """The name of one set."""
    return set_ids(s, np.array([0, len(s)]))[0]


def bit_sketch(s: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Parity per bit position, as signed cells."""
    bits = np.bincount((s >> _U(40)) % _U(64 * cells), minlength=64 * cells) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def wide_cells(n: int) -> int:
    """Cells of a wide sketch: a power of two, of four bits per shingle or more. The
    exclusive or of its halves is the sketch of half the size."""
    return max(CELLS, 1 << max(0, (4 * n - 1) // 64).bit_length())


def most_apart(n: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference between a set of ``n`` and any that it links
    with: |A xor B| <= (100 - p) / (100 + p) (|A| + |B|), |B| <= 100 |A| / p."""
    return (100 - percent) * (n + 100 * n // percent) // (100 + percent)


def schemes(n: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(scheme, parts, difference) of a set's size. Two sets that link share the
    scheme of the smaller one: the larger is less than 1.25 times as large."""
    level = n.bit_length() - 1
    parts = lambda i: 4 << i if i < 4 else 3 << (i - 2)
    out = [(level, parts(level), most_apart(n, percent))]
    below = (1 << level) - 1
    if level and 100 * below >= percent * n:
        out.append((level - 1, parts(level - 1), (100 - percent) * (n + below) // (100 + percent)))
    return out


def parity_words(s: np.ndarray, scheme: int, parts: int) -> np.ndarray:
    """Parity words of the parts that have any shingle, named by scheme and part."""
    part = (s >> _U(20)) % _U(parts)
    order = np.argsort(part, kind="stable")
    part, cells = part[order], s[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    words = np.bitwise_xor.reduceat(cells, first)
    return _mix(words + _mix(part[first] * _U(64) + _U(scheme + 1)))


def _rank(words: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Order of words: by the magnitude of their count in the table, then at random."""
    level = common[words % _U(len(common))].astype(np.uint64)
    return level << _U(56) | words >> _U(8)


def meeting_words(s: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The words on which a set meets others: the first ``d + 1`` per scheme. A
    set with no more than ``d`` words adds the single shingles of a prefix."""
    out, few = [], False
    for scheme, parts, apart in schemes(len(s), percent):
        words = parity_words(s, scheme, parts)
        few |= len(words) <= apart
        if len(words) > apart + 1:
            words = words[np.argpartition(_rank(words, common), apart)[: apart + 1]]
        out.append(words)
    if few:
        prefix = len(s) - -(-percent * len(s) // 100) + 1
        out.append(_mix(s[:prefix] ^ _U(0x5851F42D4C957F2D)))
    return np.concatenate(out)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _named_sets(batch: pa.RecordBatch, column: int, words: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Name and members of every text's set, in order."""
    texts = batch.column(column).cast(pa.binary())
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        members, offsets = shingle_sets(texts[lo:hi].to_pylist(), words)
        at = offsets.tolist()
        for name, a, b in zip(set_ids(members, offsets), at, at[1:]):
            yield name, members[a:b]
        lo = hi


def _describe(texts: DataFrame, words: int) -> tuple[DataFrame, np.ndarray]:
    """First pass: (doc_id, n, fp, sketch, wide) of all documents, and how common
    words are, as magnitudes. A class has its sketches once per task."""
    width = COUNTERS // 64

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        cells, kind = np.zeros(COUNTERS, np.uint32), pa.int64()
        names = ["doc_id", "n", "fp", "sketch", "wide", "block", "cells"]
        for b in batches:
            kind, ids, ns, fps, sketches, wide = b.column(0).type, [], [], [], [], []
            for i, (fp, s) in zip(b.column(0).to_pylist(), _named_sets(b, 1, words)):
                ids.append(i)
                ns.append(len(s))
                fps.append(fp)
                if fp is None or fp in seen:
                    sketches.append(None)
                    wide.append(None)
                    continue
                if len(seen) < 1_000_000:
                    seen.add(fp)
                sketches.append(bit_sketch(s))
                wide.append(bit_sketch(s, wide_cells(len(s))))
                scheme, parts, _ = schemes(len(s))[0]
                np.add.at(cells, parity_words(s, scheme, parts) % _U(COUNTERS), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array(ns, pa.int64()), pa.array(fps, pa.int64()), pa.array(sketches, pa.list_(pa.int64())),
                 pa.array(wide, pa.list_(pa.int64())), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names=names)
        for block in range(64 * bool(seen)):
            none = [pa.nulls(1, t) for t in (kind, pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
            part = cells[block * width : (block + 1) * width].tobytes()
            yield pa.RecordBatch.from_arrays([*none, pa.array([block], pa.int32()), pa.array([part], pa.binary())], names=names)

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, fp long, sketch array<long>, wide array<long>, block int, cells binary"
    both = stage(texts.mapInArrow(run, schema), "sets")
    counts = fixed_total(both.where("block IS NOT NULL"), ["block", "cells"], COUNTERS, _add_block)
    common = np.floor(np.log2(counts + 1.0)).astype(np.uint8)
    return both.where("block IS NULL").select("doc_id", "n", "fp", "sketch", "wide"), common


def _add_block(total: np.ndarray, batch: pa.RecordBatch) -> None:
    width = COUNTERS // 64
    for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        total[i * width : (i + 1) * width] += np.frombuffer(c, np.uint32)


def _words(texts: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """Second pass: (word, fp) of every class, once per task."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, of, size = [], [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_long(np.concatenate(keys)), _long(np.concatenate(of))], names=["word", "fp"])

        for b in batches:
            for fp, s in _named_sets(b, 1, words):
                if fp is None or fp in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(fp)
                w = meeting_words(s, shared.value, percent)
                keys.append(w)
                of.append(np.full(len(w), fp, np.int64))
                size += len(w)
                if size > 100_000:
                    yield rows()
                    keys, of, size = [], [], 0
        if keys:
            yield rows()

    return texts.mapInArrow(run, "word long, fp long")


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, fp), sorted: pairs of classes that meet, and as (fp, null, word)
    the members of words with more classes than all of whose pairs are given."""
    keep = LAGS + 2
    word, fp, hub, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
    for table in chunks(batches, 500_000):
        w = np.concatenate([word, table.column(0).to_numpy()])
        f = np.concatenate([fp, table.column(1).to_numpy()])
        new = np.r_[np.zeros(len(word), bool), np.ones(len(w) - len(word), bool)]
        same = np.r_[False, (w[1:] == w[:-1]) & (f[1:] == f[:-1])]
        w, f, new = w[~same | ~new], f[~same | ~new], new[~same | ~new]
        first = np.r_[True, w[1:] != w[:-1]] if len(w) else np.zeros(0, bool)
        run = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        # The first run may have begun before what is held of it.
        held = int((~new).sum())
        place = np.arange(len(w)) - at[run] + np.where(run == 0, seen - held, 0)
        hubs = f[at][run]
        if held:
            hubs[run == 0] = hub
        pairs = []
        for lag in range(1, LAGS + 1):
            i = np.flatnonzero(new & (place >= lag))
            pairs.append(np.stack([f[i - lag], f[i]]))
        i = np.flatnonzero(new & (place > LAGS))
        pairs.append(np.stack([hubs[i], f[i]]))
        found = np.concatenate(pairs, axis=1)
        if found.shape[1]:
            found = np.stack([found.min(axis=0), found.max(axis=0)], axis=1)
            found = np.unique(found, axis=0)
            for lo in range(0, len(found), 100_000):
                part = found[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([_long(part[:, 0].copy()), _long(part[:, 1].copy()), pa.nulls(len(part), pa.int64())], names=["a", "b", "word"])
        many = np.flatnonzero(new & (place == LAGS + 1))
        members = np.concatenate([i - lag for lag in range(1, LAGS + 2) for i in [many]] + [np.flatnonzero(new & (place > LAGS))])
        for lo in range(0, len(members), 100_000):
            m = members[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([_long(f[m]), pa.nulls(len(m), pa.int64()), _long(w[m])], names=["a", "b", "word"])
        if len(w):
            seen, hub = int(place[-1]) + 1, int(hubs[-1])
            tail = min(keep, seen, len(w) - int(at[-1]))
            word, fp = w[len(w) - tail :], f[len(f) - tail :]


def _differ(a: str, b: str) -> Column:
    """Hamming distance of two sketches; the larger is folded to the smaller's size."""

    def folded(x: str, other: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        both = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) > F.size(other), both).otherwise(F.col(x))

    bits = F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x)


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by their sizes, short sketches and wide sketches."""
    close = lambda a, b: F.lit(100 + percent) * _differ(a, b) <= F.lit(100 - percent) * (F.col("n_a") + F.col("n_b"))
    alike = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    short = lambda x: classes.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    wide = lambda x: classes.select(F.col("fp").alias(x), F.col("wide").alias(f"w_{x}"))
    some = pairs.distinct().join(short("a"), "a").join(short("b"), "b").where(alike & close("s_a", "s_b"))
    some = stage(some.select("a", "b", "n_a", "n_b"), "alike")
    return some.join(wide("a"), "a").join(wide("b"), "b").where(close("w_a", "w_b")).select("a", "b", "n_a", "n_b")


def _sets(near: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(fp, members): the sets of the classes in ``near``. A bit filter of fixed size
    keeps most other sets from being sent at all."""
    wanted = near.select(F.explode(F.array("a", "b")).alias("fp"))
    bits = texts.sparkSession.sparkContext.broadcast(fixed_total(wanted, ["fp"], FILTER // 32, _mark, combine="or"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "members"])
        for b in batches:
            fps, sets, size = [], [], 0
            for fp, s in _named_sets(b, 1, words):
                if fp is None or fp in seen or not _marked(bits.value, fp):
                    continue
                if len(seen) < 1_000_000:
                    seen.add(fp)
                fps.append(fp)
                sets.append(s.view(np.int64).copy())
                size += len(s)
                if size > 500_000:
                    yield batch()
                    fps, sets, size = [], [], 0
            if fps:
                yield batch()

    sets = texts.mapInArrow(run, "fp long, members array<long>").join(wanted.distinct(), "fp", "left_semi")
    return stage(sets.dropDuplicates(["fp"]), "members")


def _verified(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    one = sets.select(F.col("fp").alias("a"), F.col("members").alias("of_a"))
    other = sets.select(F.col("fp").alias("b"), F.col("members").alias("of_b"))
    return (
        near.join(one, "a").join(other, "b").withColumn("both", F.size(F.array_intersect("of_a", "of_b")))
        .where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("both")))
        .select("a", "b")
    )


def _linked(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components of the links among ``near``: first each class is compared with its
    least partner, then whatever pairs are not in one component yet."""
    least = F.min("a").over(Window.partitionBy("b"))
    first = near.withColumn("least", least).where(F.col("a") == F.col("least")).drop("least")
    roots = components(_verified(first, sets, percent))
    open_pairs = stage(_apart(near, roots), "open_pairs")
    return roots if open_pairs.isEmpty() else extended(roots, _verified(open_pairs, sets, percent))


def _apart(near: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose classes are in different components."""
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r_{x}"))
    rows = near.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return rows.where(F.coalesce("r_a", "a") != F.coalesce("r_b", "b")).select("a", "b", "n_a", "n_b")


def _mark(cells: np.ndarray, batch: pa.RecordBatch) -> None:
    bit = _mix(batch.column(0).to_numpy().view(np.uint64)) % _U(FILTER)
    np.bitwise_or.at(cells, bit >> _U(5), np.uint32(1) << (bit & _U(31)).astype(np.uint32))


def _marked(cells: np.ndarray, fp: int) -> bool:
    bit = int(_mix(np.array([fp], np.int64).view(np.uint64))[0] % _U(FILTER))
    return bool(int(cells[bit >> 5]) >> (bit & 31) & 1)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for nodes of links (a, b). Each
    round points all larger neighbours of a node at its smallest one, then all
    smaller ones, until nothing moves."""
    edges = stage(links.select("a", "b").where("a <> b").distinct(), "edges")

    def hooked(e: DataFrame, larger: bool) -> DataFrame:
        ways = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if larger:
            ways = ways.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            ways = ways.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = ways.groupBy(F.col("u").alias("of")).agg(F.least(F.min("v"), F.any_value("u")).alias("least"))
        new = ways.join(least, F.col("u") == F.col("of"))
        if larger:
            new = new.where("v > u").select(F.col("v").alias("a"), F.col("least").alias("b"))
        else:
            new = new.select(F.col("v").alias("a"), F.col("least").alias("b")).unionByName(
                least.select(F.col("of").alias("a"), F.col("least").alias("b"))
            )
        return new.where("a <> b").distinct()

    state = None
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        edges = stage(hooked(hooked(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(now)


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components of ``roots`` and further links (a, b). Only links between different
    components are searched, as links of their roots."""
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r_{x}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    moved = components(between.select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b")))
    to = moved.select(F.col("node").alias("of"), F.col("root").alias("to"))
    kept = roots.join(to, F.col("root") == F.col("of"), "left").select("node", F.coalesce("to", "root").alias("root"))
    return stage(kept.unionByName(moved), "roots")


def _blocks(members: DataFrame, roots: DataFrame, classes: DataFrame, percent: int) -> DataFrame | None:
    """Pairs that may link among the members of common words, between different
    components (None without such members). The members of one word are compared
    block by block."""
    rows = members.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("word", "fp", F.coalesce("root", "fp").alias("root"))
    open_words = rows.groupBy(F.col("word").alias("of")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"))
    open_words = open_words.where("lo <> hi").select("of", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = stage(rows.join(open_words, F.col("word") == F.col("of")).select("word", "fp", "root", "blocks"), "open")
    if rows.isEmpty():
        return None
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long")).cast("int")
    rows = rows.join(classes.select("fp", "n", "sketch"), "fp").withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("word", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "fp", "root", "n", "sketch")

    def compare(group: pa.Table) -> pa.RecordBatch:
        mine, i, j = (group.column(c).to_numpy() for c in ("mine", "i", "j"))
        fp, root, n = (group.column(c).to_numpy() for c in ("fp", "root", "n"))
        sketch = np.stack([np.array(x, np.int64) for x in group.column("sketch").to_pylist()])
        left = np.flatnonzero(mine == i[0])
        right = np.flatnonzero(mine == j[0])
        found = []
        for x in left:
            other = right[fp[right] > fp[x]] if i[0] == j[0] else right
            other = other[(root[other] != root[x]) & (100 * np.minimum(n[other], n[x]) >= percent * np.maximum(n[other], n[x]))]
            differ = np.bitwise_count((sketch[other] ^ sketch[x]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            other = other[(100 + percent) * differ <= (100 - percent) * (n[other] + n[x])]
            found.append(np.stack([np.full(len(other), fp[x]), fp[other]]))
        found = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([_long(found.min(axis=0)), _long(found.max(axis=0))], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for b in batches:
            w, i, j = (b.column(c).to_numpy() for c in ("word", "i", "j"))
            cut = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            for lo, hi in zip(cut, np.r_[cut[1:], len(w)]):
                key = (w[lo], i[lo], j[lo])
                if key != at and held:
                    yield compare(pa.Table.from_batches(held))
                    held = []
                at = key
                held.append(b.slice(lo, hi - lo))
        if held:
            yield compare(pa.Table.from_batches(held))

    return rows.repartition("word", "i", "j").sortWithinPartitions("word", "i", "j").mapInArrow(run, "a long, b long")


def link_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """Per document: size of its set, and the smallest id reachable by links."""
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    described, common = _describe(texts, words)
    classes = stage(
        described.where("fp IS NOT NULL").groupBy("fp")
        .agg(F.max("n").alias("n"), F.any_value("sketch", True).alias("sketch"), F.any_value("wide", True).alias("wide"), F.min("doc_id").alias("least")),
        "classes",
    )
    meetings = _words(texts, words, percent, common).repartition(F.col("word")).sortWithinPartitions("word", "fp")
    met = stage(meetings.mapInArrow(_meet, "a long, b long, word long"), "met")
    near = stage(_near(met.where("word IS NULL").select("a", "b"), classes, percent), "near")
    roots = _linked(near, _sets(near, texts, words), percent)
    rest = _blocks(met.where("word IS NOT NULL").select("word", F.col("a").alias("fp")), roots, classes, percent)
    rest = None if rest is None else stage(_near(rest, classes, percent), "near")
    if rest is not None and not rest.isEmpty():
        more = _linked(rest, _sets(rest, texts, words), percent)
        roots = extended(roots, more.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    named = stage(named.join(smallest, F.col("root") == F.col("of")).select(F.col("fp").alias("of"), "component_id"), "named")
    rows = described.join(named, F.col("fp") == F.col("of"), "left")
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
