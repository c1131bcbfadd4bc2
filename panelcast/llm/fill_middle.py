"""Fill-in-the-middle rewriting by displacement scatter.

A text is cut into prefix, middle and suffix; the output moves the middle to the end
and marks where each part begins. Within a batch the cuts of all texts are the places
at which the displacement of the bytes changes: the changes form a difference array,
its running sum is every byte's displacement, and one scatter writes all outputs. The
way back finds the marks, forms the displacements of the text to be rebuilt, and
gathers. Both run over windows of ``WINDOW`` bytes, so besides the texts and outputs of
one slice memory is fixed, however long a text is.

The cuts depend on the key and the length only, so reruns and lost tasks give the
same rows; no row is shuffled.

Defined cases: null text counts as empty; an empty text and a text that holds a mark
stay plain; a cut at either end or two equal cuts give empty parts; a null key is
hashed as the empty string; repeated rows are rewritten one by one; other columns
are kept, and those that bear the name of a new one are replaced; an empty table
gives no rows; ``restore`` gives null for an output whose marks don't fit its form.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares of texts, in hundredths: rewritten at all, and of these suffix first.
REWRITTEN, SUFFIX_FIRST = 90, 20
#: Bytes of text handled together, and bytes displaced in one step.
SLICE = 4 << 20
WINDOW = 1 << 20
#: Bytes whose code points are counted together.
_RUN = 4096
_MARK = 3
FORMS = ("plain", "psm", "spm")


def _word(key: Column, n: int) -> Column:
    """The n-th group of eight hexadecimal digits of the key's hash."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * n - 7, 8), 16, 10).cast("long")


def plan(key: Column, text: Column, rewritten: int = REWRITTEN, suffix_first: int = SUFFIX_FIRST) -> dict[str, Column]:
    """Length, form and cuts of a text, in code points."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text).cast("long")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (n == 0) | marked | (_word(key, 3) % 100 >= rewritten)
    one, two = _word(key, 1) % (n + 1), _word(key, 2) % (n + 1)
    return {
        "n": n,
        "form": F.when(plain, "plain").when(_word(key, 4) % 100 < suffix_first, "spm").otherwise("psm"),
        "prefix_chars": F.when(~plain, F.least(one, two)),
        "middle_chars": F.when(~plain, F.abs(one - two)),
    }


def displace(source: np.ndarray, size: int, starts: np.ndarray, shifts: np.ndarray, scatter: bool, out: np.ndarray) -> None:
    """Move bytes: those from ``starts[i]`` to the next start are ``shifts[i]`` away.

    With ``scatter`` the places are those of ``source`` and byte ``i`` goes to ``i``
    plus its shift of ``out``; else they are those of ``out``, which gathers. Starts
    ascend; of equal ones the last counts.
    """
    changes = np.diff(shifts, prepend=0)
    before = 0
    for lo in range(0, size, WINDOW):
        hi = min(lo + WINDOW, size)
        a, b = np.searchsorted(starts, [lo, hi])
        shift = np.zeros(hi - lo, np.int64)
        np.add.at(shift, starts[a:b] - lo, changes[a:b])
        shift[0] += before
        np.cumsum(shift, out=shift)
        before = shift[-1]
        places = shift + np.arange(lo, hi)
        if scatter:
            out[places] = source[lo:hi]
        else:
            out[lo:hi] = source[places]


def byte_places(data: np.ndarray, base: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Where the code point begins that is ``chars`` after byte ``base``."""
    lead = (data & 0xC0) != 0x80
    edges = np.arange(0, len(data), _RUN)
    before = np.concatenate([[0], np.cumsum(np.add.reduceat(lead, edges, dtype=np.int64))]) if len(data) else np.zeros(1, np.int64)
    run = base // _RUN
    origin = before[run] + [int(lead[r * _RUN : b].sum()) for r, b in zip(run.tolist(), base.tolist())]
    target = origin + chars
    out = np.empty(len(base), np.int64)
    for i, t in enumerate(target.tolist()):
        r = int(np.searchsorted(before, t, "right")) - 1
        if r * _RUN >= len(data):
            out[i] = len(data)
        else:
            out[i] = r * _RUN + np.flatnonzero(lead[r * _RUN : (r + 1) * _RUN])[t - before[r]]
    return out


def _marks(out: np.ndarray, at: np.ndarray, mark: str) -> None:
    out[at[:, None] + np.arange(_MARK)] = np.frombuffer(mark.encode(), np.uint8)


def rewrite(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, prefix: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the outputs of texts, cut after ``prefix`` and ``prefix``
    plus ``middle`` code points; ``form`` indexes ``FORMS``."""
    begin, end = offsets[:-1], offsets[1:]
    moved = form > 0
    a, b = begin.copy(), begin.copy()
    a[moved] = byte_places(data, begin[moved], prefix[moved])
    b[moved] = byte_places(data, begin[moved], (prefix + middle)[moved])
    to = np.concatenate([[0], np.cumsum(end - begin + 3 * _MARK * moved)]).astype(np.int64)
    out = np.empty(to[-1], np.uint8)
    at = to[:-1]
    first, last = a - begin, end - b
    spm, psm = form == 2, form == 1
    # Where each part of the output begins; a plain text is all suffix.
    p = np.where(spm, at + last + 2 * _MARK, at + _MARK * psm)
    s = np.where(spm, at + _MARK, at + (first + 2 * _MARK) * psm)
    m = np.where(moved, at + first + last + 3 * _MARK, at)
    starts = np.stack([begin, a, b], axis=1).ravel()
    shifts = np.stack([p - begin, m - a, s - b], axis=1).ravel()
    displace(data, len(data), starts, shifts, True, out)
    for start, mark in ((p, PREFIX), (s, SUFFIX), (m, MIDDLE)):
        _marks(out, start[moved] - _MARK, mark)
    return out, to


def rebuild(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that gave outputs, and which could be rebuilt."""
    begin, end = offsets[:-1], offsets[1:]
    moved = form > 0
    found = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">"))) if len(data) > 2 else np.zeros(0, np.int64)
    found = found[np.isin(data[found + 1], np.frombuffer(b"PSM", np.uint8))]
    of = np.searchsorted(offsets, found, "right") - 1
    inside = (found + _MARK <= end[of]) & moved[of]
    found, of = found[inside], of[inside]
    count = np.bincount(of, minlength=len(begin))
    three = moved & (count == 3)
    marks = np.repeat(begin[:, None], 3, axis=1)
    marks[three] = found[three[of]].reshape(-1, 3)
    kinds = data[np.minimum(marks + 1, max(0, len(data) - 1))] if len(data) else np.zeros((len(begin), 3), np.uint8)
    order = np.where((form == 2)[:, None], np.frombuffer(b"SPM", np.uint8), np.frombuffer(b"PSM", np.uint8))
    three &= (kinds == order).all(axis=1) & (marks[:, 0] == begin)
    sound = ~moved | three
    spm = three & (form == 2)
    x, y, z = (marks[:, i] for i in range(3))
    p = np.where(three, np.where(spm, y, x) + _MARK, begin)
    first = np.where(three, np.where(spm, z, y) - p, 0)
    s = np.where(three, np.where(spm, x, y) + _MARK, begin)
    last = np.where(three, np.where(spm, y, z) - s, np.where(sound, end - begin, 0))
    m = np.where(three, z + _MARK, begin)
    inner = np.where(three, end - m, 0)
    to = np.concatenate([[0], np.cumsum(first + inner + last)]).astype(np.int64)
    at = to[:-1]
    starts = np.stack([at, at + first, at + first + inner], axis=1)
    shifts = np.stack([p, m, s], axis=1) - starts
    out = np.empty(to[-1], np.uint8)
    displace(data, len(out), starts.ravel(), shifts.ravel(), False, out)
    return out, to, sound


def _slices(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``SLICE`` bytes: first row, end, bytes and offsets."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())


def _forms(column: pa.Array) -> np.ndarray:
    codes = {f: i for i, f in enumerate(FORMS)}
    return np.array([codes.get(f, 0) for f in column.to_pylist()], np.int64)


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: str = "fim_",
    rewritten: int = REWRITTEN, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """``docs`` with length, form, cuts and output of every whole text, in columns
    named with ``prefix``: n, form, prefix_chars, middle_chars, output."""
    columns = plan(F.col(key), F.col(text), rewritten, suffix_first)
    names = [prefix + c for c in (*columns, "output")]
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(*kept, *[c.alias(prefix + n) for n, c in columns.items()], F.coalesce(F.col(text), F.lit("")).alias(names[-1]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _slices(batch.column(batch.num_columns - 1)):
                b = batch.slice(lo, hi - lo)
                cuts = [b.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (-3, -2)]
                out = rewrite(data, offsets, _forms(b.column(-4)), *cuts)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], _strings(*out)], names=b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def restore(rows: DataFrame, output: str = "fim_output", form: str = "fim_form", into: str = "fim_restored") -> DataFrame:
    """``rows`` with the text rebuilt from output and form; null where they don't fit."""
    kept = [c for c in rows.columns if c != into]
    given = rows.select(*kept, F.coalesce(F.col(form), F.lit("plain")).alias("__form"), F.coalesce(F.col(output), F.lit("")).alias("__output"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _slices(batch.column(batch.num_columns - 1)):
                b = batch.slice(lo, hi - lo)
                text, to, sound = rebuild(data, offsets, _forms(b.column(-2)))
                texts = pa.compute.if_else(pa.array(sound), _strings(text, to), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], texts], names=[*kept, into])

    return given.mapInArrow(run, rows.select(kept).schema.add(into, "string"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: form and cuts, hashes of the output and of the text
    rebuilt from it."""
    rows = restore(transform(docs.select(key, text), key, text).drop(text))
    return rows.select(
        F.col(key).alias("doc_id"), F.col("fim_n").alias("n"), F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"), F.sha2("fim_restored", 256).alias("restored_sha256"),
    )
