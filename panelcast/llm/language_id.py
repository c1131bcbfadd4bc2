"""Language identification by cross-parsing.

Per language, a suffix automaton of labelled text gives the longest match from any
place of a new text. The text is parsed from left to right into such longest
matches; the language that needs the fewest phrases wins, each phrase counted as the
bits of a place in that language's sample, per character. Many pieces of text are parsed
at once: one step moves all of them, in all languages, by one character through one
table.

The models are fitted on a bounded sample: ``sample_chars`` characters over all
languages together. The sample is broadcast; each Python worker builds the automata
once.

Defined cases: null text, or text without letters, is ``und`` with score 0; a null
lang is never learnt from; without labelled text everything is ``und``; with one
language its score is 1; ties go to the first language by code point; repeated rows
are predicted one by one; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import small_side
from panelcast.session import stage

#: Bounds of the sample: documents per language, characters of one document, and
#: characters of all languages together.
SAMPLE_DOCS = 200
DOC_CHARS = 800
SAMPLE_CHARS = 160_000
#: A text is parsed in pieces of this many characters, so many pieces at once.
PIECE = 256
AT_ONCE = 8_192
#: Code points with a column of their own in the tables, less one; the transitions by
#: rarer ones of the samples are kept apart.
ALPHABET = 80



def held_out(key: Column) -> Column:
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1


class Transitions:
    """``table[state, symbol]``, with a column for symbols below ``width`` only."""

    def __init__(self, states: int, width: int) -> None:
        self.dense, self.width = np.zeros((states, width), np.int32), width
        self.rare: dict[int, dict[int, int]] = {}

    def __getitem__(self, at: tuple[int, int]) -> int:
        state, symbol = at
        return int(self.dense[state, symbol]) if symbol < self.width else self.rare.get(state, {}).get(symbol, 0)

    def __setitem__(self, at: tuple[int, int], to: int) -> None:
        state, symbol = at
        if symbol < self.width:
            self.dense[state, symbol] = to
        else:
            self.rare.setdefault(state, {})[symbol] = to

    def copy(self, of: int, to: int) -> None:
        self.dense[to] = self.dense[of]
        if of in self.rare:
            self.rare[to] = dict(self.rare[of])


def automaton(symbols: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``symbols``: ``table[state, symbol]``
    is the next state, or 0; state 1 is the start."""
    return transitions(symbols, width)[0]


def transitions(symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The table of :func:`automaton`, and (state, symbol, next state) rows for
    symbols from ``width`` on."""
    n = 2 * len(symbols) + 2
    table = Transitions(n, width)
    link, length = [0] * n, [0] * n
    states, last = 2, 1
    for symbol in symbols.tolist():
        new = states
        states += 1
        length[new] = length[last] + 1
        p = last
        while p and not table[p, symbol]:
            table[p, symbol] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = table[p, symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = states
                states += 1
                length[copy], link[copy] = length[p] + 1, link[q]
                table.copy(q, copy)
                while p and table[p, symbol] == q:
                    table[p, symbol] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    rare = [(p, symbol, to) for p, by in table.rare.items() for symbol, to in by.items()]
    return table.dense[:states], np.array(rare, np.int64).reshape(-1, 3)


def has_letter(text: str | None) -> bool:
    """Whether any character is of a letter category; number forms are none."""
    return any(map(str.isalpha, text or ""))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Model:
    languages: list[str]
    #: Symbol of a code point; 0 for those without one.
    symbols: np.ndarray
    #: All automata in one table, and where each starts.
    table: np.ndarray
    starts: np.ndarray
    #: Transitions by symbols without a column: the key of state and symbol, in
    #: order, and the next state; and the next state from each start by any symbol.
    rare_keys: np.ndarray
    rare_to: np.ndarray
    firsts: np.ndarray
    #: Bits of a phrase.
    bits: np.ndarray

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of every text in every language."""
        width = self.table.shape[1]
        flat, langs = self.table.ravel(), len(self.languages)
        counts = np.zeros((len(texts), langs))
        of, rows = [], []
        for i, t in enumerate(texts):
            s = self.symbols[np.minimum(t, len(self.symbols) - 1)]
            for at in range(0, len(s), PIECE):
                of.append(i)
                rows.append(s[at : at + PIECE])
        for lo in range(0, len(rows), AT_ONCE):
            part = rows[lo : lo + AT_ONCE]
            sizes = np.array([len(r) for r in part])
            order = np.argsort(-sizes, kind="stable")
            sizes = sizes[order]
            grid = np.zeros((PIECE, len(part)), np.int64)
            for j, o in enumerate(order):
                grid[: sizes[j], j] = part[o]
            alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
            origin = self.starts.astype(np.int64)[:, None] * width
            state = np.repeat(origin, len(part), axis=1)
            found = np.zeros((langs, len(part)))
            for step in range(int(sizes[0])):
                n = int(alive[step])
                symbol = grid[step, :n]
                to = flat[state[:, :n] + np.where(symbol < width, symbol, 0)].astype(np.int64) * width
                if symbol.max() >= width:
                    # Only automata of samples with that symbol can go on.
                    lang, at = np.nonzero((symbol >= width) & (self.firsts[:, symbol] > 0))
                    keys = state[lang, at] // width * self.firsts.shape[1] + symbol[at]
                    near = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
                    to[lang, at] = np.where(self.rare_keys[near] == keys, self.rare_to[near], 0) * width
                ends = to == 0
                if ends.any():
                    # The phrase ends before this character, which begins the next one.
                    again = self.firsts[:, symbol] * width
                    fresh = np.where(again == 0, origin, again)
                    to = np.where(ends, fresh, to)
                    # A character that matches nothing is a phrase of its own.
                    found[:, :n] += ends & (state[:, :n] != origin)
                    found[:, :n] += ends & (again == 0)
                state[:, :n] = to
            found += state != origin
            np.add.at(counts, np.array(of)[lo : lo + AT_ONCE][order], found.T)
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        which = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for lo in range(0, len(which), 512):
            part = which[lo : lo + 512]
            points = [code_points(texts[i]) for i in part]
            rate = self.phrases(points) / np.array([[len(p)] for p in points]) * self.bits
            best = rate.argmin(axis=1)
            for i, r, b in zip(part, rate, best):
                others = np.delete(r, b)
                langs[i] = self.languages[b]
                scores[i] = float(others.min() / (others.min() + r[b])) if len(others) else 1.0
        return langs, scores


@functools.lru_cache(maxsize=1)
def fit(sample: tuple[tuple[str, str], ...], sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model of (lang, text) rows."""
    by: dict[str, list[str]] = {}
    for lang, text in sample:
        by.setdefault(lang, []).append(text)
    languages = sorted(by)
    share = max(64, sample_chars // max(1, len(languages)))
    points = [code_points("\n".join(by[x]))[:share] for x in languages]
    every = np.concatenate(points) if points else np.zeros(0, np.uint32)
    seen, counts = np.unique(every, return_counts=True)
    kept = seen[np.lexsort((seen, -counts))]
    symbols = np.zeros(int(kept.max()) + 2 if len(kept) else 1, np.int64)
    symbols[kept] = np.arange(1, len(kept) + 1)
    tables, starts, rare, at = [], [], [np.zeros((0, 3), np.int64)], 0
    firsts = np.zeros((len(languages), len(kept) + 1), np.int64)
    for i, p in enumerate(points):
        # Symbol 0 is in the text of no automaton: it always ends a phrase.
        t, apart = transitions(symbols[p], ALPHABET)
        tables.append(np.where(t > 0, t + at, 0).astype(np.int32))
        rare.append(apart + [at, 0, at])
        own = min(ALPHABET, firsts.shape[1])
        firsts[i, :own] = tables[-1][1, :own]
        from_start = rare[-1][rare[-1][:, 0] == at + 1]
        firsts[i, from_start[:, 1]] = from_start[:, 2]
        starts.append(at + 1)
        at += len(t)
    table = np.concatenate(tables) if tables else np.zeros((1, ALPHABET), np.int32)
    bits = np.log2(np.array([len(p) + 1.0 for p in points]))
    apart = np.concatenate(rare)
    keys = apart[:, 0] * firsts.shape[1] + apart[:, 1]
    order = np.argsort(keys)
    return Model(languages, symbols, table, np.array(starts, np.int64), keys[order], apart[order, 2], firsts, bits)


def sample_rows(docs: DataFrame, key: str, text: str, lang: str, learn: Column, seed: int = 7) -> tuple[tuple[str, str], ...]:
    """A bounded sample per language, the same on every run: a passage of each of the
    distinct texts with the smallest hashes."""
    h = F.xxhash64(F.lit(seed), F.col(text))
    known = docs.where(learn & F.col(lang).isNotNull() & (F.length(text) > 0))
    rows = known.select(F.col(lang).alias("of"), h.alias("at")).distinct()
    order = F.row_number().over(Window.partitionBy("of").orderBy("at"))
    chosen = stage(rows.withColumn("n", order).where(F.col("n") <= SAMPLE_DOCS).select("of", "at"), "sample")
    texts = known.join(small_side(chosen), (F.col(lang) == F.col("of")) & (h == F.col("at")))
    room = F.greatest(F.length(text) - DOC_CHARS, F.lit(0)) + 1
    passage = F.substring(F.col(text), (F.pmod(F.xxhash64(F.lit(seed + 1), "at"), room) + 1).cast("int"), F.lit(DOC_CHARS))
    found = texts.select("of", "at", passage.alias("text")).dropDuplicates(["of", "at"])
    return tuple((r.of, r.text) for r in found.orderBy("of", "at").collect())


def identify(docs: DataFrame, sample: tuple[tuple[str, str], ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Language and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                langs, scores = model.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    sample = sample_rows(docs, key, text, lang, F.coalesce(~held_out(F.col(key)), F.lit(True)))
    return identify(docs, sample, key, text).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
