"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton finds all pieces of the vocabulary that end at each place
of a word; dynamic programming keeps the best score and how many tokens reach it.
Of equal scores the piece that begins first wins, a later one must be better, which
is the rule of the tokenizer: it goes through the text by the starts of pieces and
replaces only by a greater score. A character that no piece of one character covers
costs the least score of the vocabulary minus ten, and counts as its UTF-8 bytes.

Spaces become the mark of a word's beginning, and every text begins with one. A text
is cut before a mark only where no piece of the vocabulary goes across: a run of marks
is counted together with the word after it, and where a piece has a mark after other
characters, the text around it stays whole. Units met before are looked up.

The scores decide: a vocabulary of merges is counted as the unigram model that its
scores make, not by its merge order.

Defined cases: null text counts as empty; an empty text has no tokens; repeated
rows are counted one by one; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
UNKNOWN_COST = 10.0
#: Words kept in one of two generations, and the longest that is kept.
KEPT, LONG = 300_000, 64


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a model file, in the order of ids, without those that text
    never matches: control, unknown, byte and unused pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    apart = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not apart(i)]


class Counter:
    """Counts the tokens of words; all byte pieces are taken to be in the vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, value in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), value))
        self.automaton.make_automaton()
        self.unknown = min((v for _, v in vocabulary), default=0.0) - UNKNOWN_COST
        # Where a piece goes across a cut, on either side of it at least one character.
        self.across = {piece[i - 1 : i + 1] for piece, _ in vocabulary for i in range(1, len(piece)) if piece[i] == MARK != piece[i - 1]}
        self.words: dict[str, tuple[int, float]] = {}
        self.older: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Tokens and best score of one word."""
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (size, value) in self.automaton.iter(word):
            ends[last + 1].append((size, value))
        for end in range(1, n + 1):
            # From the first start to the last: only a greater score replaces.
            top, tokens = None, 0
            found = sorted(ends[end], reverse=True)
            for size, value in found:
                total = best[end - size] + value
                if top is None or total > top:
                    top, tokens = total, count[end - size] + 1
            if not found or found[-1][0] > 1:
                total = best[end - 1] + self.unknown
                if top is None or total > top:
                    top, tokens = total, count[end - 1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            best[end], count[end] = top, tokens
        return count[n], best[n]

    def units(self, marked: str) -> list[str]:
        """Parts of a text that no piece goes across, each with its marks before it."""
        units = UNIT.findall(marked)
        if not self.across:
            return units
        out = units[:1]
        for u in units[1:]:
            if out[-1][-1] + MARK in self.across:
                out[-1] += u
            else:
                out.append(u)
        return out

    def text(self, text: str) -> tuple[int, float]:
        """Tokens and score of a text."""
        marked = text.replace(" ", MARK)
        if not marked:
            return 0, 0.0
        if marked[0] != MARK:
            marked = MARK + marked
        words, older, tokens, score = self.words, self.older, 0, 0.0
        for w in self.units(marked):
            found = words.get(w)
            if found is None:
                found = older.get(w) or self.word(w)
                if len(w) <= LONG:
                    if len(words) >= KEPT:
                        self.older = older = words
                        self.words = words = {}
                    words[w] = found
            tokens += found[0]
            score += found[1]
        return tokens, score


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of tokens and score of the best segmentation of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in batches:
            found = [counter.text(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "n_tokens", "score"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")
