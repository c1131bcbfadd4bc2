"""Byte-level BPE: encoding by a transducer that is built as it is needed, and
streaming decoding.

The rank file is compiled into a transducer over bytes. A state is the longest end of
the bytes read with which a token can begin; it holds the tokens that can end there.
Reading a byte finds the one token that does, by the rule that a sequence of tokens
is the encoding of its bytes exactly if every two neighbours are. The last token is
noted for every open byte. A token is emitted as soon as every continuation goes
through it; tokens have a greatest length, so the lookahead is bounded. States and
arcs are made when first met and kept up to a limit, then made anew. Short pieces
of several texts go through the transducer side by side, a byte of each at a time.

Defined cases: null text is empty; an empty text has no tokens; ids that the
vocabulary doesn't know raise; other columns are kept by :func:`encode`.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def read_ranks(path: str) -> list[bytes]:
    """Token bytes in the order of their ranks, from a rank file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


#: Bytes of a long piece that are read between two looks for tokens that are settled.
LOOKAHEAD = 64
#: Characters of the longest piece that is short and kept.
LONG = 64
#: Words of one generation, and pairs of tokens, that a task keeps: with them and the
#: states a task grew by 72 MB over 8,000 texts.
WORDS, PAIRS = 80_000, 131_072
#: Pieces that are read side by side, and characters of the texts that they come from.
SIDE, CHARS = 16_384, 400_000


class Transducer:
    """Encodes byte strings by the ranks of merges, one byte at a time. Ids of a
    piece are kept as the bytes of 32-bit numbers."""

    def __init__(self, tokens: list[bytes], most_states: int = 20_000, most_words: int = WORDS) -> None:
        self.tokens = tokens
        self.sizes = np.array(list(map(len, tokens)), np.int32)
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.bytes = np.array([self.ranks.get(bytes((i,)), -1) for i in range(256)], np.int32)
        self.prefixes = {t[:n] for t in self.ranks for n in range(1, len(t) + 1)}
        self.most_states, self.most_words = most_states, most_words
        # A pair and whether it fits, at the place that its hash gives.
        self.pairs = np.full(PAIRS, -1, np.int64)
        # Pairs that joined are a token, in order, and that token; the halves of tokens.
        joins = np.fromiter(self._splits(), np.dtype((np.int64, 2)))
        self.joins, self.joined = joins[np.argsort(joins[:, 0])].T.copy()
        self.halves = np.full((2, len(tokens)), -2, np.int32)
        self.made: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.edges: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._forget()

    def _splits(self) -> Iterator[tuple[int, int]]:
        for whole, i in self.ranks.items():
            for n in range(1, len(whole)):
                left = self.ranks.get(whole[:n])
                if left is not None:
                    right = self.ranks.get(whole[n:])
                    if right is not None:
                        yield left << 31 | right, i
        yield 1 << 62, 0

    def _forget(self) -> None:
        self.states: dict[bytes, int] = {}
        self.open: list[bytes] = []
        # By state: the state after a byte; the token of several bytes that it is; the
        # state of the longest such token that ends there, and of the next shorter one.
        # State 0 is the start, which nothing leads to: there 0 means none.
        self.arcs = np.zeros((1_024, 256), np.int32)
        self.token, self.top, self.shorter = np.zeros((3, 1_024), np.int32)
        self._state(b"")

    def _state(self, pending: bytes) -> int:
        found = self.states.get(pending)
        if found is None:
            shorter = 0
            for at in range(1, len(pending) - 1):
                if self._token(pending[at:]) >= 0:
                    shorter = self._state(pending[at:])
                    break
            found = self.states[pending] = len(self.open)
            self.open.append(pending)
            if found == len(self.arcs):
                for name in ("arcs", "token", "top", "shorter"):
                    kept = getattr(self, name)
                    more = np.zeros((2 * found, *kept.shape[1:]), np.int32)
                    more[:found] = kept
                    setattr(self, name, more)
            self.token[found] = self._token(pending)
            self.top[found] = found if self.token[found] >= 0 else shorter
            self.shorter[found] = shorter
        return found

    def _token(self, piece: bytes) -> int:
        """The token of several bytes that merges make of ``piece``, or -1."""
        token = self.ranks.get(piece, -1) if len(piece) > 1 else -1
        return token if token >= 0 and self._halves(piece) is not None else -1

    def _arc(self, state: int, byte: int) -> int:
        """The state after a byte."""
        if self.bytes[byte] < 0:
            raise ValueError(f"The vocabulary has no token for byte {byte}.")
        pending = self.open[state] + bytes((byte,))
        while pending not in self.prefixes:
            pending = pending[1:]
        after = self._state(pending)
        self.arcs[state, byte] = after
        return after

    def merged(self, text: bytes) -> list[bytes]:
        """The merges by definition: lowest rank first, leftmost of equals."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            found = [(self.ranks.get(parts[i] + parts[i + 1], len(self.tokens)), i) for i in range(len(parts) - 1)]
            rank, i = min(found)
            if rank == len(self.tokens):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The last merge that makes a token; none for a byte, or where the merges
        of its bytes don't give the token."""
        known = self.made.get(token, False)
        if known is False:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], len(self.tokens)), i) for i in range(len(parts) - 1))
                if rank == len(self.tokens):
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = self.made[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return known

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the left (0) or right (1) edge while a token is merged,
        from its outer byte to itself, each with the rank that ends it."""
        key = (token, side)
        edge = self.edges.get(key)
        if edge is None:
            edge, piece, rank = [], self.tokens[token], len(self.tokens)
            while True:
                edge.append((piece, rank))
                halves = self._halves(piece) if len(piece) > 1 else None
                if halves is None:
                    break
                rank, piece = self.ranks[piece], halves[side]
            edge.reverse()
            self.edges[key] = edge
        return edge

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether no merge joins the two tokens before both are complete. Ranks
        grow with the merges that build on them, so it is enough to walk along the
        facing edges in the order in which their parts are merged."""
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.ranks.get(x + y)
            if rank is not None and rank < x_ends and rank <= y_ends:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _half(self, ids: np.ndarray, side: int) -> np.ndarray:
        """The left (0) or right (1) halves of tokens; -1 where :meth:`_halves` has none."""
        for token in np.unique(ids[self.halves[side][ids] == -2]).tolist():
            halves = self._halves(self.tokens[token]) if len(self.tokens[token]) > 1 else None
            self.halves[:, token] = -1 if halves is None else [self.ranks[h] for h in halves]
        return self.halves[side][ids]

    def _all_neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`_neighbours` of many pairs, walked back from the whole tokens: the
        later of the two merges is undone first."""
        none = len(self.tokens)
        fits, at, a_ends, b_ends = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), none), np.full(len(a), none)
        while len(at):
            pair = a << 31 | b
            place = np.searchsorted(self.joins, pair)
            rank = np.where(self.joins[place] == pair, self.joined[place], none)
            joined = (rank < a_ends) & (rank <= b_ends)
            fits[at[joined]] = False
            a_half, b_half = self._half(a, 1), self._half(b, 0)
            more = ~joined & ((a_half >= 0) | (b_half >= 0))
            back = (np.where(a_half >= 0, a, -1) > np.where(b_half >= 0, b, -1))[more]
            at, a, b, a_half, b_half = at[more], a[more], b[more], a_half[more], b_half[more]
            a_ends, b_ends = np.where(back, a, a_ends[more]), np.where(back, b_ends[more], b)
            a, b = np.where(back, a_half, a), np.where(back, b, b_half)
        return fits

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`_neighbours` of many pairs; a left side below 0 is the start."""
        pair = left.astype(np.int64) << 31 | right
        place = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % len(self.pairs)
        known = self.pairs[place]
        fits = (known & 1 == 1) | (left < 0)
        missed = np.flatnonzero((known >> 1 != pair) & (left >= 0))
        if len(missed):
            news, which = np.unique(pair[missed], return_inverse=True)
            found = self._all_neighbours(news >> 31, news & 0x7FFFFFFF)[which]
            fits[missed] = found
            self.pairs[place[missed]] = pair[missed] << 1 | found
        return fits

    def _chain(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of the first ``end`` open bytes."""
        out = []
        while end:
            out.append(lasts[end])
            end -= len(self.tokens[lasts[end]])
        return out[::-1]

    def _settled(self, lasts: list[int], pending: int) -> list[int]:
        """The tokens through which every continuation goes: a later token starts
        among the last ``pending`` bytes or after them."""
        n = len(lasts) - 1
        chains = [self._chain(lasts, end) for end in range(n - pending, n + 1)]
        shared = 0
        for tokens in zip(*chains):
            if len(set(tokens)) > 1:
                break
            shared += 1
        return chains[0][:shared]

    def encode_bytes(self, text: bytes) -> list[int]:
        """Ids of one piece of any length."""
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        # The last token of the first n open bytes, for each n; first the token before them.
        state, lasts, out, most, known = 0, [-1], [], LOOKAHEAD, {}
        for at in range(0, len(text), LOOKAHEAD):
            if len(lasts) > most:
                settled = self._settled(lasts, len(self.open[state]))
                if settled:
                    out.extend(settled)
                    del lasts[: sum(len(self.tokens[t]) for t in settled)]
                    lasts[0] = settled[-1]
                most = max(LOOKAHEAD, 2 * len(lasts))
            if len(self.open) > self.most_states:
                pending = self.open[state]
                self._forget()
                state = self._state(pending)
            if len(known) > SIDE:
                known = {}
            for byte in text[at : at + LOOKAHEAD]:
                state = int(self.arcs[state, byte]) or self._arc(state, byte)
                last, end = int(self.bytes[byte]), int(self.top[state])
                while end:
                    token = int(self.token[end])
                    left = lasts[-len(self.tokens[token])]
                    fits = left < 0 or known.get((left, token))
                    if fits is None:
                        fits = known[left, token] = self._neighbours(left, token)
                    if fits:
                        last = token
                        break
                    end = int(self.shorter[end])
                lasts.append(last)
        return out + self._chain(lasts, len(lasts) - 1)

    def _side_by_side(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces in descending order of length, none empty."""
        if len(self.open) > self.most_states:
            self._forget()
        lengths = np.array(list(map(len, pieces)))
        n, longest = len(pieces), int(lengths[0])
        data = np.ascontiguousarray(np.array(pieces, f"S{longest}").view(np.uint8).reshape(n, longest).T)
        lasts = np.full((longest + 1, n), -1, np.int32)
        state = np.zeros(n, np.int32)
        for i in range(longest):
            byte = data[i, : np.searchsorted(-lengths, -i)]
            before, state = state[: len(byte)], self.arcs[state[: len(byte)], byte]
            new = np.flatnonzero(state == 0)
            if len(new):
                for s, b in set(zip(before[new].tolist(), byte[new].tolist())):
                    self._arc(s, b)
                state[new] = self.arcs[before[new], byte[new]]
            last, end = self.bytes[byte], self.top[state]
            at = np.flatnonzero(end)
            end = end[at]
            while len(at):
                token = self.token[end]
                fits = self._fit(lasts[i + 1 - self.sizes[token], at], token)
                last[at[fits]] = token[fits]
                at, end = at[~fits], self.shorter[end[~fits]]
                at, end = at[end > 0], end[end > 0]
            lasts[i + 1, : len(byte)] = last
        # Back from the end of each piece.
        end, counts, rounds, at = lengths.copy(), np.zeros(n, np.int64), [], np.arange(n)
        while len(at):
            token = lasts[end[at], at]
            rounds.append((at, token))
            counts[at] += 1
            end[at] -= self.sizes[token]
            at = at[end[at] > 0]
        stops = np.cumsum(counts)
        ids, place = np.empty(stops[-1], np.int32), stops.copy()
        for at, token in rounds:
            place[at] -= 1
            ids[place[at]] = token
        data, stops = ids.tobytes(), (4 * stops).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        out, short = {}, []
        for p in pieces:
            data = p.encode()
            if 0 < len(p) <= LONG and data not in self.ranks:
                short.append((data, p))
            else:
                out[p] = np.array(self.encode_bytes(data), np.int32).tobytes()
        short.sort(key=lambda x: -len(x[0]))
        for lo in range(0, len(short), SIDE):
            data, names = zip(*short[lo : lo + SIDE])
            out.update(zip(names, self._side_by_side(data)))
        return out

    def encode_texts(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts, each given as its pieces. Words are kept in two generations:
        those not met again while one fills up are forgotten."""
        found = [list(map(self.words.get, pieces)) for pieces in texts]
        gaps = [(ids, i, pieces[i]) for ids, pieces in zip(found, texts) for i, x in enumerate(ids) if x is None]
        missed = {p: self.older.get(p) for _, _, p in gaps}
        missed.update(self._encode([p for p, x in missed.items() if x is None]))
        for ids, i, p in gaps:
            ids[i] = missed[p]
        for p, x in missed.items():
            if len(p) <= LONG:
                if len(self.words) >= self.most_words:
                    self.older, self.words = self.words, {}
                self.words[p] = x
        return [np.frombuffer(b"".join(ids), np.int32) for ids in found]

    def encode_pieces(self, pieces: list[str]) -> str:
        """Decimal ids of all pieces, joined by one space."""
        return " ".join(map(str, self.encode_texts([pieces])[0].tolist()))


class StreamDecoder:
    """Ids to text, part by part: an incremental UTF-8 decoder holds back the
    first bytes of a character until the rest arrives. Bytes that are no UTF-8
    become U+FFFD."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> tuple[bytes, str]:
        data = b"".join(map(self.tokens.__getitem__, ids))
        return data, self.utf8.decode(data, final)


def _machine(tokens: list[bytes], pattern: str):
    """A transducer and the splitter of texts, for one task. What the transducer
    keeps has no cycles; the collector would walk through it again and again."""
    import gc

    import regex

    gc.disable()
    return Transducer(tokens), regex.compile(pattern)


def _groups(column: pa.Array) -> Iterator[list[str]]:
    """Texts of about ``CHARS`` characters together, or one longer text."""
    held, chars = [], 0
    for i in range(len(column)):
        text = column[i].as_py() or ""
        if held and chars + len(text) > CHARS:
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield held


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids. ``pattern`` splits the text before the merges."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    kept = [c for c in docs.columns if c != ids]
    schema = docs.select(kept).schema.add(ids, ArrayType(IntegerType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, split = _machine(shared.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                found = [x for texts in _groups(b.column(text)) for x in machine.encode_texts(list(map(split.findall, texts)))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, pa.list_(pa.int32()))], names=[*kept, ids])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, tokens: list[bytes], ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text of a column of token ids; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(tokens)
    kept = [c for c in rows.columns if c != text]
    schema = rows.select(kept).schema.add(text, "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if x is None else StreamDecoder(shared.value).feed(x, True)[1] for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, pa.string())], names=[*kept, text])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokens: list[bytes], pattern: str, key: str = "doc_id", text: str = "text", part: int = 4096) -> DataFrame:
    """Number of tokens and digests of ids and decoded bytes, per document.

    The ids of documents of about ``CHARS`` characters together, or of one longer
    document, are in memory; they are decoded in parts of ``part`` ids. ``decoded_chars`` is the length of the decoded text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, split = _machine(shared.value, pattern)
        known = shared.value
        decimals = list(map(str, range(len(known))))
        for b in batches:
            counts, encoded, decoded, chars = [], [], [], []
            for texts in _groups(b.column(1)):
                for found in machine.encode_texts(list(map(split.findall, texts))):
                    ids = found.tolist()
                    stream, digest, n = StreamDecoder(known), hashlib.sha256(), 0
                    for i in range(0, len(ids), part):
                        data, piece = stream.feed(ids[i : i + part], i + part >= len(ids))
                        digest.update(data)
                        n += len(piece)
                    counts.append(len(ids))
                    encoded.append(hashlib.sha256(" ".join(map(decimals.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(digest.hexdigest())
                    chars.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded), pa.array(chars, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"],
            )

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
