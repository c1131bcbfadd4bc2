"""Pieces go through the transducer side by side, with the ids that the merges give."""

import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from panelcast.llm import byte_bpe


@pytest.fixture(scope="module")
def tokens():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def some_words(seed, n):
    rng = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    return list(dict.fromkeys(" " + "".join(rng.choice(parts) for _ in range(rng.randint(3, 7))) for _ in range(n)))


def calls(work):
    """Calls of functions, of Python and of C, that ``work`` makes."""
    made = Counter()
    sys.setprofile(lambda frame, event, arg: made.update([event]))
    try:
        work()
    finally:
        sys.setprofile(None)
    return made["call"] + made["c_call"]


def test_new_words_take_few_calls(tokens):
    machine = byte_bpe.Transducer(tokens)
    machine.encode_pieces(some_words(1, 4_000))
    words = some_words(2, 20_000)
    assert calls(lambda: machine.encode_pieces(words)) < 2 * sum(map(len, words))


def trained(rng, n):
    """A vocabulary of merges, each the most frequent pair of random words."""
    words = [[bytes((b,)) for b in rng.choice(["ab", "abc", "abcde"]).encode() for _ in range(rng.randint(1, 3))] for _ in range(60)]
    for w in words:
        rng.shuffle(w)
    made = [bytes((i,)) for i in range(256)]
    for _ in range(n):
        pairs = Counter((a, b) for w in words for a, b in zip(w, w[1:]) if a + b not in made)
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p], p))
        made.append(best[0] + best[1])
        for w in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = [best[0] + best[1]]
                i += 1
    return made


@pytest.mark.parametrize("seed", range(8))
def test_ids_are_those_of_the_merges(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(byte_bpe, "SIDE", 7)
    machine = byte_bpe.Transducer(trained(rng, 40), most_states=rng.choice([5, 1_000]), most_words=10)
    texts = [["".join(rng.choice("abcde") for _ in range(rng.choice([0, 1, 3, 9, 30, 64, 65, 300]))) for _ in range(20)] for _ in range(6)]
    for _ in range(2):
        got = [x.tolist() for x in machine.encode_texts(texts)]
        assert got == [[machine.ranks[t] for p in pieces for t in (machine.merged(p.encode()) if p else [])] for pieces in texts]
    left, right = np.divmod(np.arange(len(machine.tokens) ** 2)[-9_000:], len(machine.tokens))
    whole = np.array([len(t) == 1 or machine._halves(t) is not None for t in machine.tokens])
    left, right = left[whole[left] & whole[right]], right[whole[left] & whole[right]]
    want = [machine.merged(machine.tokens[a] + machine.tokens[b]) == [machine.tokens[a], machine.tokens[b]] for a, b in zip(left, right)]
    assert machine._all_neighbours(left, right).tolist() == want
    assert [machine._neighbours(a, b) for a, b in zip(left.tolist(), right.tolist())] == want


def test_long_pieces_are_emitted_as_they_settle(tokens, monkeypatch):
    machine = byte_bpe.Transducer(tokens, most_states=100)
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
    rng = random.Random(4)
    open_bytes, chain = [], machine._chain
    monkeypatch.setattr(machine, "_chain", lambda lasts, end: open_bytes.append(len(lasts)) or chain(lasts, end))
    for letters in ("abtheing", "x", "é世", "theandingon"):
        piece = "".join(rng.choice(letters) for _ in range(3_000))
        assert machine.encode_bytes(piece.encode()) == exact.encode_ordinary(piece)
    assert max(open_bytes) <= 8 * byte_bpe.LOOKAHEAD
