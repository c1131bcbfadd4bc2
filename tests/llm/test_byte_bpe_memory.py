"""What an encoding task keeps is bounded, and forgetting changes no ids."""

import random

from panelcast.llm import byte_bpe


def test_kept_words_and_pairs_are_bounded(monkeypatch):
    assert 2 * byte_bpe.WORDS + byte_bpe.PAIRS <= 300_000
    letters = [bytes([i]) for i in range(256)]
    tokens = letters + [a + b for a in letters[97:105] for b in letters[97:105]] + [b"abc", b"abcd", b"cab"]
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(4_000)]
    monkeypatch.setattr(byte_bpe, "PAIRS", 50)
    machine = byte_bpe.Transducer(tokens, most_words=100)
    for w in words + words[::-1]:
        want = " ".join(str(machine.ranks[t]) for t in machine.merged(w.encode()))
        assert machine.encode_pieces([w]) == want
        assert len(machine.words) <= 100 and len(machine.older) <= 100 and len(machine.pairs) <= 50
