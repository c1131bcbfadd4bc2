"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from panelcast.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def own_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=20):
    held = [(i, own_terms(t)) for i, t in docs]
    held = [(i, Counter(t), len(t)) for i, t in held if t]
    docs_n, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 100 - 25 + (25 * n * docs_n) // length
            score = sum(math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in own_terms(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def tables(spark, seed=1, n=400):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    rare = [f"r{i}" for i in range(300)]
    texts = [" ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    copy = " ".join(rng.choice(rare) for _ in range(30))
    texts += [copy] * 60 + [copy + " c1 c2"] * 30
    texts += [None, "", " .,;\x00", "C1 c1 R1 r1", "É é ÉÉ", "r1 " * 30_000, "世界 r2"]
    docs = [(i * 7 % 1009, t, "x") for i, t in enumerate(texts)]
    docs += [docs[0], docs[0], (None, "c1 c2 r3", "x"), (-9_223_372_036_854_775_808, copy, "x")]
    items = [(i, " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.randint(1, 12)))) for i in range(40)]
    items += [(100, copy), (101, "c1"), (102, "c1 c1 r1 r1 r1"), (103, None), (104, "..."), (105, "nowhere"), (106, "é"), (107, "É"), (107, "É"), (None, "r1 r2"), (108, "世界")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score string"), docs,
        spark.createDataFrame(items, "item_id long, text string"), items,
    )


@pytest.mark.parametrize("limits", [{}, {"SHARD": 64, "PROBED": 3, "PER_PIVOT": 2, "BLOCK": 3}, {"ITEMS": 9}])
def test_ranking_matches_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    docs, doc_rows, items, item_rows = tables(spark)
    got = lexical.search(docs.repartition(3), items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = ranked([r[:2] for r in doc_rows], item_rows)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_other_columns_and_k(spark):
    docs, doc_rows, items, item_rows = tables(spark, 2, 60)
    got = lexical.search(docs.withColumnRenamed("text", "body"), items, k=3, text="body").collect()
    assert sorted(map(tuple, got), key=str) == ranked([r[:2] for r in doc_rows], item_rows, 3)


def test_empty_tables(spark):
    docs, _, items, _ = tables(spark, 3, 5)
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("text is null"), items)):
        rows = lexical.search(d, i)
        assert rows.columns == ["item_id", "rank", "doc_id", "score"] and rows.count() == 0


def test_blocks_hold_every_posting_once_and_bounds_hold():
    rng = np.random.default_rng(3)
    impact = rng.integers(1, 900, (500, 40)).astype(np.int32) * (rng.random((500, 40)) < 0.3)
    shard = lexical.Shard(None, impact.astype(np.int32), np.arange(40), np.arange(40))
    docs, starts, of = lexical.blocks(shard, np.arange(40), np.ones(40, np.int64), rng.choice(np.array([-1, 1], np.float32), (40, 8)))
    ends = np.append(starts[1:], len(docs))
    assert (ends - starts).max() <= lexical.BLOCK
    for term in range(40):
        held = np.concatenate([docs[a:b] for a, b, t in zip(starts, ends, of) if t == term])
        assert sorted(held) == np.flatnonzero(impact[:, term]).tolist()


def test_weak_lists_stay_closed_and_blocks_are_skipped(spark, monkeypatch):
    """Items that many copies hold rule out most other blocks."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(2_000)]
    copy = " ".join(f"x{i} w{i}" for i in range(20))
    texts += [copy] * 25
    items = lexical.Items([1], {}, [], [])
    own = Counter(lexical.terms(copy.encode()))
    items.terms.append(np.array([items.vocabulary.setdefault(t, len(items.vocabulary)) for t in own]))
    items.counts.append(np.array(list(own.values())))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    forward = lexical.forward_index(docs, items.vocabulary, "doc_id", "text")
    df = lexical.document_counts(forward, len(items.vocabulary))
    scorer = lexical.Scorer(items, len(texts), sum(len(t.split()) for t in texts), df)
    order = items.terms[0][np.argsort(df[items.terms[0]], kind="stable")]
    known, most = lexical.known_scores(forward, scorer, [order[:3]], 20)
    opened = lexical.open_lists(scorer, known, most)[0]
    names = {i: t for t, i in items.vocabulary.items()}
    assert 0 < len(opened) < len(own) and all(names[t].startswith(b"x") for t in opened)
