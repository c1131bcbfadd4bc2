"""The toxicity model: features, FTRL steps, held-out accuracy, odd tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import catalog, toxicity

FOLDER = "/root/testdata/sf0.01"


def features(text):
    """Cells of one text, in plain loops."""
    hashes = toxicity.WordHashes()
    own = [hashes.table[hashes[w]].copy() for w in toxicity.words(text)]
    found, counts = set(), {}
    for i, h in enumerate(own):
        found.add(int(h[0]) >> 32)
        for gap in range(1, toxicity.GAPS + 1):
            if i + gap < len(own):
                found.add(int(toxicity._mixed(h[:1], own[i + gap][:1], gap)[0]))
        for s in h[1:]:
            if s:
                counts[int(s) >> 32] = counts.get(int(s) >> 32, 0) + 1
    for s, n in counts.items():
        found.add(s)
        found |= {int(toxicity._mixed(np.array([s], np.uint64), np.array([t], np.uint64), 0)[0]) for t in toxicity.TIMES if n >= t}
    return found


def test_features_of_many_texts_are_those_of_each():
    texts = [None, "", "one", "One, two; ONE-three!", "a b a b a b", "élan élanesque élanesques élanesque", "stemword stemwords " * 4, "x" * 100_000]
    hashes = toxicity.WordHashes()
    cell, of = toxicity.cells(*hashes.of(texts))
    for i, t in enumerate(texts):
        assert set(cell[of == i].tolist()) == features(t), t


def test_words_are_forgotten_between_slices_only(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE", 10)
    hashes = toxicity.WordHashes()
    first = hashes.of([" ".join(f"w{i}" for i in range(50))])[0].copy()
    assert np.array_equal(hashes.of([" ".join(f"w{i}" for i in range(50))])[0], first)


def test_ftrl_steps_match_a_plain_loop():
    rng = random.Random(1)
    rows = [sorted(rng.sample(range(9), rng.randint(0, 5))) + [9] for _ in range(60)]
    labels = [float(2 in r) for r in rows]
    z, n = np.zeros(10), np.zeros(10)
    toxicity.go_over([np.array(r) for r in rows], labels, z, n)
    zs, ns = [0.0] * 10, [0.0] * 10
    for r, y in zip(rows, labels):
        w = {}
        for i in r:
            l1 = 0.0 if i == 9 else toxicity.L1
            w[i] = 0.0 if abs(zs[i]) <= l1 else (math.copysign(l1, zs[i]) - zs[i]) / ((toxicity.BETA + math.sqrt(ns[i])) / toxicity.ALPHA + toxicity.L2)
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in r:
            step = (math.sqrt(ns[i] + g * g) - math.sqrt(ns[i])) / toxicity.ALPHA
            zs[i] += g - step * w[i]
            ns[i] += g * g
    assert np.allclose(z, zs) and np.allclose(n, ns)


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = catalog.QUERIES["op12_toxicity"](spark, FOLDER)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    got = rows.join(labels, "doc_id").collect()
    assert rows.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    apart = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in apart) / len(apart) >= 0.95
    clean = [r.predicted for r in apart if not r.toxic]
    assert sum(clean) / len(clean) <= 0.01


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(300)}"
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = [word() for _ in range(rng.randint(5, 40))] + (["vile", "creature"] if bad else [])
        rows.append((i, " ".join(text), "x", 0.5))
        labels.append((i, int(bad)))
    rows += [(900, None, None, None), (901, "", "x", 1.0), (None, "vile creature", "x", 1.0), (902, "vile creature " * 25_000, "x", 1.0), (903, "世界" * 50, "x", 1.0)]
    labels += [(0, 0), (None, 1), (901, None), (5_000, 1), (900, 0)]
    return (
        spark.createDataFrame(rows + rows[:5], "doc_id long, text string, score string, held_out double"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_odd_rows(table, spark):
    docs, labels = table
    rows = toxicity.detect(docs, labels).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[902].predicted == 1 and by[None].predicted == 1 and by[None].held_out is False
    assert by[901].score == by[900].score and by[900].predicted == 0
    assert toxicity.detect(docs.where("false"), labels).count() == 0
    assert sorted(map(str, toxicity.detect(docs, labels).collect())) == sorted(map(str, rows))


def test_without_both_labels_all_score_the_share(table):
    docs, labels = table
    for some, share in ((labels.where("false"), 0.5), (labels.where("toxic = 0 and doc_id <> 0"), None)):
        scores = {r.score for r in toxicity.detect(docs, some).collect()}
        assert len(scores) == 1 and (share is None or scores.pop() == pytest.approx(share))


def test_an_id_on_every_row_is_learnt_from_once(spark):
    docs = spark.range(2_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(1, 1)] * 50 + [(2, 0)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, "doc_id", "text", "toxic", F.lit(True)).collect()
    assert len(rows) == 1 and rows[0].y == 1.0
