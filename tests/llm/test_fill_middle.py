"""Fill-in-the-middle rewriting against plain string slicing."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import fill_middle

ODD = [
    None, "", "a", "<", "<P>", "a <S> b", "x<M>", "<P", "P>", "<<S", "S>>", "é世🙂" * 40, "\x00\x7f", "long text. " * 20_000,
    "世" * 5_000, "<P" * 30 + "S>" * 30, " \t\n",
]


def expected(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    texts = ODD * 4 + ["".join(rng.choice("ab<>PSMé世🙂 ") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(None if i == 7 else i * 31 - 500, t, f"k{i}", "old") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:6], "doc_id long, text string, n string, fim_form string")


def test_outputs_and_round_trip(docs):
    rows = fill_middle.restore(fill_middle.transform(docs)).collect()
    assert len(rows) == docs.count()
    forms = set()
    for r in rows:
        got = (r.fim_n, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_output)
        assert got == expected(r.doc_id, r.text)
        assert r.fim_restored == (r.text or "") and r.n.startswith("k")
        forms.add(r.fim_form)
    assert forms == set(fill_middle.FORMS)


def test_digests(docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((r.doc_id is None, r.doc_id or 0), *expected(r.doc_id, r.text)[:4], sha(expected(r.doc_id, r.text)[4]), sha(r.text or "")) for r in docs.collect())
    got = sorted(((r.doc_id is None, r.doc_id or 0), *r[1:]) for r in fill_middle.digests(docs).collect())
    assert str(got) == str(want)


def test_empty_table_and_outputs_that_fit_no_form(docs, spark):
    assert fill_middle.digests(docs.where("false")).count() == 0
    rows = [("psm", "<P>a<S>b<M>c"), ("psm", "<S>b<P>a<M>c"), ("spm", "<S>b<P>a<M>c"), ("psm", "<P>a<S>b"), ("psm", "x<P>a<S>b<M>c"), ("psm", ""), ("plain", "<P>"), (None, "t"), ("spm", None)]
    got = fill_middle.restore(spark.createDataFrame(rows, "form string, output string").coalesce(1), "output", "form", "text")
    assert [r.text for r in got.collect()] == ["acb", None, "acb", None, None, None, "<P>", "t", None]


def test_displacement_in_small_windows(monkeypatch):
    monkeypatch.setattr(fill_middle, "WINDOW", 7)
    monkeypatch.setattr(fill_middle, "_RUN", 5)
    texts = ["0123456789é", "", "世界🙂abc", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for form in (1, 2):
        forms = np.array([form, 0, form, form])
        out, to = fill_middle.rewrite(data, offsets, forms, np.array([3, 0, 2, 0]), np.array([5, 0, 3, 1]))
        whole = [bytes(out[a:b]).decode() for a, b in zip(to, to[1:])]
        cut = [("012", "34567", "89é"), None, ("世界", "🙂ab", "c"), ("", "x", "")]
        shape = "<P>{0}<S>{2}<M>{1}" if form == 1 else "<S>{2}<P>{0}<M>{1}"
        assert whole == ["" if c is None else shape.format(*c) for c in cut]
        back, at, sound = fill_middle.rebuild(out, to, forms)
        assert [bytes(back[a:b]).decode() for a, b in zip(at, at[1:])] == texts and sound.all()


def test_slices_of_a_sliced_array():
    text = pa.array(["skip", "one", "", "two" * 10, "end"])[1:]
    parts = list(fill_middle._slices(text))
    assert [(lo, hi) for lo, hi, _, _ in parts] == [(0, 4)] and bytes(parts[0][2]) == b"one" + b"two" * 10 + b"end"
