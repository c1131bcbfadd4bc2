"""Passages that are common to a host are cut from its main texts, articles included."""

import random

import numpy as np
import pytest

from panelcast.llm import main_text

SCHEMA = "page_id long, url string, html string"
NOTICE = "Read more of our stories in the weekly letter"
LEGAL = " ".join(f"legal{j}" for j in range(35))


def own(i, k=0, n=25):
    return " ".join(f"own{i}x{k}x{j}" for j in range(n))


def texts(spark, pages):
    rows = [(i, f"http://some.host/{i}", h) for i, h in enumerate(pages)]
    return {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post">', "</div>"), ("", "")])
def test_notices_without_markup_are_cut_from_every_main_text(spark, open_, close):
    n = 9
    shared = lambda i: f"<p>{own('passage')}</p>" if i < 4 and open_ else ""
    page = lambda i: f"<body>{open_}<p>{own(i)}</p>{shared(i)}<p>{own(i, 1)} {LEGAL}</p><p>{NOTICE}</p>{close}<footer>f</footer>"
    want = {i: " ".join(x for x in (own(i), own("passage") if shared(i) else "", own(i, 1)) if x) for i in range(n)}
    short = f"<body>{open_}<p>Three own words</p><p>{NOTICE}</p><p>{LEGAL}</p>{close}"
    alone = f"<body>{open_}<p>{NOTICE}</p>{close}"
    got = texts(spark, [page(i) for i in range(n)] + [short, alone, page(0)])
    assert got == want | {n: "Three own words", n + 1: NOTICE, n + 2: want[0]}


def test_articles_keep_what_is_not_common(spark):
    # Versions of one article, and a passage of three pages, whatever their number.
    version = lambda i: "<article>" + "".join(f"<p>{own('all', k)}</p>" for k in range(6)) + f"<p>{own(i)}</p></article>"
    got = texts(spark, [version(i) for i in range(8)])
    assert got == {i: " ".join([own("all", k) for k in range(6)] + [own(i)]) for i in range(8)}
    few = lambda i: f"<article><p>{own(i)}</p><p>{NOTICE}</p></article>"
    assert texts(spark, [few(i) for i in range(3)]) == {i: f"{own(i)} {NOTICE}" for i in range(3)}
    half = lambda i: f"<article><p>{own(i)}</p>" + (f"<p>{NOTICE}</p>" if i % 2 else "") + "</article>"
    assert texts(spark, [half(i) for i in range(8)]) == {i: own(i) + (f" {NOTICE}" if i % 2 else "") for i in range(8)}


def test_groups_of_a_host_find_the_same(spark, monkeypatch):
    rng = random.Random(5)
    pages = []
    for i in range(150):
        open_, close = rng.choice([("<article>", "</article>")] * 4 + [("", "")])
        parts = [own(i, k, rng.randint(3, 40)) for k in range(rng.randint(1, 3))]
        parts += [NOTICE] * (i % 25 < 14) + [f"Common to some {own('some', 0, 5)}"] * (i * 7 % 25 < 11)
        parts += [f"{own(i, 9)} {LEGAL}"] * (i * 3 % 25 < 15) + [own("rare")] * (i % 11 == 0)
        pages.append(f"<body><p>Site menu of some words</p>{open_}" + "".join(f"<p>{x}</p>" for x in parts) + close)
    pages += [pages[0]] * 20 + ["", "<article></article>"]
    rows = [(i, f"http://some.host/{i}", h) for i, h in enumerate(pages)]
    table = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(main_text.extract(table).collect())
    assert not any(NOTICE in r.text or LEGAL in r.text for r in whole if own(r.page_id, 0, 3) in r.text)
    assert sum("Common to some" in r.text for r in whole if "<article>" in pages[r.page_id]) > 30
    for size, few in ((100, 100_000), (16, 10), (3, 100_000)):
        monkeypatch.setattr(main_text, "PAGES", size)
        monkeypatch.setattr(main_text, "BROADCAST_ROWS", few)
        assert sorted(main_text.extract(table).collect()) == whole


def test_common_passages_by_brute_force():
    rng = random.Random(7)
    run, long, found_any = 2, 3, 0
    for _ in range(300):
        n = rng.randint(1, 7)
        block = lambda: (*(rng.randint(1, rng.choice([2, 9])) for _ in range(rng.randint(1, 5))), 0)
        shared = [block() for _ in range(3)]
        streams = {sum(((rng.choice(shared) if rng.random() < 0.6 else block()) for _ in range(rng.randint(1, 4))), ()) for _ in range(n)}
        held, cover = {}, {}
        for s in streams:
            at = start = 0
            for end, x in enumerate(s):
                if x:
                    continue
                places = [(("long", s[i : i + long]), i, i + long) for i in range(start, end - long + 1)]
                places += [(("block", s[start:end]), start, end)] if end - start >= run else []
                for name, i, j in places:
                    held.setdefault(name, set()).add(s)
                    cover.setdefault(s, []).append((name, i, j))
                start = end + 1
        common = {k for k, v in held.items() if len(v) * 2 > len(streams) and len(v) >= main_text.FEW}
        covered = lambda s, names: {x for k, i, j in cover.get(s, []) if k in names for x in range(i, j)}
        beside = {s for s in streams if 2 * len(covered(s, common)) <= sum(x > 0 for x in s)}
        common = {k for k in common if 2 * len(held[k] & beside) > len(held[k])}
        arrays = [np.array(s, np.uint64) for s in streams]
        keys = main_text.common_passages(arrays, "h", run, long)
        found_any += len(common) > 0
        assert len(keys) == len(common) == len(set(keys.tolist()))
        cuts = main_text._found(arrays, "h", keys, run, long)[2] if common else [np.zeros(sum(x > 0 for x in s), bool) for s in streams]
        for s, cut in zip(streams, cuts):
            words = [i for i, x in enumerate(s) if x]
            assert {w for w, c in zip(words, cut) if c} == covered(s, common)
    assert found_any > 20
