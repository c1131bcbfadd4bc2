"""The corpus operators against brute force, on small odd tables."""

import hashlib
import html
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import corpus_pipeline
from panelcast.llm import (
    byte_bpe, catalog, chat, cotrain, exact_dedup, jaccard, language_id, main_text, mixture, token_counts, winnowing,
)

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long"
WORDS = [f"w{i}" for i in range(400)]


def odd_texts():
    rng = random.Random(3)
    base = [rng.choice(WORDS) for _ in range(200)]
    texts = [None, "", " \t\n", "one", "One\ttwo", "one  two", "a b c d e", "a b c d e f"]
    texts += [" ".join(base), " ".join(base), " ".join(base).upper(), "\n".join(base)]
    for i in range(12):
        other = list(base)
        for _ in range(2 * i):
            other[rng.randrange(200)] = f"x{rng.random()}"
        texts.append(" ".join(other))
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return texts + ["long " * 20_000, "é世🙂" * 50, "x" * 5_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 97, t, "en" if i % 3 else None, f"s{i % 5}" if i % 4 else None, None if t is None else len(t), "k", 1) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows + [(None, "lone text", None, None, None, None, None)], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokens():
    return byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def links_by_brute_force(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if i is not None)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_extended_components_match_those_of_all_links(spark):
    rng = random.Random(8)
    pairs = [tuple(rng.sample(range(120), 2)) for _ in range(90)]
    first, more = (spark.createDataFrame(p, "a long, b long") for p in (pairs[:50], pairs[50:]))
    roots = jaccard.components(first)
    want = sorted(map(tuple, jaccard.components(first.unionByName(more)).collect()))
    assert sorted(map(tuple, jaccard.extended(roots, more).collect())) == want
    none = first.where("a < 0")
    assert sorted(map(tuple, jaccard.extended(roots, none).collect())) == sorted(map(tuple, roots.collect()))
    assert sorted(map(tuple, jaccard.extended(jaccard.components(none), first).collect())) == sorted(map(tuple, roots.collect()))


def test_components_match_brute_force(docs, empty, spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()}
    assert got == links_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.link_components(empty).count() == 0
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = links_by_brute_force([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in catalog.QUERIES["op1_ngram_jaccard"](spark, FOLDER).collect()} == want


def test_common_words_are_compared_in_blocks(spark):
    # Many sets around one centre link with it, few with each other.
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        at = rng.randrange(100)
        rows.append((i, " ".join(base[:at] + [f"y{i}"] * 6 + base[at + 6 :])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(df).collect()}
    assert got == links_by_brute_force(rows)


def test_parity_words_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 17, 40, 333, 2_000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[n // 9 :], rng.integers(0, 2**63, n // 12).astype(np.uint64)])
        apart = len(np.setxor1d(a, b))
        assert np.bitwise_count((jaccard.bit_sketch(a) ^ jaccard.bit_sketch(b)).view(np.uint64)).sum() <= apart
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            common = np.zeros(jaccard.COUNTERS, np.uint8)
            assert len(np.intersect1d(jaccard.meeting_words(a, common), jaccard.meeting_words(b, common)))


def all_pieces():
    """Pieces of the model in the order of ids: the library falls back to the byte
    pieces among them. None of the texts here holds such a piece by its name."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def test_token_counts(docs, empty):
    vocabulary = token_counts.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    exact = Tokenizer(models.Unigram(all_pieces(), unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    want = Counter((r.doc_id, len(exact.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, vocabulary).collect()) == want
    assert token_counts.count_tokens(empty, vocabulary).count() == 0
    # Equal scores: the piece that begins first wins.
    tied = token_counts.Counter([("▁", 0.0), ("a", -1.0), ("aa", -2.0), ("▁a", -1.0)])
    assert tied.text("aa") == (2, -2.0)


def test_token_counts_of_runs_of_spaces():
    vocabulary = token_counts.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    exact = Tokenizer(models.Unigram(all_pieces(), unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    counter = token_counts.Counter(vocabulary)
    assert counter.text("a        b")[0] == 3
    rng = random.Random(6)
    texts = ["a        b", "  x", "x   ", " ", "def f():\n        return  1\n", "name    |   value      | 3"]
    texts += ["".join(rng.choice(["the", "table", "x1", ",", "\n"]) + " " * rng.choice([0, 1, 1, 2, 3, 8, 17, 40]) for _ in range(20)) for _ in range(30)]
    assert [counter.text(t)[0] for t in texts] == [len(exact.encode(t, add_special_tokens=False).ids) for t in texts]
    # A piece over two words is found as well.
    assert token_counts.Counter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("a▁b", -0.5)]).text("a b a") == (4, -3.5)


def test_language_id(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.detect(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in language_id.detect(docs).collect()}
    assert len(odd) == docs.count() and odd[0].lang_pred == "und" and odd[7].lang_pred == "und" and odd[21].lang_pred == "en"
    assert language_id.detect(empty).count() == 0


def test_languages_of_several_scripts():
    rng = random.Random(8)
    scripts = {"de": (97, 26), "el": (0x3B1, 24), "ja": (0x4E00, 900), "ko": (0xAC00, 900), "ru": (0x430, 32), "zh": (0x4E00, 900)}
    words = {
        lang: ["".join(chr(lo + rng.randrange(n)) for _ in range(rng.randint(1, 4) if n > 99 else rng.randint(3, 8))) for _ in range(300)]
        for lang, (lo, n) in scripts.items()
    }
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    # The samples of the scripts with many letters are the smaller ones.
    model = language_id.fit(tuple((lang, text(lang, 150 if n > 99 else 400)) for lang, (_, n) in scripts.items() for _ in range(6)))
    want = [lang for lang in scripts for _ in range(20)]
    langs, scores = model.predict([text(lang, 30) for lang in want])
    assert langs == want and min(scores) > 0.5


def test_rare_code_points_match_as_others():
    # By brute force: the longest match from each place, in pieces.
    rng = random.Random(2)
    letters = [chr(0x4E00 + i) for i in range(120)]
    base = "".join(rng.choice(letters[:6] if rng.random() < 0.7 else letters) for _ in range(3000))
    other = "".join(rng.choice(letters) for _ in range(2000))
    model = language_id.fit((("a", base), ("b", other)))
    for lo in (0, 500, 1200):
        new = base[lo : lo + 40] + other[lo : lo + 30] + chr(0x7000) + base[lo + 90 : lo + 130][::-1]
        got = model.phrases([language_id.code_points(new)])[0]
        for sample, n in zip((base, other), got):
            count, at = 0, 0
            while at < len(new):
                size = 1
                while at + size < len(new) and new[at : at + size + 1] in sample:
                    size += 1
                at += size
                count += 1
            assert n == count


def test_automaton_finds_longest_matches():
    model = language_id.fit((("x", "abcabd"), ("y", "zzzz")))
    counts = model.phrases([language_id.code_points(t) for t in ("abcabd", "abdabc", "zz", "q")])
    assert counts.tolist() == [[1, 6], [2, 6], [2, 1], [1, 1]]


def test_byte_bpe(docs, empty, tokens):
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = Counter()
    for r in docs.collect():
        ids = exact.encode_ordinary(r.text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())] += 1
    got = byte_bpe.round_trip(docs, tokens, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    rows = byte_bpe.decode(byte_bpe.encode(docs, tokens, public_tokenizers.PATTERN), tokens).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert byte_bpe.encode(empty, tokens, public_tokenizers.PATTERN).count() == 0
    machine, split = byte_bpe.Transducer(tokens, 50, 20), regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("abtheing 0123éß世🙂'\n\t") for _ in range(rng.randint(0, 90)))
        assert machine.encode_pieces(split.findall(t)).split() == list(map(str, exact.encode_ordinary(t)))


def test_streaming_decoder(tokens):
    data = "aé世🙂".encode()
    ids = [tokens.index(bytes((b,))) for b in data]
    stream = byte_bpe.StreamDecoder(tokens)
    parts = [stream.feed([i])[1] for i in ids]
    assert "".join(parts) == "aé世🙂" and parts[1] == "" and parts[2] == "é"
    assert byte_bpe.StreamDecoder(tokens).feed(ids[:2], True)[1] == "a�"


def test_chat(spark):
    call = lambda i, a: f'Hm <tool_call>{{"name":"add","id":"{i}","arguments":{a}}}</tool_call>'
    result = lambda i: f'<tool_result>{{"id":"{i}","content":3}}</tool_result>'
    rows = [
        (1, 0, "user", "Say\n\"hi\""), (1, 1, "tool", result("c1")), (1, 2, "assistant", call("c1", '{"y":2,"x":1}')),
        (1, 3, "tool", result("none")), (1, 4, "assistant", call("c2", '{"x":"1"}')), (2, 0, "assistant", "<tool_call>{bad</tool_call>"),
        (2, None, None, None), (2, None, None, None),
    ]
    schemas = {"add": {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "number"}, "y": {"type": "number"}}}}
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas)
    got = out.orderBy(*chat.in_order()).collect()
    assert len(got) == len(rows)
    one = [r for r in got if r.conv_id == 1]
    assert [r.turn for r in one] == [0, 2, 1, 3, 4]
    assert [r.n_linked for r in one] == [0, 1, 1, 0, 0] and [r.n_problems for r in one] == [0, 0, 0, 0, 2]
    assert one[0].message == '{"content":"Say\\n\\"hi\\"","role":"user"}'
    assert one[1].message == '{"content":"Hm","role":"assistant","tool_calls":[{"arguments":{"x":1,"y":2},"id":"c1","name":"add"}]}'
    assert [r.message for r in got if r.conv_id == 2][0] == '{"content":"<tool_call>{bad</tool_call>","role":"assistant"}'
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_exact_dedup(docs, empty, spark):
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[normal(r.text)].append(r.doc_id)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    got = exact_dedup.keepers(exact_dedup.duplicates(docs)).collect()
    assert len(got) == docs.count() and sum(r.kept for r in got) == len(groups)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size, r.kept) == (least(ids), len(ids), r.doc_id == least(ids))
    twice = docs.unionByName(docs)
    assert Counter(map(normal, [r.text for r in exact_dedup.dedup(twice).collect()])) == Counter(list(groups))
    assert exact_dedup.dedup(empty).columns == empty.columns and exact_dedup.dedup(empty).count() == 0
    log = [(0, b"a" * 32, True), (1, b"b" * 32, True), (2, b"a" * 32, False), (3, b"c" * 32, False), (4, b"b" * 32, True)]
    live = exact_dedup.apply_changes(spark.createDataFrame(log, "seq int, digest binary, live boolean"))
    assert [bytes(r.digest) for r in live.collect()] == [b"b" * 32]


def test_cuckoo_index_grows_and_forgets():
    index = exact_dedup.CuckooIndex(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3_000)]
    assert all(index.insert(k)[1] for k in keys) and not index.insert(keys[5])[1] and len(index) == 3_000
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert all((index.find(k) >= 0) == (i % 2 == 1) for i, k in enumerate(keys))


def test_fingerprints(docs, empty):
    rows = sorted(docs.where("doc_id IS NOT NULL").collect(), key=lambda r: -r.doc_id) + docs.where("doc_id IS NULL").collect()
    got = {r.doc_id: r for r in winnowing.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for r, following in zip(rows, rows[1:] + rows[:1]):
        t, u = r.text or "", following.text or ""
        half = len(t) // 2
        f = got[r.doc_id]
        assert f.n_chars == len(t)
        assert f.edited_sha256 == hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()
        assert 0 <= f.near_edited <= 1 and 0 <= f.near_next <= 1
        a, b = set(f.fingerprint.split()), set(got[following.doc_id].fingerprint.split())
        assert abs(f.near_next - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-9
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text or ""].add(got[r.doc_id].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert winnowing.fingerprints(empty).count() == 0


def test_winnowing_keeps_the_rightmost_minimum(spark):
    texts = [" ".join(random.Random(i).choice("abc") for _ in range(40)) for i in range(20)] + ["b " * 12]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    w = winnowing.winnow(F.col("text"))
    grams = F.transform(F.sequence(F.lit(0), F.size(F.split(F.trim("text"), " ")) - winnowing.GRAM), lambda i: F.hash(
        *[F.get(F.split(F.trim(F.col("text")), " "), i + o) for o in range(winnowing.GRAM)]))
    for r in df.select(winnowing.hashes(w).alias("h"), winnowing.positions(w).alias("p"), grams.alias("g")).collect():
        want = []
        for at in range(max(1, len(r.g) - winnowing.WINDOW + 1)):
            window = range(at, min(at + winnowing.WINDOW, len(r.g)))
            best = min(window, key=lambda i: (r.g[i], -i))
            if not want or want[-1] != best + 1:
                want.append(best + 1)
        assert r.p == want and len(set(r.h)) == len({r.g[p - 1] for p in want})


def test_main_text(spark):
    page = (
        '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>Menu</ul></nav><div class="ad">Buy</div>'
        "<article><h1>Head &amp; tail</h1><p>One <b>bold</b>\n word<br>next<p>Two&nbsp;&lt;x&gt;<form>Mail</form>"
        '<div class="comments"><p>Me too</p></div></article><aside>Side</aside><footer>&copy; 1</footer>'
    )
    bare = [f"<body><div>Same old site line here</div><p>Story number {i} goes {i * 7} ways</p>" for i in range(4)]
    rows = [(0, "http://a.b/1", page), (1, None, None), (2, "http://a.b/2", "")] + [(3 + i, "http://c.d/x", h) for i, h in enumerate(bare)]
    got = {r.page_id: r for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text == "Head & tail One bold word next Two <x>" and got[1].text == "" and got[2].n_chars == 0
    assert [got[3 + i].text for i in range(4)] == [f"Story number {i} goes {i * 7} ways" for i in range(4)]
    table = spark.read.parquet(f"{FOLDER}/pages.parquet")
    out = {r.page_id: r.text for r in main_text.extract(table).collect()}
    for r in table.collect():
        body = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r.html)[1]
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))
        assert out[r.page_id] == " ".join(html.unescape(plain).split())
    assert main_text.extract(table.limit(0)).count() == 0


def test_runs_repeat_over_all_pages_of_a_large_host(spark):
    # Five groups; most hold the notice on one page at most.
    n = 5 * main_text.PAGES
    story = lambda i: " ".join(f"s{i}x{j}" for j in range(12))
    notice = lambda i: "<div>Shop closed until further notice today</div>" if i % 200 == 0 else ""
    rows = [(i, f"http://big.host/{i}", f"<body>{notice(i)}<p>{story(i)}</p>") for i in range(n)]
    got = {r.page_id: r for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == n and all(got[i].text == story(i) for i in range(n))
    assert all(got[i].n_repeated == 6 * (i % 200 == 0) for i in range(n))


def test_prose_without_an_article_keeps_its_phrases(spark):
    # Pages of two groups; every paragraph has phrases that others have as well.
    n = 2 * main_text.PAGES
    phrases = [" ".join(f"p{k}q{j}" for j in range(4 + k % 9)) for k in range(20)]
    legal = " ".join(f"legal{j}" for j in range(40))

    def paragraph(i, k):
        rng = random.Random(i * 10 + k)
        return " ".join(x for j in range(6) for x in (f"own{i}x{k}x{j}", rng.choice(phrases)))

    rows, want = [], []
    for i in range(n):
        own = [paragraph(i, k) for k in range(3)]
        shared = i % 200 == 3
        body = [own[0], "Sign up for our weekly letter" if shared else "", own[1] + (f" {legal}" if shared else ""), own[2]]
        rows.append((i, f"http://prose.host/{i}", "<body>" + "".join(f"<p>{x}</p>" for x in body)))
        want.append(" ".join(own))
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(want))


def test_inline_elements_end_where_they_close():
    text = lambda page: main_text.article(main_text.blocks(page))
    rest = "</p><p>rest</p></article><p>out</p>"
    for inline in ('<span class="ad">x</span>', '<a class="share" href="/s">x</a>', "<b hidden>x</b>", '<span class="ad"><span>x</span> y <b>z</b></span>',
                   '<a class="share" href="/s"><div>x</div></a>', '<span class="ad">x <b class="c">y</span>', "</span>"):
        assert text(f"<article><p>Intro {inline} more{rest}") == "Intro more rest"
    assert text(f'<article><p>Intro <a href="/k">kept</a> <i class="e">too</i> <b>x</b> more{rest}') == "Intro kept too x more rest"
    assert text('<div class="post"><p>One <a class="story" href="/">two</a> three</p></div><p>out</p>') == "One two three"
    assert text('<p>One <a class="story" href="/">two</a> three</p>') is None
    # A stray end tag of an inline element leaves the container open.
    assert text('<div><span class="y">a<article><p>b</span> c</p><p>d</p></article></div>') == "b c d"


def test_repeated_runs_by_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        streams = [np.array([rng.randrange(1, 4) for _ in range(rng.randint(0, 14))], np.uint64) for _ in range(5)]
        found = main_text.repeated(streams, 3)
        grams = defaultdict(set)
        for s in streams:
            for i in range(len(s) - 2):
                grams[tuple(s[i : i + 3])].add(s.tobytes())
        for s, f in zip(streams, found):
            want = np.zeros(len(s), bool)
            for i in range(len(s) - 2):
                if len(grams[tuple(s[i : i + 3])]) > 1:
                    want[i : i + 3] = True
            assert f.tolist() == want.tolist()


def test_quality(spark, docs, empty):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    scored = cotrain.score(table, labels.where(~held))
    rows = scored.join(labels.where(held), "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in rows) >= 0.97 * len(rows) > 50
    none = labels.limit(0)
    assert cotrain.score(docs, none).where("keep").count() == docs.count()
    assert cotrain.score(empty, none).columns == [*empty.columns, *cotrain.SCORES]
    assert cotrain.score(empty, none).count() == 0


def mixed_by_brute_force(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((md5(f"mix:{'' if i is None else i}:{md5(t or '')}"), i, size(t)))
    sources = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sources)}
    total = {s: sum(x[2] for x in by[s]) for s in sources}
    target, left, open_ones = {}, 1.5 * sum(total.values()), set(sources)
    while open_ones:
        rate = left / sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if rate * weight[s] >= 2 * total[s]}
        for s in full or open_ones:
            target[s] = 2 * total[s] if full else rate * weight[s]
        left -= sum(target[s] for s in full)
        open_ones = open_ones - full if full else set()
    return by, total, target


def test_mixture(docs, empty):
    by, total, target = mixed_by_brute_force([(r.doc_id, r.text, r.source) for r in docs.collect()])
    got = mixture.mix(docs).collect()
    assert len(got) == docs.count()
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in total)
    words = Counter()
    for r in mixture.emit(docs).collect():
        words[r.source] += len((r.text or "").split())
    assert words == taken
    assert mixture.mix(empty).count() == 0 and mixture.emit(empty).columns == empty.columns


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, at = docs.columns, docs
    for name, function in corpus_pipeline.STAGES[:3]:
        before = at
        at = function(spark, before, FOLDER).cache()
        assert at.columns == columns and at.join(before, columns, "left_anti").count() == 0
        if name == "exact_dedup":
            rows = before.collect()
            assert at.count() == len({" ".join(re.split(r"[\x20\x09-\x0D]+", r.text)) for r in rows})
        if name == "near_dedup":
            want = links_by_brute_force([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in at.collect()) == sorted({c for _, c in want.values()})
    out = corpus_pipeline.run(spark, FOLDER).collect()
    kept = {r.doc_id for r in at.collect()}
    assert out and {r.doc_id for r in out} <= kept and all(len(r.ids) == r.n_tokens for r in out)
    assert set(columns) <= set(out[0].asDict())
