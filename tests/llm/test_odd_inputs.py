"""Inputs that earlier versions of operators 2, 3, 5 and 10 answered wrongly."""

import hashlib
import json
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from panelcast.llm import catalog, chat, cotrain, language_id, main_text, mixture, token_counts, winnowing


def best_count(pieces, text):
    """Tokens of the best segmentation, by trying every cut."""
    scores = dict(pieces)
    unknown = min(scores.values()) - token_counts.UNKNOWN_COST
    text = token_counts.MARK + text.replace(" ", token_counts.MARK)
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            if piece in scores:
                found = (best[start][0] + scores[piece], best[start][1] + 1)
            elif end - start == 1:
                found = (best[start][0] + unknown, best[start][1] + len(piece.encode()))
            else:
                continue
            if best[end] is None or found[0] > best[end][0]:
                best[end] = found
    return best[-1][1]


def test_control_and_byte_pieces_are_never_matched():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    assert token_counts.read_vocabulary(path) == pieces
    counter = token_counts.Counter(token_counts.read_vocabulary(path))
    for text in ("a<s>b", "x<0x41>y", "</s>", "<unk>", "<s> <s>", "<0x0A>"):
        assert counter.text(text)[0] == best_count(pieces, text) == len([p for p in model.encode(text, out_type=str)]), text


def test_number_forms_are_no_letters():
    model = language_id.fit((("en", "some words of text " * 20), ("fr", "quelques mots de texte " * 20)))
    for text in ("½ ² Ⅷ", "①②", "٣ 12", "", None, "!? ́"):
        assert model.predict([text]) == (["und"], [0.0]), text
    for text in ("½a", "ª", "世", "ʰ"):
        assert model.predict([text])[0] != ["und"], text


def test_the_sample_holds_distinct_texts(spark):
    rng = random.Random(3)
    other = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(300)), "en") for i in range(390)]
    copies = [(1_000 + i, "one text " * 10, "en") for i in range(5_000)]
    docs = spark.createDataFrame(other + copies, "doc_id long, text string, lang string")
    sample = language_id.sample_rows(docs, "doc_id", "text", "lang", F.lit(True))
    assert len(sample) == len(set(sample)) == language_id.SAMPLE_DOCS
    whole = {t for _, t, _ in other}
    assert all(len(t) <= language_id.DOC_CHARS and any(t in w for w in whole | {"one text " * 10}) for _, t in sample)
    assert len({t[:20] for _, t in sample} & {w[:20] for w in whole}) < 100  # passages, not beginnings


MALFORMED = [
    '{"id":1,"name":[1]}', '{"id":1,"name":{"a":1},"arguments":{}}', '{"id":"\\ud800","name":"f"}', '{"id":1,"name":"f","arguments":{"x":"\\udfff"}}',
    '{"id":1,"name":"f","arguments":NaN}', '{"id":1,"name":"f","arguments":{"x":1e999}}', '{"id":1,"arguments":' + "[" * 100_000 + "]" * 100_000 + "}",
    '{"id":1,"name":"f","arguments":' + "9" * 10_000 + "}", '{"id":{"a":[1]},"name":"f"}', '{"id":null}', "[]", "", "{", '{"id":1}', '{"id":true,"name":null}',
]


@pytest.mark.parametrize("schemas", [None, {"f": {"type": "object", "properties": {"x": {"type": "string"}}}}])
def test_no_message_ends_the_job(spark, schemas):
    rows = [(1, i, "assistant", f"before <tool_call>{c}</tool_call> after", "x") for i, c in enumerate(MALFORMED)]
    rows += [(1, 100 + i, "tool", f"<tool_result>{c}</tool_result>", "x") for i, c in enumerate(MALFORMED)]
    found = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string"), schemas).collect()
    assert len(found) == len(rows)
    by = {r.turn: r for r in found}

    def refused(name):
        raise AssertionError(name)

    for r in found:
        json.loads(r.message, parse_constant=refused)
        r.message.encode()
    assert by[0].n_calls == 1 and by[0].n_problems == 1 and by[4].n_calls == by[5].n_calls == by[6].n_calls == 0
    assert "�" in by[2].message and by[4].message.count("NaN") == 1
    assert by[8].n_linked == 1 and by[108].n_linked == 1


def test_random_json_survives(spark):
    rng = random.Random(6)

    def value(depth=0):
        kind = rng.randrange(7 if depth < 4 else 5)
        if kind < 5:
            return [None, True, rng.random() * 10 ** rng.randrange(-300, 300), rng.randrange(-(10**20), 10**20), "".join(chr(rng.choice([65, 233, 0x1F642, 10, 0, 0xD800])) for _ in range(3))][kind]
        return [value(depth + 1) for _ in range(3)] if kind == 5 else {f"k{i}": value(depth + 1) for i in range(3)}

    calls = [{"id": value(), "name": value(), "arguments": value()} for _ in range(300)]
    rows = [(i, 0, "assistant", f"<tool_call>{json.dumps(c)}</tool_call>") for i, c in enumerate(calls)]
    found = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for i, c in enumerate(calls):
        message = json.loads(found[i].message)
        if c["id"] is None:
            assert "tool_calls" not in message
        else:
            assert message["tool_calls"][0]["arguments"] == json.loads(chat.canonical(c["arguments"]))


@pytest.mark.parametrize("copies, size, others", [(500, 42, 0), (500, 42, 30), (7, 3, 4), (2, 5, 1), (1, 9, 6), (40, 0, 3)])
def test_budgets_that_end_among_equal_rows(spark, copies, size, others):
    rng = random.Random(copies + others)
    equal = [(5, " ".join(["w"] * size), "a", i) for i in range(copies)]
    more = [(100 + i, " ".join(["x"] * rng.randrange(1, 60)), "a", 0) for i in range(others)]
    rest = [(10_000 + i, "y " * rng.randrange(90), rng.choice(["b", None, "c"]), 0) for i in range(60)]
    docs = spark.createDataFrame(equal + more + rest, "doc_id long, text string, source string, tie long").repartition(5)
    taken = mixture.mix(docs).collect()
    target = {r.source: r.target for r in taken}
    for source, wanted in target.items():
        rows = [r for r in taken if r.source == source]
        assert sum(r.taken for r in rows) == int(wanted) and all(0 <= r.taken <= 2 * r.size for r in rows)
    words = {}
    for r in mixture.emit(docs).collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert {s: w for s, w in words.items() if w} == {s: int(w) for s, w in target.items() if int(w)}
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    want = con.sql(catalog.ORACLES["op10_source_mixture"]).df()
    key = lambda r: (r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken)
    assert sorted(map(key, taken)) == sorted(map(key, want.itertuples()))


def junk_table(spark, rows=6_000):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(rows):
        bad = i % 4 == 0
        words = [("".join(rng.choice("abcdefgh") for _ in range(6)).upper() + "!!") if bad else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(30)]
        texts.append((i, " ".join(words), "junk" if bad else f"good{i % 5}", "en", 200, i))
        if i % 3 == 0:
            labels.append((i, int(not bad)))
    return (
        spark.createDataFrame(texts, "doc_id long, text string, source string, lang string, n_chars long, row long"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    )


def test_one_id_on_every_row_gives_one_labelled_row(spark):
    docs, labels = junk_table(spark, 400)
    same = docs.withColumn("doc_id", F.lit(7).cast("long"))
    text, meta, label = cotrain.sample(same, spark.createDataFrame([(7, 1), (7, 0), (7, 1), (8, 0), (None, 1)], "doc_id long, quality int"), "doc_id", "quality", cotrain.COLUMNS)
    assert len(text) == len(meta) == len(label) == 1 and label[0] == 1
    assert cotrain.score(same, labels).count() == 400


def test_every_unlabelled_document_takes_part(spark):
    """The sums of a round are those of all documents, in one array."""
    docs, labels = junk_table(spark)
    known = cotrain.sample(docs, labels, "doc_id", "quality", cotrain.COLUMNS)
    model = cotrain.fit(*known)
    got = cotrain.exchanged(cotrain.described(docs, cotrain.COLUMNS), model)
    rows = docs.collect()
    text = np.stack([cotrain.text_view(r.text).astype(np.float16).astype(np.float32) for r in rows])
    meta = np.stack([cotrain.meta_view(r.source, r.lang, r.n_chars) for r in rows])
    by_text, by_meta, _ = model.scores(text, meta)
    for (count, gradient, curvature), x, w, other in zip(got, (text, meta), (model.text, model.meta), (by_meta, by_text)):
        sure = (other >= cotrain.SURE) | (other <= 1 - cotrain.SURE)
        p = 1 / (1 + np.exp(-(x[sure] @ w)))
        assert count == sure.sum() > 1_000
        np.testing.assert_allclose(gradient, x[sure].T @ ((other[sure] >= 0.5) - p), atol=1e-2)
        np.testing.assert_allclose(curvature, x[sure].T @ x[sure] / 4, rtol=1e-3, atol=1e-2)


def test_views_teach_each_other(spark):
    """A source that no labelled row has is told apart after the exchange."""
    docs, labels = junk_table(spark)
    renamed = docs.withColumn("source", F.when((F.col("source") == "junk") & (F.col("doc_id") % 3 != 0), "other").otherwise(F.col("source")))
    known = cotrain.sample(renamed, labels, "doc_id", "quality", cotrain.COLUMNS)
    views = cotrain.described(renamed, cotrain.COLUMNS)
    meta = cotrain.meta_view("other", "en", 200)[None, :]
    alone = cotrain.fit(*known).scores(np.zeros((1, cotrain.TEXT_CELLS)), meta)[1][0]
    taught = cotrain.fit(*known, lambda model: cotrain.exchanged(views, model)).scores(np.zeros((1, cotrain.TEXT_CELLS)), meta)[1][0]
    assert taught < 0.1 < alone
    scored = cotrain.score(renamed, labels).collect()
    assert sum(r.keep == (r.doc_id % 4 != 0) for r in scored) == len(scored)


@pytest.mark.parametrize(
    "html, text",
    [
        ('<div class="flex overflow-hidden"><article><p>One two.</p></article></div>', "One two."),
        ('<div class="content has-sidebar no-nav with-menu"><p>One two.</p></div>', "One two."),
        ('<article><p title="the hidden truth">One two.</p></article>', "One two."),
        ("<article><p hidden>x</p><p data-x='hidden' class=\"a\">One</p><p Hidden=''>y</p></article>", "One"),
        ("<article>Let <math><mi>x</mi></math> be <math><semantics><mi>y</mi><annotation>tex</annotation></semantics></math>.</article>", "Let x be y."),
        ('<div class="modal"><main><p>One</p><div class="sidebar">no</div></main></div>', "One"),
        ('<div class="overlay"><article>Inner</article></div><article>Outer</article>', "Outer"),
        ('<div class="sidebar"><article>Teaser</article></div><p>Body</p>', "Body"),
        ('<div class="comments"><article>Reply</article></div><article>Text</article>', "Text"),
        ('<div class="site-footer">f</div><div class="ad-slot">a</div><div id="top_nav">n</div><article>Text</article>', "Text"),
        ('<article><object data="x.pdf">A drawing.</object> Text</article>', "A drawing. Text"),
        ('<div class="is-hidden">x</div><p>One</p>', "One"),
    ],
)
def test_common_class_names_lose_no_article(html, text):
    found = main_text.blocks(f"<html><body>{html}</body></html>")
    main = main_text.article(found)
    assert (main if main is not None else " ".join(t for p, t in found if p == main_text.OTHER)) == text


def test_fingerprints_at_the_ends_of_the_id_range(spark):
    rng = random.Random(2)
    ids = [-(2**63), -(2**63) + 1, -5, 0, 7, 2**63 - 2, 2**63 - 1, None]
    texts = {i: " ".join(f"w{rng.randrange(50)}" for _ in range(40)) for i in ids}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in winnowing.fingerprints(docs).collect()}
    order = sorted([i for i in ids if i is not None], reverse=True) + [None]
    for i, j in zip(order, order[1:] + order[:1]):
        edited = texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert len(got[i].positions.split()) == len(got[i].fingerprint.split()) > 1


def test_groups_are_linked_over_ranges_of_ids(spark, monkeypatch):
    """Many small groups, most ids in one place: every document meets its next one."""
    monkeypatch.setattr(winnowing, "GROUP", 4)
    monkeypatch.setattr(winnowing, "CUTS", 5)
    rng = random.Random(8)
    ids = [*range(150), *rng.sample(range(10**6, 10**12), 50)]
    rows = [(i, f"text {i} of {rng.random()}") for i in ids] + [(3, "again"), (3, "again")]
    got = winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    texts = dict(rows[:200])
    order = sorted(ids, reverse=True)
    by = {r.doc_id: r for r in got if r.doc_id not in (3, 4)}
    for i, j in zip(order, order[1:] + order[:1]):
        if i not in (3, 4) and j not in (3, 4):
            half = len(texts[i]) // 2
            assert by[i].edited_sha256 == hashlib.sha256((texts[i][: len(texts[i]) - half] + texts[j][:half]).encode()).hexdigest(), i


def test_positions_are_places_of_grams(spark):
    text = " ".join(f"word{i}" for i in range(30))
    row = winnowing.fingerprints(spark.createDataFrame([(1, text), (2, "other")], "doc_id long, text string")).where("doc_id = 1").first()
    places = list(map(int, row.positions.split()))
    assert places == sorted(set(places)) and 1 <= places[0] and places[-1] <= 28
    assert max(b - a for a, b in zip(places, places[1:])) <= winnowing.WINDOW
