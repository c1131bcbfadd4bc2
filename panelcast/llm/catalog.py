"""The corpus queries, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import (
    byte_bpe, chat, cotrain, exact_dedup, fill_middle, jaccard, language_id, lexical, main_text, mixture, token_counts, toxicity, winnowing,
)
from panelcast.sources.tables import read_table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_ngram_jaccard")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_components(read_table(spark, folder, "documents"))


@query("op2_token_counts")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = token_counts.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(read_table(spark, folder, "documents"), vocabulary)


@query("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.detect(read_table(spark, folder, "documents"))


@query("op4_byte_bpe")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.round_trip(read_table(spark, folder, "documents"), tokens, public_tokenizers.PATTERN)


@query("op5_chat_format")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(read_table(spark, folder, "conversations"))


@query(
    "op6_exact_dedup",
    r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)""",
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.keepers(exact_dedup.duplicates(read_table(spark, folder, "documents")))


@query("op7_fingerprints")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.fingerprints(read_table(spark, folder, "documents"))


@query("op8_main_text")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(read_table(spark, folder, "pages"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    return cotrain.score(docs, labels).select("doc_id", *cotrain.SCORES)


@query(
    "op10_source_mixture",
    r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n
  FROM d GROUP BY source),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
l AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS level,
    1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM w),
f AS (
  SELECT *, sum(most) OVER o + level * (sum(weight) OVER () - sum(weight) OVER o) <= total AS is_full
  FROM l WINDOW o AS (ORDER BY level, n ROWS UNBOUNDED PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN most
    ELSE (total - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0::DOUBLE)) * weight
      / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target
  FROM f),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
    floor(e.target)::BIGINT - e.epochs * e.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(read_table(spark, folder, "documents")).drop("source")


@query(
    "op11_fill_middle",
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
      OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT *, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m,
    substr(t, greatest(a, b) + 1) AS s FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.digests(read_table(spark, folder, "documents"))


@query("op12_toxicity")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.detect(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query(
    "op13_lexical_search",
    r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
i AS (
  SELECT row_number() OVER () AS item, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark),
q AS (SELECT item, term, count(*) AS times FROM (SELECT item, unnest(terms) AS term FROM i) GROUP BY item, term),
g AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
p AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY row, term),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM p, g GROUP BY term, n_docs),
s AS (
  SELECT q.item, p.row, sum(q.times * w.weight * ((1000000000 * p.tf) // (1000 * p.tf
    + 12 * (100 - 25 + ((25 * len(d.terms) * g.n_docs) // g.n_terms)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d ON d.row = p.row, g GROUP BY q.item, p.row),
r AS (
  SELECT item, row, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM s JOIN d USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (item) JOIN d USING (row) WHERE rank <= 20""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
