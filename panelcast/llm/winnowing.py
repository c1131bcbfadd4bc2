"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into its words, those over ``PIECE`` characters into several pieces.
Every ``GRAM`` neighbouring pieces are hashed; of every ``WINDOW`` neighbouring
hashes the smallest is kept, the rightmost of equal ones. Any run of
``GRAM + WINDOW - 1`` pieces that two texts share therefore leaves a hash in both
fingerprints. A hash and its position are one long: the hash in the upper half,
minus the position, so that the smallest long is the rightmost smallest hash.

Defined cases: null text counts as empty; a text without words has an empty
fingerprint; a text shorter than a gram is one gram, fewer grams than a window are one window;
two empty fingerprints are alike (1), an empty one and another are not (0); equal
ids are ordered by a hash of their texts, null ids come last; a single document is
its own next one; other columns are ignored. The id must be an integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import small_side
from panelcast.session import stage

PIECE = 8
GRAM = 3
WINDOW = 4
#: Documents that are put in order in one group, and cut points of their ids.
GROUP = 256
CUTS = 32


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row: inside a lambda the plain
    expression would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def winnow(text: Column) -> Column:
    """The kept hashes with their positions, in the order of the text."""

    def grams(pieces: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(pieces) - (GRAM - 1)))
        gram = lambda i: F.hash(*[F.get(pieces, i + (o - 1)) for o in range(GRAM)])
        return F.transform(at, lambda i: F.shiftleft(gram(i).cast("long"), 32) - i)

    def minima(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(hashes) - WINDOW))
        return F.transform(at, lambda j: F.least(*[F.get(hashes, j + o) for o in range(WINDOW)]))

    kept = lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1)))
    chosen = lambda p: F.when(F.size(p) > 0, _with(_with(grams(p), minima), kept)).otherwise(F.array().cast("array<bigint>"))
    return _with(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % PIECE), F.lit(0)), chosen)


def hashes(fingerprint: Column) -> Column:
    return F.transform(fingerprint, lambda x: F.shiftright(x, 32).cast("int"))


def positions(fingerprint: Column) -> Column:
    """Places of the kept grams: the number of their first piece, from 1."""
    return F.transform(fingerprint, lambda x: (-x).bitwiseAND(0xFFFFFFFF).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes in all hashes of two arrays of hashes."""
    all_of = F.size(F.array_union(a, b))
    return F.when(all_of == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / all_of)


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), " ")


def in_groups(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with a group of neighbouring ids, bounded in rows for
    ids that are spread evenly between cut points; the first row of each group is
    also in the group before it (``extra``), in descending order, cyclically."""
    cuts = F.percentile_approx("doc_id", [i / CUTS for i in range(1, CUTS)], 10_000)
    r = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), cuts.alias("cuts")).first()
    steps = max(1, -(-r.n // (GROUP * CUTS)))
    if r.lo is None:
        group = F.lit(0).cast("long")
    else:
        edges = sorted({r.lo, *r.cuts, r.hi})
        edge = F.array(*[F.lit(e).cast("long") for e in edges])
        i = F.size(F.filter(edge, lambda e: e <= F.col("doc_id")))
        # As doubles, differences of ids can't overflow and keep their order.
        at = lambda n: F.get(edge, n).cast("double")
        lo, hi = at(F.greatest(F.least(i, F.lit(len(edges) - 1)), F.lit(1)) - 1), at(F.least(i, F.lit(len(edges) - 1)))
        within = F.floor((F.col("doc_id").cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * steps)
        group = F.coalesce(i.cast("long") * steps + F.least(within, F.lit(steps - 1)), F.lit(-1).cast("long"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"tie": F.xxhash64("text"), "group": group})
    # Greater means earlier; a null id is the least.
    first = rows.groupBy("group").agg(F.max(F.struct("doc_id", "tie")).alias("first"))
    # A group's next one is in its own range of ids, or the first of the next range;
    # of ranges there are no more than cut points.
    first = stage(first.withColumn("range", F.floor(F.col("group") / steps)), "group_heads")
    ranges = first.groupBy(F.col("range").alias("of")).agg(F.min("group").alias("head"))
    after = F.coalesce(F.lead("head").over(Window.orderBy("of")), F.min("head").over(Window.partitionBy()))
    in_range = Window.partitionBy("range").orderBy("group")
    firsts = stage(
        first.join(F.broadcast(ranges.select("of", after.alias("after"))), F.col("range") == F.col("of")).select(
            F.coalesce(F.lead("group").over(in_range), F.col("after")).alias("to"),
            F.col("first.doc_id").alias("first_id"), F.col("first.tie").alias("first_tie"),
        ),
        "firsts",
    )
    heads = rows.join(small_side(firsts), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie")))
    heads = heads.dropDuplicates(["to"]).select("doc_id", "text", "tie", F.col("to").alias("group"))
    return rows.withColumn("extra", F.lit(False)).unionByName(heads.withColumn("extra", F.lit(True)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the
    beginning of the next document, with their likeness and the next one's, and the
    places of the kept grams of the text."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    order = Window.partitionBy("group").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half),
    )
    rows = (
        in_groups(docs)
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.when(~F.col("extra"), edited))
        .withColumn("found", winnow(F.col("text")))
        .withColumn("kept", hashes(F.col("found")))
        .withColumn("edited_kept", F.when(F.col("edited").isNotNull(), hashes(winnow(F.col("edited")))))
        .withColumn("next_kept", F.lead("kept").over(order))
        .where(~F.col("extra"))
    )
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("kept")).alias("fingerprint"), as_text(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept")).alias("near_edited"),
        likeness(F.col("kept"), F.col("next_kept")).alias("near_next"),
        F.array_join(positions(F.col("found")), " ").alias("positions"),
    )
