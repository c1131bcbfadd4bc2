"""Mixing sources to target weights by hash-random order and prefix sums.

Only DataFrame functions. Every row gets a hash-random key. Within a source, rows
are taken in the order of their keys until the source's word budget is met; whole
epochs come first where the budget exceeds the source. The order is never built in
one task: sums per key range give the range in which a budget ends, and only that
range is sorted.

Defined cases: null text has size 0; the null source is a source of its own, last
in order; a null id takes part like any other; of repeated rows at which a budget
ends some are taken, one in part, and the others not; an empty table gives no rows;
other columns are kept by :func:`emit` and ignored by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import SPACE, small_side, word_count
from panelcast.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Hex digits of a key that name its range.
RANGE_DIGITS = 3


def random_key(key: Column, text: Column, seed: str) -> Column:
    """32 hex digits that depend on seed, id and text alone."""
    return F.md5(
        F.concat(
            F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"),
            F.md5(F.coalesce(text, F.lit(""))),
        )
    )


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS) -> DataFrame:
    """Word budget of each source from ``(source, source_size)``.

    A source is full at ``most`` times its size. Filling all sources at a common
    rate per weight, those that get full before the total is used up keep that
    amount; the rest divide what remains by weight.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_level = Window.orderBy("level", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = (
        sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", w)
        .withColumn("full", float(most) * F.col("source_size"))
        .withColumn("level", F.col("full") / F.col("weight"))
        .withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("full_so_far", F.sum("full").over(by_level))
        .withColumn("weight_after", F.sum("weight").over(everything) - F.sum("weight").over(by_level))
        .withColumn("is_full", F.col("full_so_far") + F.col("level") * F.col("weight_after") <= F.col("total"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("is_full"), F.col("full"))).over(everything), F.lit(0.0)))
        .withColumn("weights", F.sum(F.when(~F.col("is_full"), F.col("weight"))).over(everything))
    )
    target = F.when(F.col("is_full"), F.col("full")).otherwise(F.col("left") * F.col("weight") / F.col("weights"))
    return s.select("source", "source_size", target.alias("target"))


def _keyed(docs: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        random_key(F.col(key), F.col(text), seed).alias("key"),
    )


def cuts(rows: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS) -> DataFrame:
    """Per source: size, target, whole epochs, and where the last epoch ends.

    Rows with a key below ``cut_key`` are in the last epoch, the row at it gives
    its first ``cut_words`` words. ``rows`` has source, size and key.
    """
    rows = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = stage(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "ranges")
    budget = targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    budget = budget.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
    budget = stage(budget, "budget")
    in_order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    b = small_side(budget.select(F.col("source").alias("of"), "rest"))
    crossing = (
        ranges.withColumn("before", F.coalesce(F.sum("words").over(in_order), F.lit(0)))
        .join(b, F.col("source").eqNullSafe(F.col("of")))
        .where((F.col("rest") > F.col("before")) & (F.col("rest") <= F.col("before") + F.col("words")))
        .select("of", F.col("range").alias("at"), "before", "rest")
    )
    crossing = stage(crossing, "crossing")
    tied = (
        rows.join(small_side(crossing), F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
        .groupBy("source", "key").agg(F.first("before").alias("before"), F.first("rest").alias("rest"), F.sum("size").alias("words"), F.count("*").alias("tied"))
    )
    by_key = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        tied.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(by_key), F.lit(0)))
        .where((F.col("rest") > F.col("before")) & (F.col("rest") <= F.col("before") + F.col("words")))
        .select(F.col("source").alias("of"), F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_words"), F.col("tied").alias("cut_rows"))
    )
    return stage(budget.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source", "source_size", "target", "epochs", "cut_key", "cut_words", "cut_rows"
    ), "cuts")


def placed(rows: DataFrame, into: str = "tie") -> DataFrame:
    """``rows``, which have been written, with 16 random hex digits by their place."""
    return rows.withColumn(into, F.lpad(F.hex(F.xxhash64("_metadata.file_name", "_metadata.row_index")), 16, "0"))


def tie_cuts(tied: DataFrame, cut: DataFrame) -> DataFrame:
    """Per source whose budget ends among repeated rows: the place at which it does,
    and the words of the row there. ``tied`` has source, size and tie."""
    ranges = tied.groupBy("source", F.substring("tie", 1, RANGE_DIGITS).alias("range")).agg(F.count("*").alias("rows"), F.max("size").alias("size"))
    in_order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    c = small_side(cut.select(F.col("source").alias("of"), F.col("cut_words").alias("wanted")))
    # All rows of a source that are tied have one size.
    whole = F.floor((F.col("wanted") - 1) / F.col("size"))
    crossing = (
        ranges.withColumn("before", F.coalesce(F.sum("rows").over(in_order), F.lit(0))).join(c, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("whole", whole).where((F.col("whole") >= F.col("before")) & (F.col("whole") < F.col("before") + F.col("rows")))
        .select("of", F.col("range").alias("at"), "before", "whole", "wanted")
    )
    by_tie = Window.partitionBy("source").orderBy("tie")
    return (
        tied.join(small_side(stage(crossing, "crossing")), F.col("source").eqNullSafe(F.col("of")) & F.startswith("tie", "at"))
        .withColumn("n", F.col("before") + F.row_number().over(by_tie) - 1).where(F.col("n") == F.col("whole"))
        .select(F.col("source").alias("of"), F.col("tie").alias("cut_tie"), (F.col("wanted") - F.col("whole") * F.col("size")).alias("tie_words"))
    )


def _last(tied: Column) -> Column:
    """Words that a row gives to the last epoch, from its size, key and cuts; ``tied``
    is what a row at the cut gives."""
    return F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), tied).otherwise(0).cast("long")


def _decided(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows``, which have been written, with their cuts and the words taken."""
    c = small_side(cut.withColumnRenamed("source", "of"))
    joined = rows.join(c, F.col("source").eqNullSafe(F.col("of")))
    at_cut = F.col("cut_words")
    if not cut.where("cut_rows > 1").isEmpty():
        among = F.coalesce((F.col("cut_rows") > 1) & (F.col("key") == F.col("cut_key")), F.lit(False))
        tied = placed(rows).join(c, F.col("source").eqNullSafe(F.col("of"))).where(among)
        ends = stage(tie_cuts(tied.select("source", "size", "tie"), cut), "tie_cuts")
        e = small_side(ends.withColumnRenamed("of", "of_tie"))
        joined = placed(rows).join(c, F.col("source").eqNullSafe(F.col("of")))
        joined = joined.join(e, among & F.col("source").eqNullSafe(F.col("of_tie")), "left")
        some = F.when(F.col("tie") < F.col("cut_tie"), F.col("size")).when(F.col("tie") == F.col("cut_tie"), F.col("tie_words")).otherwise(0)
        at_cut = F.when(F.col("cut_rows") > 1, some).otherwise(at_cut)
    return joined.withColumn("last", _last(at_cut)).withColumn("taken", F.col("epochs") * F.col("size") + F.col("last"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS, seed: str = "mix",
) -> DataFrame:
    """How many words the mix takes of each document."""
    rows = stage(_keyed(docs, key, text, source, seed), "sizes")
    return _decided(rows, cuts(rows, weights, share, most)).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def emit(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS, seed: str = "mix",
) -> DataFrame:
    """The mixed corpus: every document once per epoch that takes it. The one
    document of a source at which its budget ends is cut after its last word."""
    narrow = stage(_keyed(docs, key, text, source, seed).drop("doc_id"), "sizes")
    cut = cuts(narrow, weights, share, most)
    names = [f"__m_{c}" for c in ("of", "epochs", "cut_key", "cut_words", "cut_rows")]
    of, epochs, cut_key, cut_words, cut_rows = names
    c = small_side(cut.select(*[F.col(a).alias(b) for a, b in zip(("source", "epochs", "cut_key", "cut_words", "cut_rows"), names)]))
    keyed = docs.withColumns({"__m_source": F.col(source), "__m_key": random_key(F.col(key), F.col(text), seed)})
    rows = keyed.join(c, F.col("__m_source").eqNullSafe(F.col(of)))
    at_cut = F.coalesce(F.col("__m_key") == F.col(cut_key), F.lit(False))
    many = at_cut & (F.col(cut_rows) > 1)
    below = F.when(F.col("__m_key") < F.col(cut_key), 1).otherwise(0)
    out = _copied(rows.where(~many), text, F.col(epochs) + below, F.when(at_cut, F.col(cut_words)))
    if not cut.where("cut_rows > 1").isEmpty():
        tied = placed(stage(rows.where(many), "tied"), "__m_tie")
        narrow = tied.select(F.col("__m_source").alias("source"), word_count(F.col(text)).alias("size"), F.col("__m_tie").alias("tie"))
        ends = stage(tie_cuts(narrow, cut), "tie_cuts")
        e = small_side(ends.select(*[F.col(c).alias(f"__m_{c}_end") for c in ("of", "cut_tie", "tie_words")]))
        tied = tied.join(e, F.col("__m_source").eqNullSafe(F.col("__m_of_end")))
        first = F.when(F.col("__m_tie") < F.col("__m_cut_tie_end"), 1).otherwise(0)
        part = F.when(F.col("__m_tie") == F.col("__m_cut_tie_end"), F.col("__m_tie_words_end"))
        out = out.select(docs.columns).unionByName(_copied(tied, text, F.col(epochs) + first, part).select(docs.columns))
    return out.select(docs.columns)


def _copied(rows: DataFrame, text: str, whole: Column, part: Column) -> DataFrame:
    """A row per whole copy, and one with the first ``part`` words unless that is null."""
    words = F.filter(F.split(F.col(text), SPACE), lambda w: w != "")
    copies = F.array_repeat(F.col(text), whole.cast("int"))
    first = F.array(F.array_join(F.slice(words, F.lit(1), part.cast("int")), " "))
    copies = F.when(part.isNotNull(), F.concat(copies, first)).otherwise(copies)
    return rows.withColumn("__m_copies", copies).withColumn(text, F.explode("__m_copies"))
