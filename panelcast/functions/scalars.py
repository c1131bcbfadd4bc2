"""Column-level functions: calendar, events, promotions, casts, keys."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_parts(date: Column) -> dict[str, Column]:
    """Year, month, ISO week, quarter and day of year."""
    return {
        "year": F.year(date),
        "month": F.month(date),
        "week": F.weekofyear(date),
        "quarter": F.quarter(date),
        "day_of_year": F.dayofyear(date),
    }


def cyclic(part: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a calendar part; parts beyond the period do not wrap."""
    angle = part * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def event_weight(flag: Column, weight: float = 5.0) -> Column:
    return F.when(flag.cast("int") == 1, F.lit(weight)).otherwise(F.lit(1.0))


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def promo_total(cols: Iterable[str]) -> Column:
    total = F.lit(0.0)
    for c in cols:
        total = total + zero_if_null(F.col(c))
    return total


def promo_active(c: Column) -> Column:
    """1 where the promotion is positive; null and negative amounts are 0."""
    return (zero_if_null(c) > 0).cast("int")


def promo_intensity(total: Column, size: Column) -> Column:
    return total / (size + 1)


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column) -> Column:
    return ratio(num * 100.0, den)


def signs(c: Column) -> dict[str, Column]:
    return {"negative": c < 0, "zero": c == 0, "positive": c > 0}


def flag_to_number(c: Column) -> Column:
    """Booleans and their text forms to 1.0 / 0.0, anything else to NULL."""
    text = F.lower(c.cast("string"))
    return F.when(text.isin("true", "1"), 1.0).when(text.isin("false", "0"), 0.0)


def to_number(c: Column) -> Column:
    """Text to double; text that is no number becomes NULL."""
    return c.cast("string").try_cast("double")


def epoch_seconds(date: Column) -> Column:
    return F.unix_date(date).cast("bigint") * 86400


def month_start(date: Column) -> Column:
    return F.make_date(F.year(date), F.month(date), F.lit(1))


def store_key(store: Column) -> Column:
    return F.concat(F.lit("Store_"), store.cast("string"))


def leaf_key(store: Column, dept: Column) -> Column:
    return F.concat(F.lit("Store_"), store.cast("string"), F.lit("_Dept_"), dept.cast("string"))


def parse_key(key: Column) -> tuple[Column, Column]:
    """Entity key back to its store and department ids, NULL where absent."""
    store = F.regexp_extract(key, r"^Store_(.+?)(?:_Dept_.*)?$", 1)
    dept = F.regexp_extract(key, r"_Dept_(.+)$", 1)
    return F.nullif(store, F.lit("")), F.nullif(dept, F.lit(""))


def strength_label(r: Column) -> Column:
    """Class of a correlation by its absolute value."""
    size = F.abs(r)
    return (
        F.when(size > 0.5, "strong")
        .when(size > 0.3, "moderate")
        .when(size > 0.1, "weak")
        .otherwise("negligible")
    )
