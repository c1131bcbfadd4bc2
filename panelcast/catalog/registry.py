"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import stage
from panelcast.sources import panel as P
from panelcast.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Data:
    """The input tables of a query, read lazily from one folder."""

    spark: SparkSession
    folder: str
    site: str = "nation"

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def train(self) -> DataFrame:
        return P.train(self.spark, self.folder, self.site)

    def stores(self) -> DataFrame:
        return P.stores(self.spark, self.folder, self.site)

    def features(self) -> DataFrame:
        return P.features(self.spark, self.folder, self.site)

    def panel(self) -> DataFrame:
        return P.panel(self.spark, self.folder, self.site)

    def staged_train(self) -> DataFrame:
        """The fact table, written once for queries that read it several times."""
        return stage(self.train(), "train")

    def staged_panel(self) -> DataFrame:
        return stage(self.panel(), "panel")


CTES = {
    "train": """
SELECT store, dept, date, weekly_sales, weekofyear(date) IN (6, 36, 47, 52) AS is_holiday
FROM (SELECT {site} AS store, p_type AS dept,
        CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS date,
        SUM(CASE WHEN l_returnflag = 'R' THEN -0.25::DOUBLE ELSE 1.0::DOUBLE END
            * floor(l_extendedprice * (1 - l_discount) + 0.5::DOUBLE)) AS weekly_sales
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
      GROUP BY 1, 2, 3) c""",
    "stores": """
SELECT n_nationkey AS store, substr('ABC', n_regionkey % 3 + 1, 1) AS type,
  CAST(10000 * COUNT(*) + 100 * n_nationkey AS INTEGER) AS size
FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey""",
    "features": """
SELECT store, date, AVG(l_quantity) AS temperature,
  2 + AVG(floor(100 * l_tax + 0.5::DOUBLE)) AS fuel_price,
  AVG(floor(l_extendedprice / l_quantity + 0.5::DOUBLE)) / 7 AS cpi,
  3 + AVG(floor(100 * l_discount + 0.5::DOUBLE)) AS unemployment,
  SUM(CASE WHEN date >= DATE '1998-06-05' AND l_returnflag = 'A' THEN promo END) AS markdown1,
  SUM(CASE WHEN date >= DATE '1998-06-05' AND l_returnflag = 'N' THEN promo END) AS markdown2,
  SUM(CASE WHEN date >= DATE '1998-06-05' AND l_returnflag = 'R' THEN promo END) AS markdown3,
  SUM(CASE WHEN date >= DATE '1998-06-05' AND l_linestatus = 'F' THEN promo END) AS markdown4,
  SUM(CASE WHEN date >= DATE '1998-06-05' AND l_linestatus = 'O' THEN promo END) AS markdown5
FROM (SELECT {site} AS store, CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS date,
        floor(l_extendedprice * l_discount + 0.5::DOUBLE) AS promo, l.*
      FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey) x
GROUP BY store, date HAVING count_if(l_returnflag = 'R') > 0""",
    "panel": """
SELECT t.*, f.temperature, f.fuel_price, f.cpi, f.unemployment,
  f.markdown1, f.markdown2, f.markdown3, f.markdown4, f.markdown5, s.type, s.size
FROM train t LEFT JOIN features f ON t.store = f.store AND t.date = f.date
LEFT JOIN stores s ON t.store = s.store""",
    "cut": """
SELECT min(date) AS start FROM (SELECT DISTINCT date FROM train ORDER BY date DESC LIMIT 8)""",
}


def define_cte(name: str, sql: str) -> None:
    """Add a shared table expression; it may use those defined before it."""
    if name in CTES:
        raise KeyError(f"{name} is defined twice")
    CTES[name] = sql


def _uses(sql: str) -> list[str]:
    """Shared table expressions a text needs, in the order of definition."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(body)
    return [n for n in CTES if n in needed]


def with_tables(sql: str, site: str = "nation") -> str:
    column = "s_nationkey" if site == "nation" else "CAST(s_suppkey AS INTEGER)"
    names = _uses(sql)
    if site != "nation" and "stores" in names:
        raise ValueError("the site dimension in SQL is defined for nations only")
    head = ",\n".join(f"{n} AS ({CTES[n].replace('{site}', column).strip()})" for n in names)
    body = sql.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def _places(**columns: str) -> dict[str, int]:
    """``r4="a b"`` to ``{"a": 4, "b": 4}``."""
    return {c: int(r[1:]) for r, cols in columns.items() for c in cols.split()}


def round_columns(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """Doubles rounded for comparison between engines; -0.0 becomes 0.0."""
    return df.withColumns(
        {c: F.round(F.col(c).cast("double"), n) + F.lit(0.0) for c, n in places.items()}
    )


def round_sql(sql: str, places: dict[str, int]) -> str:
    if not places:
        return sql
    cells = ", ".join(
        f"round(CAST({c} AS DOUBLE), {n}) + 0.0::DOUBLE AS {c}" for c, n in places.items()
    )
    return f"SELECT * REPLACE ({cells}) FROM (\n{sql}\n) result"


def tail_sql(source: str, key: str) -> str:
    """Two-sided Student tail of columns ``t`` and ``df``, by Simpson's rule on
    the density; ``key`` lists the columns that identify a row."""
    return f"""SELECT {key}, greatest(1 - 2 * area * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()), 0) AS p_value
    FROM (SELECT {key}, df, abs(t) / 4000 / 3 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * pow(1 + pow(abs(t) * i / 4000, 2) / df, -(df + 1) / 2.0)) AS area
      FROM {source} CROSS JOIN range(0, 4001) g(i) GROUP BY {key}, df, t)"""


def query(
    name: str,
    sql: str | None = None,
    site: str = "nation",
    r2: str = "",
    r4: str = "",
    r6: str = "",
    r8: str = "",
    r12: str = "",
):
    """Register ``fn(data) -> DataFrame`` under a name, with its SQL if any.

    ``r2`` to ``r12`` name the columns both sides round to that many
    places, since sums of doubles depend on the order of addition.
    """
    places = _places(r2=r2, r4=r4, r6=r6, r8=r8, r12=r12)

    def register(fn: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise KeyError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: round_columns(fn(Data(spark, folder, site)), places)
        if sql is not None:
            ORACLES[name] = round_sql(with_tables(sql, site), places)
        return fn

    return register
