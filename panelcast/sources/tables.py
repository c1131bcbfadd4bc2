"""Readers: explicit schemas, dates parsed on read, NaN turned into NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_SCHEMA = "store int, dept int, date string, weekly_sales double, is_holiday boolean"
TEST_SCHEMA = "store int, dept int, date string, is_holiday boolean"
STORES_SCHEMA = "store int, type string, size int"
FEATURES_SCHEMA = (
    "store int, date string, temperature double, fuel_price double, markdown1 double, "
    "markdown2 double, markdown3 double, markdown4 double, markdown5 double, "
    "cpi double, unemployment double, is_holiday boolean"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of the data folder; columns are pruned by the query."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN marks "missing" in source files; Spark functions expect NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str,
    dates: tuple[str, ...] = ("date",),
    date_format: str = "yyyy-MM-dd",
    null_value: str = "NA",
) -> DataFrame:
    """CSV scan by position with a fixed schema; a missing file raises."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", null_value)
        .csv(path)
    )
    present = [c for c in dates if c in df.columns]
    return nan_to_null(df.withColumns({c: parse_date(F.col(c), date_format) for c in present}))


def parse_date(c: Column, date_format: str = "yyyy-MM-dd") -> Column:
    """Text to date; text that is no date becomes NULL."""
    return F.try_to_timestamp(c, F.lit(date_format)).cast("date")


def read_sales_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four input tables of a sales panel, from CSV files."""
    return {
        "train": read_csv(spark, f"{folder}/train.csv", TRAIN_SCHEMA),
        "test": read_csv(spark, f"{folder}/test.csv", TEST_SCHEMA),
        "stores": read_csv(spark, f"{folder}/stores.csv", STORES_SCHEMA),
        "features": read_csv(spark, f"{folder}/features.csv", FEATURES_SCHEMA),
    }
