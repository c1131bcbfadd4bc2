"""Writers for forecasts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_forecasts(df: DataFrame, path: str, fmt: str = "csv", by: str = "hierarchy_level") -> None:
    """All hierarchy forecasts, one folder per level, written by the executors."""
    writer = df.write.mode("overwrite").partitionBy(by)
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def to_json_documents(df: DataFrame, key: str, name: str = "document") -> DataFrame:
    """One JSON document per row, beside its key."""
    return df.select(key, F.to_json(F.struct(*df.columns)).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
