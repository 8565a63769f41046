"""Reading the tables, with the scope that every query carries pushed into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scoped(df: DataFrame, **scope: object) -> DataFrame:
    """Rows of one scope (tenant, venue, ...): equality predicates that reach the Parquet scan. None means any."""
    for column, value in scope.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """One row by key; Parquet statistics skip row groups."""
    return df.where(F.col(key) == F.lit(value))


def optional(predicate: Column | None) -> Column:
    """A predicate that may be absent."""
    return F.lit(True) if predicate is None else predicate
