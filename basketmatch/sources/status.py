"""Which tables are there, and how much they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketmatch.schemas import BASE_TABLES


def dataset_status(catalog: dict[str, DataFrame], expected: tuple[str, ...] = BASE_TABLES) -> DataFrame:
    """One row per expected table: is it there, and its row count (null if not)."""
    spark = next(iter(catalog.values())).sparkSession
    present = None
    for name in expected:
        if name in catalog:
            rows = catalog[name].agg(
                F.lit(name).alias("table_name"),
                F.lit(True).alias("present"),
                F.count(F.lit(1)).alias("n_rows"),
            )
        else:
            rows = spark.range(1).select(
                F.lit(name).alias("table_name"),
                F.lit(False).alias("present"),
                F.lit(None).cast("bigint").alias("n_rows"),
            )
        present = rows if present is None else present.unionByName(rows)
    return present


def existing_tables(spark: SparkSession, expected: tuple[str, ...] = BASE_TABLES) -> list[str]:
    """Names among ``expected`` that the session's catalogue knows."""
    return [name for name in expected if spark.catalog.tableExists(name)]
