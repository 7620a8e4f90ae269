"""Reading a catalogue: Parquet folders, JDBC tables, seed files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from basketmatch.schemas import BASE_TABLES, SCHEMAS, apply_defaults


def read_catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The base tables of a folder, one Parquet data set each, with fixed schemas."""
    return {
        name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")
        for name in BASE_TABLES
    }


def jdbc_options(
    url: str, table: str, split_by: str | None = None, low: int = 0, high: int = 0, parts: int = 1
) -> dict[str, str]:
    """Options of one JDBC read; with ``split_by`` the table is read in ``parts``."""
    options = {"url": url, "dbtable": table, "fetchsize": "10000"}
    if split_by is not None and parts > 1:
        options |= {
            "partitionColumn": split_by,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(parts),
        }
    return options


def read_catalog_jdbc(
    spark: SparkSession, tables: dict[str, dict[str, str]], **connection: str
) -> dict[str, DataFrame]:
    """The same tables from a database; ``tables`` maps names to ``jdbc_options``."""
    return {
        name: spark.read.format("jdbc").options(**connection, **options).load()
        for name, options in tables.items()
    }


def load_seed(
    spark: SparkSession,
    path: str,
    table: str,
    schema: T.StructType | None = None,
    format: str | None = None,
) -> DataFrame:
    """Rows of CSV (with header; texts may hold line breaks) or JSON lines, defaults filled in.

    ``format`` is ``csv`` or ``json``; without it the name decides (``.csv``, ``.json``,
    ``.jsonl``, each also compressed), and any other name is refused. A value that does
    not fit the schema fails the read instead of turning null.
    """
    if format is None:
        named = re.search(r"\.(csv|json|jsonl)(\.\w+)?/?$", path)
        if named is None:
            raise ValueError(f"name the format of {path!r}: csv or json")
        format = "csv" if named[1] == "csv" else "json"
    reader = spark.read.schema(schema or SCHEMAS[table]).option("mode", "FAILFAST")
    if format == "csv":
        rows = reader.csv(path, header=True, multiLine=True, escape='"')
    else:
        rows = reader.json(path)
    return apply_defaults(rows, table)


def append_table(df: DataFrame, folder: str, table: str) -> None:
    df.select(*SCHEMAS[table].names).write.mode("append").parquet(f"{folder}/{table}")
