"""Name suggestions for a typed beginning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmatch.functions.text import collated, fold
from basketmatch.operators.skew import best_rows

# Fixed value: how many names are suggested.
SUGGESTIONS = 10


def suggest_items(items: DataFrame, queries: DataFrame, k: int = SUGGESTIONS) -> DataFrame:
    """(query_id, rank, name): names that begin with the query, the exact one first.

    ``queries`` is (query_id, query). Each distinct beginning is answered once,
    from the first ``k`` names that have it; an empty query begins every name.
    """
    wanted = queries.withColumn("prefix", fold("query"))
    folded = items.select("name").distinct().withColumn("folded", fold("name"))
    lengths = F.sequence(F.lit(0), F.length("folded"))
    beginnings = folded.select(
        "name", "folded", F.explode(F.transform(lengths, lambda n: F.left("folded", n))).alias("prefix")
    )
    asked = beginnings.join(wanted.select("prefix").distinct(), "prefix", "left_semi")
    exact_first = F.when(F.col("folded") == F.col("prefix"), 1).otherwise(2)
    best = best_rows(asked, ["prefix"], [exact_first, collated("name"), F.col("name")], k, "rank")
    return wanted.join(best.drop("folded"), "prefix").select("query_id", "query", "rank", "name")


def begins_with(items: DataFrame, query: str) -> DataFrame:
    """Items whose name begins with one query (case and accents do not count)."""
    return items.filter(F.startswith(fold("name"), fold(F.lit(query))))
