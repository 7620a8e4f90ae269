"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmatch.llm.scratch import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each linked node with the smallest node that it reaches.

    Each round points every node at its smallest neighbour, follows the pointers
    twice more, and replaces both ends of each link by what they point at; links
    within one node go. The images of linked nodes stay linked and the smallest
    node of a component stays itself, so that it is left at the end. Rounds grow
    with the logarithm of a component's diameter. A node with very many links costs
    one map-side combined minimum and joins that adaptive execution can split.
    Nodes may be of any ordered type; links with a null end are left out.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    links = stored(links, "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        first = first.select("node", F.least("node", "near").alias("to"))
        pointers = stored(_followed(_followed(first)), "pointers")
        labels = stored(pointers if labels is None else _replaced(labels, pointers, "to"), "labels")
        links = _replaced(_replaced(links, pointers, "a"), pointers, "b")
        links = stored(links.where("a <> b").distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("to").alias("component"))


def _replaced(df: DataFrame, pointers: DataFrame, column: str) -> DataFrame:
    p = pointers.select(F.col("node").alias("_node"), F.col("to").alias("_to"))
    joined = df.join(p, df[column] == p["_node"], "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_node", "_to")


def _followed(pointers: DataFrame) -> DataFrame:
    return _replaced(pointers, pointers, "to")
