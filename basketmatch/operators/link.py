"""Linking baskets to items: by rules given as data, or by the item list text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmatch.functions.text import collated, norm, parse_item_text
from basketmatch.operators.skew import join_skewed


def link_by_rules(baskets: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """(basket_id, item_id) for rules (title, item_name), both compared collated.

    Rules meet items first; what is left meets the baskets on the title.
    """
    named = items.select("item_id", collated("name").alias("_name"))
    ready = (
        rules.select(collated("title").alias("_title"), collated("item_name").alias("_name"))
        .distinct()
        .join(named, "_name")
        .select("_title", "item_id")
    )
    titled = baskets.select("basket_id", collated("title").alias("_title"))
    return join_skewed(titled, ready, ["_title"], ["basket_id"]).select("basket_id", "item_id")


def link_by_text(baskets: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links from the parsed item list, ``norm`` to ``norm``, and the names without an item."""
    named = items.select("item_id", norm("name").alias("name_key"))
    mentions = baskets.select("basket_id", F.explode(parse_item_text("item_text")).alias("name_key"))
    links = join_skewed(mentions, named, ["name_key"], ["basket_id"]).select("basket_id", "item_id")
    unlinked = (
        mentions.groupBy("name_key")
        .agg(F.count(F.lit(1)).alias("n_baskets"))
        .join(named, "name_key", "left_anti")
    )
    return links.distinct(), unlinked
