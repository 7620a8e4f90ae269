"""Lists and counts of the catalogue: stock, items, favourites, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmatch.functions.text import collated
from basketmatch.operators.skew import join_lookup

# List limits.
LIST_LIMIT, POPULAR_LIMIT = 100, 5
LIST_COLUMNS = (
    "basket_id",
    "title",
    "item_text",
    "instructions",
    "prep_minutes",
    "calories",
    "difficulty",
    "tags",
    "image_url",
)


def list_baskets(baskets: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The first baskets by title (collated), then id."""
    return baskets.select(*LIST_COLUMNS).orderBy(collated("title"), "basket_id").limit(limit)


def list_stock(stock: DataFrame, items: DataFrame) -> DataFrame:
    """Stock with item names, sorted by name (collated) within each owner."""
    named = join_lookup(stock, items.select("item_id", "name"), ["item_id"], ["owner_id"])
    return named.select("owner_id", "item_id", "name", *_if_there(stock, "added_at")).orderBy(
        "owner_id", collated("name"), "item_id"
    )


def stock_names(stock: DataFrame, items: DataFrame) -> DataFrame:
    return list_stock(stock, items).select("owner_id", "name")


def items_with_stock_count(items: DataFrame, stock: DataFrame) -> DataFrame:
    """Every item with the number of stock rows that hold it, most first."""
    held = stock.groupBy("item_id").agg(F.count(F.lit(1)).alias("stock_count"))
    return (
        items.select("item_id", "name")
        .join(held, "item_id", "left")
        .withColumn("stock_count", F.coalesce("stock_count", F.lit(0)))
        .orderBy(F.desc("stock_count"), collated("name"), "item_id")
    )


def usage_counts(bridge: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with the number of baskets that use it, 0 included."""
    used = bridge.groupBy("item_id").agg(F.count(F.lit(1)).alias("usage_count"))
    return (
        items.select("item_id", "name")
        .join(used, "item_id", "left")
        .withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))
    )


def popular_items(bridge: DataFrame, items: DataFrame, k: int = POPULAR_LIMIT) -> DataFrame:
    """The most used items; ties go to the smaller id (the order is ours)."""
    return usage_counts(bridge, items).orderBy(F.desc("usage_count"), "item_id").limit(k)


def totals(baskets: DataFrame, items: DataFrame) -> DataFrame:
    """One row with the number of baskets and items."""
    return _counts(total_baskets=baskets, total_items=items)


def catalog_stats(
    baskets: DataFrame, items: DataFrame, stock: DataFrame, view: str | None = None
) -> DataFrame:
    """One row of counts, also kept as a temporary view when ``view`` names one."""
    stats = _counts(total_baskets=baskets, total_items=items, stock_items=stock)
    if view:
        stats.createOrReplaceTempView(view)
    return stats


def flag_items(
    items: DataFrame, selected: DataFrame, stock: DataFrame, by: str | None = None
) -> DataFrame:
    """Is an item selected, is it in stock (exact names).

    ``selected`` holds names, ``stock`` holds item ids. Without ``by`` both
    belong to one owner and every item gets a row. With ``by`` (a column of
    both) each owner gets rows for the items that carry a flag; all others are
    neither selected nor in stock.
    """
    named = items.select("item_id", "name")
    keys = [by] if by else []
    chosen = join_lookup(selected.select(*keys, "name").distinct(), named, ["name"], keys or ["name"])
    chosen = chosen.select(*keys, "item_id").withColumn("_selected", F.lit(True))
    held = stock.select(*keys, "item_id").distinct().withColumn("_held", F.lit(True))
    if by:
        flags = chosen.join(held, [by, "item_id"], "full")
        flagged = join_lookup(flags, named, ["item_id"], [by])
    else:
        flagged = named.join(chosen, "item_id", "left").join(held, "item_id", "left")
    return flagged.select(
        *keys,
        "item_id",
        "name",
        F.coalesce("_selected", F.lit(False)).alias("is_selected"),
        F.coalesce("_held", F.lit(False)).alias("in_stock"),
    )


def favourite_baskets(favourites: DataFrame, baskets: DataFrame) -> DataFrame:
    """Favourites with their baskets, newest first; a repeated row is repeated."""
    marked = favourites.withColumnRenamed("created_at", "marked_at")
    joined = marked.join(baskets.select(*LIST_COLUMNS), "basket_id")
    return joined.orderBy("session_id", F.desc("marked_at"), "basket_id")


def flag_favourites(rows: DataFrame, favourites: DataFrame) -> DataFrame:
    """Add ``is_favorite`` to rows with a session and a basket."""
    keys = ["session_id", "basket_id"]
    marked = favourites.select(*keys).distinct().withColumn("_marked", F.lit(True))
    return (
        rows.join(marked, keys, "left")
        .withColumn("is_favorite", F.coalesce("_marked", F.lit(False)))
        .drop("_marked")
    )


def only_favourites(rows: DataFrame, favourites: DataFrame) -> DataFrame:
    """Rows whose (session, basket) is a favourite."""
    return rows.join(favourites, ["session_id", "basket_id"], "left_semi")


def _counts(**tables: DataFrame) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    count = F.count(F.lit(1))
    return spark.range(1).select(
        *[df.agg(count.alias("n")).scalar().alias(name) for name, df in tables.items()]
    )


def _if_there(df: DataFrame, name: str) -> list[str]:
    return [name] if name in df.columns else []
