"""Keeping a catalogue: inserts, upserts, deletes, cascades and audits.

Tables are values: each operator returns the table as it is afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmatch.functions.text import collated, trim_blanks
from basketmatch.operators.skew import checkpointed, join_lookup, join_skewed, number_rows
from basketmatch.schemas import ADDED, ALREADY, FOREIGN_KEYS, INVALID, UNIQUE_KEYS, apply_defaults

_NAME_KEY = "_name_key"


def _keyed(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn(_NAME_KEY, collated(name))


def upsert_items(items: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert items by name; on a clash (collated) only the spelling is replaced.

    ``incoming`` is (item_id, name, category, created_at, seq): the last row of a
    name wins, its id is used only when the name is new.
    """
    columns = [c for c in items.columns]
    latest = (
        _keyed(incoming)
        .groupBy(_NAME_KEY)
        .agg(F.max_by("name", "seq").alias("_new_name"), F.min_by(F.struct(*columns), "seq").alias("_first"))
    )
    merged = _keyed(items).join(latest, _NAME_KEY, "full")
    is_new = F.col("item_id").isNull()
    return merged.select(
        *[
            F.coalesce("_new_name", "name").alias(c)
            if c == "name"
            else F.when(is_new, F.col(f"_first.{c}")).otherwise(F.col(c)).alias(c)
            for c in columns
        ]
    )


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append the incoming rows whose key is not there yet, each key once."""
    fresh = incoming.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def add_stock(stock: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add items to owners' stock unless they are there; the first ``added_at`` stays."""
    keys = ["owner_id", "item_id"]
    earliest = incoming.groupBy(*keys).agg(F.min("added_at").alias("added_at"))
    return insert_ignore(stock, earliest, keys)


def add_stock_by_name(
    items: DataFrame, stock: DataFrame, incoming: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add typed item names to owners' stock; unknown names become items first.

    ``incoming`` is (seq, owner_id, name, added_at). Returns the items and the stock
    afterwards, and (seq, owner_id, name, item_id, result) for each row: 'invalid' for a
    blank name, 'added' for the first row of an item that its owner did not have, else
    'already there'.
    """
    # used several times each: written once
    incoming = checkpointed(incoming.select("seq", "owner_id", "name", "added_at"))
    everything, resolved, rejects = get_or_create_items(items, incoming.select("seq", "name"))
    keys = ["owner_id", "item_id"]
    rows = checkpointed(incoming.drop("name").join(resolved, "seq"))
    first = rows.groupBy(*keys).agg(F.min("seq").alias("_first"), F.min_by("added_at", "seq").alias("added_at"))
    fresh = first.join(stock.select(*keys), keys, "left_anti")
    added = F.when(F.col("seq") == F.col("_first"), F.lit(ADDED)).otherwise(F.lit(ALREADY))
    told = join_skewed(rows.drop("added_at"), fresh.drop("added_at"), keys, ["seq"], "left")
    valid = told.select("seq", "owner_id", "name", "item_id", added.alias("result"))
    invalid = incoming.select("seq", "owner_id").join(rejects.select("seq", "name"), "seq")
    invalid = invalid.withColumns({"item_id": F.lit(None).cast("bigint"), "result": F.lit(INVALID)})
    return everything, stock.unionByName(fresh.select(*stock.columns)), valid.unionByName(invalid)


def append_baskets(baskets: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add baskets in the order of ``seq``; ids go on from the largest, defaults fill in.

    The new baskets have no bridge rows yet (see ``link_items``).
    """
    numbered = number_rows(incoming, "seq", "_no").withColumn(
        "basket_id", _last(baskets, "basket_id") + F.col("_no")
    )
    for name in baskets.columns:
        if name not in numbered.columns:
            numbered = numbered.withColumn(name, F.lit(None).cast(baskets.schema[name].dataType))
    return baskets.unionByName(apply_defaults(numbered, "baskets").select(*baskets.columns))


def get_or_create_items(
    items: DataFrame, names: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Find each typed name (trimmed, collated) and create those that are new.

    ``names`` is (seq, name). Returns the items afterwards, (seq, name, item_id)
    for each valid name, and the rejected (empty) ones. New ids follow the order
    of first arrival.
    """
    # names and new ones are used several times: written once, the collation of a name costs
    trimmed = checkpointed(names.select("seq", F.coalesce(trim_blanks("name"), F.lit("")).alias("name")))
    rejects = trimmed.filter(F.col("name") == "")
    valid = _keyed(trimmed.filter(F.col("name") != ""))
    known = _keyed(items).select(_NAME_KEY, "item_id")
    first = valid.groupBy(_NAME_KEY).agg(F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name"))
    unknown = checkpointed(first.join(known, _NAME_KEY, "left_anti").select("seq", "name"))
    created = _keyed(number_rows(unknown, "seq", "_no")).withColumn(
        "item_id", _last(items, "item_id") + F.col("_no")
    )
    added = created.select("item_id", "name")
    for name in items.columns:
        if name not in added.columns:
            added = added.withColumn(name, F.lit(None).cast(items.schema[name].dataType))
    everything = items.unionByName(apply_defaults(added, "items").select(*items.columns))
    ids = known.unionByName(created.select(_NAME_KEY, "item_id"))
    resolved = join_skewed(valid, ids, [_NAME_KEY], ["seq"]).select("seq", "name", "item_id")
    return everything, resolved, rejects


def delete_by_key(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not listed in ``gone``; keys that match nothing are fine."""
    spread = [c for c in df.columns if c not in keys] or list(keys)
    return join_lookup(df, gone.select(*keys).distinct(), keys, spread, "left_anti")


def clear_owner(stock: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Empty the stock of the listed owners; also the deleted rows per owner."""
    listed = owners.select("owner_id").distinct()
    counts = stock.groupBy("owner_id").agg(F.count(F.lit(1)).alias("_n"))
    deleted = listed.join(counts, "owner_id", "left").select(
        "owner_id", F.coalesce("_n", F.lit(0)).alias("deleted")
    )
    return delete_by_key(stock, listed, ["owner_id"]), deleted


def orphans(catalog: dict[str, DataFrame]) -> DataFrame:
    """Foreign-key values without a parent: (child, column, value, n_rows)."""
    found = []
    for child, column, parent in FOREIGN_KEYS:
        used = catalog[child].groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
        missing = used.join(catalog[parent].select(column), column, "left_anti")
        found.append(
            missing.select(
                F.lit(child).alias("child"),
                F.lit(column).alias("column"),
                F.col(column).cast("bigint").alias("value"),
                "n_rows",
            )
        )
    return reduce(DataFrame.unionByName, found)


def cascade_delete(
    catalog: dict[str, DataFrame], table: str, gone: DataFrame
) -> dict[str, DataFrame]:
    """Delete keys of ``table`` and every row that refers to them."""
    column = _key_of(table)
    after = dict(catalog) | {table: delete_by_key(catalog[table], gone, [column])}
    for child, child_column, parent in FOREIGN_KEYS:
        if parent == table:
            after[child] = delete_by_key(after[child], gone, [child_column])
    return after


def cascade_rekey(
    catalog: dict[str, DataFrame], table: str, changes: DataFrame
) -> dict[str, DataFrame]:
    """Give keys of ``table`` new values (old_id, new_id), also where they are used."""
    column = _key_of(table)
    after = dict(catalog) | {table: _rekeyed(catalog[table], column, changes)}
    for child, child_column, parent in FOREIGN_KEYS:
        if parent == table:
            after[child] = _rekeyed(after[child], child_column, changes)
    return after


def dedupe_unique(df: DataFrame, table: str, order: str) -> DataFrame:
    """One row per unique key of ``table``: the first in ``order``."""
    keys, named = _unique(df, table)
    rows = named.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_row"))
    return rows.select("_row.*")


def unique_violations(df: DataFrame, table: str) -> DataFrame:
    """Unique keys of ``table`` that occur more than once, with their count."""
    keys, named = _unique(df, table)
    shown = [F.min(c).alias(c) for c in UNIQUE_KEYS[table] if c not in keys]
    counted = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *shown)
    return counted.filter(F.col("n_rows") > 1).select(*UNIQUE_KEYS[table], "n_rows")


def _unique(df: DataFrame, table: str) -> tuple[list[str], DataFrame]:
    keys = list(UNIQUE_KEYS[table])
    return ([_NAME_KEY], _keyed(df)) if keys == ["name"] else (keys, df)


def _rekeyed(df: DataFrame, column: str, changes: DataFrame) -> DataFrame:
    renamed = changes.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
    spread = [c for c in df.columns if c != column] or [column]
    joined = join_lookup(df, renamed, [column], spread, "left")
    return joined.withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def _key_of(table: str) -> str:
    return {"items": "item_id", "baskets": "basket_id"}[table]


def _last(df: DataFrame, column: str):
    return F.coalesce(df.agg(F.max(column).alias("n")).scalar(), F.lit(0))
