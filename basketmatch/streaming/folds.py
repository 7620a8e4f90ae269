"""Change logs folded to the state they lead to.

A change log is (scope_id, key, op, value, ts, seq). Scopes are owners or
sessions; keys are items, list entries or days. Changes count in (ts, seq)
order, however the rows lie in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketmatch.functions.text import trim_blanks
from basketmatch.operators.skew import join_skewed, previous_value, running_sum
from basketmatch.schemas import ADDED, ALREADY, INVALID, REMOVED

# Operations of a change log.
ADD, SET, REMOVE, CLEAR = "add", "set", "remove", "clear"

_KEY = ["scope_id", "key"]


def named_changes(log: DataFrame) -> DataFrame:
    """``log`` with outer blanks taken off its keys, which are one key with and without."""
    if log.schema["key"].dataType.typeName() != "string":
        return log
    return log.withColumn("key", trim_blanks("key"))


def _has_name() -> Column:
    return F.coalesce(F.col("key").cast("string"), F.lit("")) != ""


def surviving_changes(log: DataFrame, set_creates: bool = False) -> DataFrame:
    """Per key the first add after its last removal, and the last set after that removal.

    Returns (scope_id, key, first, last) with ``first`` and ``last`` as structs
    (ts, seq, value); ``first`` is the change that made the key present. Keys are
    trimmed; changes of a blank key are left out.
    """
    log = named_changes(log)
    when = F.struct("ts", "seq")
    op = F.col("op")
    keyed = log.filter(op.isin(ADD, SET, REMOVE)).filter(_has_name())
    removed = keyed.groupBy(*_KEY).agg(F.max(F.when(op == REMOVE, when)).alias("_removed"))
    cleared = log.filter(op == CLEAR).groupBy("scope_id").agg(F.max(when).alias("_cleared"))
    gone = (
        join_skewed(removed, cleared, ["scope_id"], ["key"], "left")
        .withColumn("_gone", F.greatest("_removed", "_cleared"))
        .filter(F.col("_gone").isNotNull())
        .select(*_KEY, "_gone")
    )
    changes = keyed.filter(op != REMOVE)
    alive = join_skewed(changes, gone, _KEY, ["seq"], "left").filter(
        F.col("_gone").isNull() | (when > F.col("_gone"))
    )
    full = F.struct("ts", "seq", "value")
    creates = op.isin(ADD, SET) if set_creates else op == ADD
    return (
        alive.groupBy(*_KEY)
        .agg(
            F.min(F.when(creates, full)).alias("first"),
            F.max(F.when(op == SET, full)).alias("last"),
        )
        .filter(F.col("first").isNotNull())
        .withColumn("last", F.when(F.col("last") >= F.col("first"), F.col("last")))
    )


def fold_changes(log: DataFrame, set_creates: bool = False) -> DataFrame:
    """The state after all changes: (scope_id, key, added_at, value).

    ``add`` inserts if absent (``added_at`` and value of the first add stay),
    ``set`` gives a present key a new value, ``remove`` drops one key, ``clear``
    the whole scope. With ``set_creates`` a set inserts as well (plans).
    """
    return surviving_changes(log, set_creates).select(
        *_KEY,
        F.col("first.ts").alias("added_at"),
        F.coalesce("last", "first")["value"].alias("value"),
    )


def compact_changes(log: DataFrame, before, set_creates: bool = False) -> DataFrame:
    """A shorter log with the same state, now and after any change from ``before`` on."""
    old = surviving_changes(log.filter(F.col("ts") < before), set_creates)
    made = old.select(*_KEY, F.lit(SET if set_creates else ADD).alias("op"), "first.value", "first.ts", "first.seq")
    changed = old.filter(F.col("last") > F.col("first")).select(
        *_KEY, F.lit(SET).alias("op"), "last.value", "last.ts", "last.seq"
    )
    recent = log.filter(F.col("ts") >= before).select(*made.columns)
    return made.unionByName(changed).unionByName(recent)


def fold_toggles(log: DataFrame) -> DataFrame:
    """Favourites after all toggles (session_id, basket_id, ts): present iff odd."""
    return odd_toggles(count_toggles(log))


def count_toggles(log: DataFrame) -> DataFrame:
    """Toggles and the last one per (session, basket), for tables and streams."""
    return log.groupBy("session_id", "basket_id").agg(
        F.count(F.lit(1)).alias("n_toggles"), F.max("ts").alias("created_at")
    )


def odd_toggles(counts: DataFrame) -> DataFrame:
    odd = F.col("n_toggles") % 2 == 1
    return counts.filter(odd).select("session_id", "basket_id", "created_at")


def toggle_results(log: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Each toggle with its outcome, 'added' or 'removed'."""
    counted = running_sum(
        log, ["session_id", "basket_id"], "ts", "seq", F.lit(1), "_nth", rows_per_task
    )
    outcome = F.when(F.col("_nth") % 2 == 1, ADDED).otherwise(REMOVED)
    return counted.withColumn("result", outcome).drop("_nth")


def change_results(log: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Each add and remove with its outcome; clears are not listed.

    An add finds its key present when the change before it, since the scope's
    last clear, was an add. Removing what is not there succeeds all the same.
    Keys are trimmed; a blank one is invalid and changes no state.
    """
    log = named_changes(log)
    op = F.col("op")
    is_clear = F.when(op == CLEAR, 1).otherwise(0)
    life = running_sum(
        log.filter(op.isin(ADD, REMOVE, CLEAR)), ["scope_id"], "ts", "seq", is_clear, "_life", rows_per_task
    ).filter(op != CLEAR)
    named = _has_name()
    valid = previous_value(
        life.filter(named), [*_KEY, "_life"], "ts", "seq", "op", "_before", rows_per_task
    )
    outcome = (
        F.when(op == REMOVE, REMOVED).when(F.col("_before") == ADD, ALREADY).otherwise(ADDED)
    )
    columns = [*log.columns, "result"]
    return (
        valid.withColumn("result", outcome)
        .select(*columns)
        .unionByName(life.filter(~named).withColumn("result", F.lit(INVALID)).select(*columns))
    )


def clear_results(log: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Each clear of a stock log with the number of rows that it deletes (``deleted``).

    A clear deletes the keys whose last change since the scope's clear before was an add.
    """
    log = named_changes(log)
    op = F.col("op")
    is_clear = F.when(op == CLEAR, 1).otherwise(0)
    life = running_sum(
        log.filter(op.isin(ADD, REMOVE, CLEAR)), ["scope_id"], "ts", "seq", is_clear, "_life", rows_per_task
    )
    last = life.filter(op != CLEAR).filter(_has_name()).groupBy(*_KEY, "_life").agg(F.max_by("op", F.struct("ts", "seq")).alias("_op"))
    present = last.filter(F.col("_op") == ADD).groupBy("scope_id", "_life").agg(F.count(F.lit(1)).alias("deleted"))
    # The n-th clear ends the life before it.
    clears = life.filter(op == CLEAR).withColumn("_life", F.col("_life") - 1)
    told = clears.join(present, ["scope_id", "_life"], "left")
    return told.select("scope_id", "ts", "seq", F.coalesce("deleted", F.lit(0)).alias("deleted"))
