"""Joins, numbering and running values that stay even when one key is huge.

A key may hold a third of all rows. The helpers find such keys with one
map-side-combined count, and then split only those keys; all others take the
ordinary path. Nothing is dropped: a split key is put together again by the
join or aggregate that follows.

The count reads the left side once more, so ``join_skewed`` is for stored
tables (or ``checkpointed`` results). Joins on freshly derived rows are left to
Spark, whose adaptive execution splits large partitions as it finds them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ROWS_PER_TASK = 1_000_000
# Rows without a key match nothing; they are spread over so many parts.
NULL_SALTS = 256
# A lookup side is broadcast up to this many rows, counted first. Lookups are
# narrow (ids, a name), so this is some tens of megabytes.
BROADCAST_ROWS = 500_000
# Rows of a part where each row is multiplied or carries a list (``parts_of``).
ROWS_PER_PART = 200_000
# Rows of a range that ``number_rows`` numbers in one task; rows may carry whole texts.
RANGE_ROWS = 10_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's checkpoint folder, else
    one in its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/basketmatch-scratch"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder once and read it from there.

    Cuts the lineage like checkpoint(), but computes ``df`` only once, and the
    row count of the result is in the file footers.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a small table of few files one part per core; large ones stay as they are.

    For steps that cost far more time than bytes. The row count (file footers)
    is looked at first, so a large table is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and df.count() <= ROWS_PER_TASK:
        return df.repartition(cores)
    return df


def parts_of(df: DataFrame, rows_per_part: int | None = None) -> int:
    """Into how many parts a stored table is dealt so that a part stays at ``rows_per_part``
    rows however large the table is; the session's shuffle partitions at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-df.count() // (rows_per_part or ROWS_PER_PART)))


def hot_keys(df: DataFrame, on: Sequence[str], rows_per_task: int | None = None) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows and the number of parts for each.

    There are fewer of them than rows / ``rows_per_task``, a millionth of the rows
    as a rule, which is why callers may broadcast them.
    """
    limit = rows_per_task or ROWS_PER_TASK
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    parts = F.ceil(F.col("_rows") / limit).cast("int")
    return counts.filter(F.col("_rows") > limit).select(*on, parts.alias("_parts"))


def join_skewed(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Equi-join whose hot left keys are salted by ``spread_by``.

    The right rows of a hot key are repeated once per salt. Kinds whose result
    is decided per left row are allowed: inner, left, left_semi, left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join kind {how!r} cannot be salted on the left")
    on = list(on)
    hot = F.broadcast(hot_keys(left, on, rows_per_task))
    spread = F.xxhash64(*spread_by)
    no_key = F.lit(False)
    for name in on:
        no_key = no_key | F.col(name).isNull()
    salt = (
        F.when(no_key, F.pmod(spread, F.lit(NULL_SALTS)))
        .when(F.col("_parts").isNull(), F.lit(0))
        .otherwise(F.pmod(spread, F.col("_parts")))
    )
    salted = left.join(hot, on, "left").withColumn("_salt", salt.cast("int")).drop("_parts")
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)
    repeated = right.join(hot, on, "left").withColumn("_salt", F.explode(salts)).drop("_parts")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def join_lookup(
    left: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Join a stored lookup table: broadcast when its count allows, else salted."""
    if lookup.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(lookup), list(on), how)
    return join_skewed(left, lookup, on, spread_by, how)


def number_rows(df: DataFrame, seq: str, name: str, width: int = RANGE_ROWS) -> DataFrame:
    """Number rows 1, 2, 3, ... in the order of the unique whole number ``seq``.

    Ranges of values are numbered side by side; only the list of range sizes is
    summed up in order. Ranges are as wide as it takes for ``width`` rows on
    average, so the list has a row for each ``width`` rows and not for each value,
    however far the values lie apart. A task takes ten ranges or so.
    """
    low, high, n = df.agg(F.min(seq), F.max(seq), F.count(F.lit(1))).first()
    step = max(width, -(-(high - low + 1) * width // n)) if n else width
    ranged = df.withColumn("_range", F.floor((F.col(seq) - F.lit(low or 0)) / step))
    parts = n // (10 * width)
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        ranged = ranged.repartition(parts, "_range")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_range").orderBy(seq)
    return (
        ranged.join(offsets, "_range")
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .drop("_range", "_before")
    )


def _minute(df: DataFrame, at: str) -> Column:
    """Minutes since 1970 as a whole number that never falls as time goes on."""
    if isinstance(df.schema[at].dataType, T.TimestampNTZType):
        days = F.unix_date(F.col(at).cast("date")).cast("bigint")
        return days * 1440 + F.hour(at) * 60 + F.minute(at)
    return F.floor(F.unix_micros(F.col(at)) / 60_000_000)


def slice_hot_keys(
    log: DataFrame, keys: Sequence[str], at: str, rows_per_task: int | None = None
) -> DataFrame:
    """Add ``_slice``: null for ordinary keys, the minute of ``at`` for hot ones."""
    keys = list(keys)
    hot = F.broadcast(hot_keys(log, keys, rows_per_task))
    return (
        log.join(hot, keys, "left")
        .withColumn("_slice", F.when(F.col("_parts").isNotNull(), _minute(log, at)))
        .drop("_parts")
    )


def running_sum(
    log: DataFrame,
    keys: Sequence[str],
    at: str,
    seq: str,
    value: Column,
    name: str,
    rows_per_task: int | None = None,
) -> DataFrame:
    """Sum of ``value`` per key up to and with each row, in (at, seq) order."""
    keys = list(keys)
    sliced = slice_hot_keys(log.withColumn("_value", value), keys, at, rows_per_task)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.filter(F.col("_slice").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_slice", F.sum("_sum").over(before).alias("_before"))
    )
    inside = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(at, seq)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        sliced.join(offsets, [*keys, "_slice"], "left")
        .withColumn(name, F.coalesce("_before", F.lit(0)) + F.sum("_value").over(inside))
        .drop("_slice", "_value", "_before")
    )


def previous_value(
    log: DataFrame,
    keys: Sequence[str],
    at: str,
    seq: str,
    value: str,
    name: str,
    rows_per_task: int | None = None,
) -> DataFrame:
    """``value`` of the row before within the key, in (at, seq) order."""
    keys = list(keys)
    sliced = slice_hot_keys(log, keys, at, rows_per_task)
    carried = (
        sliced.filter(F.col("_slice").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(F.max_by(value, F.struct(at, seq)).alias("_last"))
        .select(
            *keys,
            "_slice",
            F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carried"),
        )
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(at, seq)
    first = F.row_number().over(inside) == 1
    return (
        sliced.join(carried, [*keys, "_slice"], "left")
        .withColumn(name, F.when(first, F.col("_carried")).otherwise(F.lag(value).over(inside)))
        .drop("_slice", "_carried")
    )


def best_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows per key in ``order``, numbered from 1.

    Spark cuts to ``k`` per key before the shuffle (WindowGroupLimit), so a hot
    key sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
