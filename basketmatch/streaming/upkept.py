"""Answers kept up with a change log, part by part, instead of computed anew.

``stock`` here is (scope_id, key, added_at): the folded state of a stock log whose
scopes are owners and whose keys are item ids as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from basketmatch.functions.match import match_percentage
from basketmatch.operators.coverage import basket_sizes
from basketmatch.operators.skew import checkpointed, join_lookup, join_skewed
from basketmatch.streaming.folds import ADD, CLEAR, change_results, fold_changes, named_changes
from basketmatch.streaming.streams import LOG_COLUMNS, read_batches

_KEY = ["scope_id", "key"]
# The place of what was there before a part of the log: ahead of all its changes.
_BEFORE = -(2**63)


def as_changes(stock: DataFrame, log: DataFrame) -> DataFrame:
    """The state as adds that come before all changes of ``log``."""
    types = {c: log.schema[c].dataType for c in LOG_COLUMNS}
    first = F.lit("0001-01-01 00:00:00").cast(types["ts"])
    values = {"op": F.lit(ADD), "value": F.lit(None), "ts": first, "seq": F.lit(_BEFORE)}
    return stock.select(*(values.get(c, F.col(c)).cast(types[c]).alias(c) for c in LOG_COLUMNS))


def apply_changes(stock: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stock after a further part of the log, and (scope_id, key, delta): what it adds
    (1) and takes away (-1) on the whole.

    Only keys that the part names, and scopes that it clears, are folded; the rest of the
    stock goes through.
    """
    log = checkpointed(named_changes(log).select(*LOG_COLUMNS))
    keys = log.filter(F.col("op") != CLEAR).select(*_KEY).distinct()
    cleared = checkpointed(log.filter(F.col("op") == CLEAR).select("scope_id").distinct())
    whole = join_lookup(stock, cleared.withColumn("_whole", F.lit(True)), ["scope_id"], ["key"], "left")
    named = join_skewed(whole, keys.withColumn("_named", F.lit(True)), _KEY, _KEY, "left")
    split = checkpointed(named.withColumn("_touched", F.col("_whole").isNotNull() | F.col("_named").isNotNull()))
    before = split.filter("_touched").select(*stock.columns)
    after = fold_changes(as_changes(before, log).unionByName(log)).select(*_KEY, "added_at")
    kept = after.join(before.select(*_KEY, F.col("added_at").alias("_since")), _KEY, "left")
    # A key that stays keeps the time of its first add, one that went and came back does not.
    is_old = F.year("added_at") == 1
    after = checkpointed(kept.select(*_KEY, F.when(is_old, F.col("_since")).otherwise(F.col("added_at")).alias("added_at")))
    came = after.join(before, _KEY, "left_anti").select(*_KEY, F.lit(1).alias("delta"))
    went = before.join(after, _KEY, "left_anti").select(*_KEY, F.lit(-1).alias("delta"))
    rest = split.filter("not _touched").select(*stock.columns)
    return checkpointed(rest.unionByName(after.select(*stock.columns))), checkpointed(came.unionByName(went))


def update_coverage(covered: DataFrame, bridge: DataFrame, delta: DataFrame) -> DataFrame:
    """``coverage`` after stock changes (owner_id, item_id, delta), from ``coverage`` before.

    Only bridge rows of the changed items are read; pairs that lose their last hit go.
    """
    links = bridge.select("basket_id", "item_id")
    changed = checkpointed(delta.select("item_id").distinct())
    touched = join_lookup(links, changed, ["item_id"], ["basket_id"], "left_semi")
    hits = join_skewed(touched, delta, ["item_id"], ["basket_id"])
    summed = hits.groupBy("owner_id", "basket_id").agg(F.sum("delta").alias("delta")).filter("delta <> 0")
    sized = join_lookup(basket_sizes(links), checkpointed(touched.select("basket_id").distinct()), ["basket_id"], ["need"], "left_semi")
    summed = summed.join(sized.withColumnRenamed("need", "_need"), "basket_id")
    merged = covered.select("owner_id", "basket_id", "have", "need").join(summed, ["owner_id", "basket_id"], "full")
    have = F.coalesce("have", F.lit(0)) + F.coalesce("delta", F.lit(0))
    need = F.coalesce("need", "_need")
    counted = merged.select("owner_id", "basket_id", have.cast("bigint").alias("have"), need.cast("bigint").alias("need"))
    complete = (F.col("have") == F.col("need")).alias("is_complete")
    return counted.filter("have > 0").select("*", match_percentage("have", "need").alias("match_percentage"), complete)


class OutcomeStore:
    """The outcome of each streamed change, told in the order of event time.

    A change is settled once the watermark (latest time less ``delay``) has passed it:
    then no earlier one can come any more. Each batch keeps three small tables in the
    folder, ``stock`` (the state at the watermark), ``waiting`` (changes after it) and
    ``marks`` (the watermark); changes that come too late go to ``late`` and change
    nothing. A batch that is run again replaces its own output and nothing else.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, delay: str = "1 hour"):
        self.spark = spark
        self.folder = folder
        self.schema = T.StructType([schema[c] for c in LOG_COLUMNS])
        self.delay = delay
        told = T.StructType([*self.schema.fields, T.StructField("result", T.StringType())])
        time = T.StructField("added_at", schema["ts"].dataType)
        self.schemas = {
            "results": told,
            "late": self.schema,
            "waiting": self.schema,
            "stock": T.StructType([schema["scope_id"], schema["key"], time]),
            "marks": T.StructType([T.StructField("mark", schema["ts"].dataType)]),
        }

    def write(self, batch: DataFrame, batch_id: int) -> None:
        mark = self._of("marks", batch_id - 1).agg(F.max("mark")).scalar()
        is_late = F.coalesce(F.col("ts") < mark, F.lit(False))
        rows = checkpointed(named_changes(batch).select(*LOG_COLUMNS, is_late.alias("late")))
        self._put("late", batch_id, rows.filter("late").select(*LOG_COLUMNS))
        waiting = checkpointed(rows.filter("not late").drop("late").unionByName(self._of("waiting", batch_id - 1)))
        newest = waiting.agg(F.max("ts").alias("ts")).select((F.col("ts") - F.expr(f"INTERVAL {self.delay}")).alias("mark"))
        marks = checkpointed(newest.unionByName(self._of("marks", batch_id - 1)).agg(F.max("mark").alias("mark")))
        is_due = F.coalesce(F.col("ts") < marks.scalar(), F.lit(False))
        due = waiting.filter(is_due)
        stock = self._of("stock", batch_id - 1)
        self._put("results", batch_id, self._told(stock, due))
        self._put("stock", batch_id, apply_changes(stock, due)[0])
        self._put("waiting", batch_id, waiting.filter(~is_due))
        self._put("marks", batch_id, marks)

    def results(self) -> DataFrame:
        """All outcomes: the settled ones, and those of waiting changes as they stand."""
        newest = self._all("marks").agg(F.max("batch")).first()[0]
        settled = self._all("results").drop("batch")
        if newest is None:
            return settled
        return settled.unionByName(self._told(self._of("stock", newest), self._of("waiting", newest)))

    def late(self) -> DataFrame:
        return self._all("late").drop("batch")

    def _told(self, stock: DataFrame, log: DataFrame) -> DataFrame:
        both = as_changes(stock, log).unionByName(log.select(*LOG_COLUMNS))
        told = change_results(both).filter(F.col("seq") != _BEFORE)
        return told.select(*LOG_COLUMNS, "result")

    def _put(self, part: str, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{part}/batch={batch_id}")

    def _all(self, part: str) -> DataFrame:
        return read_batches(self.spark, self.folder, part, self.schemas[part])

    def _of(self, part: str, batch_id: int) -> DataFrame:
        return self._all(part).filter(F.col("batch") == batch_id).drop("batch")


def stream_change_results(changes: DataFrame, store: OutcomeStore) -> DataStreamWriter:
    return changes.writeStream.foreachBatch(store.write).option("checkpointLocation", f"{store.folder}/checkpoint")
