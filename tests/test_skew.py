from __future__ import annotations

import random

import pytest
from helpers import at
from pyspark.sql import functions as F

from basketmatch.operators import skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_salted_join_equals_plain_join(spark, how, limit):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, 2, 3, None]), i) for i in range(200)]
    left = spark.createDataFrame(rows, "k int, v int")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (2, "c"), (9, "d")], "k int, w string")
    salted = skew.join_skewed(left, right, ["k"], ["v"], how, rows_per_task=limit)
    plain = left.join(right, ["k"], how)
    assert salted.columns == plain.columns
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_lookup_falls_back_to_salting(spark, monkeypatch):
    left = spark.range(50).select((F.col("id") % 3).alias("k"), "id")
    right = spark.range(2).withColumnRenamed("id", "k")
    expected = sorted(skew.join_lookup(left, right, ["k"], ["id"]).collect())
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 5)
    assert sorted(skew.join_lookup(left, right, ["k"], ["id"]).collect()) == expected


def test_number_rows(spark):
    seqs = [5, 0, 17, 18, 19, 3, 1_000_000, 42]
    df = spark.createDataFrame([(s,) for s in seqs], "seq bigint")
    numbered = skew.number_rows(df, "seq", "no", width=4)
    assert sorted((r.no, r.seq) for r in numbered.collect()) == list(enumerate(sorted(seqs), 1))


@pytest.mark.parametrize("time_type", ["timestamp", "timestamp_ntz"])
def test_sliced_running_values_equal_one_window(spark, time_type):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 4}", at(rng.randrange(9)), i, rng.choice("ab")) for i in range(300)]
    df = spark.createDataFrame(rows, f"k string, ts {time_type}, seq bigint, v string")
    expected_sum, expected_prev, sums, prevs = {}, {}, {}, {}
    for k, ts, seq, v in sorted(rows, key=lambda r: (r[1], r[2])):
        sums[k] = sums.get(k, 0) + (v == "a")
        expected_sum[seq], expected_prev[seq] = sums[k], prevs.get(k)
        prevs[k] = v
    value = (F.col("v") == "a").cast("int")
    for limit in (10, 10_000):
        summed = skew.running_sum(df, ["k"], "ts", "seq", value, "n", limit).collect()
        assert {r.seq: r.n for r in summed} == expected_sum
        previous = skew.previous_value(df, ["k"], "ts", "seq", "v", "p", limit).collect()
        assert {r.seq: r.p for r in previous} == expected_prev


def test_checkpointed_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, ["a"], at(0)), (None, None, None)], "a int, b array<string>, c timestamp")
    stored = skew.checkpointed(df)
    assert stored.schema == df.schema
    assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect()))


def test_hot_key_from_before_time_zero(spark):
    """Minute 0 and minutes before 1970 are slices like any other."""
    from datetime import datetime

    times = [datetime(1969, 12, 31, 23, 58, 50), datetime(1970, 1, 1), datetime(1970, 1, 1, 0, 1, 10), datetime(1970, 1, 1, 0, 2, 10)]
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate(times)], "k string, ts timestamp_ntz, seq bigint")
    for limit in (1, 100):
        got = skew.running_sum(df, ["k"], "ts", "seq", F.lit(1), "n", limit).orderBy("seq").collect()
        assert [r.n for r in got] == [1, 2, 3, 4]
        got = skew.previous_value(df, ["k"], "ts", "seq", "seq", "p", limit).orderBy("seq").collect()
        assert [r.p for r in got] == [None, 0, 1, 2]


def test_every_hot_key_is_split(spark):
    df = spark.range(3000).select((F.col("id") % 1500).alias("k"), "id")
    hot = skew.hot_keys(df, ["k"], 1)
    assert hot.count() == 1500 and {r._parts for r in hot.collect()} == {2}
    big = spark.range(1000).select(F.lit(1).alias("k"))
    assert skew.hot_keys(big, ["k"], 2).first()._parts == 500


def test_sparse_numbers_make_few_ranges(spark):
    df = spark.createDataFrame([(s * 10**12 - 7,) for s in range(40)], "seq bigint")
    numbered = skew.number_rows(df, "seq", "no", width=10)
    assert sorted((r.no, r.seq) for r in numbered.collect()) == [(i + 1, i * 10**12 - 7) for i in range(40)]
    assert skew.number_rows(df.limit(0), "seq", "no").count() == 0


def test_ranges_that_are_numbered_stay_small(spark):
    """Rows may carry whole texts, so a task must not get a million of them."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        numbered = skew.number_rows(spark.range(5 * skew.RANGE_ROWS).withColumnRenamed("id", "seq"), "seq", "no")
        assert numbered.filter("no = seq + 1").count() == 5 * skew.RANGE_ROWS
        assert numbered.groupBy(F.spark_partition_id()).count().count() > 1
        numbered = skew.number_rows(spark.range(500).withColumnRenamed("id", "seq"), "seq", "no", width=5)
        assert numbered.rdd.getNumPartitions() == 10 and numbered.filter("no = seq + 1").count() == 500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
