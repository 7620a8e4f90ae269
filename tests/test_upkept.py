"""Coverage and outcomes kept up with a change log beside those of the whole log."""

from __future__ import annotations

import random

import pytest
from helpers import BRIDGE, at, table

from basketmatch.operators.coverage import coverage
from basketmatch.streaming import folds, upkept
from workload import changes as workload_changes
from workload.registry import QUERIES

SCHEMA = "scope_id string, key string, op string, value string, ts timestamp, seq long"


def random_log(seed, n=80):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        op = rng.choices(["add", "remove", "clear"], [6, 3, 1])[0]
        key = None if op == "clear" else rng.choice([str(rng.randint(1, 12)), f" {rng.randint(1, 3)}\t", " "] if seq % 9 == 0 else [str(rng.randint(1, 12))])
        rows.append((rng.choice(["o1", "o2", "o3"]), key, op, None, at(rng.randint(0, 30) + seq * 2), seq))
    return sorted(rows, key=lambda r: (r[4], r[5]))


def stock_of(spark, rows):
    state = folds.fold_changes(spark.createDataFrame(rows, SCHEMA))
    return state.select("scope_id", "key", "added_at")


def owned(stock):
    return stock.selectExpr("scope_id as owner_id", "cast(key as bigint) as item_id")


def test_a_log_in_parts_gives_the_same_stock_and_coverage(spark):
    rows, bridge = random_log(1), table(spark, "bridge", BRIDGE)
    for cuts in ([20, 55], [0, 1, 40]):
        edges = [0, *cuts, len(rows)]
        stock = stock_of(spark, [])
        covered = coverage(bridge, owned(stock))
        for low, high in zip(edges, edges[1:]):
            before = {(r.scope_id, r.key) for r in stock.collect()}
            stock, delta = upkept.apply_changes(stock, spark.createDataFrame(rows[low:high], SCHEMA))
            now = sorted(map(tuple, stock.collect()))
            assert now == sorted(map(tuple, stock_of(spark, rows[:high]).collect()))
            after = {(s, k) for s, k, _ in now}
            assert {(r.scope_id, r.key, r.delta) for r in delta.collect()} == {(*k, 1) for k in after - before} | {(*k, -1) for k in before - after}
            changes = delta.selectExpr("scope_id as owner_id", "cast(key as bigint) as item_id", "delta")
            covered = upkept.update_coverage(covered, bridge, changes)
            names = ("owner_id", "basket_id", "have", "need", "match_percentage", "is_complete")
            assert sorted(map(tuple, covered.select(*names).collect())) == sorted(map(tuple, coverage(bridge, owned(stock)).select(*names).collect()))


@pytest.mark.parametrize("delay", ["30 minutes", "10 days"])
def test_streamed_outcomes_equal_those_of_the_whole_log(spark, tmp_path, delay):
    """Rows come in any order within the delay, in batches of which one runs twice."""
    rows = random_log(2)
    rng = random.Random(3)
    arrived = sorted(rows, key=lambda r: (r[4] - at(0)).total_seconds() / 60 + rng.random() * 25)
    log = spark.createDataFrame(rows, SCHEMA)
    store = upkept.OutcomeStore(spark, str(tmp_path), log.schema, delay)
    for batch_id, low in enumerate(range(0, len(arrived), 27)):
        some = spark.createDataFrame(arrived[low : low + 27], SCHEMA)
        for _ in range(2 if batch_id == 1 else 1):
            store.write(some, batch_id)
    want = {(r.seq, r.result) for r in folds.change_results(log).collect()}
    got = [(r.seq, r.result) for r in store.results().collect()]
    assert len(got) == len(want) and set(got) == want and store.late().count() == 0
    late = spark.createDataFrame([("o1", "1", "add", None, at(-60 * 24 * 30), 999)], SCHEMA)
    store.write(late, 3)
    assert [r.seq for r in store.late().collect()] == [999]
    assert set((r.seq, r.result) for r in store.results().collect()) == want


def test_clears_tell_what_they_delete(spark):
    rows = random_log(4, 150)
    held, want = {}, {}
    for scope, key, op, _, _, seq in rows:
        mine = held.setdefault(scope, set())
        if op == "clear":
            want[seq] = len(mine)
            mine.clear()
        elif key.strip():
            (mine.add if op == "add" else mine.discard)(key.strip())
    for limit in (None, 2):
        got = folds.clear_results(spark.createDataFrame(rows, SCHEMA), limit).collect()
        assert {r.seq: r.deleted for r in got} == want and len(got) == len(want)


def test_a_source_of_many_files_is_streamed_in_four_batches(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    kinds = ["purchase", "error", "signup", "view"]
    rows = [(i, at(i * 20), rng.randint(1, 3), rng.choice(kinds), 1.0, f'{{"k": {rng.randint(0, 6)}}}') for i in range(80)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(workload_changes, "_run_folder", lambda t: f"{tmp_path}/run")
    streamed = QUERIES["stream_change_results"](spark, str(tmp_path)).collect()
    assert sorted(map(str, streamed)) == sorted(map(str, QUERIES["change_results"](spark, str(tmp_path)).collect()))
    assert len(streamed) > 20
    assert len(list((tmp_path / "run" / "source").glob("*.parquet"))) > 4
    assert sorted(x.name for x in (tmp_path / "run" / "results").glob("batch=*")) == [f"batch={i}" for i in range(4)]
