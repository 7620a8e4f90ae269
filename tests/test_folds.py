from __future__ import annotations

import random

import pytest
from helpers import at, table
from pyspark.sql import functions as F

from basketmatch.streaming import folds, streams


def play(rows, set_creates=False):
    """The state machine, one change at a time."""
    state, results = {}, {}
    for scope, key, op, value, ts, seq in sorted(rows, key=lambda r: (r[4], r[5])):
        k = (scope, key)
        if op == "clear":
            state = {x: v for x, v in state.items() if x[0] != scope}
        elif op == "remove":
            state.pop(k, None)
            results[seq] = "removed"
        elif op == "add":
            results[seq] = "already there" if k in state else "added"
            state.setdefault(k, (ts, value))
        elif k in state or set_creates:
            state[k] = (state.get(k, (ts,))[0], value)
    return state, results


def random_log(seed, n=400, ops=("add", "add", "set", "remove", "clear")):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        op = rng.choice(ops)
        if op == "clear" and rng.random() < 0.8:
            op = "add"
        key = None if op == "clear" else rng.choice(["a", "a", "a", "b", "c"])
        rows.append((rng.choice(["x", "x", "y"]), key, op, f"v{seq}", at(rng.randrange(120)), seq))
    return rows


def states(df):
    return {(r.scope_id, r.key): (r.added_at, r.value) for r in df.collect()}


@pytest.mark.parametrize("set_creates", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_the_state_machine(spark, seed, set_creates):
    rows = random_log(seed)
    log = table(spark, "change_log", rows)
    assert states(folds.fold_changes(log, set_creates)) == play(rows, set_creates)[0]


def test_edges(spark):
    rows = [
        ("x", "a", "add", "1", at(1), 1),
        ("x", "a", "add", "2", at(2), 2),
        ("x", "a", "remove", None, at(3), 3),
        ("x", "a", "add", "3", at(4), 4),
        ("x", None, "clear", None, at(5), 5),
        ("x", "b", "add", "4", at(5), 6),  # after the clear by its number
        ("x", "c", "set", "5", at(6), 7),  # not there
        ("y", "a", "remove", None, at(1), 8),  # not there either
    ]
    log = table(spark, "change_log", rows)
    assert states(folds.fold_changes(log)) == {("x", "b"): (at(5), "4")}
    outcomes = {r.seq: r.result for r in folds.change_results(log).collect()}
    assert outcomes == {1: "added", 2: "already there", 3: "removed", 4: "added", 6: "added", 8: "removed"}


@pytest.mark.parametrize("rows_per_task", [None, 20])
def test_outcomes_equal_the_state_machine(spark, rows_per_task):
    rows = random_log(7, ops=("add", "add", "remove", "clear"))
    log = table(spark, "change_log", [*rows, ("x", " \t", "add", None, at(1), 9999)])
    got = {r.seq: r.result for r in folds.change_results(log, rows_per_task).collect()}
    assert got == play(rows)[1] | {9999: "invalid"}


def toggles(spark, n=300, seed=4):
    rng = random.Random(seed)
    rows = [(rng.choice(["s", "s", "t"]), rng.choice([1, 1, 1, 2, 3]), at(rng.randrange(60)), i) for i in range(n)]
    return rows, table(spark, "toggle_log", rows)


@pytest.mark.parametrize("rows_per_task", [None, 20])
def test_toggles(spark, rows_per_task):
    rows, log = toggles(spark)
    present, outcome = {}, {}
    for session, basket, ts, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        k = (session, basket)
        outcome[seq] = "removed" if k in present else "added"
        if k in present:
            del present[k]
        else:
            present[k] = ts
    folded = folds.fold_toggles(log).collect()
    assert {(r.session_id, r.basket_id): r.created_at for r in folded} == present
    results = folds.toggle_results(log, rows_per_task).collect()
    assert {r.seq: r.result for r in results} == outcome


def test_compaction_changes_nothing(spark):
    for set_creates in (False, True):
        rows = random_log(9)
        early = [r for r in rows if r[4] < at(60)]
        shorter = folds.compact_changes(table(spark, "change_log", early), F.lit(at(50)), set_creates)
        whole = shorter.unionByName(table(spark, "change_log", [r for r in rows if r[4] >= at(60)]))
        assert states(folds.fold_changes(whole, set_creates)) == play(rows, set_creates)[0]
        assert shorter.count() < len(early)


def feed(spark, tmp_path, name, batches):
    """A file stream with one micro-batch per list of rows."""
    source = str(tmp_path / "source")
    for i, rows in enumerate(batches):
        table(spark, name, rows).coalesce(1).write.parquet(f"{source}/{i}")
    schema = table(spark, name, []).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return schema, reader.parquet(f"{source}/*")


def test_streamed_toggles_equal_the_batch(spark, tmp_path):
    rows, log = toggles(spark, n=90)
    schema, stream = feed(spark, tmp_path, "toggle_log", [rows[:40], rows[40:41], rows[41:]])
    folder = str(tmp_path / "out")
    streams.stream_toggles(stream, folder).trigger(availableNow=True).start().awaitTermination()
    got = streams.read_toggles(spark, folder, schema).collect()
    assert sorted(got) == sorted(folds.fold_toggles(log).collect())


@pytest.mark.parametrize("compact_every", [1, 2])
def test_streamed_changes_equal_the_batch(spark, tmp_path, compact_every):
    rows = sorted(random_log(5, n=200), key=lambda r: r[4])
    rng = random.Random(1)
    batches = [rows[i : i + 50] for i in range(0, 200, 50)]
    for batch in batches:
        rng.shuffle(batch)
    batches[1], batches[2] = batches[2][:25] + batches[1][25:], batches[1][:25] + batches[2][25:]
    too_late = ("x", "z", "add", "late", at(-600), 5000)
    schema, stream = feed(spark, tmp_path, "change_log", [*batches[:3], [*batches[3], too_late]])
    store = streams.ChangeStore(spark, str(tmp_path / "out"), schema, "2 hours", compact_every)
    streams.stream_changes(stream, store).trigger(availableNow=True).start().awaitTermination()
    assert states(store.state()) == play(rows)[0]
    assert [r.seq for r in store.late().collect()] == [5000]
    assert store.changes().count() <= len(rows)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = random_log(6, n=60)
    log = table(spark, "change_log", rows)
    store = streams.ChangeStore(spark, str(tmp_path / "out"), log.schema, compact_every=2)
    store.write(log.filter("seq < 30"), 0)
    for _ in range(2):
        store.write(log.filter("seq >= 30"), 1)
    assert states(store.state()) == play(rows)[0]


def test_streamed_requests_equal_the_batch(spark, catalog, tmp_path):
    from basketmatch.plans.recommend import recommend

    asked = [(1, "o1", "s1", ["su"], "1", ""), (2, "o2", "s2", [], None, "kase"), (3, "o1", "s2", ["ayva"], "1", "")]
    _, stream = feed(spark, tmp_path, "requests", [asked[:2], asked[2:]])
    folder = str(tmp_path / "out")
    answers = streams.stream_recommend(stream, lambda: catalog, folder)
    answers.trigger(availableNow=True).start().awaitTermination()
    batch = recommend(catalog, table(spark, "requests", asked))
    got = streams.read_answers(spark, folder).select(*batch.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
