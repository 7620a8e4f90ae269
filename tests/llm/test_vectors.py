"""Vector codes beside a plain version that evaluates every entry."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from basketmatch.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string, n string, error string"


def brute(rows):
    """{(vec_id, code, error, label_error)} and the codebooks' hash, by plain Python."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if sound(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    d = len(kept[0][1]) // 16
    cut = [[v[p * d : p * d + d] for p in range(16)] for _, v, _ in kept]
    books = [[list(parts[p]) for parts in cut[:64]] for p in range(16)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(2):
        fresh = []
        for p in range(16):
            groups = {}
            for parts in cut:
                groups.setdefault(nearest(p, parts[p])[1], []).append(parts[p])
            fresh.append([[sum(x) // len(x) for x in zip(*groups[e])] if e in groups else entry for e, entry in enumerate(books[p])])
        books = fresh
    found = [[nearest(p, parts[p]) for p in range(16)] for parts in cut]
    errors = [sum(apart for apart, _ in f) for f in found]
    by_label = {}
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    name = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), error, by_label[label]) for (i, _, label), f, error in zip(kept, found, errors)), name


def sound(v):
    return bool(v) and len(v) % 16 == 0 and all(x is not None and math.isfinite(x) for x in v)


def check(spark, rows):
    got = vc.vector_codes(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)).collect()
    want, name = brute(rows)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {name}


@pytest.mark.parametrize("size", [16, 48])
def test_codes_equal_a_plain_version(spark, size):
    rng = random.Random(size)
    centres = [[rng.gauss(0, 0.3) for _ in range(size)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice([None, 0, 1])) for i in rng.sample(range(10_000), 160)]
    rows += [(20_000, rows[0][1], 1), (20_000, rows[0][1], 1), (None, rows[1][1], None), (20_001, [0.0] * size, 1)]
    rows += [(-9, None, 1), (-8, [], 1), (-7, [float("nan")] + [0.0] * (size - 1), 1), (-6, [None] + [0.0] * (size - 1), 0)]
    rows += [(-5, [float("inf")] * size, 1), (30_000, [0.0] * 15, 1), (30_001, [0.0] * (size + 16), 1), (30_002, [-3.0, 700.0] * (size // 2), 1)]
    check(spark, rows)


def test_ties_go_to_the_lowest_entry_and_unused_entries_stay(spark):
    rows = [(i, [(i % 3) / 256] * 16, 0) for i in range(70)] + [(100 + i, [1.5 / 256, 0.5 / 256] * 8, 0) for i in range(5)]
    check(spark, rows)


def test_few_rows_and_none(spark):
    check(spark, [(5, [0.25] * 32, None)])
    empty = spark.createDataFrame([], SCHEMA)
    assert vc.vector_codes(empty).count() == 0
    none_kept = spark.createDataFrame([(1, None, 1, "", "", "", "")], SCHEMA)
    assert vc.vector_codes(none_kept).count() == 0


def test_no_nearest_entry_is_left_out_of_a_cell(monkeypatch):
    rng = np.random.default_rng(2)
    for d in (1, 2, 4, 9):
        book = rng.integers(-60, 60, (64, d))
        points = rng.integers(-150, 150, (3_000, d))
        apart = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        for remembered in (1, 50, vc.REMEMBERED):
            monkeypatch.setattr(vc, "REMEMBERED", remembered)
            grid = vc.Grid(book)
            for some in np.array_split(np.arange(len(points)), 7):
                entry, least = grid.nearest(points[some])
                assert (entry == apart[some].argmin(axis=1)).all() and (least == apart[some].min(axis=1)).all()
        assert grid.left.mean() < 1 or d > 4


def test_a_code_stands_for_its_entries():
    books = np.arange(16 * 64 * 2).reshape(16, 64, 2)
    out = vc.decoded("".join(f"{p:02x}" for p in range(16)), books)
    assert out.tolist() == [x for p in range(16) for x in books[p, p]]
