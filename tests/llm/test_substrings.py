"""Repeated passages beside a version that looks at every window."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from basketmatch.llm import substring_dedup as sd
from basketmatch.llm import wordhash
from tests.llm.odd_rows import ODD
from tests.llm.test_dedup import WORDS, changed, prose


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    """{(doc_id, text): (words, removed, hash, kept)}, and every window that occurs earlier."""
    texts = sorted({(d is not None, d or 0, i, t or "") for i, (d, t) in enumerate(rows)})
    seen, out, later = {}, {}, set()
    done = {}
    for some, d, _, t in texts:
        key = (d if some else None, t)
        if key in done:
            continue
        done[key] = True
        w = split(t)
        gone = set()
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
                later.add((key[0], i))
            seen.setdefault(window, (key[0], i))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[key] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out, later


def check(docs, rows):
    want, _ = brute(rows)
    got = sd.dedup_passages(docs, texts=True).collect()
    expected = sorted((str(d), *want[(d, t or "")]) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == expected


def corpus(seed):
    """Passages between different neighbours, edited copies, overlaps, repeats in one text."""
    rng = random.Random(seed)
    rows = [r for r in ODD if r[0] not in (6, 7)]
    passages = [prose(rng, rng.choice([19, 20, 21, 33, 50, 140])) for _ in range(12)]
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 30)) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            at = rng.randint(0, max(0, len(p) - 20))
            parts.insert(rng.randint(0, len(parts)), " ".join(p[at : at + rng.randint(15, 60)]))
        rows.append((100 + i, rng.choice([" ", "\n", " \t "]).join(parts)))
    base = prose(rng, 300)
    rows += [(1000 + i, changed(rng, base, rng.choice([0, 1, 4, 12]))) for i in range(12)]
    rows += [(2000, " ".join(["la"] * 200)), (2001, " ".join(["la", "li"] * 70)), (2002, " ".join(WORDS[:7] * 12)), (2003, " ".join(["la"] * 19))]
    rows += [(3000, base.upper()), (3000, base + " x"), (None, base), (3001, " ".join(base.split()[5:60] + base.split()[40:90]))]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_words_equal_all_windows(spark, make, seed):
    rows = corpus(seed)
    check(make(rows).repartition(6), rows)


def test_stretches_and_slices_change_nothing(spark, make, monkeypatch):
    rows = corpus(4)
    for name, value in (("TOGETHER", 1), ("ROWS", 3), ("LONG", 64)):
        monkeypatch.setattr(sd, name, value)
    monkeypatch.setattr(wordhash, "CHUNK_BYTES", 400)
    monkeypatch.setattr(wordhash, "BLOCK", 32)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(make(rows).repartition(6), rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_factors_stand_in_their_source(spark, make):
    rows = [r for r in corpus(5) if r[0] not in (None, 3000, 5)]
    words = {d: split(t) for d, t in rows}
    _, later = brute(rows)
    covered = set()
    for f in sd.factors(make(rows)).collect():
        assert f.n_words >= 20 and (f.src_doc, f.src_first) < (f.doc_id, f.first)
        assert words[f.doc_id][f.first : f.first + f.n_words] == words[f.src_doc][f.src_first : f.src_first + f.n_words]
        covered.update((f.doc_id, i) for i in range(f.first, f.first + f.n_words - 19))
    assert covered <= later
    assert {(d, i + k) for d, i in covered for k in range(20)} == {(d, i + k) for d, i in later for k in range(20)}


def test_a_row_repeated_many_times_is_one_document(spark):
    text = prose(random.Random(1), 60)
    rows = [(4, text)] * 700 + [(5, text + " end"), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(docs, rows)


def test_no_rows_and_no_words(spark, make):
    assert sd.dedup_passages(make([])).count() == 0 and sd.factors(make([])).count() == 0
    check(make([(1, None), (2, ""), (None, " ")]), [(1, None), (2, ""), (None, " ")])


def test_windows_belong_to_one_phrase_each():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 5, 900).astype(np.uint64)
    ends = np.array([0, 10, 400, 400, 419, 900])
    _, _, text, first, last = sd.phrases(words, ends)
    got = sorted((t, i) for t, f, e in zip(text, first, last) for i in range(f, e + 1))
    starts = np.concatenate([[0], ends])
    assert got == [(t, i) for t in range(len(ends)) for i in range(max(0, ends[t] - starts[t] - 19))]
    assert (last - first < sd.SPREAD).all()
