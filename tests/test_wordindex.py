"""The stored word index: additions, commits and what a search reads of it."""

from __future__ import annotations

import pytest
from helpers import BASKETS, requests, table

from basketmatch.operators import search, wordindex


def rows(df):
    return sorted(map(str, df.collect()))


def test_an_extended_index_equals_a_rebuilt_one(spark, tmp_path):
    whole = wordindex.build_index(table(spark, "baskets", BASKETS), str(tmp_path / "whole"))
    index = wordindex.build_index(table(spark, "baskets", BASKETS[:3]), str(tmp_path / "parts"), buckets=3)
    index = wordindex.extend_index(index, table(spark, "baskets", BASKETS[3:4]))
    wordindex.extend_index(index, table(spark, "baskets", BASKETS[4:]))
    again = wordindex.open_index(spark, str(tmp_path / "parts"))
    assert len(again.commits) == 3 and again.buckets == 3
    for name in ("postings", "texts", "titles", "words", "runs", "run_sizes"):
        assert rows(getattr(again, name)()) == rows(getattr(whole, name)()), name


def test_an_addition_that_broke_off_is_not_seen(spark, tmp_path, monkeypatch):
    index = wordindex.build_index(table(spark, "baskets", BASKETS[:5]), str(tmp_path / "index"))
    before = {name: rows(getattr(index, name)()) for name in ("postings", "texts", "words", "runs")}
    append = wordindex._append

    def breaks(index, name, rows, commit):
        if name == "runs":
            raise OSError("no space")
        append(index, name, rows, commit)

    monkeypatch.setattr(wordindex, "_append", breaks)
    with pytest.raises(OSError):
        wordindex.extend_index(index, table(spark, "baskets", BASKETS[5:]))
    monkeypatch.undo()
    again = wordindex.open_index(spark, str(tmp_path / "index"))
    assert {name: rows(getattr(again, name)()) for name in before} == before
    whole = wordindex.extend_index(again, table(spark, "baskets", BASKETS[5:]))
    assert whole.titles().count() == len(BASKETS)


def test_no_baskets_and_no_folder(spark, tmp_path):
    index = wordindex.build_index(table(spark, "baskets", []), str(tmp_path / "none"))
    asked = search.normalise_requests(requests(spark, (1, ["su"], "0", ""), (2, [], None, "")))
    assert search.search_scored(index, asked).count() == 0 and search.score_text(index, asked).count() == 0
    with pytest.raises(FileNotFoundError):
        wordindex.open_index(spark, str(tmp_path / "nothing"))


def test_hits_stay_in_their_bucket(spark, catalog, capsys):
    """What the postings of a basket give is made distinct without an exchange of them."""
    index = wordindex.build_index(catalog["baskets"])
    terms = spark.createDataFrame([("mandalina",), ("biberiye",)], "term string")
    lookup = search.look_up(index, terms, False)
    hits = search.find_narrow(lookup)
    capsys.readouterr()
    hits.explain()
    plan = capsys.readouterr().out
    settled = plan[: plan.index("Generate explode(open")]
    assert "Bucketed: true" in settled and "Exchange hashpartitioning(term" not in settled


def test_baskets_that_cannot_reach_the_last_rank_are_not_read(spark, monkeypatch):
    """Many texts share the broad terms; few hold the rare ones that decide."""
    texts = [f"ana bal {'kivi' if i % 40 == 0 else ''} x{i}" for i in range(400)]
    baskets = table(spark, "baskets", [(i, f"t{i:03}", text) for i, text in enumerate(texts)])
    asked = search.normalise_requests(requests(spark, (1, ["ana", "bal", "kivi", "x1"], "1", "")))
    read = []
    whole = search._in_full

    def counted(lookup, pairs, facts):
        read.append(pairs.count())
        return whole(lookup, pairs, facts)

    monkeypatch.setattr(search, "_in_full", counted)
    got = search.search_scored(baskets, asked, limit=10).collect()
    scores = sorted(((-sum(t in text for t in ("ana", "bal", "kivi", "x1")), f"t{i:03}", i) for i, text in enumerate(texts)))
    assert [(r.basket_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i, -s) for s, _, i in scores[:10]]
    assert sum(read) <= 40


def test_words_are_sorted_in_tasks_of_few_baskets(spark, tmp_path, monkeypatch):
    """A task's memory must not grow with the table."""
    monkeypatch.setattr(wordindex, "BASKETS_PER_TASK", 1)
    index = wordindex.build_index(table(spark, "baskets", BASKETS), str(tmp_path / "index"), buckets=2)
    monkeypatch.undo()
    assert index.texts().count() > 0 and len(list((tmp_path / "index" / "texts").rglob("part-*.parquet"))) > 2
    whole = wordindex.build_index(table(spark, "baskets", BASKETS), str(tmp_path / "whole"), buckets=2)
    assert rows(index.postings()) == rows(whole.postings()) and rows(index.words()) == rows(whole.words())


def test_postings_do_not_travel_to_many_words(spark, catalog, monkeypatch, capsys):
    index = wordindex.build_index(catalog["baskets"])
    terms = spark.createDataFrame([("mandalina",), ("biberiye",), ("su",)], "term string")
    lookup = search.look_up(index, terms, False)
    want = rows(search.find_narrow(lookup))
    monkeypatch.setattr(search, "WORDS_PER_CHUNK", 1)
    hits = search.find_narrow(lookup)
    assert rows(hits) == want and want
    capsys.readouterr()
    hits.explain()
    assert "hashpartitioning(word" not in capsys.readouterr().out


def test_rounds_of_a_search_for_all_terms(spark, catalog, monkeypatch):
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([["su"], ["a"], ["a", "e"], ["i", "a", "n"], [""], []])], "request_id bigint, terms array<string>")
    index = wordindex.build_index(catalog["baskets"])
    for limit in (2,):
        want = rows(search.search_all_terms(index, asked, limit))
        with monkeypatch.context() as m:
            for name, value in (("ROUND_BASKETS", 1), ("ROUND_GROWTH", 2), ("QUESTIONS_PER_PASS", 2)):
                m.setattr(search, name, value)
            assert rows(search.search_all_terms(index, asked, limit)) == want and want
