"""The physical plans: no cross products, no Python workers, pruned scans."""

from __future__ import annotations

import pytest
from helpers import requests

from basketmatch.operators import coverage, link, listing, search
from basketmatch.plans.recommend import recommend
from basketmatch.streaming import folds
from workload.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture
def tables(spark):
    return Tables(spark, FOLDER)


def cores(t, spark, catalog):
    asked = requests(spark, (1, ["su"], "1", "a"))
    clean = search.normalise_requests(asked)
    return {
        "coverage": coverage.coverage(t.bridge(), t.stock()),
        "have_missing": coverage.have_missing(t.bridge(), t.unique_items(), t.stock()),
        "search_scored": search.search_scored(catalog["baskets"], clean),
        "search_all_terms": search.search_all_terms(catalog["baskets"], clean),
        "recommend": recommend(catalog, asked),
        "link_by_text": link.link_by_text(catalog["baskets"], catalog["items"])[0],
        "items_with_stock_count": listing.items_with_stock_count(t.items(), t.stock()),
        "fold_toggles": folds.fold_toggles(t.toggles()),
    }


def test_no_cross_products_and_no_python(tables, spark, catalog, capsys):
    for name, df in cores(tables, spark, catalog).items():
        plan = plan_of(df, capsys)
        for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert operator not in plan, (name, operator)


def test_scans_are_pruned_and_filtered(tables, capsys):
    plan = plan_of(folds.fold_toggles(tables.toggles()), capsys)
    assert "EqualTo(event_type,click)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in plan
    names = plan_of(listing.usage_counts(tables.bridge(), tables.items()), capsys)
    assert "struct<p_partkey:bigint,p_name:string>" in names


def test_ranking_is_cut_before_the_shuffle(spark, capsys):
    from pyspark.sql import functions as F

    from basketmatch.operators.skew import best_rows

    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    assert "WindowGroupLimit" in plan_of(best_rows(rows, ["k"], [F.col("id")], 5, "n"), capsys)
