from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basketmatch.functions import text
from basketmatch.functions.match import match_band, match_percentage
from basketmatch.functions.sql import register_functions


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[1] for r in df.select("i", column).orderBy("i").collect()]


def test_fold_agrees_with_the_collation(spark):
    pairs = list(zip(text.ACCENTED, text.UNACCENTED))
    assert len(pairs) == len(text.UNACCENTED) > 200
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.filter(text.collated("a") != text.collated("b")).count() == 0
    folded = values(spark, text.fold("x"), ["ÇİLEK", "Süt", "ŞğÖ", "ısı", "é", None])
    assert folded == ["cilek", "sut", "sgo", "ısı", "e", None]
    different = spark.createDataFrame([("ı", "i"), ("b", "d")], "a string, b string")
    assert different.filter(text.collated("a") == text.collated("b")).count() == 0


def test_norm_and_parse(spark):
    assert values(spark, text.norm("x"), ["\t Işık ÇÖP\x0b", "ğüş\0", None]) == ["isik cop", "gus", None]
    parsed = values(spark, text.parse_item_text("x"), ["Su,; süt |\n su ,,tuz\t", " ", ",;|", None])
    assert parsed == [["su", "sut", "tuz"], [], [], None]


def test_percentage_rounds_half_up(spark):
    rows = [(1, 8, 13), (1, 3, 33), (2, 3, 67), (0, 4, 0), (4, 4, 100), (0, 0, 0), (7, 5, 100), (1, 200, 1)]
    df = spark.createDataFrame(rows, "h bigint, n bigint, expected int")
    wrong = df.filter(match_percentage("h", "n") != F.col("expected"))
    assert wrong.collect() == []


def test_bands(spark):
    df = spark.createDataFrame([(79,), (80,), (50,), (49,)], "p int").select(match_band("p").alias("b"))
    assert [r.b for r in df.collect()] == ["medium", "high", "medium", "low"]


@pytest.mark.parametrize(
    "term, hits",
    [("a%c", ["abc", "xaXcx"]), ("a_c", ["abc", "xaXcx"]), (r"\%", ["5%"]), (r"\q", ["q"]), ("\\", ["b\\s"])],
)
def test_like_pattern(spark, term, hits):
    texts = ["abc", "xaXcx", "5%", "q", "b\\s", ""]
    df = spark.createDataFrame([(t, term) for t in texts], "x string, term string")
    found = df.filter(F.like(F.col("x"), text.like_pattern("term")))
    assert [r.x for r in found.collect()] == hits


def test_sql_functions_equal_the_columns(spark):
    assert set(register_functions(spark)) == {"norm", "parse_item_text", "match_percentage", "match_band"}
    df = spark.createDataFrame([("\t Işık, ÇÖP;çöp \n", 1, 8)], "x string, h bigint, n bigint")
    row = df.select(
        F.expr("norm(x)") == text.norm("x"),
        F.expr("parse_item_text(x)") == text.parse_item_text("x"),
        F.expr("match_percentage(h, n)") == match_percentage("h", "n"),
        F.expr("match_band(80)") == F.lit("high"),
    ).first()
    assert all(row)
