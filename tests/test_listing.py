from __future__ import annotations

from helpers import BASKETS, at, table

from basketmatch import schemas
from basketmatch.operators import listing
from basketmatch.operators.suggest import begins_with, suggest_items
from basketmatch.sources.status import dataset_status


def test_titles_sort_without_case_and_accents(catalog):
    titles = [r.title for r in listing.list_baskets(catalog["baskets"]).collect()]
    assert titles == [
        "Boş Tabak", "Büyük Kase", "Çay", "Cay", "kis kompostosu",
        "Kış Salatası", "Sütlü Ayva", "Tek", "Yalnız",
    ]
    assert len(listing.list_baskets(catalog["baskets"], limit=2).collect()) == 2


def test_stock_lists(catalog):
    rows = listing.list_stock(catalog["stock"], catalog["items"]).collect()
    assert [(r.owner_id, r.name) for r in rows] == [
        ("o1", "fındık"), ("o1", "kereviz"), ("o1", "mandalina"), ("o2", "ahududu"), ("o2", "su"),
    ]
    assert rows[0].added_at == at(5)
    assert len(listing.stock_names(catalog["stock"], catalog["items"]).columns) == 2


def test_counts(catalog):
    popular = listing.popular_items(catalog["bridge"], catalog["items"]).collect()
    assert [(r.name, r.usage_count) for r in popular] == [
        ("mandalina", 8), ("su", 3), ("ayva", 3), ("kereviz", 2), ("Çilek", 2),
    ]
    usage = {r.name: r.usage_count for r in listing.usage_counts(catalog["bridge"], catalog["items"]).collect()}
    assert usage["zencefil"] == 0 and len(usage) == 12
    counted = listing.items_with_stock_count(catalog["items"], catalog["stock"]).collect()
    assert [r.stock_count for r in counted] == [1] * 5 + [0] * 7
    assert counted[0].name == "ahududu"
    assert listing.totals(catalog["baskets"], catalog["items"]).first() == (9, 12)


def test_stats_view_and_status(catalog, spark):
    listing.catalog_stats(catalog["baskets"], catalog["items"], catalog["stock"], view="stats")
    assert spark.table("stats").first() == (9, 12, 5)
    present = {k: v for k, v in catalog.items() if k != "stock"}
    rows = {r.table_name: (r.present, r.n_rows) for r in dataset_status(present).collect()}
    assert rows["stock"] == (False, None) and rows["baskets"] == (True, 9) and len(rows) == 5


def test_flags(catalog, spark):
    selected = spark.createDataFrame([("su",), ("çilek",), ("kivi",)], "name string")
    stock = catalog["stock"].filter("owner_id = 'o2'")
    rows = {r.name: (r.is_selected, r.in_stock) for r in listing.flag_items(catalog["items"], selected, stock).collect()}
    assert len(rows) == 12
    assert rows["su"] == (True, True) and rows["ahududu"] == (False, True) and rows["kivi"] == (True, False)
    assert rows["Çilek"] == (False, False)  # exact bytes
    many = spark.createDataFrame([("o1", "su"), ("o2", "su")], "owner_id string, name string")
    flags = listing.flag_items(catalog["items"], many, catalog["stock"], by="owner_id").collect()
    got = {(r.owner_id, r.name): (r.is_selected, r.in_stock) for r in flags}
    assert got["o1", "su"] == (True, False) and got["o2", "su"] == (True, True) and len(got) == 6


def test_favourites(catalog, spark):
    rows = listing.favourite_baskets(catalog["favourites"], catalog["baskets"]).collect()
    assert [(r.session_id, r.basket_id) for r in rows] == [("s1", 1), ("s1", 8), ("s1", 1), ("s2", 3)]
    shown = spark.createDataFrame([("s1", 1), ("s2", 1)], "session_id string, basket_id bigint")
    flagged = {(r.session_id, r.is_favorite) for r in listing.flag_favourites(shown, catalog["favourites"]).collect()}
    assert flagged == {("s1", True), ("s2", False)}
    assert listing.only_favourites(shown, catalog["favourites"]).count() == 1


def test_suggestions(spark, catalog):
    names = ["kır", "Kır", "kir pası", "kırmızı", "kıraç", "soya", "sogan", "su"]
    items = table(spark, "items", list(enumerate(names)))
    queries = spark.createDataFrame([(1, "kır"), (2, "SO"), (3, "x"), (4, "")], "query_id int, query string")
    rows = suggest_items(items, queries, k=3).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r.name)
    assert got[1] == ["Kır", "kır", "kıraç"] or got[1] == ["kır", "Kır", "kıraç"]
    assert got[2] == ["sogan", "soya"]
    assert 3 not in got and len(got[4]) == 3
    assert {r.name for r in begins_with(items, "SÖ").collect()} == {"soya", "sogan"}


def test_defaults_and_domain(spark):
    baskets = table(spark, "baskets", BASKETS[:3])
    filled = schemas.apply_defaults(baskets, "baskets").orderBy("basket_id").collect()
    assert [r.difficulty for r in filled] == ["kolay", "orta", "kolay"]
    assert {r.category for r in filled} == {"ana yemek"} and filled[0].created_at is not None
    odd = baskets.replace("orta", "imkansız", subset="difficulty")
    valid, rejects = schemas.check_difficulty(odd)
    assert valid.count() == 2 and [r.basket_id for r in rejects.collect()] == [2]
