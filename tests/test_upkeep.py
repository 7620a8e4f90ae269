from __future__ import annotations

import pytest

from helpers import BRIDGE, at, table

from basketmatch.operators import link, skew, upkeep
from basketmatch.sources import readers


def test_upsert_replaces_only_the_spelling(spark):
    items = table(spark, "items", [(1, "süt", "içecek", at(0)), (2, "tuz", "baharat", at(0))])
    incoming = spark.createDataFrame(
        [(9, "SUT", "x", at(1), 1), (8, "Şeker", "y", at(1), 2), (7, "Süt", "z", at(1), 3), (6, "şeker", "w", at(1), 4)],
        "item_id bigint, name string, category string, created_at timestamp, seq int",
    )
    rows = sorted(map(tuple, upkeep.upsert_items(items, incoming).collect()))
    assert rows == [(1, "Süt", "içecek", at(0)), (2, "tuz", "baharat", at(0)), (8, "şeker", "y", at(1))]


def test_insert_ignore_and_add_stock(spark, catalog):
    incoming = spark.createDataFrame([(1, 1), (9, 2), (9, 2)], "basket_id bigint, item_id bigint")
    grown = upkeep.insert_ignore(catalog["bridge"], incoming, ["basket_id", "item_id"])
    assert grown.count() == len(BRIDGE) + 1
    more = table(spark, "stock", [("o1", 1, at(99)), ("o3", 1, at(7)), ("o3", 1, at(6))])
    rows = {(r.owner_id, r.item_id): r.added_at for r in upkeep.add_stock(catalog["stock"], more).collect()}
    assert rows["o1", 1] == at(1) and rows["o3", 1] == at(6) and len(rows) == 6


def test_append_baskets(spark, catalog):
    incoming = spark.createDataFrame(
        [(500, "Son", "su"), (3, "İlk", None)], "seq bigint, title string, item_text string"
    )
    grown = upkeep.append_baskets(catalog["baskets"], incoming).filter("basket_id > 9").orderBy("basket_id").collect()
    assert [(r.basket_id, r.title, r.difficulty, r.category) for r in grown] == [
        (10, "İlk", "kolay", "ana yemek"), (11, "Son", "kolay", "ana yemek"),
    ]


def test_get_or_create(spark, catalog):
    typed = spark.createDataFrame(
        [(1, "\tCILEK "), (2, " "), (3, "nar"), (4, None), (5, "NAR"), (6, "erik\n"), (7, "su")],
        "seq bigint, name string",
    )
    items, resolved, rejects = upkeep.get_or_create_items(catalog["items"], typed)
    got = {r.seq: r.item_id for r in resolved.collect()}
    assert got == {1: 4, 3: 13, 5: 13, 6: 14, 7: 3}
    new = {r.item_id: (r.name, r.category) for r in items.filter("item_id > 12").collect()}
    assert new == {13: ("nar", "diğer"), 14: ("erik", "diğer")}
    assert sorted(r.seq for r in rejects.collect()) == [2, 4]


def test_deletes(spark, catalog, monkeypatch):
    gone = spark.createDataFrame([("o1", 1), ("o1", 77)], "owner_id string, item_id bigint")
    assert upkeep.delete_by_key(catalog["stock"], gone, ["owner_id", "item_id"]).count() == 4
    owners = spark.createDataFrame([("o1",), ("o9",)], "owner_id string")
    for limit in (500_000, 0):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
        kept, deleted = upkeep.clear_owner(catalog["stock"], owners)
        assert {r.owner_id for r in kept.collect()} == {"o2"}
        assert {tuple(r) for r in deleted.collect()} == {("o1", 3), ("o9", 0)}


def test_cascades_and_orphans(spark, catalog):
    gone = spark.createDataFrame([(1,), (3,)], "item_id bigint")
    after = upkeep.cascade_delete(catalog, "items", gone)
    assert after["items"].count() == 10 and after["stock"].count() == 3
    assert {r.item_id for r in after["bridge"].collect()}.isdisjoint({1, 3})
    assert upkeep.orphans(after).count() == 0 and upkeep.orphans(catalog).count() == 0
    half = dict(catalog) | {"items": after["items"]}
    assert {tuple(r) for r in upkeep.orphans(half).collect()} == {
        ("bridge", "item_id", 1, 8), ("bridge", "item_id", 3, 3),
        ("stock", "item_id", 1, 1), ("stock", "item_id", 3, 1),
    }
    changes = spark.createDataFrame([(1, 100)], "old_id bigint, new_id bigint")
    moved = upkeep.cascade_rekey(catalog, "baskets", changes)
    assert moved["bridge"].filter("basket_id = 100").count() == 3
    assert moved["favourites"].filter("basket_id = 100").count() == 2
    assert moved["baskets"].columns == catalog["baskets"].columns


def test_unique_names(spark):
    items = table(spark, "items", [(2, "Süt"), (1, "sut"), (3, "tuz")])
    assert {r.item_id for r in upkeep.dedupe_unique(items, "items", "item_id").collect()} == {1, 3}
    assert [r.n_rows for r in upkeep.unique_violations(items, "items").collect()] == [2]
    bridge = table(spark, "bridge", [(1, 1), (1, 1), (1, 2)])
    assert upkeep.dedupe_unique(bridge, "bridge", "item_id").count() == 2
    assert [tuple(r) for r in upkeep.unique_violations(bridge, "bridge").collect()] == [(1, 1, 2)]


def test_link_by_rules(spark, catalog):
    rules = table(spark, "link_rules", [
        ("SUTLU AYVA", "cilek"),  # accents and case do not count
        ("Sütlü Ayva", "Çilek"),  # the same once more
        ("Sütlü Ava", "ayva"),  # a missing letter does
        ("Çay", "su"),  # two baskets have this title
        ("Tek", "marul"),  # no such item
    ])
    rows = link.link_by_rules(catalog["baskets"], catalog["items"], rules).collect()
    assert {tuple(r) for r in rows} == {(2, 4), (6, 3), (7, 3)} and len(rows) == 3


def test_link_by_text(catalog):
    links, unlinked = link.link_by_text(catalog["baskets"], catalog["items"])
    rows = {tuple(r) for r in links.collect()}
    assert {(2, 6), (3, 7), (8, 1), (1, 5), (5, 4)} <= rows
    # the small letter of a dotted capital I keeps its dot as a mark of its own
    dotted = "ci\u0307lek"
    assert {r.name_key for r in unlinked.collect()} == {
        "sut", "%50 ahududu", "su_bardagi", "kuskonmaz", dotted,
    }


def test_readers(spark, catalog, tmp_path):
    for name, df in catalog.items():
        readers.append_table(df, str(tmp_path), name)
    back = readers.read_catalog(spark, str(tmp_path))
    assert {n: df.count() for n, df in back.items()} == {n: df.count() for n, df in catalog.items()}
    path = tmp_path / "seed.csv"
    path.write_text("item_id,name,category,created_at\n1,nar,,\n2,erik,meyve,\n", encoding="utf-8")
    seed = {r.name: r.category for r in readers.load_seed(spark, str(path), "items").collect()}
    assert seed == {"nar": "diğer", "erik": "meyve"}
    options = readers.jdbc_options("jdbc:x", "items", "id", 1, 9, 4)
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "4"
    assert "partitionColumn" not in readers.jdbc_options("jdbc:x", "items")


def test_seed_files_by_name_and_by_format(spark, tmp_path):
    import gzip

    text = 'item_id,name,category,created_at\n1,"nar\nve ""su""",,\n'
    (tmp_path / "seed.csv.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "seed.txt").write_text(text, encoding="utf-8")
    (tmp_path / "seed.jsonl").write_text('{"item_id": 2, "name": "erik"}\n', encoding="utf-8")
    (tmp_path / "bad.csv").write_text("item_id,name,category,created_at\nx1,nar,,\n", encoding="utf-8")
    for name, format in (("seed.csv.gz", None), ("seed.txt", "csv")):
        rows = readers.load_seed(spark, str(tmp_path / name), "items", format=format).collect()
        assert [(r.item_id, r.name, r.category) for r in rows] == [(1, 'nar\nve "su"', "diğer")]
    assert [r.name for r in readers.load_seed(spark, str(tmp_path / "seed.jsonl"), "items").collect()] == ["erik"]
    with pytest.raises(ValueError):
        readers.load_seed(spark, str(tmp_path / "seed.txt"), "items")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE|BAD_RECORD"):
        readers.load_seed(spark, str(tmp_path / "bad.csv"), "items").collect()


def test_add_stock_by_name(spark, catalog):
    rows = [(1, "o1", " MANDALINA ", at(1)), (2, "o2", "mandalina", at(2)), (3, "o2", "Mandalina", at(3)), (4, "o1", " \t", at(4)),
            (5, "o1", "Tarçin", at(5)), (6, "o2", "tarcin", at(6)), (7, "o1", "TARÇIN", at(7)), (8, "o3", None, at(8))]
    incoming = spark.createDataFrame(rows, "seq long, owner_id string, name string, added_at timestamp")
    items, stock, told = upkeep.add_stock_by_name(catalog["items"], catalog["stock"], incoming)
    assert {r.seq: r.result for r in told.collect()} == {
        1: "already there", 2: "added", 3: "already there", 4: "invalid", 5: "added", 6: "added", 7: "already there", 8: "invalid",
    }
    assert {r.seq: r.item_id for r in told.collect() if r.seq in (1, 2, 5, 6)} == {1: 1, 2: 1, 5: 13, 6: 13}
    assert items.count() == 13
    before = {(r.owner_id, r.item_id) for r in catalog["stock"].collect()}
    after = {(r.owner_id, r.item_id): r.added_at for r in stock.collect()}
    assert set(after) == before | {("o2", 1), ("o1", 13), ("o2", 13)} and after["o2", 1] == at(2)
