"""Invented rows and small builders for the tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from basketmatch.schemas import SCHEMAS

NOON = datetime(2024, 5, 1, 12, 0, 0)


def at(minutes: float) -> datetime:
    return NOON + timedelta(minutes=minutes)


def table(spark, name, rows):
    schema = SCHEMAS[name]
    width = len(schema)
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


# Invented rows: 12 items, 9 baskets, 3 owners, 3 sessions.
ITEMS = [
    (1, "mandalina"),
    (2, "kereviz"),
    (3, "su"),
    (4, "Çilek"),
    (5, "fındık"),
    (6, "ayva"),
    (7, "pancar"),
    (8, "biberiye"),
    (9, "hindiba"),
    (10, "kivi"),
    (11, "ahududu"),
    (12, "zencefil"),  # in no basket
]
BASKETS = [
    (1, "Kış Salatası", "kereviz, mandalina, fındık", "yıka; doğra", 20, 150, "kolay", "salata"),
    (2, "Sütlü Ayva", "ayva, süt, ÇİLEK", None, 40, None, "orta", "tatlı"),
    (3, "kis kompostosu", "ayva; pancar | kivi", None, None, None, None, None),
    (4, "Boş Tabak", None, None, None, None, None, "hiçbir şey"),
    (5, "Büyük Kase", "mandalina, kereviz, su, çilek, fındık, ayva, pancar, biberiye", "", 5, 5, "zor", "kase"),
    (6, "Çay", "su, %50 ahududu", None, 3, 1, "kolay", "içecek"),
    (7, "Cay", "su_bardağı, hindiba", None, 3, 1, "kolay", "içecek"),
    (8, "Yalnız", "mandalina, kuşkonmaz", None, 9, 9, "kolay", "deneme"),  # no bridge rows
    (9, "Tek", "mandalina", None, 1, 1, "kolay", ""),
]
BRIDGE = [
    (1, 1), (1, 2), (1, 5),
    (2, 1), (2, 4), (2, 6),
    (3, 1), (3, 6), (3, 7), (3, 10),
    (4, 1),
    (5, 1), (5, 2), (5, 3), (5, 4), (5, 5), (5, 6), (5, 7), (5, 8),
    (6, 1), (6, 3), (6, 11),
    (7, 1), (7, 3), (7, 9),
    (9, 1),
]
STOCK = [("o1", i, at(i)) for i in (1, 2, 5)] + [("o2", 3, at(3)), ("o2", 11, at(11))]
FAVOURITES = [
    ("s1", 1, at(1)),
    ("s1", 8, at(5)),
    ("s1", 1, at(9)),  # stored twice
    ("s2", 3, at(2)),
]


def requests(spark, *rows):
    """(request_id, terms, min_match, q) with owner o1 and session s1."""
    full = [(i, "o1", "s1", terms, minimum, q) for i, terms, minimum, q in rows]
    return spark.createDataFrame(full, SCHEMAS["requests"])
