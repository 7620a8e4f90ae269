"""Table schemas, column defaults, domains and foreign keys of a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


_LONG, _INT, _STR, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType()

SCHEMAS: dict[str, T.StructType] = {
    "items": _schema(
        ("item_id", _LONG, False),
        ("name", _STR, False),
        ("category", _STR, True),
        ("created_at", _TS, True),
    ),
    "baskets": _schema(
        ("basket_id", _LONG, False),
        ("title", _STR, False),
        ("item_text", _STR, True),
        ("instructions", _STR, True),
        ("prep_minutes", _INT, True),
        ("calories", _INT, True),
        ("difficulty", _STR, True),
        ("tags", _STR, True),
        ("image_url", _STR, True),
        ("category", _STR, True),
        ("created_at", _TS, True),
    ),
    "bridge": _schema(("basket_id", _LONG, False), ("item_id", _LONG, False)),
    "stock": _schema(
        ("owner_id", _STR, False), ("item_id", _LONG, False), ("added_at", _TS, True)
    ),
    "favourites": _schema(
        ("session_id", _STR, False), ("basket_id", _LONG, False), ("created_at", _TS, True)
    ),
    "requests": _schema(
        ("request_id", _LONG, False),
        ("owner_id", _STR, True),
        ("session_id", _STR, True),
        ("terms", T.ArrayType(_STR), True),
        ("min_match", _STR, True),
        ("q", _STR, True),
    ),
    "link_rules": _schema(("title", _STR, False), ("item_name", _STR, False)),
    "change_log": _schema(
        ("scope_id", _STR, False),
        ("key", _STR, True),
        ("op", _STR, False),
        ("value", _STR, True),
        ("ts", _TS, False),
        ("seq", _LONG, False),
    ),
    "toggle_log": _schema(
        ("session_id", _STR, False),
        ("basket_id", _LONG, False),
        ("ts", _TS, False),
        ("seq", _LONG, False),
    ),
}

# The base tables, column defaults and the difficulty domain.
BASE_TABLES = ("items", "baskets", "bridge", "stock", "favourites")
DEFAULTS: dict[str, dict[str, str]] = {
    "items": {"category": "diğer"},
    "baskets": {"difficulty": "kolay", "category": "ana yemek"},
}
NOW_COLUMNS = {
    "items": "created_at",
    "baskets": "created_at",
    "stock": "added_at",
    "favourites": "created_at",
}
DIFFICULTIES = ("kolay", "orta", "zor")
# The outcomes of single changes.
ADDED, ALREADY, INVALID, REMOVED = "added", "already there", "invalid", "removed"

# child table, child column -> parent table (same column name)
FOREIGN_KEYS = (
    ("bridge", "basket_id", "baskets"),
    ("bridge", "item_id", "items"),
    ("stock", "item_id", "items"),
    ("favourites", "basket_id", "baskets"),
)
UNIQUE_KEYS = {
    "items": ("name",),
    "bridge": ("basket_id", "item_id"),
    "stock": ("owner_id", "item_id"),
}


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill missing values with the table's column defaults, times with now."""
    values: dict[str, Column] = {c: F.lit(v) for c, v in DEFAULTS.get(table, {}).items()}
    if table in NOW_COLUMNS:
        values[NOW_COLUMNS[table]] = F.current_timestamp()
    for name, default in values.items():
        column = F.coalesce(F.col(name), default) if name in df.columns else default
        df = df.withColumn(name, column)
    return df


def check_difficulty(baskets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into rows whose difficulty is allowed (or null) and rejects."""
    allowed = F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(True))
    return baskets.filter(allowed), baskets.filter(~allowed)
