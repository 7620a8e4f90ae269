"""Catalogue maintenance on increments that the tables themselves provide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmatch import schemas
from basketmatch.operators import link, upkeep
from workload.registry import query
from workload.tables import BRIDGE, EVENTS, FAVOURITES, STOCK, TOGGLES, UNIQUE_ITEMS, Tables, with_views


# Incoming names: every customer's segment, typed in capitals, blanks around.
_INCOMING = """incoming AS (
  SELECT c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'small ring#' || c_nationkey
    ELSE c_mktsegment || '#' || c_nationkey END AS name FROM customer)"""


def _incoming(t: Tables) -> DataFrame:
    n = F.col("c_custkey")
    nation = F.col("c_nationkey").cast("string")
    name = F.concat_ws("#", F.when(n % 3 == 0, "small ring").otherwise(F.col("c_mktsegment")), nation)
    return t.raw("customer").select(n.alias("seq"), name.alias("name"))


# Names typed for an owner's stock: a part for each order, some unknown, some blank.
_TYPED = """typed AS (
  SELECT o_orderkey AS seq, o_orderkey % 25 AS owner_id,
    CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN name || '?' ELSE upper(name) END AS name
  FROM orders JOIN items ON item_id = o_custkey)"""


@query(
    with_views(UNIQUE_ITEMS, _INCOMING)
    + """, latest AS (
  SELECT lower(name) AS k, arg_max(upper(name), seq) AS new_name, min(seq) AS first_seq FROM incoming GROUP BY 1)
SELECT coalesce(i.item_id, 1000000 + l.first_seq) AS item_id, coalesce(l.new_name, i.name) AS name,
  CASE WHEN i.item_id IS NULL THEN 'new' ELSE i.category END AS category
FROM items i FULL JOIN latest l ON l.k = lower(i.name)"""
)
def upsert_items(t: Tables) -> DataFrame:
    incoming = _incoming(t).select(
        (F.col("seq") + 1_000_000).alias("item_id"),
        F.upper("name").alias("name"),
        F.lit("new").alias("category"),
        "seq",
    )
    return upkeep.upsert_items(t.unique_items(), incoming)


@query(
    with_views(STOCK, UNIQUE_ITEMS, _TYPED)
    + """, named AS (
  SELECT t.*, i.item_id FROM typed t LEFT JOIN items i ON lower(i.name) = lower(t.name)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY owner_id, lower(name) ORDER BY seq) AS nth FROM named)
SELECT n.seq, n.owner_id, n.name, n.item_id IS NULL AND n.name <> '' AS is_new,
  CASE WHEN n.name = '' THEN 'invalid' WHEN n.nth = 1 AND s.item_id IS NULL THEN 'added'
    ELSE 'already there' END AS result
FROM numbered n LEFT JOIN stock s ON s.owner_id = n.owner_id AND s.item_id = n.item_id"""
)
def add_stock_by_name(t: Tables) -> DataFrame:
    """A part typed by name for each order, for the stock of one of the owners."""
    n, orders, parts = F.col("o_orderkey"), t.raw("orders"), t.unique_items()
    named = orders.join(parts, orders["o_custkey"] == parts["item_id"])
    unknown = F.concat("name", F.lit("?"))
    name = F.when(n % 7 == 0, F.lit(" \t")).when(n % 11 == 0, unknown).otherwise(F.concat(F.lit(" "), F.upper("name")))
    incoming = named.select(n.alias("seq"), (n % 25).alias("owner_id"), name.alias("name"), F.col("o_orderdate").alias("added_at"))
    known = t.unique_items().select("item_id")
    _, _, told = upkeep.add_stock_by_name(t.unique_items(), t.stock(), incoming)
    flagged = told.join(known.withColumn("_known", F.lit(True)), "item_id", "left")
    is_new = (F.col("_known").isNull() & F.col("item_id").isNotNull()).alias("is_new")
    return flagged.select("seq", "owner_id", "name", is_new, "result")


@query(
    with_views(UNIQUE_ITEMS, _INCOMING)
    + """, first_new AS (
  SELECT lower(name) AS k, min(seq) AS seq, arg_min(name, seq) AS name FROM incoming
  WHERE lower(name) NOT IN (SELECT lower(name) FROM items) GROUP BY 1),
created AS (
  SELECT name, k, (SELECT max(item_id) FROM items) + row_number() OVER (ORDER BY seq) AS item_id FROM first_new)
SELECT i.seq, i.name, coalesce(o.item_id, c.item_id) AS item_id
FROM incoming i LEFT JOIN items o ON lower(o.name) = lower(i.name) LEFT JOIN created c ON c.k = lower(i.name)"""
)
def get_or_create_items(t: Tables) -> DataFrame:
    typed = _incoming(t).withColumn("name", F.concat(F.lit("\t "), "name", F.lit(" \n")))
    _, resolved, _ = upkeep.get_or_create_items(t.unique_items(), typed)
    return resolved


@query(
    with_views(BRIDGE)
    + """SELECT * FROM bridge UNION
SELECT o_orderkey, o_custkey FROM orders"""
)
def insert_ignore(t: Tables) -> DataFrame:
    """Every order also gets the item with its customer's number, once."""
    incoming = t.raw("orders").select(
        F.col("o_orderkey").alias("basket_id"), F.col("o_custkey").alias("item_id")
    )
    return upkeep.insert_ignore(t.bridge(), incoming, ["basket_id", "item_id"])


@query(
    with_views(STOCK)
    + """SELECT owner_id, item_id, strftime(min(added_at), '%Y-%m-%d') AS added_on FROM (
  SELECT owner_id, item_id, added_at FROM stock
  UNION ALL SELECT c_nationkey, o_custkey, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE (c_nationkey, o_custkey) NOT IN (SELECT (owner_id, item_id) FROM stock)) GROUP BY 1, 2"""
)
def add_stock(t: Tables) -> DataFrame:
    orders, customers = t.raw("orders"), t.raw("customer")
    incoming = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        F.col("c_nationkey").cast("bigint").alias("owner_id"),
        F.col("o_custkey").alias("item_id"),
        F.col("o_orderdate").alias("added_at"),
    )
    held = upkeep.add_stock(t.stock(), incoming)
    return held.select("owner_id", "item_id", F.date_format("added_at", "yyyy-MM-dd").alias("added_on"))


@query(
    """SELECT o_orderkey AS basket_id, o_orderpriority AS title, NULL AS text_md5,
  'kolay' AS difficulty, 'ana yemek' AS category FROM orders
UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY doc_id), source, md5(text),
  'kolay', 'ana yemek' FROM documents"""
)
def append_baskets(t: Tables) -> DataFrame:
    """All documents become new baskets behind the orders."""
    now = schemas.apply_defaults(t.orders(), "baskets")
    incoming = t.documents().select(
        F.col("basket_id").alias("seq"), "title", "item_text", "instructions", "prep_minutes"
    )
    grown = upkeep.append_baskets(now, incoming)
    return grown.select("basket_id", "title", F.md5("item_text").alias("text_md5"), "difficulty", "category")


@query(
    with_views(STOCK)
    + """SELECT owner_id, item_id FROM stock WHERE (owner_id, item_id) NOT IN (
  SELECT (CAST(c_nationkey AS BIGINT), o_custkey) FROM orders JOIN customer ON c_custkey = o_custkey)"""
)
def delete_by_key(t: Tables) -> DataFrame:
    orders, customers = t.raw("orders"), t.raw("customer")
    gone = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        F.col("c_nationkey").cast("bigint").alias("owner_id"), F.col("o_custkey").alias("item_id")
    )
    kept = upkeep.delete_by_key(t.stock(), gone, ["owner_id", "item_id"])
    return kept.select("owner_id", "item_id")


@query(
    with_views(STOCK)
    + """SELECT CAST(n_nationkey AS BIGINT) AS owner_id, count(item_id) AS deleted,
  (SELECT count(*) FROM stock WHERE owner_id NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) AS kept
FROM nation LEFT JOIN stock ON owner_id = n_nationkey WHERE n_regionkey = 1 GROUP BY 1"""
)
def clear_owner(t: Tables) -> DataFrame:
    """The nations of one region empty their stock."""
    owners = t.raw("nation").filter("n_regionkey = 1").select(
        F.col("n_nationkey").cast("bigint").alias("owner_id")
    )
    kept, deleted = upkeep.clear_owner(t.stock(), owners)
    n_kept = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    return deleted.withColumn("kept", n_kept)


# Keys that go: the parts of one type.
_GONE = "gone AS (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')"


@query(
    with_views(BRIDGE, STOCK, _GONE)
    + """SELECT 'items' AS table_name, count(*) AS n_rows, sum(p_partkey)::BIGINT AS key_sum FROM part
  WHERE p_partkey NOT IN (FROM gone)
UNION ALL SELECT 'bridge', count(*), sum(item_id)::BIGINT FROM bridge WHERE item_id NOT IN (FROM gone)
UNION ALL SELECT 'stock', count(*), sum(item_id)::BIGINT FROM stock WHERE item_id NOT IN (FROM gone)"""
)
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.items().filter("category = 'ECONOMY'").select("item_id")
    return _sums(upkeep.cascade_delete(t.order_catalog(), "items", gone))


@query(
    with_views(BRIDGE, STOCK, _GONE)
    + """, moved AS (SELECT p_partkey AS old_id, 9000000 + p_partkey AS new_id FROM part WHERE p_type = 'ECONOMY')
SELECT 'items' AS table_name, count(*) AS n_rows, sum(coalesce(new_id, p_partkey))::BIGINT AS key_sum
  FROM part LEFT JOIN moved ON old_id = p_partkey
UNION ALL SELECT 'bridge', count(*), sum(coalesce(new_id, item_id))::BIGINT FROM bridge LEFT JOIN moved ON old_id = item_id
UNION ALL SELECT 'stock', count(*), sum(coalesce(new_id, item_id))::BIGINT FROM stock LEFT JOIN moved ON old_id = item_id"""
)
def cascade_rekey(t: Tables) -> DataFrame:
    moved = t.items().filter("category = 'ECONOMY'")
    changes = moved.select(F.col("item_id").alias("old_id"), (F.col("item_id") + 9_000_000).alias("new_id"))
    return _sums(upkeep.cascade_rekey(t.order_catalog(), "items", changes))


def _sums(catalog: dict[str, DataFrame]) -> DataFrame:
    rows = None
    for name in ("items", "bridge", "stock"):
        row = catalog[name].agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("item_id").alias("key_sum"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query(
    with_views(BRIDGE, STOCK, EVENTS, TOGGLES, FAVOURITES)
    + """SELECT 'bridge' AS child, 'basket_id' AS "column", basket_id AS value, count(*) AS n_rows FROM bridge
  WHERE basket_id NOT IN (SELECT doc_id FROM documents) GROUP BY basket_id
UNION ALL SELECT 'favourites', 'basket_id', basket_id, count(*) FROM favs
  WHERE basket_id NOT IN (SELECT doc_id FROM documents) GROUP BY basket_id
UNION ALL SELECT 'bridge', 'item_id', item_id, count(*) FROM bridge
  WHERE item_id NOT IN (SELECT p_partkey FROM part) GROUP BY item_id
UNION ALL SELECT 'stock', 'item_id', item_id, count(*) FROM stock
  WHERE item_id NOT IN (SELECT p_partkey FROM part) GROUP BY item_id"""
)
def orphans(t: Tables) -> DataFrame:
    """Lines of orders that are no document, among others."""
    return upkeep.orphans(t.text_catalog())


@query("SELECT min(p_name) AS name, count(*) AS n_rows FROM part GROUP BY lower(p_name) HAVING count(*) > 1")
def unique_violations(t: Tables) -> DataFrame:
    return upkeep.unique_violations(t.items(), "items")


@query("SELECT min(p_partkey) AS item_id, p_name AS name, arg_min(p_type, p_partkey) AS category FROM part GROUP BY p_name")
def dedupe_unique(t: Tables) -> DataFrame:
    return upkeep.dedupe_unique(t.items(), "items", "item_id")


@query(
    """SELECT o_orderstatus AS difficulty, false AS allowed, count(*) AS n_rows FROM orders
WHERE o_orderstatus <> 'O' GROUP BY 1
UNION ALL SELECT 'orta', true, count(*) FROM orders WHERE o_orderstatus = 'O'"""
)
def check_difficulty(t: Tables) -> DataFrame:
    """Order states as difficulties; only one of them is translated."""
    marked = t.orders().withColumn("difficulty", F.when(F.col("tags") == "O", "orta").otherwise(F.col("tags")))
    valid, rejects = schemas.check_difficulty(marked)
    both = valid.withColumn("allowed", F.lit(True)).unionByName(rejects.withColumn("allowed", F.lit(False)))
    return both.groupBy("difficulty", "allowed").agg(F.count(F.lit(1)).alias("n_rows"))


# Rules: each order priority, in small letters, needs the items its orders' customers stand for.
_RULES = """rules AS (
  SELECT DISTINCT lower(o_orderpriority) AS title, upper(p_name) AS item_name
  FROM orders JOIN part ON p_partkey = o_custkey)"""


@query(
    with_views(_RULES)
    + """SELECT DISTINCT o_orderkey AS basket_id, p.p_partkey AS item_id
FROM orders JOIN rules ON lower(o_orderpriority) = title
JOIN (SELECT min(p_partkey) AS p_partkey, p_name FROM part GROUP BY p_name) p ON lower(p.p_name) = lower(item_name)"""
)
def link_by_rules(t: Tables) -> DataFrame:
    orders, part = t.raw("orders"), t.raw("part")
    rules = orders.join(part, orders["o_custkey"] == part["p_partkey"]).select(
        F.lower("o_orderpriority").alias("title"), F.upper("p_name").alias("item_name")
    )
    items = upkeep.dedupe_unique(t.items(), "items", "item_id")
    return link.link_by_rules(t.orders(), items, rules)


_MENTIONS = r"""mentions AS (
  SELECT DISTINCT doc_id, trim(part, E' \t\n\r\x0b') AS part FROM (
    SELECT doc_id, unnest(regexp_split_to_array(
      translate(lower(trim(text, E' \t\n\r\x0b')), 'ıçğöşü', 'icgosu'), '[,;|\n]+')) AS part FROM documents)),
named AS (
  SELECT item_id AS benchmark_id,
    trim(unnest(regexp_split_to_array(translate(lower(text), 'ıçğöşü', 'icgosu'), '[,;|\n]+')), E' \t\n\r\x0b') AS name
  FROM benchmark),
things AS (SELECT min(benchmark_id) AS item_id, name FROM named WHERE name <> '' GROUP BY name)"""


def _passages(t: Tables) -> DataFrame:
    """Items named after the pieces of the benchmark texts."""
    from basketmatch.functions.text import parse_item_text

    pieces = t.raw("benchmark").select("item_id", F.explode(parse_item_text("text")).alias("name"))
    return pieces.groupBy("name").agg(F.min("item_id").alias("item_id"))


@query(
    with_views(_MENTIONS)
    + "SELECT DISTINCT doc_id AS basket_id, item_id FROM mentions JOIN things ON things.name = part"
)
def link_by_text(t: Tables) -> DataFrame:
    links, _ = link.link_by_text(t.documents(), _passages(t))
    return links


@query(
    with_views(_MENTIONS)
    + """SELECT part AS name_key, count(*) AS n_baskets FROM mentions
WHERE part <> '' AND part NOT IN (SELECT name FROM things) GROUP BY 1"""
)
def unlinked_names(t: Tables) -> DataFrame:
    _, unlinked = link.link_by_text(t.documents(), _passages(t))
    return unlinked
