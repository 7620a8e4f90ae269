"""Coverage, lists and counts over the order catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmatch.functions.match import match_band
from basketmatch.functions.sql import register_functions
from basketmatch.functions.text import norm, parse_item_text
from basketmatch.operators import coverage, listing
from basketmatch.operators.suggest import suggest_items as suggest
from basketmatch.sources.status import dataset_status as status
from workload.registry import query
from workload.tables import (
    BRIDGE,
    EVENTS,
    FAVOURITES,
    ITEMS,
    PERCENT,
    REQUESTS,
    SIZES,
    STOCK,
    TIME,
    TOGGLES,
    UNIQUE_ITEMS,
    Tables,
    time_text,
    with_views,
)

_COVERAGE = f"""cov AS (
  SELECT owner_id, basket_id, count(*) AS have, any_value(need) AS need
  FROM bridge JOIN stock USING (item_id) JOIN sizes USING (basket_id) GROUP BY 1, 2),
scored AS (
  SELECT owner_id, basket_id, have, need,
         {PERCENT.format(have='have', need='need')} AS match_percentage, have = need AS is_complete
  FROM cov)"""


@query(with_views(BRIDGE, STOCK, SIZES, _COVERAGE) + "SELECT * FROM scored")
def coverage_by_owner(t: Tables) -> DataFrame:
    return coverage.coverage(t.bridge(), t.stock())


@query(
    with_views(BRIDGE, STOCK, SIZES, _COVERAGE)
    + """SELECT owner_id, basket_id, need, match_percentage FROM scored WHERE is_complete
UNION ALL SELECT NULL, o_orderkey, 0, 0 FROM orders
WHERE o_orderkey NOT IN (SELECT basket_id FROM bridge)"""
)
def complete_baskets(t: Tables) -> DataFrame:
    return coverage.complete_baskets(t.orders(), t.bridge(), t.stock())


@query(
    with_views(BRIDGE, STOCK, SIZES)
    + f"""SELECT p.owner_id, p.basket_id, count(s.item_id) AS have, count(b.item_id) AS need,
  CASE WHEN count(b.item_id) = 0 THEN 0
       ELSE {PERCENT.format(have='count(s.item_id)', need='count(b.item_id)')} END AS match_percentage,
  count(s.item_id) = count(b.item_id) AS is_complete
FROM (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS owner_id, o_orderkey AS basket_id
      FROM orders JOIN customer ON c_custkey = o_custkey) p
LEFT JOIN bridge b ON b.basket_id = p.basket_id
LEFT JOIN stock s ON s.owner_id = p.owner_id AND s.item_id = b.item_id
GROUP BY 1, 2"""
)
def coverage_of_own_orders(t: Tables) -> DataFrame:
    """Every order against the stock of its customer's nation."""
    return coverage.coverage_of(_own_orders(t), t.bridge(), t.stock())


def _own_orders(t: Tables) -> DataFrame:
    orders, customers = t.raw("orders"), t.raw("customer")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(
        F.col("c_nationkey").cast("bigint").alias("owner_id"),
        F.col("o_orderkey").alias("basket_id"),
    )


@query(
    with_views(BRIDGE, STOCK, SIZES, _COVERAGE) + "SELECT * FROM scored WHERE 100 * have >= 80 * need"
)
def coverage_at_least(t: Tables) -> DataFrame:
    """Pairs of which four fifths or more are in stock."""
    return coverage.coverage_at_least(t.bridge(), t.stock(), 80)


@query(
    with_views(BRIDGE, STOCK, UNIQUE_ITEMS)
    + """SELECT p.owner_id, p.basket_id,
  coalesce(string_agg(i.name, ',' ORDER BY i.name) FILTER (s.item_id IS NOT NULL), '') AS items_have,
  coalesce(string_agg(i.name, ',' ORDER BY i.name) FILTER (i.item_id IS NOT NULL AND s.item_id IS NULL), '')
    AS items_missing
FROM (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS owner_id, o_orderkey AS basket_id
      FROM orders JOIN customer ON c_custkey = o_custkey) p
LEFT JOIN bridge b ON b.basket_id = p.basket_id LEFT JOIN items i ON i.item_id = b.item_id
LEFT JOIN stock s ON s.owner_id = p.owner_id AND s.item_id = b.item_id
GROUP BY 1, 2"""
)
def have_missing_of_own_orders(t: Tables) -> DataFrame:
    """The lists of every order against the stock of its customer's nation."""
    lists = coverage.have_missing_of(_own_orders(t), t.bridge(), t.unique_items(), t.stock())
    return lists.withColumns({c: F.array_join(c, ",") for c in ("items_have", "items_missing")})


@query(
    with_views(BRIDGE, STOCK, UNIQUE_ITEMS)
    + """, pairs AS (SELECT DISTINCT owner_id, basket_id FROM bridge JOIN stock USING (item_id))
SELECT p.owner_id, p.basket_id, CAST(0 AS INTEGER) AS part,
  coalesce(string_agg(i.name, ',' ORDER BY i.name) FILTER (s.item_id IS NOT NULL), '') AS items_have,
  coalesce(string_agg(i.name, ',' ORDER BY i.name) FILTER (s.item_id IS NULL), '') AS items_missing
FROM pairs p JOIN bridge b ON b.basket_id = p.basket_id JOIN items i ON i.item_id = b.item_id
LEFT JOIN stock s ON s.owner_id = p.owner_id AND s.item_id = b.item_id
GROUP BY 1, 2""".replace("\n, pairs", ",\npairs")
)
def have_missing(t: Tables) -> DataFrame:
    lists = coverage.have_missing(t.bridge(), t.unique_items(), t.stock())
    return lists.withColumns({c: F.array_join(c, ",") for c in ("items_have", "items_missing")})


@query(
    with_views(BRIDGE, UNIQUE_ITEMS)
    + """SELECT basket_id, CAST(0 AS INTEGER) AS part, string_agg(name, ',' ORDER BY name) AS item_names
FROM bridge JOIN items USING (item_id) GROUP BY 1"""
)
def basket_items(t: Tables) -> DataFrame:
    lists = coverage.basket_items(t.bridge(), t.unique_items())
    return lists.withColumn("item_names", F.array_join("item_names", ","))


@query(
    with_views(BRIDGE, STOCK, SIZES, _COVERAGE)
    + """SELECT owner_id, CASE WHEN match_percentage >= 80 THEN 'high'
  WHEN match_percentage >= 50 THEN 'medium' ELSE 'low' END AS band, count(*) AS baskets
FROM scored GROUP BY 1, 2"""
)
def match_bands(t: Tables) -> DataFrame:
    scored = coverage.coverage(t.bridge(), t.stock())
    band = match_band("match_percentage").alias("band")
    return scored.groupBy("owner_id", band).agg(F.count(F.lit(1)).alias("baskets"))


@query(
    with_views(STOCK, UNIQUE_ITEMS)
    + f"""SELECT owner_id, item_id, name, {TIME.format('added_at')} AS added_at
FROM stock JOIN items USING (item_id)"""
)
def stock_list(t: Tables) -> DataFrame:
    listed = listing.list_stock(t.stock(), t.unique_items())
    return listed.withColumn("added_at", time_text("added_at"))


@query(with_views(STOCK, ITEMS) + "SELECT owner_id, name FROM stock JOIN items USING (item_id)")
def stock_names(t: Tables) -> DataFrame:
    return listing.stock_names(t.stock(), t.items())


@query(
    with_views(STOCK, ITEMS)
    + """SELECT i.item_id, i.name, count(s.item_id) AS stock_count
FROM items i LEFT JOIN stock s ON s.item_id = i.item_id GROUP BY 1, 2"""
)
def items_with_stock_count(t: Tables) -> DataFrame:
    return listing.items_with_stock_count(t.items(), t.stock())


@query(
    with_views(BRIDGE, ITEMS)
    + """SELECT i.item_id, i.name, count(b.item_id) AS usage_count
FROM items i LEFT JOIN bridge b ON b.item_id = i.item_id GROUP BY 1, 2"""
)
def item_usage(t: Tables) -> DataFrame:
    return listing.usage_counts(t.bridge(), t.items())


@query(
    with_views(BRIDGE, ITEMS)
    + """SELECT i.item_id, i.name, count(b.item_id) AS usage_count
FROM items i LEFT JOIN bridge b ON b.item_id = i.item_id GROUP BY 1, 2
ORDER BY usage_count DESC, i.item_id LIMIT 5"""
)
def popular_items(t: Tables) -> DataFrame:
    return listing.popular_items(t.bridge(), t.items())


@query("SELECT (SELECT count(*) FROM orders) AS total_baskets, (SELECT count(*) FROM part) AS total_items")
def catalog_totals(t: Tables) -> DataFrame:
    return listing.totals(t.orders(), t.items())


@query(
    with_views(STOCK)
    + """SELECT (SELECT count(*) FROM orders) AS total_baskets,
  (SELECT count(*) FROM part) AS total_items, (SELECT count(*) FROM stock) AS stock_items"""
)
def catalog_stats(t: Tables) -> DataFrame:
    listing.catalog_stats(t.orders(), t.items(), t.stock(), view="catalog_stats")
    return t.spark.sql("SELECT * FROM catalog_stats")


@query(
    with_views(BRIDGE, STOCK, EVENTS, TOGGLES, FAVOURITES)
    + """SELECT 'items' AS table_name, true AS present, count(*) AS n_rows FROM part
UNION ALL SELECT 'baskets', true, count(*) FROM orders
UNION ALL SELECT 'bridge', true, count(*) FROM bridge
UNION ALL SELECT 'stock', true, count(*) FROM stock
UNION ALL SELECT 'favourites', true, count(*) FROM favs
UNION ALL SELECT 'menus', false, NULL"""
)
def dataset_status(t: Tables) -> DataFrame:
    expected = ("items", "baskets", "bridge", "stock", "favourites", "menus")
    return status(t.order_catalog(), expected)


@query(
    """SELECT o_orderkey AS basket_id, o_orderpriority AS title, o_orderstatus AS tags,
  CAST(trunc(o_totalprice) AS INTEGER) AS calories
FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 100"""
)
def list_baskets(t: Tables) -> DataFrame:
    return listing.list_baskets(t.orders()).select("basket_id", "title", "tags", "calories")


@query(
    """SELECT doc_id AS basket_id, source AS title, md5(text) AS text_md5, lang AS tags
FROM documents ORDER BY source, doc_id LIMIT 100"""
)
def list_texts(t: Tables) -> DataFrame:
    listed = listing.list_baskets(t.documents())
    return listed.select("basket_id", "title", F.md5("item_text").alias("text_md5"), "tags")


_CHOSEN = """chosen AS (
  SELECT DISTINCT owner_id, item_id FROM
    (SELECT owner_id, unnest(terms) AS name FROM req) JOIN items USING (name))"""


@query(
    with_views(STOCK, ITEMS, REQUESTS, _CHOSEN)
    + """SELECT owner_id, item_id, name, max(sel) AS is_selected, max(held) AS in_stock FROM (
  SELECT owner_id, item_id, true AS sel, false AS held FROM chosen
  UNION ALL SELECT owner_id, item_id, false, true FROM stock) JOIN items USING (item_id)
GROUP BY 1, 2, 3"""
)
def flag_items(t: Tables) -> DataFrame:
    selected = t.requests().select("owner_id", F.explode("terms").alias("name"))
    return listing.flag_items(t.items(), selected, t.stock(), by="owner_id")


@query(
    with_views(EVENTS, TOGGLES, FAVOURITES)
    + f"""SELECT session_id, basket_id, source AS title, {TIME.format('created_at')} AS marked_at
FROM favs JOIN documents ON doc_id = basket_id"""
)
def favourite_baskets(t: Tables) -> DataFrame:
    listed = listing.favourite_baskets(t.favourites(), t.documents())
    return listed.select("session_id", "basket_id", "title", time_text("marked_at"))


@query(
    with_views(EVENTS, TOGGLES, FAVOURITES)
    + """SELECT v.seq, v.user_id AS session_id, v.k AS basket_id, f.basket_id IS NOT NULL AS is_favorite
FROM ev v LEFT JOIN favs f ON f.session_id = v.user_id AND f.basket_id = v.k
WHERE v.event_type = 'view'"""
)
def flag_favourites(t: Tables) -> DataFrame:
    """Every viewed basket with the mark it has for its viewer."""
    views = t.events().filter("event_type = 'view'")
    rows = views.select("seq", F.col("user_id").alias("session_id"), F.col("k").alias("basket_id"))
    return listing.flag_favourites(rows, t.favourites())


@query(
    with_views(EVENTS, TOGGLES, FAVOURITES)
    + """SELECT v.seq, v.user_id AS session_id, v.k AS basket_id
FROM ev v SEMI JOIN favs f ON f.session_id = v.user_id AND f.basket_id = v.k
WHERE v.event_type = 'view'"""
)
def only_favourites(t: Tables) -> DataFrame:
    views = t.events().filter("event_type = 'view'")
    rows = views.select("seq", F.col("user_id").alias("session_id"), F.col("k").alias("basket_id"))
    return listing.only_favourites(rows, t.favourites())


@query(
    with_views(ITEMS)
    + """SELECT query_id, query, rank, name FROM (
  SELECT q.query_id, q.query, n.name, row_number() OVER (
    PARTITION BY q.query_id ORDER BY CASE WHEN n.name = lower(q.query) THEN 1 ELSE 2 END, n.name) AS rank
  FROM (SELECT c_custkey AS query_id, substr(c_mktsegment, 1, CAST(1 + c_custkey % 2 AS BIGINT)) AS query
        FROM customer) q
  JOIN (SELECT DISTINCT name FROM items) n ON starts_with(lower(n.name), lower(q.query)))
WHERE rank <= 10"""
)
def suggest_items(t: Tables) -> DataFrame:
    """Each customer types the first letter or two of a market segment."""
    n = F.col("c_custkey")
    typed = F.substring(F.col("c_mktsegment"), F.lit(1), (1 + n % 2).cast("int"))
    queries = t.raw("customer").select(n.alias("query_id"), typed.alias("query"))
    return suggest(t.items(), queries).withColumn("rank", F.col("rank").cast("bigint"))


_NORM = "translate(lower(trim({0}, E' \\t\\n\\r\\x0b')), 'ıçğöşü', 'icgosu')"


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS norm_md5 FROM documents")
def norm_text(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.md5(norm("text")).alias("norm_md5"))


@query(
    f"""SELECT doc_id, count(*) AS n_parts, md5(string_agg(part, '/' ORDER BY first_no)) AS parts_md5
FROM (SELECT doc_id, trim(piece, E' \\t\\n\\r\\x0b') AS part, min(piece_no) AS first_no FROM (
    SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS piece_no FROM (
      SELECT doc_id, regexp_split_to_array({_NORM.format('text')}, '[,;|\\n]+') AS parts FROM documents))
  WHERE trim(piece, E' \\t\\n\\r\\x0b') <> '' GROUP BY 1, 2)
GROUP BY 1"""
)
def parse_texts(t: Tables) -> DataFrame:
    """Every document read as an item list; the list is shown as a digest."""
    parsed = t.raw("documents").select("doc_id", parse_item_text("text").alias("parts"))
    return parsed.filter(F.size("parts") > 0).select(
        "doc_id",
        F.size("parts").cast("bigint").alias("n_parts"),
        F.md5(F.array_join("parts", "/")).alias("parts_md5"),
    )


@query(
    f"""SELECT p_partkey AS item_id, {_NORM.format('p_type')} AS type_key,
  CASE WHEN p_size * 2 >= 80 THEN 'high' WHEN p_size * 2 >= 50 THEN 'medium' ELSE 'low' END AS band,
  CAST((200 * p_size + 50) // 100 AS INTEGER) AS percent FROM part"""
)
def sql_functions(t: Tables) -> DataFrame:
    """The scalar functions called by name from SQL."""
    register_functions(t.spark)
    t.raw("part").createOrReplaceTempView("sized_parts")
    return t.spark.sql(
        """SELECT p_partkey AS item_id, norm(p_type) AS type_key,
        match_band(p_size * 2) AS band, match_percentage(p_size, 50) AS percent FROM sized_parts"""
    )
