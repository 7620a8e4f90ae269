"""The driver's tables seen as a catalogue.

Two catalogues: orders with their lines (many baskets, no texts) and documents
(baskets with texts; their items are the lines of the order with the same
number). Owners are nations, sessions are event users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketmatch.operators.skew import checkpointed
from basketmatch.operators.wordindex import WordIndex, build_index

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# Indexes of this process by application and folder, as a catalogue would have them.
_INDEXES: dict[tuple[str, str], WordIndex] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def items(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("item_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
        )

    def unique_items(self) -> DataFrame:
        """Part names repeat; with the key behind them they do not."""
        name = F.concat_ws("#", "name", F.col("item_id").cast("string"))
        return self.items().withColumn("name", name)

    def bridge(self) -> DataFrame:
        """Derived once and stored, as a catalogue would have it."""
        lines = self.raw("lineitem")
        return checkpointed(
            lines.select(
                F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("item_id")
            ).distinct()
        )

    def stock(self) -> DataFrame:
        lines, suppliers = self.raw("lineitem"), self.raw("supplier")
        return checkpointed(
            lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"])
            .groupBy(
                F.col("s_nationkey").cast("bigint").alias("owner_id"),
                F.col("l_partkey").alias("item_id"),
            )
            .agg(F.min("l_shipdate").alias("added_at"))
        )

    def orders(self) -> DataFrame:
        none = F.lit(None).cast("string")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("basket_id"),
            F.col("o_orderpriority").alias("title"),
            none.alias("item_text"),
            none.alias("instructions"),
            F.lit(None).cast("int").alias("prep_minutes"),
            F.col("o_totalprice").cast("int").alias("calories"),
            none.alias("difficulty"),
            F.col("o_orderstatus").alias("tags"),
            none.alias("image_url"),
        )

    def documents(self) -> DataFrame:
        none = F.lit(None).cast("string")
        return self.raw("documents").select(
            F.col("doc_id").alias("basket_id"),
            F.col("source").alias("title"),
            F.col("text").alias("item_text"),
            none.alias("instructions"),
            F.col("n_chars").cast("int").alias("prep_minutes"),
            F.lit(None).cast("int").alias("calories"),
            none.alias("difficulty"),
            F.col("lang").alias("tags"),
            none.alias("image_url"),
        )

    def index(self) -> WordIndex:
        """The documents' word index: built at the first search, then used by all."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _INDEXES:
            _INDEXES[key] = build_index(self.documents())
        return _INDEXES[key]

    def toggles(self) -> DataFrame:
        return self.events().filter("event_type = 'click'").select(
            F.col("user_id").alias("session_id"), F.col("k").alias("basket_id"), "ts", "seq"
        )

    def events(self) -> DataFrame:
        return with_number(self.raw("events"))

    def requests(self) -> DataFrame:
        return self.requests_from(self.raw("benchmark"))

    def requests_from(self, benchmark: DataFrame) -> DataFrame:
        """One request per benchmark text: its words as terms, plus the odd cases.

        Terms: all words, the first two as a phrase, a part name;
        every tenth request has none, another tenth an empty one. ``min_match``
        and ``q`` come as typed text.
        """
        n = F.col("item_id")
        words = F.split("text", " ")
        phrase = F.concat_ws(" ", words[0], words[1])
        terms = F.concat(words, F.array(phrase, F.col("p_name")))
        parts = self.raw("part").select(F.col("p_partkey").alias("item_id"), "p_name")
        return (
            benchmark.join(parts, "item_id").select(
                n.alias("request_id"),
                (n % 25).alias("owner_id"),
                (n % 150).alias("session_id"),
                F.when(n % 10 == 9, F.array().cast("array<string>"))
                .when(n % 10 == 8, F.concat(terms, F.array(F.lit(" "))))
                .otherwise(terms)
                .alias("terms"),
                F.element_at(F.array(*map(F.lit, ["1", "2", " 3x", None, "0"])), (n % 5 + 1).cast("int")).alias(
                    "min_match"
                ),
                F.when(n % 4 == 0, words[5]).when(n % 4 == 1, F.lit("0")).otherwise(F.lit("")).alias("q"),
            )
        )

    def favourites(self) -> DataFrame:
        from basketmatch.streaming.folds import fold_toggles

        return fold_toggles(self.toggles())

    def text_catalog(self) -> dict[str, DataFrame]:
        return {
            "items": self.items(),
            "baskets": self.documents(),
            "bridge": self.bridge(),
            "stock": self.stock(),
            "favourites": self.favourites(),
        }

    def searched_catalog(self) -> dict[str, DataFrame | WordIndex]:
        return self.text_catalog() | {"index": self.index()}

    def order_catalog(self) -> dict[str, DataFrame]:
        return self.text_catalog() | {"baskets": self.orders(), "items": self.unique_items()}


def with_number(events: DataFrame) -> DataFrame:
    """Events with the number in their properties as ``k`` and their id as ``seq``."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.withColumn("k", k).withColumnRenamed("event_id", "seq")


def time_text(column: str):
    return F.date_format(column, TIME_FORMAT).alias(column)


# The same views as SQL, for the oracle ------------------------------------------

BRIDGE = """bridge AS (
  SELECT DISTINCT l_orderkey AS basket_id, l_partkey AS item_id FROM lineitem)"""

STOCK = """stock AS (
  SELECT CAST(s_nationkey AS BIGINT) AS owner_id, l_partkey AS item_id, min(l_shipdate) AS added_at
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""

UNIQUE_ITEMS = """items AS (
  SELECT p_partkey AS item_id, p_name || '#' || CAST(p_partkey AS VARCHAR) AS name,
         p_type AS category FROM part)"""

ITEMS = "items AS (SELECT p_partkey AS item_id, p_name AS name, p_type AS category FROM part)"

SIZES = "sizes AS (SELECT basket_id, count(*) AS need FROM bridge GROUP BY 1)"

EVENTS = """ev AS (
  SELECT event_id AS seq, ts, user_id, event_type,
         CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)"""

TOGGLES = """toggles AS (
  SELECT user_id AS session_id, k AS basket_id, ts, seq FROM ev WHERE event_type = 'click')"""

FAVOURITES = """favs AS (
  SELECT session_id, basket_id, max(ts) AS created_at FROM toggles
  GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""

REQUESTS = r"""raw_requests AS (
  SELECT item_id AS request_id, item_id % 25 AS owner_id, item_id % 150 AS session_id,
         string_split(text, ' ') AS w, p_name,
         ['1', '2', ' 3x', NULL, '0'][item_id % 5 + 1] AS min_text,
         CASE item_id % 4 WHEN 0 THEN string_split(text, ' ')[6] WHEN 1 THEN '0' ELSE '' END AS q_text
  FROM benchmark JOIN part ON p_partkey = item_id),
req AS (
  SELECT request_id, owner_id, session_id,
    list_transform(
      CASE request_id % 10
        WHEN 9 THEN CAST([] AS VARCHAR[])
        WHEN 8 THEN list_concat(list_concat(w, [w[1] || ' ' || w[2], p_name]), [' '])
        ELSE list_concat(w, [w[1] || ' ' || w[2], p_name]) END,
      lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS terms,
    CASE WHEN min_text IS NULL THEN 1
         WHEN regexp_matches(min_text, '^\s*[+-]?\d+')
           THEN CAST(regexp_extract(min_text, '^\s*([+-]?\d+)', 1) AS BIGINT)
         ELSE 0 END AS min_match,
    regexp_replace(q_text, '^\s+|\s+$', '', 'g') AS q
  FROM raw_requests)"""

# Texts as the search compares them.
DOCS = """docs AS (
  SELECT doc_id AS basket_id, source AS title, strip_accents(lower(text)) AS t,
         strip_accents(lower(source)) AS ti, strip_accents(lower(lang)) AS ta FROM documents)"""

TERMS = """terms AS (
  SELECT request_id, strip_accents(lower(u.term)) AS term
  FROM (SELECT request_id, unnest(terms) AS term FROM req) u)"""

PERCENT = "CAST((200 * {have} + {need}) // (2 * {need}) AS INTEGER)"
TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
