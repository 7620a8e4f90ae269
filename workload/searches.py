"""Search, recommendations, picks and plans over the document catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmatch.operators import picks, search
from basketmatch.operators.wordindex import build_index, extend_index, open_index
from basketmatch.plans.recommend import favourites_view as favourites_of
from basketmatch.plans.recommend import recommend as answer_requests
from basketmatch.sources import sinks
from workload.registry import query
from workload.tables import (
    BRIDGE,
    DOCS,
    EVENTS,
    FAVOURITES,
    ITEMS,
    PERCENT,
    REQUESTS,
    STOCK,
    TERMS,
    TIME,
    TOGGLES,
    Tables,
    time_text,
    with_views,
)

_SCORES = """scores AS (
  SELECT request_id, basket_id, sum(CAST(contains(t, term) AS BIGINT)) AS score
  FROM terms, docs GROUP BY 1, 2)"""

_Q = """asked AS (
  SELECT *, q NOT IN ('', '0') AS filtered, strip_accents(lower(q)) AS fq FROM req)"""

_PASSES = "(NOT a.filtered OR contains(d.ti, a.fq) OR contains(d.t, a.fq) OR contains(d.ta, a.fq))"

_RANKED = f"""found AS (
  SELECT a.request_id, a.owner_id, a.session_id, a.terms, d.basket_id, d.title, CAST(s.score AS BIGINT) AS score
  FROM asked a CROSS JOIN docs d LEFT JOIN scores s
    ON s.request_id = a.request_id AND s.basket_id = d.basket_id
  WHERE {_PASSES} AND (len(a.terms) = 0 OR s.score >= a.min_match)),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY request_id ORDER BY score DESC NULLS LAST, title, basket_id) AS rank
  FROM found QUALIFY rank <= 100)"""

_SEARCH = (REQUESTS, DOCS, TERMS, _SCORES, _Q, _RANKED)


@query(
    with_views(REQUESTS)
    + "SELECT request_id, array_to_string(terms, '/') AS terms, min_match, q FROM req"
)
def normalise_requests(t: Tables) -> DataFrame:
    clean = search.normalise_requests(t.requests())
    return clean.select("request_id", F.array_join("terms", "/").alias("terms"), "min_match", "q")


_WORDS = r"""texts AS (
  SELECT t AS text FROM docs UNION ALL SELECT ti FROM docs UNION ALL SELECT ta FROM docs),
listed AS (
  SELECT unnest(list_distinct(string_split_regex(text, '\s+') || regexp_extract_all(text, '\s+'))) AS word
  FROM texts WHERE text IS NOT NULL)"""

_WORD_INDEX = with_views(DOCS, _WORDS) + "SELECT word, count(*) AS n_texts FROM listed GROUP BY 1"


@query(_WORD_INDEX)
def word_index(t: Tables) -> DataFrame:
    """The words of the index with the number of texts that have them."""
    return t.index().words()


@query(_WORD_INDEX)
def extended_word_index(t: Tables) -> DataFrame:
    """The same from an index of two thirds of the baskets, extended twice by the others;
    the numbers are counted anew from its postings."""
    baskets = t.documents()
    third = F.col("basket_id") % 3
    index = build_index(baskets.filter(third == 0))
    for i in (1, 2):
        index = extend_index(index, baskets.filter(third == i))
    index = open_index(t.spark, index.folder)
    return index.postings().groupBy("word").agg(F.count(F.lit(1)).alias("n_texts"))


@query(
    with_views(REQUESTS, DOCS, TERMS)
    + """SELECT request_id, basket_id, sum(CAST(contains(t, term) AS BIGINT))::BIGINT AS score
FROM terms, docs GROUP BY 1, 2 HAVING bool_or(term <> '' AND contains(t, term))
UNION ALL SELECT request_id, NULL, count(*) FROM terms WHERE term = '' GROUP BY 1"""
)
def score_text(t: Tables) -> DataFrame:
    return search.score_text(t.index(), search.normalise_requests(t.requests()))


@query(with_views(*_SEARCH) + "SELECT request_id, rank, basket_id, score FROM ranked")
def search_scored(t: Tables) -> DataFrame:
    ranked = search.search_scored(t.index(), search.normalise_requests(t.requests()))
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    with_views(REQUESTS, DOCS, _Q)
    + f"""SELECT a.request_id, d.basket_id, row_number() OVER (
  PARTITION BY a.request_id ORDER BY d.title, d.basket_id) AS rank
FROM asked a CROSS JOIN docs d WHERE {_PASSES} QUALIFY rank <= 100"""
)
def search_text(t: Tables) -> DataFrame:
    found = search.search_text(t.index(), search.normalise_requests(t.requests()))
    return found.withColumn("rank", F.col("rank").cast("bigint"))


_TALK = r"""talk AS (
  SELECT conv_id * 1000 + turn AS request_id, string_split_regex(text, '\s+') AS terms FROM conversations),
asks AS (
  SELECT request_id, list_transform(terms, lambda x: strip_accents(lower(x))) AS terms FROM talk
  UNION ALL SELECT -request_id, list_transform(terms[:3], lambda x: strip_accents(lower(x))) FROM talk)"""


def _talk_requests(t: Tables) -> DataFrame:
    """All words of every conversation turn, and its first three words."""
    number = F.col("conv_id") * 1000 + F.col("turn")
    words = F.split("text", r"\s+")
    turns = t.raw("conversations")
    return turns.select(number.alias("request_id"), words.alias("terms")).unionByName(
        turns.select((-number).alias("request_id"), F.slice(words, 1, 3).alias("terms"))
    )


@query(
    with_views(_TALK, DOCS)
    + """SELECT request_id, basket_id, row_number() OVER (
  PARTITION BY request_id ORDER BY title, basket_id) AS rank
FROM asks, docs WHERE len(list_filter(terms, lambda x: NOT contains(t, x))) = 0
QUALIFY rank <= 100"""
)
def search_all_terms(t: Tables) -> DataFrame:
    found = search.search_all_terms(t.index(), _talk_requests(t))
    return found.withColumn("rank", F.col("rank").cast("bigint"))


_WILD = r"""wild AS (
  SELECT item_id AS request_id,
    '%' || strip_accents(lower(substr(w, 1, 2) || '%' || substr(w, 4, 1) || '_')) || '%' AS pattern
  FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark)),
patterns AS (SELECT request_id, pattern, count(*) AS times FROM wild GROUP BY ALL),
hits AS (SELECT pattern, basket_id FROM (SELECT DISTINCT pattern FROM patterns), docs WHERE t LIKE pattern)"""


@query(
    with_views(DOCS, _WILD)
    + """SELECT request_id, basket_id, sum(times)::BIGINT AS score FROM hits JOIN patterns USING (pattern) GROUP BY 1, 2"""
)
def score_wildcards(t: Tables) -> DataFrame:
    """Typed wildcards for every word of a text: two letters, anything, a letter and one more character."""
    word = F.explode(F.split("text", " ")).alias("word")
    pattern = F.concat(F.substring("word", 1, 2), F.lit("%"), F.substring("word", 4, 1), F.lit("_"))
    words = t.raw("benchmark").select(F.col("item_id").alias("request_id"), word)
    requests = words.groupBy("request_id").agg(F.collect_list(pattern).alias("terms"))
    return search.score_text(t.index(), requests, wildcards=True)


_ITEMISED = f"""itemised AS (
  SELECT r.request_id, r.rank, any_value(r.score) AS score, r.basket_id, any_value(r.title) AS title,
    any_value(r.session_id) AS session_id, any_value(len(r.terms)) AS n_terms,
    count(b.item_id) AS need, count(s.item_id) AS have,
    count(b.item_id) FILTER (list_contains(r.terms, i.name)) AS selected,
    coalesce(string_agg(i.name, ',' ORDER BY i.name) FILTER (s.item_id IS NOT NULL), '') AS items_have,
    coalesce(string_agg(i.name, ',' ORDER BY i.name) FILTER (b.item_id IS NOT NULL AND s.item_id IS NULL), '')
      AS items_missing
  FROM ranked r LEFT JOIN bridge b ON b.basket_id = r.basket_id LEFT JOIN items i ON i.item_id = b.item_id
  LEFT JOIN stock s ON s.owner_id = r.owner_id AND s.item_id = b.item_id
  GROUP BY r.request_id, r.rank, r.basket_id)"""

_BASE = "CASE WHEN n_terms > 0 THEN selected ELSE have END"

_RECOMMENDED = f"""recommended AS (
  SELECT t.request_id, t.rank, t.score, t.basket_id, t.title, t.items_have, t.items_missing,
    md5(d.text) AS text_md5, '' AS instructions, CAST(d.n_chars AS INTEGER) AS prep_minutes, d.lang AS tags,
    CASE WHEN need = 0 THEN 0 ELSE {PERCENT.format(have=f'({_BASE})', need='need')} END AS match_percentage,
    have = need AS is_complete, f.basket_id IS NOT NULL AS is_favorite
  FROM itemised t JOIN documents d ON d.doc_id = t.basket_id
  LEFT JOIN favs f ON f.session_id = t.session_id AND f.basket_id = t.basket_id)"""

_WHOLE = (*_SEARCH, BRIDGE, ITEMS, STOCK, EVENTS, TOGGLES, FAVOURITES, _ITEMISED, _RECOMMENDED)


@query(with_views(*_WHOLE) + "SELECT * FROM recommended")
def recommend(t: Tables) -> DataFrame:
    rows = answer_requests(t.searched_catalog(), t.requests())
    return rows.select(
        "request_id",
        F.col("rank").cast("bigint").alias("rank"),
        "score",
        "basket_id",
        "title",
        F.array_join("items_have", ",").alias("items_have"),
        F.array_join("items_missing", ",").alias("items_missing"),
        F.md5("item_text").alias("text_md5"),
        "instructions",
        "prep_minutes",
        "tags",
        "match_percentage",
        "is_complete",
        "is_favorite",
    )


@query(
    with_views(*_WHOLE)
    + """SELECT request_id, rank, to_json(struct_pack(id := basket_id, title := title,
  text_md5 := text_md5, instructions := instructions, prep_minutes := prep_minutes, calories := NULL,
  difficulty := NULL, tags := tags, image_url := NULL, match_percentage := match_percentage,
  is_complete := is_complete, is_favorite := is_favorite))::VARCHAR AS json FROM recommended"""
)
def recommend_json(t: Tables) -> DataFrame:
    """Answer rows as JSON with nulls present; the long text as its digest."""
    rows = answer_requests(t.searched_catalog(), t.requests())
    fields = [
        F.col("basket_id").alias("id"),
        "title",
        F.md5("item_text").alias("text_md5"),
        "instructions",
        "prep_minutes",
        "calories",
        "difficulty",
        "tags",
        "image_url",
        "match_percentage",
        "is_complete",
        "is_favorite",
    ]
    json = sinks.json_row(fields).alias("json")
    return rows.select("request_id", F.col("rank").cast("bigint").alias("rank"), json)


@query(
    with_views(EVENTS, TOGGLES, FAVOURITES, BRIDGE, STOCK, ITEMS)
    + f"""SELECT f.session_id, f.basket_id, any_value({TIME.format('f.created_at')}) AS created_at,
  any_value(d.source) AS title,
  coalesce(string_agg(i.name, ',' ORDER BY i.name) FILTER (s.item_id IS NOT NULL), '') AS items_have,
  coalesce(string_agg(i.name, ',' ORDER BY i.name) FILTER (b.item_id IS NOT NULL AND s.item_id IS NULL), '')
    AS items_missing,
  CASE WHEN count(b.item_id) = 0 THEN 0
    ELSE {PERCENT.format(have='count(s.item_id)', need='count(b.item_id)')} END AS match_percentage,
  count(b.item_id) = count(s.item_id) AS is_complete, true AS is_favorite
FROM favs f JOIN documents d ON d.doc_id = f.basket_id
LEFT JOIN bridge b ON b.basket_id = f.basket_id LEFT JOIN items i ON i.item_id = b.item_id
LEFT JOIN stock s ON s.owner_id = f.session_id % 25 AND s.item_id = b.item_id
GROUP BY f.session_id, f.basket_id"""
)
def favourites_view(t: Tables) -> DataFrame:
    """Favourites of all sessions; a session looks into the stock of nation ``id % 25``."""
    session = F.col("user_id")
    sessions = t.raw("events").select(
        session.alias("session_id"), (session % 25).alias("owner_id")
    ).distinct()
    rows = favourites_of(t.text_catalog(), sessions)
    return rows.select(
        "session_id",
        "basket_id",
        time_text("created_at"),
        "title",
        F.array_join("items_have", ",").alias("items_have"),
        F.array_join("items_missing", ",").alias("items_missing"),
        "match_percentage",
        "is_complete",
        "is_favorite",
    )


def _ranked(t: Tables) -> DataFrame:
    return search.search_scored(t.index(), search.normalise_requests(t.requests()))


@query(
    with_views(*_SEARCH)
    + """SELECT request_id, rank, basket_id, least(total, 8) AS shown, total - least(total, 8) AS remaining, total
FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS total FROM ranked) WHERE rank <= 8"""
)
def page_2(t: Tables) -> DataFrame:
    paged = picks.page(_ranked(t), 2)
    return paged.select(
        "request_id",
        F.col("rank").cast("bigint").alias("rank"),
        "basket_id",
        F.col("shown").cast("bigint").alias("shown"),
        F.col("remaining").cast("bigint").alias("remaining"),
        "total",
    )


@query(
    with_views(*_SEARCH)
    + """SELECT request_id, arg_min(basket_id, md5('tea:' || request_id || ':' || basket_id)) AS basket_id
FROM ranked GROUP BY 1"""
)
def random_pick(t: Tables) -> DataFrame:
    return picks.random_pick(_ranked(t), "tea")


_DAYS = """days AS (
  SELECT unnest(['Pazartesi', 'Salı', 'Çarşamba', 'Perşembe', 'Cuma', 'Cumartesi', 'Pazar']) AS day,
    generate_subscripts([1, 2, 3, 4, 5, 6, 7], 1) AS day_no)"""

_PLAN = """plan AS (
  SELECT request_id AS session_id, day, any_value(day_no) AS day_no,
    arg_min(basket_id, md5('tea:' || request_id || ':' || day || ':' || basket_id)) AS basket_id,
    arg_min(title, md5('tea:' || request_id || ':' || day || ':' || basket_id)) AS title
  FROM ranked CROSS JOIN days GROUP BY 1, 2)"""


def _weekly(t: Tables) -> DataFrame:
    titles = t.documents().select("basket_id", "title")
    results = _ranked(t).join(titles, "basket_id").withColumnRenamed("request_id", "session_id")
    return picks.weekly_plan(results, "tea")


@query(with_views(*_SEARCH, _DAYS, _PLAN) + "SELECT session_id, day, basket_id, title FROM plan")
def weekly_plan(t: Tables) -> DataFrame:
    return _weekly(t)


@query(
    with_views(*_SEARCH, _DAYS, _PLAN)
    + """SELECT session_id, '{' || string_agg('"' || day || '":"' || title || '"', ',' ORDER BY day_no) || '}' AS plan
FROM plan GROUP BY 1"""
)
def export_plan(t: Tables) -> DataFrame:
    return sinks.export_plan(_weekly(t)).withColumn("plan", F.to_json("plan"))
