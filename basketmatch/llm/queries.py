"""The registered queries of this package on the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketmatch.llm import bpe, decontaminate, fill_in_middle, fingerprints, language_id, line_dedup, near_dedup, secrets, substring_dedup, token_counts, toxicity, url_filter, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Register a function of (spark, folder) under its name, with its SQL if there is any."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    r"""
    with item_words as (
      select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w
      from benchmark where item_id is not null),
    doc_words as (
      select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w
      from documents where doc_id is not null),
    items as (
      select distinct item_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])
        when len(w) > 0 then [w] else [] end) s from item_words),
    lengths as (select distinct least(len(w), 5) k from item_words where len(w) > 0),
    docs as (
      select distinct doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) s
      from doc_words, lengths where len(w) >= k),
    sizes as (select item_id, count(*) n_shingles from items group by item_id)
    select doc_id, item_id, n_shingles, count(*) n_found, count(*) / n_shingles containment
    from docs join items using (s) join sizes using (item_id)
    group by doc_id, item_id, n_shingles having 100 * count(*) >= 75 * n_shingles
    """
)
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Each benchmark item that a document holds."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    model = Path(public_tokenizers.path(token_counts.MODEL)).read_bytes()
    return token_counts.token_counts(table(spark, folder, "documents"), model)


@query()
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity of every document, by a model of the labelled ones."""
    docs = table(spark, folder, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query()
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edit_fingerprints(table(spark, folder, "documents"))


#: The rules of the url query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query(
    r"""
    with parsed as (
      select page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) path from pages),
    rules (rule_host, rule_path, rule_verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
      ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    best as (
      select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) rule,
        arg_max(rule_verdict, length(rule_host || rule_path)) verdict
      from (select distinct host, path from parsed) p join rules
        on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
      group by host, path),
    formed as (
      select page_id, host, path, rule, verdict, case when contains(url, '://') then
        regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') ||
        coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
          lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref)=')), '&'), ''), '') end form
      from parsed left join best using (host, path)),
    classes as (select form, min(verdict) class_rule from formed where rule is not null and form is not null group by form)
    select page_id, host, path, rule, coalesce(verdict, class_rule, 'allow') verdict, class_rule
    from formed left join classes using (form)
    """
)
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's host, path, rule and verdict. (The SQL knows aliases by form alone;
    the driver's pages have no canonical links or refreshes.)"""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judged(table(spark, folder, "pages"), rules)


@query()
def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its group of near duplicates."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query()
def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    return bpe.digests(table(spark, folder, "documents"), ranks)


@query()
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, folder, "documents")
    net = language_id.fit(docs.where(language_id.learnable(F.col("doc_id"))))
    out = language_id.predicted(docs, net)
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    return out.select("doc_id", (crc == 1).alias("held_out"), "lang_pred", "score")


@query()
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """The secrets of every document."""
    words = secrets.word_ranks(public_tokenizers.path(bpe.RANKS))
    return secrets.secrets(table(spark, folder, "documents"), words)


@query()
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the runs of lines that repeat earlier ones."""
    out = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "removed", "text")


@query(
    r"""
    with cut as (
      select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') u,
        sha256('1:' || coalesce(doc_id::varchar, '')) h from documents),
    numbers as (
      select *, len(u)::bigint n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2,
        ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from cut),
    formed as (
      select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
          when h4 % 100 < 20 then 'spm' else 'psm' end form from numbers),
    parts as (
      select *, array_to_string(u[:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:], '') s from formed)
    select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars,
      case when form <> 'plain' then length(m) end middle_chars,
      sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
        else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
      sha256(t) restored_sha256
    from parts
    """
)
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """How every text is cut, and digests of its output and of the text restored from it."""
    return fill_in_middle.digests(table(spark, folder, "documents"))


@query(
    r"""
    with texts as (
      select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
    windows as (
      select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) h
      from (select doc_id, w, unnest(range(1, len(w) - 18)) i from texts)),
    later as (
      select doc_id, i from windows
      qualify row_number() over (partition by h order by doc_id, i) > 1),
    gone as (select distinct doc_id, i + k i from later, range(20) t(k)),
    words as (select doc_id, unnest(w) word, generate_subscripts(w, 1) i from texts),
    kept as (
      select doc_id, count(*) n, string_agg(word, ' ' order by i) kept
      from words anti join gone using (doc_id, i) group by doc_id)
    select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256
    from texts left join kept using (doc_id)
    """
)
def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the words of windows that occur earlier."""
    return substring_dedup.dedup_passages(table(spark, folder, "documents"))


def _codes_sql(rounds: int = 2) -> str:
    """Every part against every entry, round by round."""
    steps = [
        """kept as materialized (
      select row_number() over (order by vec_id) rn, vec_id, label,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v
      from embeddings where len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    parts as materialized (
      select rn, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] x from kept, range(16) t(p)),
    comps as materialized (select rn, p, generate_subscripts(x, 1) k, unnest(x) c from parts),
    book0 as materialized (select p, rn - 1 e, x from parts where rn <= 64)"""
    ]
    near = """near{r} as materialized (
      select rn, p, min(64 * list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint + e) found
      from parts a join book{r} b using (p) group by rn, p)"""
    book = """sums{r} as (
      select p, found % 64 e, k, sum(c)::bigint s, count(*) n from near{r} join comps using (rn, p) group by all),
    means{r} as (select p, e, list((s - ((s % n) + n) % n) // n order by k) x from sums{r} group by p, e),
    book{next} as materialized (select p, e, coalesce(m.x, b.x) x from book{r} b left join means{r} m using (p, e))"""
    for r in range(rounds):
        steps += [near.format(r=r), book.format(r=r, next=r + 1)]
    steps += [near.format(r=rounds)]
    return f"""with {", ".join(steps)},
    codes as (
      select rn, string_agg(printf('%02x', found % 64), '' order by p) code, sum(found // 64)::bigint error
      from near{rounds} group by rn),
    numbers as (select p, e, generate_subscripts(x, 1) k, unnest(x) c from book{rounds}),
    name as (select sha256(string_agg(c::varchar, ',' order by p, e, k)) codebooks_sha256 from numbers)
    select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, codebooks_sha256
    from codes join kept using (rn), name"""


@query(_codes_sql())
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The code of every usable vector."""
    return vector_codes.vector_codes(table(spark, folder, "embeddings"))
