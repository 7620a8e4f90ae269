"""A stored index of the baskets' words: built once, extended by what is appended.

The index is cut by basket: all words of a basket lie in one bucket, so that what a
search finds in a bucket is counted, scored and ranked there and only the best rows
leave it. Inside, the words are dealt into parts by hash and sorted, so that a search
for a few words reads a few parts.

Tables, in one folder:

* ``postings`` (word, basket_id, field): the distinct words of each text and the
  stretches of blanks between them; bucketed by basket, partitioned by word hash;
* ``texts`` (basket_id, field, folded) and ``titles`` (basket_id, title, has_text),
  bucketed by basket;
* ``words`` (word, n_texts): in how many texts (field, basket) a word occurs;
* ``runs`` (run, word): the runs of 1 to RUN_LENGTH characters of each word, and
  ``run_sizes`` (run, n_texts): the numbers of its words' texts, added up.

Each addition writes files of its own and ends with a row in ``commits``; readers see
committed additions only, so that one that broke off half-way changes nothing.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketmatch.functions.text import SPACES, fold
from basketmatch.operators.skew import scratch_dir, spread

# Runs of up to this many characters lead from a term to the words that hold it.
RUN_LENGTH = 3
# Parts that the words are dealt into, and the least number of buckets.
PARTS = 8
# Baskets whose words are sorted in one task while they are written.
BASKETS_PER_TASK = 10_000
# The numbers of the text fields.
FIELDS = ("item_text", "title", "tags")
ITEM_TEXT = 0

_TABLES = {
    "postings": ("word STRING, basket_id BIGINT, field INT, commit STRING, part INT", "commit, part", "word"),
    "texts": ("basket_id BIGINT, field INT, folded STRING, commit STRING", "commit", "basket_id"),
    "titles": ("basket_id BIGINT, title STRING, has_text BOOLEAN, commit STRING", "commit", "basket_id"),
}
_PLAIN = {
    "words": "word STRING, n_texts BIGINT, commit STRING",
    "runs": "run STRING, word STRING, n_texts BIGINT, fresh BOOLEAN, commit STRING",
    "run_sizes": "run STRING, n_texts BIGINT, commit STRING",
    "commits": "commit STRING, buckets INT, seq INT",
}


def words_of(column: Column | str) -> Column:
    """The distinct words of a folded text and the stretches of blanks between them."""
    blanks = F.regexp_extract_all(column, F.lit(f"({SPACES})"), F.lit(1))
    return F.array_distinct(F.concat(F.split(column, SPACES), blanks))


def runs_of(column: Column | str) -> Column:
    """Distinct runs of 1 to RUN_LENGTH characters (overlapping, in linear time)."""
    each = [
        F.regexp_extract_all(column, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        for n in range(1, RUN_LENGTH + 1)
    ]
    return F.array_distinct(F.concat(*each))


def part_of(word: Column | str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(PARTS)).cast("int")


class WordIndex:
    """The committed state of an index folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str, commits: list[str], buckets: int):
        self.spark = spark
        self.folder = folder
        self.commits = commits
        self.buckets = buckets
        self._repeats: bool | None = None
        self._prefix = "basketmatch_index_" + hashlib.md5(folder.encode()).hexdigest()
        for name, (columns, partitions, order) in _TABLES.items():
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._prefix}_{name} ({columns}) USING parquet "
                f"PARTITIONED BY ({partitions}) CLUSTERED BY (basket_id) SORTED BY ({order}) "
                f"INTO {buckets} BUCKETS LOCATION '{folder}/{name}'"
            )

    def postings(self, words: DataFrame | None = None) -> DataFrame:
        """(word, basket_id, field); with ``words`` only the parts that hold some of them."""
        rows = self._bucketed("postings")
        if words is not None:
            wanted = words.select(part_of("word").alias("part")).distinct().collect()  # up to PARTS rows
            rows = rows.filter(F.col("part").isin([r["part"] for r in wanted]))
        return rows.drop("part")

    def texts(self) -> DataFrame:
        return self._bucketed("texts")

    def titles(self) -> DataFrame:
        return self._bucketed("titles")

    def words(self) -> DataFrame:
        """(word, n_texts): every word once, with the number of texts that have it."""
        return self._plain("words").groupBy("word").agg(F.sum("n_texts").alias("n_texts"))

    def runs(self) -> DataFrame:
        """(run, word), each once."""
        return self._plain("runs").filter("fresh").select("run", "word")

    def run_sizes(self) -> DataFrame:
        """(run, n_texts): how many postings the words with a run have."""
        return self._plain("run_sizes").groupBy("run").agg(F.sum("n_texts").alias("n_texts"))

    def n_texts(self) -> int:
        return self.texts().count()

    def has_repeats(self) -> bool:
        """Has a basket several texts of one field? Looked up once."""
        if self._repeats is None:
            texts = self.texts().groupBy("basket_id", "field").agg(F.count(F.lit(1)).alias("n"))
            self._repeats = not texts.filter("n > 1").isEmpty()
        return self._repeats

    def _bucketed(self, name: str) -> DataFrame:
        return self.spark.table(f"{self._prefix}_{name}").filter(F.col("commit").isin(self.commits)).drop("commit")

    def _plain(self, name: str) -> DataFrame:
        rows = _read(self.spark, self.folder, name)
        return rows.filter(F.col("commit").isin(self.commits)).drop("commit")


def open_index(spark: SparkSession, folder: str) -> WordIndex:
    """The index in a folder, as of its last commit."""
    rows = _read(spark, folder, "commits").orderBy("seq").collect()  # a row for each addition
    if not rows:
        raise FileNotFoundError(f"no index in {folder}")
    index = WordIndex(spark, folder, [r["commit"] for r in rows], rows[0]["buckets"])
    for name in _TABLES:
        spark.catalog.recoverPartitions(f"{index._prefix}_{name}")
    return index


def build_index(baskets: DataFrame, folder: str | None = None, buckets: int | None = None) -> WordIndex:
    """Index baskets (basket_id, title, item_text, tags), in a new folder.

    ``buckets`` is the number of tasks a search of the whole index takes, by default the
    session's shuffle partitions. Without a folder a scratch one is used.
    """
    spark = baskets.sparkSession
    folder = folder or f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return extend_index(WordIndex(spark, folder, [], n), baskets)


def extend_index(index: WordIndex, incoming: DataFrame) -> WordIndex:
    """The index with the words of further baskets; only their texts are read.

    The ids of ``incoming`` must not be in the index yet (``append_baskets`` gives such).
    """
    spark, commit = index.spark, uuid.uuid4().hex
    mark = F.lit(commit).alias("commit")
    rows = incoming.select(F.col("basket_id").cast("bigint").alias("basket_id"), *FIELDS)
    titled = rows.select("basket_id", "title", F.col("item_text").isNotNull().alias("has_text"), mark)
    _insert(index, "titles", titled.repartition(index.buckets, "basket_id"))
    fields = F.posexplode(F.array(*FIELDS)).alias("field", "text")
    texts = spread(rows).select("basket_id", fields).filter(F.col("text").isNotNull())
    folded = texts.select("basket_id", "field", fold("text").alias("folded"), mark)
    # a multiple of the buckets, so that a task still writes one bucket
    n = index.buckets * -(-incoming.count() // (BASKETS_PER_TASK * index.buckets)) or index.buckets
    _insert(index, "texts", folded.repartition(n, "basket_id"))

    added = spark.table(f"{index._prefix}_texts").filter(F.col("commit") == commit).repartition(n, "basket_id")
    postings = added.select(F.explode(words_of("folded")).alias("word"), "basket_id", "field", mark)
    _insert(index, "postings", postings.withColumn("part", part_of("word")))
    counted = spark.table(f"{index._prefix}_postings").filter(F.col("commit") == commit)
    _append(index, "words", counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_texts")), commit)
    listed = _read(spark, index.folder, "words")
    own = spread(listed.filter(F.col("commit") == commit).drop("commit"))
    if index.commits:
        known = listed.filter(F.col("commit").isin(index.commits)).select("word").distinct()
        own = own.join(known.withColumn("fresh", F.lit(False)), "word", "left")
    else:
        own = own.withColumn("fresh", F.lit(True))
    runs = own.select(F.explode(runs_of("word")).alias("run"), "word", "n_texts", F.coalesce("fresh", F.lit(True)).alias("fresh"))
    _append(index, "runs", runs, commit)
    sized = _read(spark, index.folder, "runs").filter(F.col("commit") == commit)
    _append(index, "run_sizes", sized.groupBy("run").agg(F.sum("n_texts").alias("n_texts")), commit)

    seen = spark.range(1).select(F.lit(index.buckets).alias("buckets"), F.lit(len(index.commits)).alias("seq"))
    _append(index, "commits", seen, commit)
    return WordIndex(spark, index.folder, [*index.commits, commit], index.buckets)


def _insert(index: WordIndex, name: str, rows: DataFrame) -> None:
    columns = [c.split()[0] for c in _TABLES[name][0].split(", ")]
    rows.select(*columns).write.insertInto(f"{index._prefix}_{name}")


def _append(index: WordIndex, name: str, rows: DataFrame, commit: str) -> None:
    rows.write.parquet(f"{index.folder}/{name}/commit={commit}")


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    try:
        return spark.read.schema(_PLAIN[name]).parquet(f"{folder}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _PLAIN[name])
