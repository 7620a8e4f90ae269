"""Benchmark items inside documents: size-partitioned MinHash containment, then exact containment.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketmatch.llm.scratch import stored

SHINGLE_WORDS = 5
#: Least share, in hundredths, of an item's shingles that a document has.
PERCENT = 75
#: By class of item size (from so many shingles on): MinHash samples of an item, and
#: how many a document must have to be looked at. Up to 32 shingles the sample is
#: the whole set. Beyond, a document with 75 % of an item's shingles has under 22 of
#: 48 samples, or under 34 of 64, with a probability of some 1e-5 or less.
SIZE_CLASSES = ((1, 32, None), (33, 48, 22), (256, 64, 34))
#: An item table of up to so many rows (some 40 bytes each) is sent to all tasks.
MOST_SENT = 400_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(w: Column, lengths: Sequence[int] = (SHINGLE_WORDS,)) -> Column:
    """Hashes of all runs of so many words, for each of the lengths."""

    def runs(k: int) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - k)
        if k == SHINGLE_WORDS:
            hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
        else:
            hashes = F.transform(at, lambda i: F.xxhash64(F.lit(k), F.slice(w, i + 1, k)))
        return F.when(F.size(w) >= k, hashes).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*(runs(k) for k in lengths))


def _item_shingles(items: DataFrame) -> DataFrame:
    """Those of five words; an item of one to four words has one, of all its words."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    few = F.array(F.xxhash64(F.size("w"), F.col("w")))
    hashes = F.when(F.size("w") >= SHINGLE_WORDS, shingle_hashes(F.col("w"))).otherwise(few)
    return w.select("item_id", F.least(F.size("w"), F.lit(SHINGLE_WORDS)).alias("k"), F.explode(hashes).alias("h"))


def _doc_shingles(docs: DataFrame, lengths: Sequence[int]) -> DataFrame:
    w = docs.select("doc_id", words(F.col("text")).alias("w"))
    return w.select("doc_id", F.explode(shingle_hashes(F.col("w"), lengths)).alias("h"))


def item_sketches(items: DataFrame) -> DataFrame:
    """(item_id, k, h, n, need, sampled): an item's distinct shingles, and which are its MinHash samples.

    k is the number of words of a shingle."""
    shingles = _item_shingles(items.where("item_id is not null"))
    sets = shingles.groupBy("item_id").agg(F.array_sort(F.collect_set(F.struct("h", "k"))).alias("hs"))
    n = F.size("hs")
    least = F.ceil(n * PERCENT / 100).cast("int")
    size, need = F.lit(None).cast("int"), least
    for start, samples, hits in SIZE_CLASSES:
        size = F.when(n >= start, samples).otherwise(size)
        need = need if hits is None else F.when(n >= start, hits).otherwise(need)
    # The shingles are sorted by hash, so the first ones are the smallest.
    rows = sets.select("item_id", n.alias("n"), least.alias("least"), need.alias("need"), size.alias("size"), F.posexplode("hs").alias("rank", "s"))
    return rows.select("item_id", "s.k", "s.h", "n", "least", "need", (F.col("rank") < F.col("size")).alias("sampled"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, n_shingles, n_found, containment.

    ``docs`` needs doc_id and text, ``items`` item_id and text; further columns are
    ignored. A document holds an item if it has at least 75 % of the item's distinct
    shingles of five words. Items are put in classes by size; the class gives how
    many smallest hashes (MinHash samples) stand for an item and how many of them a
    document needs to become a candidate. Candidates are then counted on all shingles.

    Words are lower-case runs of letters and digits. An item of one to four words is
    found wherever these words follow each other. Null or empty texts, and texts without
    words, hold nothing and are found nowhere. Rows that repeat a doc_id or item_id
    are read as one text's shingles; rows with a null id are left out.
    """
    items = stored(item_sketches(items), "items")
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    samples = items.where("sampled").select("item_id", "h", "need")
    sent = _sent(samples)
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # up to five
    hits = _doc_shingles(docs, lengths or [SHINGLE_WORDS]).join(sent, "h").distinct()
    hits = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"), F.first("need").alias("need"))
    near = stored(hits.where("hits >= need").select("doc_id", "item_id"), "candidates")

    texts = docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi")
    exact = _doc_shingles(texts, lengths or [SHINGLE_WORDS]).join(_sent(items), "h")
    exact = exact.join(near, ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", "h", "n", "least").distinct()
    found = exact.groupBy("doc_id", "item_id").agg(
        F.first("n").alias("n_shingles"), F.count("*").alias("n_found"), F.first("least").alias("least")
    )
    return found.where("n_found >= least").select(
        "doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment")
    )


def _sent(rows: DataFrame) -> DataFrame:
    """A stored table, broadcast if it has few enough rows."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item. A null doc_id stays."""
    bad = stored(contaminated(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
