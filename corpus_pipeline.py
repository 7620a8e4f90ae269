"""A training corpus from ``documents``: five stages, each written and read again.

toxicity -> line_dedup -> near_dedup -> decontamination -> bpe. All but the last
return the columns of ``documents``; each works on what the one before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketmatch.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from basketmatch.llm.scratch import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the severity at which the model of the labelled ones rejects."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs; n_chars follows the text. A document whose
    lines all repeat earlier ones goes; one that was empty before stays."""
    out = line_dedup.dedup_lines(docs).where("text is null or text <> '' or size(removed) = 0")
    n_chars = F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; a null doc_id stays."""
    found = near_dedup.near_duplicates(docs)
    out = stored(found.where("not kept").select("doc_id").distinct(), "copies")
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    return bpe.digests(docs, ranks)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]

#: Regression, winnowing by hash and BPE are beyond SQL; a brute-force version in
#: tests/llm stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
