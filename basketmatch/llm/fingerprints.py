"""Document fingerprints: a multiset hash of paragraphs that adds and subtracts."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmatch.llm.slices import map_slices
from basketmatch.llm.wordhash import mix

#: A paragraph's vector: 16 lanes modulo 2**64 that decide equality, filled from
#: its digest, and 128 lanes modulo 2**32 for likeness, to which each window of 16
#: bytes adds 1 or -1 in one lane. They are exact for texts of up to 2**31 bytes.
LANES, LIKE_LANES, WINDOW = 16, 128, 16
#: Bytes whose windows are hashed at once.
PIECE = 1 << 18
#: Ranges of ids for each shuffle partition.
RANGES = 4


def _windows(raw: bytes) -> np.ndarray:
    """Hashes of all windows of WINDOW bytes; of a shorter text, one hash of it padded."""
    if len(raw) < WINDOW:
        raw = raw.ljust(WINDOW, b"\0")
    h = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    factor, step = 0x9E3779B97F4A7C15, 1
    while step < WINDOW:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor, step = factor * factor % (1 << 64), step * 2
    return mix(h)


def _signed(h: np.ndarray) -> np.ndarray:
    """Lanes of hashed windows: each adds 1 or takes 1 from one lane."""
    lane, up = (h >> np.uint64(57)).astype(np.int64), (h & np.uint64(1)).astype(bool)
    return np.bincount(lane[up], minlength=LIKE_LANES) - np.bincount(lane[~up], minlength=LIKE_LANES)


def vectors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the lanes of a text's paragraphs. No window spans two of them."""
    raw = text.encode("utf-8", "replace")
    paragraphs = [p for p in raw.split(b"\n") if p]
    digests = [hashlib.blake2b(p).digest() + hashlib.blake2b(p, person=b"second").digest() for p in paragraphs]
    lanes = np.frombuffer(b"".join(digests), "<u8").reshape(-1, LANES).sum(0, dtype=np.uint64)
    like = np.zeros(LIKE_LANES, np.int64)
    for p in paragraphs:
        if len(p) < WINDOW:
            like += _signed(_windows(p))
    for at in range(0, len(raw) - WINDOW + 1, PIECE):
        piece = raw[at : at + PIECE + WINDOW - 1]
        breaks = np.concatenate([[0], np.cumsum(np.frombuffer(piece, np.uint8) == 10)])
        like += _signed(_windows(piece)[breaks[WINDOW:] == breaks[:-WINDOW]])
    return lanes, like.astype(np.uint32)


class Fingerprint:
    """The sum of the vectors of a text's paragraphs, whatever their order."""

    def __init__(self, text: str | None = None) -> None:
        self.lanes, self.like = vectors(text or "")

    def insert(self, paragraph: str) -> None:
        lanes, like = vectors(paragraph)
        self.lanes, self.like = self.lanes + lanes, self.like + like

    def delete(self, paragraph: str) -> None:
        lanes, like = vectors(paragraph)
        self.lanes, self.like = self.lanes - lanes, self.like - like

    def __str__(self) -> str:
        return base64.b64encode(self.lanes.astype("<u8").tobytes() + self.like.astype("<u4").tobytes()).decode()

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal multisets; else the cosine of the likeness lanes, which estimates
        that of the texts' windows to about 0.09, from 0 and under 1. It is 0 where the
        lanes of one of them cancel out, as those of an empty text do."""
        if (self.lanes == other.lanes).all():
            return 1.0
        a, b = self.like.view(np.int32).astype(float), other.like.view(np.int32).astype(float)
        norm = np.sqrt(a @ a) * np.sqrt(b @ b)
        return float(min(max(a @ b / norm, 0.0), 0.999)) if norm else 0.0


def parse(text: str) -> Fingerprint:
    """The fingerprint that a string stands for."""
    raw = base64.b64decode(text)
    out = Fingerprint()
    out.lanes = np.frombuffer(raw[: 8 * LANES], "<u8").astype(np.uint64)
    out.like = np.frombuffer(raw[8 * LANES :], "<u4").astype(np.uint32)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint. Null is an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": [str(Fingerprint(t)) for t in batch["text"]]})

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, fingerprint string")


def _bounds(docs: DataFrame) -> np.ndarray:
    """Ids that cut the documents into ranges of about the same number."""
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 10 * n).alias("at")).first()["at"]
    return np.unique(np.array(found or [], np.int64))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, doc_id, text, ahead): ``docs`` in ranges of ids, and after each range a
    copy of the row that follows it in descending order (``ahead`` true).

    Ranges come from quantiles of the ids. A null id comes last. One shuffle of the
    texts; the copies are one document for each range.
    """
    edges = _bounds(docs)

    @F.pandas_udf("int")
    def part(doc_id: pd.Series) -> pd.Series:
        # Descending: larger ids lie in earlier parts; null lies in the last.
        place = len(edges) - np.searchsorted(edges, doc_id.fillna(np.iinfo(np.int64).min).astype(np.int64), side="left")
        return pd.Series(np.where(doc_id.isna(), len(edges) + 1, place).astype(np.int32))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The largest id of each part: as many rows as there are parts.
    tops = docs.select("doc_id").withColumn("part", part("doc_id")).groupBy("part").agg(F.max("doc_id").alias("top")).collect()
    tops = sorted((r["part"], r["top"]) for r in tops)
    before = [(tops[i][1], tops[i - 1][0], i) for i in range(len(tops))]  # the first follows the last part
    lead = docs.sparkSession.createDataFrame(before or [(None, None, None)], "top long, ahead_of int, n int")
    rows = docs.withColumn("part", part("doc_id"))
    rows = rows.join(F.broadcast(lead), rows["doc_id"].eqNullSafe(lead["top"]) & F.col("ahead_of").isNotNull(), "left")
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead"))
    copy = F.struct(F.col("ahead_of").alias("part"), F.lit(True).alias("ahead"))
    spots = F.when(F.col("ahead_of").isNull(), F.array(here)).otherwise(F.array(here, copy))
    rows = rows.select("doc_id", "text", F.explode(spots).alias("spot")).select("spot.part", "doc_id", "text", "spot.ahead")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "part").sortWithinPartitions("part", "ahead", F.desc("doc_id"), "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The next document follows in descending doc_id (rows that
    repeat an id: by text, null first); after the last comes the first. A single
    document follows itself. Null is an empty text; extra columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, closed = None, None
        for batch in batches:
            out = []
            for part, doc_id, text, ahead in zip(batch["part"], batch["doc_id"], batch["text"], batch["ahead"]):
                text = text or ""
                if part == closed:  # further rows with the id of the one that closed the part
                    continue
                mine = Fingerprint(text)
                if held is not None:
                    out.append(_edit(*held, text, mine))
                held = (doc_id, text, mine)
                if ahead:
                    held, closed = None, part
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_slices(with_next(docs), run, schema)


def _edit(doc_id: float, text: str, mine: Fingerprint, following: str, next_one: Fingerprint) -> tuple:
    changed = edited(text, following)
    other = Fingerprint(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
    return (None if pd.isna(doc_id) else int(doc_id), len(text), sha, str(mine), str(other), mine.likeness(other), mine.likeness(next_one))
