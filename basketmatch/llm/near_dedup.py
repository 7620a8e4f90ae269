"""Near duplicates by MinHash, banded candidates and odd sketches, confirmed on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketmatch.llm.components import components
from basketmatch.llm.scratch import stored
from basketmatch.llm.slices import map_slices
from basketmatch.llm.wordhash import SPACED, mix, shingles, word_hashes

#: Words in a shingle and least similarity, in hundredths, of a link.
SHINGLE_WORDS = 5
PERCENT = 75
#: A pair at the least similarity shares a band of 5 samples with probability
#: 1 - (1 - 0.75 ** 5) ** 40 = 0.99998; at 0.8 it is 0.9999999.
BANDS, BAND_SAMPLES = 40, 5
SAMPLES = BANDS * BAND_SAMPLES
#: Bits of an odd sketch, as so many longs.
WORDS64 = 16
BITS = 64 * WORDS64
#: Pairs whose estimate is under PERCENT by more than this many hundredths are not
#: confirmed. It is over five standard deviations of the estimate at PERCENT.
MARGIN = 20

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_TERMS = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_SEEDS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))
_SKETCH = [f"s{i}" for i in range(WORDS64)]
_PARITY = [f"p{i}" for i in range(WORDS64)]


def most_differing_bits(percent: float) -> int:
    """Expected ones in the XOR of two odd sketches at a similarity of ``percent``.

    Each of the SAMPLES (1 - J) samples that differ flips one bit in either sketch.
    """
    flips = 2 * SAMPLES * (1 - percent / 100)
    return math.ceil(BITS * (1 - math.exp(-2 * flips / BITS)) / 2)


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set of hashes its SAMPLES minima, one row a set."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), SAMPLES), np.uint32)
    for i in range(SAMPLES):
        out[:, i] = np.minimum.reduceat(x * _FACTORS[i] + _TERMS[i], starts)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: every (number, minimum) flips the bit that it hashes to."""
    bit = mix(samples.astype(np.uint64) ^ _SEEDS) % np.uint64(BITS)
    return _parities(np.repeat(np.arange(len(samples)), SAMPLES), bit.ravel(), len(samples))


def set_parities(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps of whole sets: every member flips the bit that its hash names."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return _parities(row, np.concatenate(sets) % np.uint64(BITS), len(sets))


def _parities(row: np.ndarray, bit: np.ndarray, n: int) -> np.ndarray:
    flips = np.bincount(row.astype(np.int64) * BITS + bit.astype(np.int64), minlength=n * BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, BITS), axis=1).view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One hash for the samples of each band, different from band to band."""
    parts = samples.reshape(len(samples), BANDS, BAND_SAMPLES).astype(np.uint64)
    key = np.broadcast_to(_SEEDS[:BANDS], parts.shape[:2])
    for j in range(BAND_SAMPLES):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def _sets(batch: pd.DataFrame) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, words, at in word_hashes(batch["text"].tolist(), SPACED):
        yield first, [shingles(words[s:e], SHINGLE_WORDS) for s, e in zip(at[:-1], at[1:])]


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first, sets in _sets(batch):
            ids = batch["doc_id"].iloc[first : first + len(sets)].to_numpy()
            full = [i for i, s in enumerate(sets) if len(s)]
            out = pd.DataFrame({"doc_id": ids, "n_shingles": [len(s) for s in sets]})
            # Sum and XOR-like sum of remixed members: 128 bits that stand for the set.
            out["set_a"] = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
            out["set_b"] = [int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            bands, sketch = [None] * len(sets), np.zeros((len(sets), WORDS64), np.int64)
            parity = sketch.copy()
            if full:
                samples = min_hashes([sets[i] for i in full])
                sketch[full] = odd_sketches(samples)
                parity[full] = set_parities([sets[i] for i in full])
                for i, keys in zip(full, band_keys(samples)):
                    bands[i] = keys
            out["bands"] = bands
            for j in range(WORDS64):
                out[_SKETCH[j]], out[_PARITY[j]] = sketch[:, j], parity[:, j]
            yield out


_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(f"{s} long" for s in _SKETCH + _PARITY)


def signatures(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): size and 128-bit name of its shingle set, band keys, odd sketch."""
    return map_slices(docs.select("doc_id", "text"), _sign, _SIGNED)


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for first, sets in _sets(batch):
            ids = batch["doc_id"].iloc[first : first + len(sets)].to_numpy()
            yield pd.DataFrame({"id": ids, "members": [s.view(np.int64) for s in sets]})


def _near(left: str, right: str) -> Column:
    """Sizes that allow a link, and sketches that differ in few enough bits.

    Members of one set alone are d at least where the parities of the whole sets
    differ in d bits, which rules a link out for certain when
    100 (a + b - d) < PERCENT (a + b + d).
    """
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")

    def ones(names: list[str]) -> Column:
        return sum(F.bit_count(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))) for s in names)

    sizes = 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)
    apart = (100 + PERCENT) * ones(_PARITY) <= (100 - PERCENT) * (a + b)
    return sizes & (ones(_SKETCH) <= most_differing_bits(PERCENT - MARGIN)) & apart


def _confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    sets = stored(map_slices(texts, _list, "id long, members array<long>"), "sets")
    # A document that comes in several rows has a set for each; any may make the link.
    sides = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("of_b")), "b")
    sides = sides.join(sets.select(F.col("id").alias("a"), F.col("members").alias("of_a")), "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    both = F.size("of_a") + F.size("of_b") - common
    return sides.where(100 * common >= PERCENT * both).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``docs`` needs a long doc_id and a string text; further columns are ignored.
    Equal shingle sets are one class and go on as its smallest doc_id, so that a
    group of copies costs one minimum. Each class is first paired with the smallest
    class of all its band buckets, which links most of a group at one pair a class.
    In buckets that still hold several components, classes are paired with the
    bucket's smallest one, and at last the classes outside the bucket's largest
    component with all classes of other components. Sketches sift the pairs and full
    sets confirm them. So every candidate pair is linked, confirmed or rejected,
    without pairs inside what is already linked.

    Null and empty texts and texts without words have no shingles and are linked
    with nothing. Rows that repeat a doc_id are one document to its links. A null
    doc_id is linked with nothing, has a null component_id and is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(signatures(docs), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    names = ["n_shingles", "set_a", "set_b"]
    classes = stored(full.groupBy(*names).agg(F.min("doc_id").alias("first")), "classes")
    member = stored(full.select("doc_id", *names).join(classes, names).select("doc_id", "first").distinct(), "members")
    of = member.groupBy("doc_id").agg(F.min("first").alias("first"), F.max("first").alias("last"))
    # A document that comes with several sets ties their classes together.
    tied = member.select("doc_id", F.col("first").alias("b")).join(of.where("first <> last"), "doc_id")
    tied = tied.select(F.col("first").alias("a"), "b").where("a <> b")

    heads = full.join(classes.withColumnRenamed("first", "doc_id"), [*names, "doc_id"], "left_semi")
    heads = stored(heads.withColumnRenamed("doc_id", "id"), "heads")
    rows = heads.select(F.explode("bands").alias("key"), "id")
    hubs = rows.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stored(rows.join(hubs, "key"), "shared")
    sketch = heads.select("id", "n_shingles", *_SKETCH, *_PARITY)

    nearest = shared.groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a")).where("a <> b")
    links = stored(_confirmed(docs, _sifted(nearest, sketch)).union(tied), "nearest")
    label = components(links)
    unsettled = _open(shared.select("key", "id"), label)
    for further in (_to_hubs, _across):
        found = stored(further(unsettled, sketch), "further")
        if not found.isEmpty():
            links = links.union(stored(_confirmed(docs, found), "confirmed"))
            label = components(links)
            unsettled = _open(unsettled.select("key", "id"), label)

    ids = signed.select("doc_id", "n_shingles").join(of.select("doc_id", "first"), "doc_id", "left")
    found = ids.join(label, ids["first"] == label["node"], "left")
    smallest = F.coalesce("component", "first", "doc_id")
    return found.select(
        "doc_id", "n_shingles", smallest.alias("component_id"), F.coalesce(smallest == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def _sifted(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches are near."""
    met = pairs.join(sketch.alias("y"), F.expr("b = y.id")).join(sketch.alias("x"), F.expr("a = x.id"))
    return met.where(_near("x", "y")).select("a", "b")


def _open(rows: DataFrame, label: DataFrame) -> DataFrame:
    """(key, id, part): the rows (key, id) of buckets that hold several components."""
    rows = rows.join(label, rows["id"] == label["node"], "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    keys = rows.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    return stored(rows.join(keys, "key", "left_semi"), "open")


def _to_hubs(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """Near pairs of a bucket's smallest class and those of its other components."""
    hubs = rows.groupBy("key").agg(F.min(F.struct("id", "part")).alias("hub"))
    apart = rows.join(hubs, "key").where("hub.part <> part").select(F.col("hub.id").alias("a"), F.col("id").alias("b"))
    return _sifted(apart.distinct(), sketch)


def _across(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs of a bucket that lie in different components and whose sketches are near.

    The left side leaves out the bucket's largest component, so that pairs grow with
    what is still apart and not with the square of the bucket.
    """
    sizes = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "part")).alias("top")).select("key", F.col("top.part").alias("main"))
    rest = rows.join(largest, "key").where("part <> main").drop("main")
    x = rest.join(sketch, "id").alias("x")
    y = rows.join(largest, "key").join(sketch, "id").alias("y")
    # Two rows of the left side meet once; a row of the main component meets all.
    once = (F.col("y.part") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") != F.col("y.part"))
    met = x.join(y, apart & once & _near("x", "y"))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
