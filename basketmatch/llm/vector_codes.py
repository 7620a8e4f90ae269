"""Vectors as short codes: each part of a vector is named by its nearest codebook entry.

The nearest entry is found by memoised grid cells. A part falls in a coarse cell of
its position's grid; an entry whose least distance to the cell's box is above the
greatest distance of another one is nearest to no point of it. What is left of the
codebook is worked out once a cell and kept, and only those entries are evaluated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from basketmatch.llm.scratch import stored
from basketmatch.operators.skew import join_lookup

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component x becomes floor(SCALE * x), held to LARGEST either way so that sums of
#: squares fit 64 bits.
SCALE, LARGEST = 256, 1 << 27
#: About so many cells cover a position's codebook, two a dimension at least.
CELLS = 4_096
#: Cells that a task remembers for a position; beyond that it starts afresh.
REMEMBERED = 8_192
#: Vectors that are worked on together.
ROWS = 1_000


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of each point to the entry in the same row."""
    apart = points - entries
    return np.einsum("ij,ij->i", apart, apart)


class Grid:
    """One position's codebook behind its grid of remembered cells."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.low = entries.min(axis=0)
        a_side = max(2, int(CELLS ** (1 / entries.shape[1])))
        self.width = np.maximum(1, -(-(entries.max(axis=0) - self.low + 1) // a_side))
        self._forget()

    def _forget(self) -> None:
        self.row: dict[bytes, int] = {}
        self.left = np.zeros((0, len(self.entries)), bool)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """For each cell which entries can be nearest to a point of its box."""
        low = (self.low + cells * self.width)[:, None, :]
        high = low + (self.width - 1)
        entries = self.entries[None]
        outside = np.maximum(np.maximum(low - entries, entries - high), 0)
        across = np.maximum(np.abs(entries - low), np.abs(entries - high))
        least, greatest = (outside**2).sum(axis=2), (across**2).sum(axis=2)
        return least <= greatest.min(axis=1, keepdims=True)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """For each point the entries left in its cell."""
        cells, which = np.unique((points - self.low) // self.width, axis=0, return_inverse=True)
        keys = [cell.tobytes() for cell in cells]
        if len(self.row) + len(keys) > max(REMEMBERED, len(keys)):
            self._forget()
        fresh = [i for i, key in enumerate(keys) if key not in self.row]
        if fresh:
            for i in fresh:
                self.row[keys[i]] = len(self.row)
            self.left = np.concatenate([self.left, self.undominated(cells[fresh])])
        rows = np.array([self.row[key] for key in keys])
        return self.left[rows][which.ravel()]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point its nearest entry (of equals the lowest) and squared distance."""
        point, entry = np.nonzero(self.candidates(points))
        apart = distances(points[point], self.entries[entry])
        starts = np.searchsorted(point, np.arange(len(points)))
        least = np.minimum.reduceat(apart, starts)
        reached = np.flatnonzero(apart == least[point])
        first = reached[np.searchsorted(point[reached], np.arange(len(points)))]
        return entry[first], least


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows with their parts: (row, position, component)."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            flat = rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield rows, flat.reshape(rows.num_rows, PARTS, -1)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): vectors without null or non-finite components, as whole numbers.

    Only those of the length of the first one, by vec_id, that can be cut into PARTS.
    """
    vector = F.col("embedding")
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rounded = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    kept = vectors.where(vector.isNotNull()).where((F.size(vector) > 0) & (F.size(vector) % PARTS == 0)).where(sound)
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), rounded.alias("v"))
    kept = stored(kept, "vectors")
    first = _in_order(kept).select(F.size("v").alias("n")).first()
    return kept.where(F.size("v") == (first["n"] if first else 0))


def _in_order(kept: DataFrame) -> DataFrame:
    return kept.orderBy(F.asc_nulls_last("vec_id"), "v")


def first_codebooks(kept: DataFrame) -> np.ndarray:
    """(position, entry, component): the parts of the vectors with the ENTRIES smallest ids."""
    rows = _in_order(kept).select("v").limit(ENTRIES).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), PARTS, -1).transpose(1, 0, 2)


def next_codebooks(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floored mean of the parts nearest to it; unused ones stay.

    A task adds up what it has read and sends a row for each entry and component; these
    are summed by Spark, and as many rows as the codebooks have numbers come back.
    """
    schema = "position int, entry int, component int, total long, n long"
    types = to_arrow_schema(StructType.fromDDL(schema))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(book) for book in books]
        total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, parts in _vectors(batches):
            for position, grid in enumerate(grids):
                entry, _ = grid.nearest(parts[:, position])
                np.add.at(total[position], entry, parts[:, position])
                n[position] += np.bincount(entry, minlength=books.shape[1])
        position, entry = np.nonzero(n)
        for at in range(0, len(position), ROWS):
            p, e = position[at : at + ROWS], entry[at : at + ROWS]
            d = books.shape[2]
            columns = [np.repeat(p, d), np.repeat(e, d), np.tile(np.arange(d), len(p)), total[p, e].ravel(), np.repeat(n[p, e], d)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types)], schema=types)

    sums = kept.mapInArrow(add, schema).groupBy("position", "entry", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.collect():
        out[r["position"], r["entry"], r["component"]] = r["total"] // r["n"]
    return out


def coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): the entry of each part in hex, the squared distances summed."""
    schema = "vec_id long, label long, code string, error long"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(book) for book in books]
        for rows, parts in _vectors(batches):
            found = [grid.nearest(parts[:, position]) for position, grid in enumerate(grids)]
            codes = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            error = sum(apart for _, apart in found)
            arrays = [rows.column("vec_id"), rows.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(assign, schema)


def train(kept: DataFrame) -> np.ndarray:
    """The codebooks after ROUNDS rounds over all vectors; ``kept`` has one at least."""
    books = first_codebooks(kept)
    for _ in range(ROUNDS):
        books = next_codebooks(kept, books)
    return books


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The whole numbers that a code stands for."""
    return np.concatenate([books[position, entry] for position, entry in enumerate(bytes.fromhex(code))])


def vector_codes(vectors: DataFrame) -> DataFrame:
    """One row for each usable row of ``vectors`` (vec_id, embedding, label).

    Columns: vec_id, code (hex of the entry of each of the 16 parts), error (squared
    distances summed over the parts), label_error (error summed over equal labels, nulls
    together; null beyond 64 bits), codebooks_sha256 (of all numbers of the codebooks, by
    part, entry and component, joined by commas).

    Left out are rows whose vector is null or empty, holds null or non-finite components,
    has no multiple of 16 components or another number of them than the row with the
    smallest vec_id. Rows that repeat a vec_id are rows of their own, in the order of
    their vectors; a null vec_id comes last. With fewer than 64 rows the codebooks have as
    many entries. Components beyond 2**27 / 256 count as that. Extra columns are ignored.
    An empty table gives no rows. What the driver holds are the codebooks: 64 numbers for
    each component of one vector.
    """
    kept = whole_numbers(vectors)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if kept.isEmpty():
        return kept.sparkSession.createDataFrame([], schema)
    books = train(kept)
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = stored(coded(kept, books), "codes")
    rows = rows.withColumns({"bare": F.col("label").isNull(), "label": F.coalesce("label", F.lit(0))})
    sums = stored(rows.groupBy("bare", "label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    found = join_lookup(rows, sums, ["bare", "label"], ["vec_id", "code"])
    return found.select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
