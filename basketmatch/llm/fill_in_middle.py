"""Fill-in-the-middle transformation by secondary sort.

Each text leaves its task as pieces of whole units with their place in the output.
Repartitioned by document and sorted within the partitions (the DataFrame form of
repartitionAndSortWithinPartitions), the pieces of a document stream by in order of
the output, into an incremental digest; sorted again where they are, in the order of
the text, they stream into the digest of the restored text. No task holds more of a
document than one batch of pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketmatch.llm.slices import map_rows

#: The marks before each segment, with the segment's place in the text.
MARKS = {"<P>": 0, "<M>": 1, "<S>": 2}
#: Percent of texts that are transformed, and of these that put the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Units of a piece, and characters of a piece when a unit is very long.
PIECE_UNITS, PIECE_CHARS = 4_096, 16_384
#: Characters that are looked at together.
SPAN = 1 << 20
#: Rows among which repeated ones are told apart.
ROWS = 500

_KEY = "doc_id long, name binary, src int"
_FACTS = "n long, form string, prefix_chars long, middle_chars long"
_PIECES = f"{_KEY}, copies int, {_FACTS}, place int, chunk string"
_PARSED = f"{_KEY}, copies int, {_FACTS}, segment int, place int, chunk string, output_sha256 string"
_DIGESTS = f"doc_id long, {_FACTS}, output_sha256 string, restored_sha256 string"
_OUTPUTS = f"doc_id long, {_FACTS}, output string"
_BY = ["doc_id", "name", "src"]


def numbers(doc_id: int | None) -> list[int]:
    """The four numbers that decide about a document; a null id counts as no digits."""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]


def _starts(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """Per span of the text its offset and the places in it where units begin."""
    before = False
    for at in range(0, len(text), SPAN):
        codes = np.frombuffer(text[at : at + SPAN].encode("utf-32-le"), np.uint32)
        letter = ((codes | np.uint32(32)) - np.uint32(97)) < 26
        inside = letter.copy()
        inside[0] &= before
        inside[1:] &= letter[:-1]
        before = bool(letter[-1])
        yield at, np.flatnonzero(~inside)


def units(text: str) -> int:
    """Number of units: runs of the letters A-Z and a-z, and single other characters."""
    return sum(len(starts) for _, starts in _starts(text))


def offsets(text: str, wanted: list[int]) -> list[int]:
    """Where the units of the rising numbers ``wanted`` begin; the end of the text for those beyond."""
    out, seen, next_one = [], 0, 0
    for at, starts in _starts(text):
        while next_one < len(wanted) and wanted[next_one] < seen + len(starts):
            out.append(at + int(starts[wanted[next_one] - seen]))
            next_one += 1
        seen += len(starts)
    return out + [len(text)] * (len(wanted) - next_one)


def _cut(text: str, bounds: list[int]) -> Iterator[tuple[list[str], int]]:
    """Per range of units, from each bound to the next, its pieces and its characters."""
    firsts = [list(range(a, b, PIECE_UNITS)) for a, b in zip(bounds, bounds[1:])]
    places = iter(offsets(text, [k for some in firsts for k in some]))
    edges = [[next(places) for _ in some] for some in firsts]
    end = len(text)
    out = []
    for some in reversed(edges):
        closed = [*some, end]
        pieces = [text[a + i : min(a + i + PIECE_CHARS, b)] for a, b in zip(closed, closed[1:]) for i in range(0, b - a, PIECE_CHARS)]
        out.append((pieces, end - closed[0]))
        end = closed[0]
    return reversed(out)


def transformed(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, list[str]]:
    """(units, form, characters of prefix and of middle, output in pieces) of one text."""
    n = units(text)
    h1, h2, h3, h4 = numbers(doc_id)
    if not text or h3 % 100 >= TRANSFORMED or any(mark in text for mark in MARKS):
        [(pieces, _)] = _cut(text, [0, n])
        return n, "plain", None, None, pieces or [""]
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (prefix, prefix_chars), (middle, middle_chars), (suffix, _) = _cut(text, [0, low, high, n])
    # A mark begins a piece, so that a segment's beginning is seen in the piece alone.
    marked = {mark: [mark + (part[0] if part else ""), *part[1:]] for mark, part in (("<P>", prefix), ("<M>", middle), ("<S>", suffix))}
    form, order = ("spm", ("<S>", "<P>", "<M>")) if h4 % 100 < SUFFIX_FIRST else ("psm", ("<P>", "<S>", "<M>"))
    return n, form, prefix_chars, middle_chars, [piece for mark in order for piece in marked[mark]]


def _emit(rows: Iterator[tuple]) -> Iterator[tuple]:
    while some := list(islice(rows, ROWS)):
        # Rows that repeat id and text travel once from these.
        times: dict[tuple, int] = {}
        for row in some:
            times[row] = times.get(row, 0) + 1
        for (doc_id, text, src), copies in times.items():
            text = text or ""
            name = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()
            *facts, chunks = transformed(doc_id, text)
            for place, chunk in enumerate(chunks):
                yield doc_id, name, src, copies, *facts, place, chunk


def pieces(docs: DataFrame) -> DataFrame:
    """The outputs in pieces: all of a document in one partition, one after the other.

    Columns: doc_id, name (hash of the text), src (partition the row came from), copies,
    n, form, prefix_chars, middle_chars, place, chunk. The chunks of a document in the
    order of place are its output. Rows that repeat doc_id and text come once from each
    slice of a partition, with their number in copies; a document repeated all over the
    table is dealt out by the partitions that it came from.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("src"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_rows(docs, _emit, _PIECES).repartition(n, *_BY).sortWithinPartitions(*_BY, "place")


def _documents(rows: Iterator[tuple]) -> Iterator[tuple[tuple, Iterator[tuple[int, str]], list[int]]]:
    """Sorted pieces as (key and facts, its (place, chunk) once each, [copies]); to be read in turn."""
    row = next(rows, None)
    while row is not None:
        key, facts, copies = row[:3], row[4:8], [0]

        def chunks() -> Iterator[tuple[int, str]]:
            nonlocal row
            last = -1
            while row is not None and row[:3] == key:
                if row[8] == 0:
                    copies[0] += row[3]
                if row[8] != last:
                    last = row[8]
                    yield row[8:]
                row = next(rows, None)

        yield (*key, *facts), chunks(), copies


def _parse(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Digest outputs as they stream by; mark each piece with the segment that it restores."""
    for (doc_id, name, src, *facts), chunks, copies in _documents(rows):
        digest, segment, plain = hashlib.sha256(), 0, facts[1] == "plain"
        for place, chunk in chunks:
            digest.update(chunk.encode("utf-8", "replace"))
            if not plain and chunk[:3] in MARKS:
                segment, chunk = MARKS[chunk[:3]], chunk[3:]
            yield doc_id, name, src, 0, *facts, segment, place, chunk, None
        yield doc_id, name, src, copies[0], *facts, len(MARKS), 0, None, digest.hexdigest()


def _restore(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Digest the pieces in the order of the text; the row of the output's digest ends a document."""
    text = hashlib.sha256()
    for doc_id, _, _, copies, *facts, _, _, chunk, output in rows:
        if output is None:
            text.update(chunk.encode("utf-8", "replace"))
            continue
        for _ in range(copies):
            yield doc_id, *facts, output, text.hexdigest()
        text = hashlib.sha256()


def _join(rows: Iterator[tuple]) -> Iterator[tuple]:
    for (doc_id, _, _, *facts), chunks, copies in _documents(rows):
        output = "".join(chunk for _, chunk in chunks)
        for _ in range(copies[0]):
            yield doc_id, *facts, output


def digests(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): how its text is cut, its output's digest, and
    that of the text rebuilt from output and form.

    Columns: doc_id, n, form (plain, psm, spm), prefix_chars and middle_chars (null if
    plain), output_sha256, restored_sha256. Null is an empty text; a null doc_id counts
    as no digits in the hash; rows that repeat come as often as they are; extra columns
    are ignored. One shuffle of the texts in pieces.
    """
    parsed = map_rows(pieces(docs), _parse, _PARSED).sortWithinPartitions(*_BY, "segment", "place")
    return map_rows(parsed, _restore, _DIGESTS)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """The same rows with the output itself: doc_id, n, form, prefix_chars, middle_chars, output."""
    return map_rows(pieces(docs), _join, _OUTPUTS)


def restored(output: str, form: str) -> str:
    """The text of an output: for one row; ``digests`` does it for tables."""
    if form == "plain":
        return output
    second, third = ("<S>", "<M>") if form == "psm" else ("<P>", "<M>")
    first, rest = output[3:].split(second, 1)
    other, middle = rest.split(third, 1)
    return first + middle + other if form == "psm" else other + middle + first
