"""Repeated passages by relative Lempel-Ziv parsing: documents as factors of earlier text.

The reference that documents are parsed against is the corpus itself, indexed by
content. Every window of WINDOW words names an anchor, the run of ANCHOR words in it
with the smallest hash; equal windows name the same one. The windows of one anchor
make a phrase, and phrases that follow each other cover a text. The index is dealt out
by anchor, so each of its blocks holds all phrases that could match, and a phrase meets
the earliest equal one there. Read left to right, matched phrases that go on in the
same place of the same source become one factor, as long as it reaches.

Where a factor ends, a phrase differs from others of its anchor in part, but some of
its windows may still occur earlier: only there are single windows looked up. So
exactly the windows that occur earlier are found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from basketmatch.llm.scratch import stored
from basketmatch.llm.slices import map_rows
from basketmatch.llm.wordhash import byte_table, mix, pieces_of, rolling, word_hashes

#: Words of a window, and of an anchor; a window holds SPREAD places for its anchor.
WINDOW, ANCHOR = 20, 8
SPREAD = WINDOW - ANCHOR + 1
#: Phrases that are looked through for repeats together, before they travel.
TOGETHER = 200_000
#: Texts that are worked on together, and words of a text.
ROWS, LONG = 500, 1 << 18

#: Words run between the six ASCII white-space bytes.
CASED = byte_table(bytes(b for b in range(256) if b not in b"\t\n\x0b\x0c\r "), lower=False)

_KEY = ["doc_id", "th"]
_PLACE = ["doc_id", "th", "first", "last"]
_ASK = "deal long, a long, c long, doc_id long, th long, first long, last long, known boolean, src_doc long, src_th long, src_first long"
_FOUND = "doc_id long, th long, first long, last long, known boolean, src_doc long, src_th long, src_first long"
_FACTORS = "doc_id long, th long, first long, n_words long, src_doc long, src_th long, src_first long"


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): rows that agree in doc_id and the hash of the text are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def phrases(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The phrases of texts whose word hashes stand one after the other.

    ``ends`` has where each text ends. Returns anchors, contents, text numbers, and the
    first and last window of each phrase, counted from its text's beginning.
    """
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return none, none, none, none, none
    anchors = rolling(words, ANCHOR)
    places = np.lib.stride_tricks.sliding_window_view(anchors, SPREAD)[:, ::-1]
    chosen = np.arange(len(places)) + SPREAD - 1 - places.argmin(axis=1)
    text = np.searchsorted(ends, np.arange(len(places)), side="right")
    starts = np.concatenate([[0], ends])[text]
    inside = np.flatnonzero(np.arange(len(places)) + WINDOW <= ends[text])
    if not len(inside):
        return none, none, none, none, none
    chosen, text = chosen[inside], text[inside]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
    first = inside[new]
    last = inside[np.concatenate([new[1:], [True]])]
    chosen, text = chosen[new], text[new]
    windows = rolling(words, WINDOW)
    # First and last window overlap, so the two hashes stand for all words of the phrase.
    shape = ((chosen - first) * SPREAD + (last - first)).astype(np.uint64)
    content = mix(mix(windows[first] + shape) ^ (windows[last] * np.uint64(3)))
    start = starts[first]
    return anchors[chosen].view(np.int64), content.view(np.int64), text, first - start, last - start


def _ask(kind: str) -> Callable:
    """Texts to the index questions about their phrases, or about single windows of ``heads``."""
    types = to_arrow_schema(StructType.fromDDL(_ASK))

    def of_phrases(words: np.ndarray, at: np.ndarray, heads: list | None) -> tuple[np.ndarray, ...]:
        if len(at) > 2 or len(words) <= LONG:
            return phrases(words, at[1:])
        # A long text in stretches of windows; a phrase that is cut here may match in part.
        found = []
        for s in range(0, len(words), LONG):
            some = words[s : s + LONG + WINDOW - 1]
            a, c, text, first, last = phrases(some, np.array([len(some)]))
            found.append((a, c, text, first + s, last + s))
        return tuple(np.concatenate(x) for x in zip(*found))

    def of_windows(words: np.ndarray, at: np.ndarray, heads: list) -> tuple[np.ndarray, ...]:
        wanted = [np.concatenate([np.arange(h["first"], h["last"] + 1) for h in some]) for some in heads]
        place = np.concatenate(wanted)
        text = np.repeat(np.arange(len(heads)), [len(w) for w in wanted])
        spots = place + at[text]
        one, other = rolling(words, WINDOW), rolling(mix(words ^ np.uint64(0x5BD1E995)), WINDOW)
        return one[spots].view(np.int64), other[spots].view(np.int64), text, place, place

    questions = of_phrases if kind == "phrases" else of_windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                ids, null = _numbers(rows.column("doc_id"))
                th = rows.column("th").to_numpy()
                heads = rows.column("heads").to_pylist() if kind == "windows" else None
                for number, words, at in word_hashes(rows.column("text").to_pylist(), CASED):
                    a, c, text, first, last = questions(words, at, heads[number : number + len(at) - 1] if heads else None)
                    text = text + number
                    held.append((a, c, null[text], ids[text], th[text], first, last))
                    n += len(a)
                    if n >= TOGETHER:
                        yield _sifted(held, types)
                        held, n = [], 0
        if n:
            yield _sifted(held, types)

    return run


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and which are missing; a missing id comes before all others."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(), null


def _sifted(held: list[tuple[np.ndarray, ...]], types: pa.Schema) -> pa.RecordBatch:
    """Questions in order; of equal ones only the earliest has to travel to its key, the
    others have their source here. A place that comes twice counts once."""
    a, c, null, doc, th, first, last = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((first, th, doc, ~null, c, a))
    a, c, null, doc, th, first, last = (x[order] for x in (a, c, null, doc, th, first, last))
    head = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    again = np.concatenate([[False], ~head[1:] & (doc[1:] == doc[:-1]) & (null[1:] == null[:-1]) & (th[1:] == th[:-1]) & (first[1:] == first[:-1])])
    known, source = ~head, np.flatnonzero(head)[np.cumsum(head) - 1]
    # What is known goes anywhere: with its document, spread evenly.
    deal = np.where(known, mix(th.view(np.uint64) + first.view(np.uint64)).view(np.int64), a)
    out = [deal, a, c, _ids(doc, null), th, first, last, known, _ids(doc[source], null[source] | head), pa.array(th[source], mask=head), pa.array(first[source], mask=head)]
    keep = pa.array(~again)
    return pa.RecordBatch.from_arrays([pa.array(x, t).filter(keep) if isinstance(x, np.ndarray) else x.filter(keep) for x, t in zip(out, types.types)], schema=types)


def _ids(doc: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(doc, pa.int64(), mask=null)


def _looked_up(asked: DataFrame) -> DataFrame:
    """Places with their earliest source (known), and the earliest place of each content
    whose anchor has other contents too.

    The questions of an anchor stream by in order of content and place: a secondary sort,
    of which a task holds one batch.
    """
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = to_arrow_schema(StructType.fromDDL(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # the last head so far, and whether it has gone out
        for batch in batches:
            if not batch.num_rows:
                continue
            a, c, th, first, last = (batch.column(x).to_numpy() for x in ("a", "c", "th", "first", "last"))
            known = batch.column("known").to_numpy(zero_copy_only=False)
            doc, null = _numbers(batch.column("doc_id"))
            src, src_null = _numbers(batch.column("src_doc"))
            src_th, src_first = (batch.column(x).fill_null(0).to_numpy() for x in ("src_th", "src_first"))
            out = [(doc[known], null[known], th[known], first[known], last[known], src[known], src_null[known], src_th[known], src_first[known])]
            flags = [np.ones(int(known.sum()), bool)]
            if not known.all():
                rows = tuple(x[~known] for x in (a, c, doc, null, th, first, last))
                if carried is not None:
                    rows = tuple(np.concatenate([one, x]) for one, x in zip(carried[0], rows))
                a, c, doc, null, th, first, last = rows
                head = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
                heads = np.flatnonzero(head)
                source = heads[np.cumsum(head) - 1]
                later = ~head & ~((doc == doc[source]) & (null == null[source]) & (th == th[source]) & (first == first[source]))
                s = source[later]
                out.append((doc[later], null[later], th[later], first[later], last[later], doc[s], null[s], th[s], first[s]))
                flags.append(np.ones(int(later.sum()), bool))
                # Heads of anchors with several contents; the carried one may be out already.
                shared = a[heads][1:] == a[heads][:-1]
                both = np.concatenate([[False], shared]) | np.concatenate([shared, [False]])
                gone = carried is not None and carried[1]
                goes = both.copy()
                if gone:
                    goes[0] = False
                h = heads[goes]
                out.append((doc[h], null[h], th[h], first[h], last[h], doc[h], null[h], th[h], first[h]))
                flags.append(np.zeros(len(h), bool))
                tail = heads[-1]
                # The only head here may share its anchor with one that went by before.
                carried = (tuple(x[tail : tail + 1] for x in rows), bool(both[-1]) or (len(heads) == 1 and gone))
            doc, null, th, first, last, src, src_null, src_th, src_first = (np.concatenate(x) for x in zip(*out))
            columns = [_ids(doc, null), th, first, last, np.concatenate(flags), _ids(src, src_null), src_th, src_first]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types.types)], schema=types)

    dealt = asked.repartition(n, "deal").sortWithinPartitions("known", "a", "c", *_PLACE[:3])
    return dealt.mapInArrow(run, _FOUND)


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, th, first, last, src_doc, src_th, src_first): windows first to last of a
    document occur earlier, the first of them at window src_first of the source."""
    texts = _documents(docs)
    found = stored(_looked_up(texts.mapInArrow(_ask("phrases"), _ASK)), "phrases")
    ends = found.where("not known").groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("heads"))
    keyed = ends.withColumnsRenamed({"doc_id": "head_id", "th": "head_th"})
    same = texts["doc_id"].eqNullSafe(keyed["head_id"]) & (texts["th"] == keyed["head_th"])
    open_texts = texts.join(keyed.hint("merge"), same).select(*_KEY, "text", "heads")
    windows = _looked_up(open_texts.mapInArrow(_ask("windows"), _ASK))
    return stored(found.where("known").drop("known").unionByName(windows.where("known").drop("known")), "matches")


def _joined(places: list) -> list[tuple]:
    """Matches in order as factors: (first word, words, source), the longest that go on in one source.

    A match that lies inside the factors before it adds nothing."""
    out: list[list] = []
    for p in places:
        source = (p["src_doc"], p["src_th"])
        if out and out[-1][2] == source and out[-1][3] - out[-1][0] == p["src_first"] - p["first"] and p["first"] <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], p["last"] + WINDOW - out[-1][0])
        elif not out or p["last"] + WINDOW > out[-1][0] + out[-1][1]:
            out.append([p["first"], p["last"] + WINDOW - p["first"], source, p["src_first"]])
    return [(first, n, *source, src_first) for first, n, source, src_first in out]


def _by_document(found: DataFrame) -> DataFrame:
    """A row a document with its matches in order."""
    place = F.struct("first", "last", "src_doc", "src_th", "src_first")
    return found.groupBy(*_KEY).agg(F.array_sort(F.collect_list(place)).alias("places"))


def factors(docs: DataFrame) -> DataFrame:
    """The duplicate factors of each document with their sources, in words.

    Columns: doc_id, th (hash of the text), first, n_words, src_doc, src_th, src_first:
    the n_words words from first on stand earlier in the source, from src_first on.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, th, places in rows:
            for factor in _joined(places):
                yield doc_id, th, *factor

    return map_rows(_by_document(matches(docs)), run, _FACTORS)


def _cut(text: str, spans: list) -> tuple[int, int, list[bytes]]:
    """(words, removed words, kept text in chunks) of a text without the words of sorted spans."""
    n = removed = at = 0
    kept: list[bytes] = []
    for piece in pieces_of(text.encode("utf-8", "replace"), CASED):
        words = piece.split()
        some, here = [], 0
        while at < len(spans) and spans[at]["first"] < n + len(words):
            low, high = max(spans[at]["first"] - n, here), min(spans[at]["end"] - n, len(words))
            if high > low:
                some += words[here:low]
                removed += high - low
                here = high
            if spans[at]["end"] > n + len(words):
                break
            at += 1
        some += words[here:]
        n += len(words)
        if some:
            kept.append(b" ".join(some))
    return n, removed, kept


def dedup_passages(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) without the words that earlier text has already.

    A window is WINDOW consecutive words of a document; words are what stands between
    blanks, unchanged. Removed are the words of windows whose words also start earlier: in
    a smaller doc_id (null is the smallest; rows that repeat an id: by the hash of the
    text), or before in the same document. Windows are judged on the input.

    Columns: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space), and with ``texts`` kept itself. Null is an empty text, texts under WINDOW words
    stay whole; rows that repeat doc_id and text are one document and get the same result,
    each. Extra columns are ignored.

    Words, anchors, contents and windows are compared by 64-bit hashes, contents and
    windows by two of them.
    """
    spans = _by_document(matches(docs)).select(*_KEY, F.transform("places", lambda p: F.struct(p["first"].alias("first"), (p["last"] + WINDOW).alias("end"))).alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "span_id", "th": "span_th"})
    all_texts = _documents(docs)
    same = all_texts["doc_id"].eqNullSafe(spans["span_id"]) & (all_texts["th"] == spans["span_th"])
    rows = all_texts.join(spans.hint("merge"), same, "left").select("doc_id", "text", "spans")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, spans in rows:
            n, removed, kept = _cut(text, spans or [])
            digest = hashlib.sha256()
            for i, chunk in enumerate(kept):
                digest.update((b" " if i else b"") + chunk)
            out = (doc_id, n, removed, digest.hexdigest())
            yield (*out, b" ".join(kept).decode("utf-8")) if texts else out

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return map_rows(rows, run, schema + (", kept string" if texts else ""))
