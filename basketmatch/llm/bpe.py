"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.group import GroupedData

from basketmatch.llm.scratch import stored
from basketmatch.llm.slices import map_slices

RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose distinct words are gathered before they are shuffled, and
#: documents whose positions go in one row. Longer texts stay whole.
CHUNK_TOKENS, ROW_DOCUMENTS = 4_000_000, 256
#: Words that an encoding task remembers.
REMEMBERED = 300_000
_CHUNKS = "chunk string, bucket int, size long, ids array<long>, payload binary, numbers binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _ranges(characters: str) -> str:
    """What stands for so many characters inside the brackets of a pattern."""
    codes = np.unique(np.fromiter(map(ord, characters), np.int64, len(characters)))
    first = codes[np.diff(codes, prepend=-2) > 1]
    last = codes[np.diff(codes, append=0x110001) > 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last))


def splitter() -> Callable[[str], list[str]]:
    """Cuts a text into the matches of the public pattern, as tiktoken would.

    Which characters are letters, numbers or white space differs between versions of
    Unicode. tiktoken's own classes are read off once, by what it keeps of all
    characters; a text that holds a character on which ``regex`` disagrees is cut by
    a pattern that lists tiktoken's classes.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    listed, odd = {}, set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        reader = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs = reader.decode(reader.encode_ordinary(every))
        odd |= set(theirs) ^ set(regex.findall(kind, every))
        listed[kind] = _ranges(theirs)
    exact = public_tokenizers.PATTERN.replace(r"\S", r"[^\s]")
    # Inside brackets the ranges stand as they are, elsewhere in brackets of their own.
    parts = regex.split(r"(\[[^\]]*\])", exact)
    for kind, ranges in listed.items():
        parts = [p.replace(kind, ranges if p.startswith("[") else f"[{ranges}]") for p in parts]
    plain, exact = regex.compile(public_tokenizers.PATTERN), regex.compile("".join(parts))

    def split(text: str) -> list[str]:
        common = text.isascii() or odd.isdisjoint(text)
        return (plain if common else exact).findall(text)

    return split


def _packed(numbers: np.ndarray, level: int = 9) -> bytes:
    """Numbers of seven bits a byte, low bits first, compressed."""
    numbers = np.asarray(numbers, np.uint32)
    parts = (numbers[:, None] >> (7 * np.arange(5, dtype=np.uint32))).astype(np.uint32)
    more = parts >= 128
    used = np.ones(parts.shape, bool)
    used[:, 1:] = more[:, :-1]
    return zstandard.compress(((parts & 127) | (more << 7)).astype(np.uint8)[used].tobytes(), level)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob, max_output_size=1 << 31), np.uint8)
    last = raw < 128
    start = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(raw) else np.empty(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(start, np.diff(np.append(start, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.uint32) << (7 * place).astype(np.uint32), start) if len(raw) else np.empty(0, np.uint32)


def _chunk(split: Callable[[str], list[str]], buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows with documents' word numbers by position, and rows with a chunk's distinct words by bucket."""

    def rows(docs: list[tuple[int | None, np.ndarray]], seen: dict[str, int], counts: np.ndarray) -> Iterator[pd.DataFrame]:
        name = uuid.uuid4().hex
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        for i in range(0, len(docs), ROW_DOCUMENTS):
            part = docs[i : i + ROW_DOCUMENTS]
            positions = np.concatenate([p for _, p in part])
            yield _frame(name, -1, len(part), [d for d, _ in part], _packed(number[positions]), _packed([len(p) for _, p in part]))
        words = list(seen)
        by_bucket: dict[int, list[int]] = {}
        for i in order:
            by_bucket.setdefault(zlib.crc32(words[i].encode()) % buckets, []).append(i)
        for bucket, members in by_bucket.items():
            blob = zstandard.compress(json.dumps([words[i] for i in members], ensure_ascii=False).encode(), 3)
            yield _frame(name, bucket, len(members), None, blob, _packed(np.diff(number[members], prepend=np.uint32(0))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, seen, tokens = [], {}, 0

        def counts() -> np.ndarray:
            total = np.zeros(len(seen), np.int64)
            for _, positions in docs:
                np.add.at(total, positions, 1)
            return total

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = split(text or "")
                positions = np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int32, len(found))
                docs.append((None if pd.isna(doc_id) else int(doc_id), positions))
                tokens += len(found)
                if tokens >= CHUNK_TOKENS:
                    yield from rows(docs, seen, counts())
                    docs, seen, tokens = [], {}, 0
        if docs:
            yield from rows(docs, seen, counts())

    return run


def _frame(chunk: str, bucket: int, size: int, ids: list | None, payload: bytes, numbers: bytes) -> pd.DataFrame:
    return pd.DataFrame({"chunk": [chunk], "bucket": [bucket], "size": [size], "ids": [ids], "payload": [payload], "numbers": [numbers]})


def whole_piece_encoding(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    """Encodes a word as one piece, whatever it holds."""
    return tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})


def _encode_words(ranks: dict[bytes, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For rows in the order of their buckets: each word's ids, encoded once for the bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, known, current = whole_piece_encoding(ranks).encode_ordinary, {}, None
        for batch in batches:
            for r in batch.itertuples():
                if r.bucket != current or len(known) > REMEMBERED:
                    known, current = {}, r.bucket
                ids = []
                for word in json.loads(zstandard.decompress(r.payload, max_output_size=1 << 31)):
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encode(word)
                    ids.append(got)
                blob = _packed(np.concatenate([[len(i) for i in ids], np.concatenate(ids)]))
                yield _frame(r.chunk, r.bucket, r.size, None, blob, r.numbers)

    return run


def _ids(docs: pd.DataFrame, words: pd.DataFrame) -> Iterator[tuple[int | None, np.ndarray]]:
    """The ids of a chunk's documents: word numbers by position, replaced by the words' ids."""
    total = int(words["size"].sum())
    length, flat = np.zeros(total, np.int64), []
    numbers = []
    for blob, size, at in zip(words["payload"], words["size"], words["numbers"]):
        values, number = _unpacked(blob), np.cumsum(_unpacked(at), dtype=np.uint32)
        length[number] = values[:size]
        flat.append(values[size:])
        numbers.append(number)
    order = np.concatenate(numbers) if numbers else np.empty(0, np.uint32)
    flat = np.concatenate(flat) if flat else np.empty(0, np.uint32)
    begin = np.zeros(total, np.int64)
    begin[order] = np.concatenate([[0], np.cumsum(length[order])[:-1]]) if total else 0
    for row in docs.itertuples():
        positions, sizes = _unpacked(row.payload), _unpacked(row.numbers)
        n = length[positions]
        ends = np.cumsum(n)
        at = np.repeat(begin[positions] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
        out = flat[at].astype(np.int32)
        for doc_id, a, b in zip(row.ids, cuts[:-1], cuts[1:]):
            yield None if pd.isna(doc_id) else int(doc_id), out[a:b]


def _assemble(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    found = list(_ids(docs, words))
    return pd.DataFrame({"doc_id": pd.array([d for d, _ in found], "Int64"), "ids": [i for _, i in found]})


def encode(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and ids, an array of ints.

    Texts are cut into pre-tokens. A chunk of texts keeps each distinct pre-token
    once, and for each text the numbers of its pre-tokens by position. Distinct
    words go to the bucket of their hash, where each is encoded once; the ids go
    back to the chunks, and positions are replaced by ids. Chunks are written
    before the shuffle, so a task that runs again reads the same numbers. A word of
    all texts comes once for each chunk, not once for each place.

    A null or empty text has no ids. Repeated rows give repeated rows; a null
    doc_id stays null; extra columns are ignored.
    """
    texts, words = _chunks(docs, ranks)
    return texts.cogroup(words).applyInPandas(_assemble, "doc_id long, ids array<int>")


def _chunks(docs: DataFrame, ranks: dict[bytes, int]) -> tuple[GroupedData, GroupedData]:
    """Positions and encoded words, both by chunk."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = _chunk(splitter(), buckets)
    chunks = stored(map_slices(docs.select("doc_id", "text"), cut, _CHUNKS), "chunks")
    words = chunks.where("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    words = map_slices(words, _encode_words(ranks), _CHUNKS)
    return chunks.where("bucket < 0").groupBy("chunk"), words.groupBy("chunk")


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table, by id."""
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def _joined(table: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` (ids, and other columns that stay) with ``bytes``, the tokens' bytes in order.

    The ids meet the token-byte table, which is as large as the vocabulary and goes
    to all tasks. Null ids give null bytes; an unknown id fails.
    """
    table = token_bytes(ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["bytes"] = [None if ids is None else _joined(table, ids) for ids in batch["ids"]]
            yield batch

    kept = [f for f in encoded.schema.fields if f.name != "bytes"]
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_slices(encoded.select(*(f"`{f.name}`" for f in kept)), run, f"{names}, bytes binary")


def digests(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Encode and decode ``docs`` in one go: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The same steps as ``encode`` and ``decode``; ids and bytes are hashed where they
    are made. SHA-256 in hex, of the decimal ids joined by one blank and of the bytes.
    """
    table = token_bytes(ranks)

    def run(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc_id, ids in _ids(texts, words):
            listed = " ".join(map(str, ids.tolist())).encode()
            rows.append((doc_id, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(_joined(table, ids)).hexdigest()))
        out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return out.astype({"doc_id": "Int64"})

    texts, words = _chunks(docs, ranks)
    return texts.cogroup(words).applyInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
