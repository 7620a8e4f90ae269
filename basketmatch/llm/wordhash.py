"""Words of many texts hashed at once with numpy.

A word's hash is a polynomial of random byte values modulo 2**64, mixed. It depends
on the word's bytes alone, so every task and every run gives the same hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed together; longer texts are cut between words.
CHUNK_BYTES = 1 << 18
#: Places whose runs are hashed together.
BLOCK = 1 << 16

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(word: bytes | range, lower: bool = True) -> np.ndarray:
    """For each byte the value hashed for it; 0 for bytes that separate words."""
    table = np.zeros(256, np.uint64)
    for b in word:
        table[b] = _VALUES[b + 32 if lower and 65 <= b <= 90 else b]
    return table


#: Words run between the six ASCII white-space bytes; A-Z count as a-z.
SPACED = byte_table(bytes(b for b in range(256) if b not in b"\t\n\x0b\x0c\r "))
#: Words are runs of ASCII letters, digits and bytes of other letters.
LETTERS = byte_table(bytes(b for b in range(256) if b >= 128 or chr(b).isalnum()))


def _hash(raw: bytes, table: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``raw`` and where they begin.

    With ``prefixes`` a row for each word: its hash, and those of its first so many
    bytes, 0 where the word is no longer than that.
    """
    values = table[np.frombuffer(raw, np.uint8)]
    inside = np.zeros(len(values) + 2, np.int8)
    inside[1:-1] = values != 0
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts])
    if not prefixes:
        return words, starts
    parts = [words]
    for k in prefixes:
        cut = np.minimum(starts + k, len(values))
        part = mix((total[cut] - total[starts]) * down[starts] + np.uint64(k))
        parts.append(np.where(ends - starts > k, part, np.uint64(0)))
    return np.stack(parts, 1), starts


def pieces_of(text: bytes, table: np.ndarray) -> Iterator[bytes]:
    """A long text cut at separators into pieces of about the chunk's size."""
    at = 0
    while len(text) - at > CHUNK_BYTES:
        end = at + CHUNK_BYTES
        while end < len(text) and table[text[end]]:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[str | None], table: np.ndarray, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of texts: number of the first one, hashes of all words, offsets by text.

    A group holds about CHUNK_BYTES, or one longer text. Null is an empty text.
    """
    first, group, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if len(raw) > CHUNK_BYTES:
            if group:
                yield first, *_joined(group, table, prefixes)
            words = np.concatenate([_hash(p, table, prefixes)[0] for p in pieces_of(raw, table)])
            yield i, words, np.array([0, len(words)])
            first, group, size = i + 1, [], 0
            continue
        group.append(raw)
        size += len(raw)
        if size > CHUNK_BYTES:
            yield first, *_joined(group, table, prefixes)
            first, group, size = i + 1, [], 0
    if group:
        yield first, *_joined(group, table, prefixes)


def _joined(group: list[bytes], table: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    words, starts = _hash(b" ".join(group), table, prefixes)
    ends = np.cumsum([len(raw) + 1 for raw in group])
    return words, np.concatenate([[0], np.searchsorted(starts, ends)])


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words, in linear time; a block of places at a time."""
    n = max(0, len(words) - k + 1)
    out = np.empty(n, np.uint64)
    up, down = _power_tables(BLOCK + k)
    for at in range(0, n, BLOCK):
        some = words[at : at + BLOCK + k - 1]
        total = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(some * up[: len(some)], out=total[1:])
        found = len(some) - k + 1
        out[at : at + found] = mix((total[k:] - total[:-k]) * down[:found])
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of all runs of ``k`` words, sorted; of fewer words, one hash of them all."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    run = np.full(n, np.uint64(min(k, len(words))))
    for j in range(min(k, len(words))):
        run = mix(run * np.uint64(_BASE) + words[j : j + n])
    return np.unique(run)
