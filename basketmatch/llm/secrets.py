"""Secrets in texts: fixed patterns, and credential values that are costly to guess."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from basketmatch.llm.bpe import read_ranks
from basketmatch.llm.slices import map_slices

#: Kinds in the order in which spans that begin together are listed; ``guess`` is added.
KINDS = ("assign", "access", "hex", "guess")
#: Patterns of the base kinds and least lengths (of group 2 for assign).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: A value behind a name that holds a word of a wider set, with any characters but
#: blanks and quotes. Names are tried from their beginning only, and taken whole, so
#: that the time stays linear; a name with its own sign is no value.
_NAME = (
    r"""(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]*?(?:pass|pwd|secret|token|credential|(?:api|access|private|client)[_.-]?key))"""
    r"""[A-Za-z0-9_.-]++["']?[\x20\t]*+(?:[:=]|=>)[\x20\t]*+["']?"""
)
CONTEXT = re.compile(rf"""{_NAME}(?!{_NAME})([^\s"'<>,;]{{6,}})""", re.I | re.A)
#: A value is added from this many guesses on, as a power of ten.
LEAST_GUESSES = 8.0
#: Rows of a keyboard.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

_DATE = re.compile(r"(?:19|20)\d\d(?:([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
_STEP = {(a, b) for row in KEYBOARD for a, b in zip(row, row[1:])} | {(b, a) for row in KEYBOARD for a, b in zip(row, row[1:])}


class Words(dict):
    """Words with their ranks, and the length of the longest."""

    longest = 0

    def add(self, word: str) -> None:
        self.setdefault(word, len(self) + 1)
        self.longest = max(self.longest, len(word))


def word_ranks(path: str) -> Words:
    """Words of three or more letters of a tokenizer's rank file, by their order there."""
    words = Words()
    for token in read_ranks(path):
        word = token.decode("utf-8", "ignore").strip().lower()
        if len(word) >= 3 and word.isalpha():
            words.add(word)
    return words


def guesses(value: str, words: Words) -> float:
    """Power of ten of the guesses that the cheapest segmentation of ``value`` takes.

    Segments are words (by rank, with twice the guesses for capitals), dates, runs
    of one character, keyboard walks and steps through the alphabet or digits, and
    single characters by brute force. Runs, walks and steps go as far as they reach.
    The cost of a place is the least over the segments that end there.
    """
    n, low = len(value), value.lower()
    best = [0.0] + [math.inf] * n
    ends = [_reach(low, link) for link in (_same, _walks, _steps)]
    for i in range(n):
        here = best[i]
        c = value[i]
        kinds = 10 if c.isdigit() else 26 if c.isalpha() else 33

        def offer(end: int, cost: float) -> None:
            if here + cost < best[end]:
                best[end] = here + cost

        offer(i + 1, math.log10(kinds))
        for end in range(i + 3, min(n, i + words.longest) + 1):
            rank = words.get(low[i:end])
            if rank:
                offer(end, math.log10(rank + 1) + (0.0 if value[i:end] == low[i:end] else math.log10(2)))
        date = _DATE.match(value, i)
        if date:
            offer(date.end(), math.log10(120) if date.end() - i == 4 else math.log10(365 * 120))
        for reach, base in zip(ends, (kinds, 47, kinds)):
            if reach[i] - i >= 3:
                offer(reach[i], math.log10(base * (reach[i] - i)))
    return best[n]


def _reach(text: str, link: Callable[[str, str], int | None]) -> list[int]:
    """For each place the end of the longest segment from it whose characters go on in the
    same way, from the last place to the first."""
    ends = [len(text)] * len(text)
    way = None  # how the character after goes on to the one after it
    for i in range(len(text) - 2, -1, -1):
        step = link(text[i], text[i + 1])
        ends[i] = i + 1 if step is None else ends[i + 1] if step == way else i + 2
        way = step
    return ends


def _same(a: str, b: str) -> int | None:
    return 0 if a == b else None


def _walks(a: str, b: str) -> int | None:
    return 0 if (a, b) in _STEP else None


def _steps(a: str, b: str) -> int | None:
    step = ord(b) - ord(a)
    return step if abs(step) == 1 else None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches that are long enough."""
    found = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "api_key", "apikey")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if _HEX_RUN in text.encode("utf-8", "replace").translate(_HEX_BYTES):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_HEX_BYTES = bytes(104 if b in b"0123456789abcdef" else 32 for b in range(256))
_HEX_RUN = b"h" * LEAST["hex"]


def guess_spans(text: str, base: list[tuple[int, int, str]], words: Words) -> list[tuple[int, int, str]]:
    """Values in a credential's context that no base span touches and that are costly to guess."""
    low = text.lower()
    if not any(w in low for w in ("pass", "pwd", "secret", "token", "credential", "key")):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        if all(end <= s or start >= e for s, e, _ in base) and guesses(m[1], words) >= LEAST_GUESSES:
            out.append((start, end, "guess"))
    return out


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secrets(docs: DataFrame, words: Words) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess.

    Spans are in code points, end exclusive, by start and then kind; ``guess`` spans
    are the values that the guess cost adds. Every text is read whole, row by row,
    without a shuffle. Null is an empty text without spans. Repeated rows give equal
    rows; extra columns are ignored. ``words`` comes from ``word_ranks``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                more = guess_spans(text, base, words)
                n = {k: sum(s[2] == k for s in base) for k in KINDS}
                every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
                sha = hashlib.sha256(_listed(base).encode()).hexdigest()
                rows.append((n["assign"], n["access"], n["hex"], sha, _listed(every), len(more)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return map_slices(
        docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    )
