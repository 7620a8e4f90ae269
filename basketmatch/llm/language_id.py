"""Language identification by a convolutional network over bytes, trained with numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketmatch.llm.slices import map_slices

#: Labelled documents and windows of each that a language is learned from, at most.
PER_LANGUAGE, PER_DOCUMENT = 300, 3
#: Bytes of a window, of an embedding, filters of each width.
WINDOW, DEPTH, FILTERS, WIDTHS = 256, 8, 8, (2, 3, 4)
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Windows that are convolved at once.
AT_ONCE = 128

_WORDLIKE = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    languages: list[str] = field(default_factory=list)
    embedding: np.ndarray | None = None
    filters: dict[int, np.ndarray] = field(default_factory=dict)
    dense: np.ndarray | None = None
    bias: np.ndarray | None = None


def has_letter(text: str) -> bool:
    """Is there a letter: fractions, superscripts and Roman numerals are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def windows(text: str | None) -> np.ndarray:
    """All windows of the lower-case text, the last one filled with zeros."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    n = -(-len(raw) // WINDOW)
    out = np.zeros((n, WINDOW), np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Network:
    """Adam on cross entropy. Max pooling passes a filter's gradient to one place of a window."""
    rng = np.random.default_rng(3)
    p = {"e": rng.normal(0, 0.5, (256, DEPTH)), "d": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), "b": np.zeros(len(languages))}
    p |= {k: rng.normal(0, 0.3, (k * DEPTH, FILTERS)) for k in WIDTHS}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = x[order[at : at + BATCH]]
            n = len(rows)
            seen = p["e"][rows]
            g = {k: np.zeros_like(a) for k, a in p.items()}
            pooled, places = [], {}
            for k in WIDTHS:
                patch = np.lib.stride_tricks.sliding_window_view(seen, (k, DEPTH), (1, 2))[:, :, 0].reshape(n, WINDOW - k + 1, k * DEPTH)
                out = patch @ p[k]
                places[k] = out.argmax(1)
                pooled.append(np.maximum(np.take_along_axis(out, places[k][:, None], 1)[:, 0], 0))
            h = np.concatenate(pooled, 1)
            err = _softmax(h @ p["d"] + p["b"])
            err[np.arange(n), y[order[at : at + BATCH]]] -= 1
            err /= n
            g["d"], g["b"] = h.T @ err, err.sum(0)
            back = (err @ p["d"].T) * (h > 0)
            for i, k in enumerate(WIDTHS):
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                spots = rows[np.arange(n)[:, None, None], places[k][:, :, None] + np.arange(k)]
                patch = p["e"][spots].reshape(n, FILTERS, k * DEPTH)
                g[k] = np.einsum("nfc,nf->cf", patch, part)
                np.add.at(g["e"], spots, (part[:, :, None] * p[k].T[None]).reshape(n, FILTERS, k, DEPTH))
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Network(languages, p["e"], {k: p[k] for k in WIDTHS}, p["d"], p["b"])


def _tables(net: Network) -> dict[int, np.ndarray]:
    """For each width and place in the filter: what each byte adds to each filter."""
    return {k: np.stack([net.embedding @ w[j * DEPTH : (j + 1) * DEPTH] for j in range(k)]).astype(np.float32) for k, w in net.filters.items()}


def log_probabilities(net: Network, tables: dict[int, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Log probabilities of the languages for each window."""
    out = np.empty((len(x), len(net.languages)))
    for at in range(0, len(x), AT_ONCE):
        rows = x[at : at + AT_ONCE]
        pooled = []
        for k, table in tables.items():
            total = table[0][rows[:, : WINDOW - k + 1]]
            for j in range(1, k):
                total += table[j][rows[:, j : WINDOW - k + 1 + j]]
            pooled.append(np.maximum(total.max(1), 0))
        out[at : at + AT_ONCE] = np.log(_softmax(np.concatenate(pooled, 1) @ net.dense + net.bias) + 1e-9)
    return out


def learnable(doc_id: Column) -> Column:
    """Whether a document may be learned from: crc32 of its id modulo 3 is not 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))


def fit(docs: DataFrame) -> Network:
    """Learn from ``docs`` (doc_id, text, lang), all of whose rows are taken as labelled.

    From each language some PER_LANGUAGE documents, picked by hash, give up to
    PER_DOCUMENT windows at even distances. What comes to the driver is bounded by
    the number of languages.
    """
    docs = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return Network()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = docs.sparkSession.createDataFrame([(k, min(1.0, 1.3 * PER_LANGUAGE / n)) for k, n in counts.items()], "_lang string, share double")
    picked = docs.join(F.broadcast(share), F.expr("lang = _lang")).where(draw < F.col("share") * (1 << 30)).select("lang", draw.alias("draw"), "text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for lang, place, text in zip(batch["lang"], batch["draw"], batch["text"]):
                if has_letter(text):
                    x = windows(text)
                    at = np.unique(np.linspace(0, len(x) - 1, PER_DOCUMENT).astype(int))
                    rows.append((lang, place, x[at].tobytes()))
            yield pd.DataFrame(rows, columns=["lang", "draw", "windows"])

    sample = map_slices(picked, cut, "lang string, draw long, windows binary").toArrow().to_pandas()
    sample = sample.sort_values(["lang", "draw", "windows"]).groupby("lang", sort=False).head(PER_LANGUAGE)
    if not len(sample):
        return Network()
    languages = sorted(sample["lang"].unique())
    x = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for w in sample["windows"]]
    y = np.repeat([languages.index(k) for k in sample["lang"]], [len(w) for w in x])
    return train(np.concatenate(x), y, languages)


def predicted(docs: DataFrame, net: Network) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score.

    All windows of the whole text are scored in batches; their mean log probability,
    weighted by bytes, gives the language and its score. A text that is null or has
    no letter is ``und`` with score 0, as is everything if nothing was learned. Ties
    go to the first language. Extra columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _tables(net) if net.languages else {}
        for batch in batches:
            names, scores = [], []
            for text in batch["text"]:
                if not net.languages or not text or not has_letter(text):
                    names.append("und")
                    scores.append(0.0)
                    continue
                x = windows(text)
                weight = (x > 0).sum(1)
                mean = (log_probabilities(net, tables, x) * weight[:, None]).sum(0, keepdims=True) / max(1, weight.sum())
                share = _softmax(mean)[0]
                names.append(net.languages[int(share.argmax())])
                scores.append(float(share.max()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": names, "score": scores})

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")
