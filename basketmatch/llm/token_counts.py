"""Token counts of a SentencePiece BPE model, with a shortcut for pre-tokens that are one token."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame

from basketmatch.llm.slices import map_slices

MODEL = "piece_bpe_32k.model"
#: Tokens that a document may have.
LIMIT = 4096
#: Counts of merged pre-tokens that a task remembers besides the proven ones.
REMEMBERED = 1_000_000

_PRE_TOKEN = re.compile(" *[^ \n]+| +")


def _load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def merged(model: sentencepiece.SentencePieceProcessor, pre_token: str) -> int:
    """Tokens of a pre-token inside a text.

    A newline in front takes the mark that the model puts before a text, and costs
    two tokens with it; nothing merges with a newline.
    """
    return len(model.encode("\n" + pre_token, num_threads=1)) - 2


def proven_whole(model: bytes) -> set[str]:
    """Pieces that encode alone as one token; to be found once, before any text is read.

    Fails if the model could merge across the cuts: a piece with a blank after
    another character, or with a newline, would span two pre-tokens, and a model
    that rewrites its text would make other pre-tokens.
    """
    loaded = _load(model)
    whole = set()
    for i in range(loaded.get_piece_size()):
        if loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_byte(i) or loaded.is_unused(i):
            continue
        piece = loaded.id_to_piece(i).replace("▁", " ")
        if re.search("[^ ] ", piece) or "\n" in piece:
            raise ValueError(f"piece {piece!r} spans two pre-tokens")
        if merged(loaded, piece) == 1:
            whole.add(piece)
    for text in ("a  b", " a ", "\n", "ﬁ", "▁x"):
        if len(loaded.encode(text)) != _count(text, _Counts(whole, loaded)):
            raise ValueError(f"the model rewrites {text!r}")
    return whole


class _Counts(dict):
    """Tokens by pre-token: one for the proven ones, merged and remembered for others."""

    def __init__(self, whole: set[str], model: sentencepiece.SentencePieceProcessor) -> None:
        super().__init__(dict.fromkeys(whole, 1))
        self.model, self.whole = model, whole

    def __missing__(self, pre_token: str) -> int:
        if len(self) > len(self.whole) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = self[pre_token] = merged(self.model, pre_token)
        return n


def _count(text: str | None, counts: _Counts) -> int:
    if not text:
        return 0
    found = _PRE_TOKEN.findall(" " + text.replace("▁", " "))
    return text.count("\n") + sum(map(counts.__getitem__, found))


def token_counts(docs: DataFrame, model: bytes, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    A text is cut before each run of blanks and at each newline; no merge crosses
    these cuts (``proven_whole`` checks it). A pre-token that is proven to be one
    token counts one; the others are merged by the model, each once while it is
    remembered; a newline is one byte token. No shuffle. ``model`` is the content of
    a model file. Null is an empty text and has no tokens; repeated rows count alike;
    extra columns are ignored.
    """
    whole = proven_whole(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = _load(model)
        counts = _Counts(whole, loaded)
        for batch in batches:
            texts = batch["text"]
            n = [_count(t, counts) for t in texts]
            size = [len(t.encode("utf-8", "replace")) if t else 0 for t in texts]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": size, "n_tokens": n, "over_limit": [k > limit for k in n]})

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
