"""The stages beside a plain version, on one small table."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from basketmatch.llm import bpe
from tests.llm.odd_rows import ODD
from tests.llm.test_dedup import groups, item_set, prose, sentences
from tests.llm.test_texts import TOXIC


def test_stages_equal_a_plain_version(spark, make, tmp_path):
    rng = random.Random(8)
    rows = [(d, t) for d, t in ODD if d is None or d != 5]
    for i in range(100, 300):
        text = "\n".join(" ".join(sentences(rng, 3)) for _ in range(2))
        if i % 4 == 0:
            text += " " + " ".join(rng.choice(TOXIC) for _ in range(6))
        rows.append((i, text))
    toxic = {d for d, t in rows if any(w in (t or "") for w in TOXIC)}
    passage = " ".join(sentences(rng, 8))
    item = prose(rng, 40)
    near = prose(rng, 120)
    rows += [(400, "Own one.\n" + passage), (401, f"{passage}\nOwn two."), (402, passage)]
    rows += [(410, near), (411, near + " end"), (412, near)]
    rows += [(420, f"before {item} after")]
    docs = make(rows)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(d, 1, int(d in toxic)) for d, _ in rows if d is not None and d < 300]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want = [(d, t) for d, t in rows if d not in toxic]
    want = [(d, {401: "Own two."}.get(d, t)) for d, t in want if d != 402]
    roots = groups(want)
    want = [(d, t) for d, t in want if d is None or roots[d] == d]
    want = [(d, t) for d, t in want if not item_set(item) <= item_set(t)]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.RANKS)), special_tokens={})
    expected = sorted((str(d), len(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in got) == expected
