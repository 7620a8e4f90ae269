"""Fill-in-the-middle beside a plain version."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from basketmatch.llm import fill_in_middle as fim
from tests.llm.odd_rows import LONG, ODD


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(3)
    letters = ["ab", "Q", " ", "\n", "é", "𝄞", "<", "P>", "<P", ">", "\x00", "1", ".", "ſ"]
    out = list(ODD) + [(50 + i, t) for i, t in enumerate(["<P>", "a <S> b", "x<M", "<", "a" * 70_000, "é" * 40_000, LONG + "<M>"])]
    for i in range(300):
        out.append((1000 + i, "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 40, 400])))))
    return out + [(7, "another text of id 7"), (1001, dict(out)[1001]), (1001, dict(out)[1001])]


def test_outputs_and_digests_equal_a_plain_version(spark, make):
    table = rows()
    want = [(d, *brute(d, t), t or "") for d, t in table]
    forms = {w[2] for w in want}
    assert forms == {"plain", "psm", "spm"}
    docs = make(table).repartition(5)
    got = fim.digests(docs).collect()
    expected = sorted((str(d), n, form, str(p), str(m), sha(out), sha(t)) for d, n, form, p, m, out, t in want)
    assert sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output_sha256, r.restored_sha256) for r in got) == expected
    texts = fim.fill_in_middle(docs).collect()
    assert sorted((str(r.doc_id), r.form, r.output) for r in texts) == sorted((str(d), form, out) for d, _, form, _, _, out, _ in want)
    assert sorted(fim.restored(r.output, r.form) for r in texts) == sorted(t for *_, t in want)


def test_spans_of_any_size_give_the_same_units(monkeypatch):
    text = "ab c1é" * 50 + "z" * 100 + " end"
    want = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
    for span in (1, 2, 7, 64, 1 << 20):
        monkeypatch.setattr(fim, "SPAN", span)
        assert fim.units(text) == len(want)
        assert fim.offsets(text, list(range(len(want) + 2))) == want + [len(text)] * 2


def test_pieces_are_bounded_and_in_order(spark, make):
    out = fim.pieces(make([(1, LONG), (2, "y" * 100_000), (3, "<P>" + "é" * 30_000)])).collect()
    assert all(len(r.chunk) <= fim.PIECE_CHARS + 3 for r in out)
    assert max(r.place for r in out) > 10
    assert fim.pieces(make([])).count() == 0 and fim.digests(make([])).count() == 0


@pytest.mark.parametrize("times", [3, 1500])
def test_a_row_repeated_all_over_comes_as_often(spark, times):
    docs = spark.createDataFrame([(1, "the same text")] * times + [(None, None)] * 2, "doc_id long, text string").repartition(3)
    out = fim.digests(docs).collect()
    assert len(out) == times + 2 and len({tuple(r) for r in out}) == 2
