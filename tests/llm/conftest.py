"""Rows that are hard on every operator: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import pytest

#: Columns whose names operators use inside, or that they return.
EXTRA = "key string, part string, h string, runs string, n string, severity string, component string, ids string, path string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows):
        """(doc_id, text[, lang]) as ``documents`` with clashing columns."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) + ("x",) * 9 for r in rows]
        return spark.createDataFrame(full, DOCS)

    return docs
