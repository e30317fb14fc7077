from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table like documents from texts, or from (id, text[, lang, source]) rows; extra columns clash by name."""
    def make(rows):
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            doc_id, text, lang, source = (*row, "en", "s")[:4] if len(row) == 2 else (*row, "s")[:4]
            full.append((doc_id, text, lang, source, len(text or ""), "clash", 1, "x", None))
        return spark.createDataFrame(full, DOCS + ", key string, row int, print string, size long").repartition(3)
    return make
