import json

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table of (doc_id, text[, lang[, source]]) rows."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


def plain(rows) -> list:
    return sorted((json.dumps(r.asDict(True), sort_keys=True, default=str) for r in rows))
