from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor " * 20_000
EDGE_TEXTS = [None, "", " \n\t ", "a", "a", "é ß ñ", "one two three four five six", LONG, LONG, "x" * 5_000, "　 a\u0085b"]


@pytest.fixture
def documents(spark):
    """Builds documents with a clashing extra column from (doc_id, text) or texts."""
    def build(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "x") for i, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, score string")

    return build
