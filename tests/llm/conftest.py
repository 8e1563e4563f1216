import random

import pytest
from llm_texts import prose, varied


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, empty and very long texts, copies, repeated rows and ids, and columns that clash with our own."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 40)
    rows = [
        (1, base),
        (2, base),
        (3, varied(rng, base, 2)),
        (3, varied(rng, base, 2)),
        (4, None),
        (5, ""),
        (6, " \t\n"),
        (7, "one two"),
        (8, "one two"),
        (9, prose(rng, 60) + " " + passage),
        (10, passage + " " + prose(rng, 60)),
        (11, "word " * 30_000),
        (12, prose(rng, 20_000)),
        (None, base),
        (None, None),
        (13, "é漢 字 x y " * 20),
        (14, prose(rng, 12)),
        (2, base),
    ]
    rows = [(i, t, "en", "s", 0, 1, 1.0, "h", 5) for i, t in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, rep int, score double, h string, label int"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
