import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from texts import prose  # noqa: E402

@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, copies, and extra columns with names that operators use."""
    rng = random.Random(8)
    base = prose(rng, 120)
    rows = [
        (1, base), (2, base), (3, base.replace("the", "a", 1)), (3, base.replace("the", "a", 1)), (4, None), (5, ""), (6, " \n\t \n"), (None, base), (None, None),
        (7, "x" * 50_000), (8, prose(rng, 20_000)), (9, "é ñ 漢字 ▁   \x00 end"), (10, "one"), (11, "A  b\n\nA  b"), (12, "same " * 300),
    ]
    extra = "clash"
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, held_out string, component_id string, start string, `offset` string, __hash string, __text string, __row string, n_deleted_lines string, redacted string, `a.b` string"
    data = [(i, t, None, "s", None if t is None else len(t), *[extra] * 12) for i, t in rows]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
