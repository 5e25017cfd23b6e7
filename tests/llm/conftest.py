import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from brute import FOLDER  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, hash int, chunk int, id int, h1 long"


@pytest.fixture(scope="session")
def given(spark):
    """The documents of the smallest tables as (doc_id, text) rows."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty, blank and long texts, copies, repeated ids and odd characters."""
    prose = " ".join(f"word{i % 97}x{i * i % 89}" for i in range(400))
    texts = [
        (1, prose), (2, prose), (3, prose.upper()), (4, prose + " and one tail"), (5, ""), (6, None), (7, " \n\t "), (8, "one two"),
        (9, "one two"), (10, "é" * 300), (10, "é" * 300), (11, "a" * 500), (12, "\U0001F600 zero width 　 space" * 9),
        (None, prose), (None, None), (13, prose[50:900] + "\n" + prose[50:900]), (14, "x " * 3000), (15, "line\n" * 80), (16, prose * 120),
    ]
    rows = [(i, t, None if n % 5 == 0 else "en" if n % 2 else "de", None if n % 4 == 0 else f"s{n % 3}", None, "big", n, None, n, 7)
            for n, (i, t) in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The messy rows with further columns whose names the operators use inside."""
    return spark.createDataFrame(messy_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
