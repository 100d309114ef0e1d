import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """Write rows as Parquet and read them again, as an operator meets them."""
    count = iter(range(10_000))

    def make(rows, schema):
        path = str(tmp_path_factory.mktemp("tables") / f"t{next(count)}")
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(path)
        return spark.read.parquet(path)

    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def odd_documents():
    """Nulls, empty and blank texts, repeated rows, very long and odd texts."""
    texts = [None, "", " \t\n", "one", "one two three four", "a b c d e f", "A B c D e F", "a b c d e f",
             "x" * 20_000, "word " * 30_000, "naïve 你好 \U0001F600 text, with  spaces\n\nand lines",
             "mail me at jo.doe@example.com or +1 (988) 555-2485 from 10.0.0.1 with 4041894974608795 now"]
    rows = [(i, t, "en", None if i % 3 == 0 else "h", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "no id here at all", "en", "h", 3), (None, None, None, None, None)]
