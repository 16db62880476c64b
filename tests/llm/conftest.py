import random
import string

import pytest

from tests.conftest import TINY, spark  # noqa: F401

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):  # noqa: F811
    """Makes a documents table from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows, extra=""):
        full = [(i, t, *(rest or ("en",)), "s", None if t is None else len(t)) for i, t, *rest in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


def odd_texts():
    """Null, empty, blank, very long, repeated and non-ASCII texts."""
    rng = random.Random(5)
    long = " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(1, 9))) for _ in range(30_000))
    return [None, "", " \t\r\n\x0b\x0c", long, long, long[:-1] + "?", "a b", "a  b", "a b", "Ünï çødé 漢字 text",
            "x", "X", "1234 5678", "!!! ???", "a\x00b", "\U0001f600 smile", "é", "é"]
