import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names the operators use themselves."""

    def build(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(i, t, "en", f"src{n % 2}", len(t or "")) for n, (i, t) in enumerate(rows)]
        if extra:
            names = "run int, digest string, bucket int, _key string, fingerprint string, rows int, spans string"
            return spark.createDataFrame([row + (7, "d", 1, "k", "f", 3, "s") for row in full], f"{schema}, {names}")
        return spark.createDataFrame(full, schema)

    return build
