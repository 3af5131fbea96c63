import math
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, row string, size string, n string"


@pytest.fixture(scope="session")
def table(small_dir):
    """Rows of a test table as dicts."""
    return lambda name: pq.read_table(f"{small_dir}/{name}.parquet").to_pylist()


@pytest.fixture
def documents(spark):
    """A documents table with extra columns whose names operators use inside; each row: (doc_id, text[, lang, source])."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z", "w") for r in full], DOCUMENTS)

    return make


@pytest.fixture
def awkward(documents):
    """Nulls, empty and blank texts, one very long word list, repeated rows, ties."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    return documents(
        [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (None, "no id here"), (7, long, "en", "a"), (8, "café ça va 日本", "fr", None), (9, "same text here", "en", "a"), (9, "same text here", "en", "a"), (10, "x" * 5000)]
    )


def folded(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def words(text):
    return (text or "").encode().split()


def lower(raw: bytes) -> bytes:
    return raw.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def close(a, b, tolerance=1e-9):
    return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)


REPO = Path(__file__).parents[2]
