import pytest
from pyspark.sql import functions as F

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, "The  quick brown fox\njumps over the lazy dog"),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "the quick brown fox jumps over the lazy cat"),
    (7, "x"),
    (8, "éàü ß 日本語 Ελλάδα привет мир"),
    (9, "12 34 !! --"),
    (9, "12 34 !! --"),
    (10, " ".join(f"word{i % 211}" for i in range(6000))),
    (11, "a▁b  c   d e f\x1cg"),
    (None, "a text without an id"),
]


def with_clashes(frame):
    """Extra columns with names that operators use inside."""
    names = ("digest", "shard", "slot", "rank", "score", "spans", "lang_pred", "kept_text", "ranges", "family", "key", "norm", "locator")
    return frame.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, None if i in (3, 8) else "en", None if i == 4 else f"s{(i or 0) % 2}", len(t or "")) for i, t in TEXTS]
    return with_clashes(spark.createDataFrame(rows, schema).repartition(3))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture
def folder(spark, tmp_path):
    """Write a table of documents for a query; returns the folder."""

    def make(frame):
        frame.write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make
