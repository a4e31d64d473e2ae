import duckdb
import pytest
from pyspark.sql import types as T

LONG = "word and " * 4000 + "end."

# NULLs, empty and very long texts, repeated rows and ids, blanks only, several scripts.
EDGE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank."),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "A repeated text that stands here twice, word for word, line for line."),
    (5, "A repeated text that stands here twice, word for word, line for line."),
    (6, "A repeated text that stands here twice, word for word, line for line."),
    (None, "A text of nobody, with a few more words than the others have, to be sure."),
    (None, None),
    (7, " \n\t \n"),
    (8, "12345 67890 !!! ???"),
    (9, "日本語のテキスト Ünïcödé ſpecial Kelvin K end 😀"),
]

# Columns that carry the names of results and of the operators' own helpers.
CLASHING = ("row", "fp", "score", "fingerprint", "shard", "spans", "h", "n", "lines", "part", "gone", "lang_pred", "key", "label")


@pytest.fixture(scope="session")
def make_docs(spark, tmp_path_factory):
    """A stored documents table from (doc_id, text) rows, with columns of clashing names."""

    def make(rows, extra=CLASHING):
        fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
        fields += [T.StructField(name, T.StringType()) for name in extra]
        full = [(*row, "en", None if i == 0 else f"src{i % 3}", *["x"] * len(extra)) for i, row in enumerate(rows)]
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        spark.createDataFrame(full, T.StructType(fields)).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    return make_docs(EDGE_ROWS)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])


@pytest.fixture(scope="session")
def small(spark):
    """The smallest driver tables, in Spark."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


@pytest.fixture(scope="session")
def small_rows():
    """doc_id, text of the smallest driver documents."""
    return duckdb.connect().execute("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()
