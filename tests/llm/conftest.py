import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) pairs, with extra columns of names that operators use inside."""
    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], DOCS)
        if extra:
            for name in ("score", "class", "bin", "n", "h", "bucket", "ids", "spots"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def make_labels(spark):
    return lambda rows: spark.createDataFrame(rows, LABELS)


@pytest.fixture()
def run_of(spark):
    from frostline.llm.shared import Run

    return lambda name: Run(spark, f"test-{name}")
