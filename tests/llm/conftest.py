import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Rows of (doc_id, text) or (doc_id, text, source) as a documents table."""

    def make(rows, extra=None):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else 0) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra or []:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(name))
        return df

    return make


@pytest.fixture(scope="session")
def whole(spark, sf_dir, tmp_path_factory):
    """A registered query's result over the test tables, computed once."""
    from logfold.llm import queries

    base, known = tmp_path_factory.mktemp("whole"), {}

    def result(name):
        if name not in known:
            queries.queries()[name](spark, sf_dir).write.parquet(f"{base}/{name}")
            known[name] = spark.read.parquet(f"{base}/{name}")
        return known[name]

    return result
