import pytest


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) as a table with further columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "x", "y", 0, 0.5, "k", 1) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, digest string, row int, score double, kept string, n_words int")

    return make


@pytest.fixture
def table(spark):
    from wagelens.session import scratch_path

    def make(**tables):
        """Writes tables as <folder>/<name>.parquet and returns the folder."""
        folder = scratch_path(spark, "llm-tables")
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return make
