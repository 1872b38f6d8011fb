import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    """A documents table of (doc_id, text) pairs; columns that clash with inner names follow."""

    def make(rows, extra="_t string, row string, n_words int"):
        full = [(i, t, None, "s", None if t is None else len(t), "x", None, 1) for i, t in rows]
        return spark.createDataFrame(full, f"{COLUMNS}, {extra}")

    return make


@pytest.fixture
def folder(spark, tmp_path):
    """Writes (doc_id, text) rows as documents.parquet and returns the folder."""

    def make(rows, **tables):
        spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], COLUMNS
        ).write.parquet(str(tmp_path / "documents.parquet"))
        for name, (data, schema) in tables.items():
            spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make
