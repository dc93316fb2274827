import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, source]) tuples, in the tables' schema."""

    def make(*rows):
        full = [(*r, *(None,) * (3 - len(r))) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, source string").selectExpr(
            "doc_id", "text", "'en' AS lang", "source", "length(text) AS n_chars"
        )

    return make


@pytest.fixture
def by_id():
    """Collected rows by their first column; it must be unique."""

    def collect(df, key="doc_id"):
        rows = df.collect()
        found = {r[key]: r.asDict() for r in rows}
        assert len(found) == len(rows)
        return found

    return collect
