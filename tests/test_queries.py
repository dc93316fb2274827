"""Registered queries: the contract, some oracle checks, and plan checks."""

import re

import duckdb
import pytest

import __spark_entry__ as contract

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
CHECKED = (
    "popular_movies", "user_statistics", "search_movies", "clean_interactions", "fill_missing",
    "validate_interactions", "user_features", "activity_level", "label_encode", "standard_scale",
    "tfidf_unigram", "item_cf_recommend", "user_cf_recommend", "mf_biases", "apply_feedback",
)


def canonical(df):
    df = df[sorted(df.columns)].map(lambda x: "NULL" if x is None or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = canonical(contract.queries()[name](spark, SMALL).toPandas())
    want = canonical(con.execute(contract.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["popular_movies", "user_history", "enrich_recommendations",
                                  "user_similarity_cosine", "user_cf_predict", "movie_stats"])
def test_no_cross_products_and_no_python(spark, name):
    plan = contract.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search(r"PythonUDF|InPandas|InArrow", plan)


def test_scans_read_only_needed_columns(spark):
    plan = contract.queries()["movie_stats"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("l_comment" not in s and "l_extendedprice" not in s for s in schemas)
