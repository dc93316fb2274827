import duckdb
import pytest

import corpus_pipeline
from tastemill.llm import queries

SMALL = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages conversations".split()


def canonical(df):
    df = df[sorted(df.columns)].map(lambda x: "NULL" if x is None or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = canonical(queries.QUERIES[name](spark, SMALL).toPandas())
    want = canonical(con.execute(queries.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_stages_keep_the_columns_and_take_effect(spark, docs_of):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(i, prose(i), "a") for i in range(40)] + [(100 + i, prose(0), "b") for i in range(5)]
    rows += [(200, "too short", "a"), (201, prose(9) + " mail x@y.org", "b"), (202, None, None)]
    docs = docs_of(*rows).selectExpr("*", "1 AS copies", "2 AS spans")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").checkpoint()
        assert docs.columns[-2:] == ["copies", "spans"]
        seen[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {i for i, _ in seen["quality_rules"]} == {i for i, *_ in rows} - {200, 202}
    assert {i for i, _ in seen["near_duplicates"]} == set(range(40))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in seen["mix_sources"]}
    assert corpus_pipeline.run(spark, SMALL).count() > 0
