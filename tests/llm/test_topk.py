import random

import numpy as np
import pytest

from tastemill.llm import topk


def brute(rows, k, every):
    known = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            known[i] = np.floor(64 * np.array(v, np.float32).astype(float)).astype(object)
    out = []
    for q in known:
        if q % every == 0:
            scores = [(-int(known[q] @ known[c]), c) for c in known if c != q and len(known[c]) == len(known[q])]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.fixture
def vectors():
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[40][1]) for i in range(60)]  # ties beyond k
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (304, [])]
    rows += [(320, [1.0, 2.0]), (321, [3.0, -1.0]), (340, [-0.5] * 7), (None, [0.1] * 6)]
    return rows


@pytest.mark.parametrize("blocks", [(2048, 16384), (3, 16)])
def test_against_brute_force(spark, vectors, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "VECTOR_BLOCK", blocks[1])
    assert found(topk.top_k(table(spark, vectors))) == brute(vectors, 20, 20)


def test_few_rows_repeats_and_large_values(spark):
    rows = [(0, [2e7, -3e7]), (1, [5e7, 1e7]), (1, [5e7, 1e7]), (20, [0.0, 0.0])]
    assert found(topk.top_k(table(spark, rows), k=5)) == brute(rows, 5, 20)
    assert topk.top_k(table(spark, rows).limit(0)).count() == 0
    assert topk.top_k(table(spark, rows[:1])).count() == 0
