"""Neighbourhood models against a dense brute-force calculation."""

import numpy as np
import pytest

from tastemill.functions import skew
from tastemill.operators import cf, matrix

USERS, ITEMS, K = 9, 11, 5


def table(seed):
    rng = np.random.default_rng(seed)
    m = np.where(
        rng.random((USERS, ITEMS)) < 0.45, rng.integers(1, 41, (USERS, ITEMS)) / 8.0, 0.0
    )
    m[:, ITEMS - 1] = 0  # a movie nobody rated
    m[0, :] = 0
    m[0, 2] = 4.0  # a user with one rating
    return m


def user(i):
    return f"u{i}"


def movie(j):
    return f"m{j:02d}"


def cells_of(spark, m):
    data = [(user(i), movie(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame(data, "user_id string, movie_id string, rating double")


def items_of(spark):
    return spark.createDataFrame([(movie(j),) for j in range(ITEMS)], "movie_id string")


def cosine(m):
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return unit @ unit.T


def brute_user(m, i, j):
    sim, mean = cosine(m)[i], m.mean(axis=1)
    near = sorted((-round(sim[v], 9), v) for v in range(USERS) if v != i and m[v, j] > 0)[:K]
    weight = sum(abs(sim[v]) for _, v in near)
    if weight == 0:
        return mean[i]
    return min(5, max(0, mean[i] + sum(sim[v] * (m[v, j] - mean[v]) for _, v in near) / weight))


def brute_item(m, i, j):
    sim = cosine(m.T)[j]
    near = sorted((-round(sim[o], 9), o) for o in range(ITEMS) if o != j and m[i, o] > 0)[:K]
    weight = sum(abs(sim[o]) for _, o in near)
    return 0.0 if weight == 0 else sum(sim[o] * m[i, o] for _, o in near) / weight


def brute_top(m, score, n):
    out = set()
    for i in range(USERS):
        ranked = sorted(
            (-round(score(m, i, j), 9), movie(j)) for j in range(ITEMS) if m[i, j] == 0
        )
        ranked = [x for x in ranked if x[0] < 0][:n]
        out |= {(user(i), o, round(-s, 6), r + 1) for r, (s, o) in enumerate(ranked)}
    return out


def top(recs):
    return {(r.user_id, r.movie_id, round(r.score, 6), r["rank"]) for r in recs.collect()}


@pytest.fixture(params=["plain", "hot"])
def paths(request, monkeypatch):
    """Run with ordinary keys, and with every key treated as hot."""
    if request.param == "hot":
        monkeypatch.setattr(cf, "DEGREE_LIMIT", 1)
        monkeypatch.setattr(cf.cosine, "__defaults__", (None, 1, None))
        monkeypatch.setattr(skew, "HOT_FLOOR", 0)
        monkeypatch.setattr(skew.hot_keys, "__defaults__", (0.001, 0))
    return request.param


def test_predictions(spark, paths):
    m = table(3)
    cells, items = cells_of(spark, m), items_of(spark)
    pairs = spark.createDataFrame(
        [(user(i), movie(j)) for i in range(USERS) for j in range(ITEMS)] + [("nobody", "m00")],
        "user_id string, movie_id string",
    )
    by_user = {(r[0], r[1]): r[2] for r in cf.user_cf_predict(cells, pairs, items).collect()}
    by_item = {(r[0], r[1]): r[2] for r in cf.item_cf_predict(cells, pairs, items).collect()}
    assert by_user.pop(("nobody", "m00")) == 0.0 and by_item.pop(("nobody", "m00")) == 0.0
    for i in range(USERS):
        for j in range(ITEMS):
            assert by_user[user(i), movie(j)] == pytest.approx(brute_user(m, i, j))
            assert by_item[user(i), movie(j)] == pytest.approx(brute_item(m, i, j))


@pytest.mark.parametrize("n", [2, 8])
def test_recommendations(spark, paths, n):
    m = table(4)
    cells, items = cells_of(spark, m).repartition(3), items_of(spark)
    assert top(cf.user_cf_recommend(cells, items, n)) == brute_top(m, brute_user, n)
    assert top(cf.item_cf_recommend(cells, items, n)) == brute_top(m, brute_item, n)


def test_targets_give_the_same_rows(spark):
    m = table(5)
    cells, items = cells_of(spark, m), items_of(spark)
    some = spark.createDataFrame([("u1",), ("u4",), ("nobody",)], "user_id string")
    for recommend, score in ((cf.user_cf_recommend, brute_user), (cf.item_cf_recommend, brute_item)):
        want = {r for r in brute_top(m, score, 3) if r[0] in ("u1", "u4")}
        assert top(recommend(cells, items, 3, targets=some)) == want


def test_pearson_matches_numpy(spark):
    m = table(6)
    cells = cells_of(spark, m)
    pairs = spark.createDataFrame(
        [(user(a), user(b)) for a in range(USERS) for b in range(USERS) if a != b],
        "id_a string, id_b string",
    )
    n = matrix.item_count(items_of(spark))
    want = np.corrcoef(m)
    got = cf.user_similarity_pearson(cells, n, pairs).collect()
    assert len(got) == USERS * (USERS - 1)
    for r in got:
        assert r.sim == pytest.approx(want[int(r.id_a[1:]), int(r.id_b[1:])])


def test_pearson_predictions(spark):
    m = table(7)
    cells, items = cells_of(spark, m), items_of(spark)
    sim, mean = np.corrcoef(m), m.mean(axis=1)
    pairs = cells.select("user_id", "movie_id")
    for r in cf.user_cf_predict(cells, pairs, items, metric="pearson").collect():
        i, j = int(r.user_id[1:]), int(r.movie_id[1:])
        near = sorted((-round(sim[i, v], 9), v) for v in range(USERS) if v != i and m[v, j] > 0)[:K]
        weight = sum(abs(sim[i, v]) for _, v in near)
        want = mean[i]
        if weight:
            want += sum(sim[i, v] * (m[v, j] - mean[v]) for _, v in near) / weight
            want = min(5, max(0, want))
        assert r.score == pytest.approx(want)


def test_similarity_is_symmetric_under_order(spark):
    cells = cells_of(spark, table(8))
    a = {(r[0], r[1]): r[2] for r in cf.user_similarity_cosine(cells).collect()}
    b = {(r[0], r[1]): r[2] for r in cf.user_similarity_cosine(cells.orderBy("rating")).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_unrated_candidates(spark):
    m = table(9)
    cells = cells_of(spark, m)
    users = spark.createDataFrame([(user(i),) for i in range(USERS)] + [("new",)], "user_id string")
    got = {tuple(r) for r in matrix.unrated_candidates(users, items_of(spark), cells).collect()}
    want = {(user(i), movie(j)) for i in range(USERS) for j in range(ITEMS) if m[i, j] == 0}
    assert got == want | {("new", movie(j)) for j in range(ITEMS)}


def test_batch_limits(spark):
    users = spark.range(101).selectExpr("cast(id as string) user_id")
    with pytest.raises(ValueError):
        cf.batch_recommend(lambda u, n: u, users)
    with pytest.raises(ValueError):
        cf.batch_recommend(lambda u, n: u, users.limit(3), 21)


def test_unrated_candidates_expand_last(spark):
    """Whatever the blocks; no row of the result goes through a join or a shuffle."""
    rows = [(f"u{u}", f"m{m:02}", 1.0) for u in range(5) for m in range(u, 23, u + 1)]
    cells = spark.createDataFrame(rows, "user_id string, movie_id string, rating double")
    items = spark.createDataFrame([(f"m{m:02}",) for m in range(23)], "movie_id string")
    users = spark.createDataFrame([(f"u{u}",) for u in range(7)], "user_id string")
    rated = {(u, m) for u, m, _ in rows}
    want = sorted((f"u{u}", f"m{m:02}") for u in range(7) for m in range(23) if (f"u{u}", f"m{m:02}") not in rated)
    for block in (1, 4, 23, 100):
        out = matrix.unrated_candidates(users, items, cells, block)
        assert sorted(tuple(r) for r in out.collect()) == want
    plan = matrix.unrated_candidates(users, items, cells)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")
