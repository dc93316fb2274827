"""Recommendations in tiles of users, against a dense brute-force calculation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.operators import cf
from tastemill.operators import neighbour_tiles as nt

N, K = 4, 3


def tables(spark):
    """Two components of very different size, a user alone, a movie outside the universe."""
    rng = np.random.default_rng(11)
    rows = []
    for base, users, movies in ((0, 30, 24), (100, 6, 8)):
        for u in range(users):
            for m in rng.choice(movies, 5, replace=False):
                rows.append((f"u{base + u}", f"m{base + m}", float(rng.integers(1, 41)) / 8))
    rows += [("alone", "m500", 2.0), ("u3", "outside", 5.0), ("u4", "outside", 4.0)]
    cells = spark.createDataFrame(rows, "user_id string, movie_id string, rating double")
    names = [(f"m{i}",) for i in [*range(24), *range(100, 108), 500, 501]]
    return cells, spark.createDataFrame(names, "movie_id string")


def rows_of(recs):
    return {(r.user_id, r.movie_id, round(r.score, 7), r["rank"]) for r in recs.collect()}


def dense(cells, items):
    rated = {(r.user_id, r.movie_id): r.rating for r in cells.collect()}
    listed = {r.movie_id for r in items.collect()}
    users, movies = sorted({u for u, _ in rated}), sorted({m for _, m in rated} | listed)
    m = np.zeros((len(users), len(movies)))
    for (u, o), x in rated.items():
        m[users.index(u), movies.index(o)] = x
    return m, users, movies, listed


def unit(m):
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    return m @ m.T


def brute(method, cells, items):
    m, users, movies, listed = dense(cells, items)
    mean, sims, out = m.sum(axis=1) / len(listed), unit(m if method == "user" else m.T), set()
    for i, u in enumerate(users):
        ranked = []
        for j, o in enumerate(movies):
            if m[i, j] > 0 or (method == "user" and o not in listed):
                continue
            if method == "user":
                sim, value, rows = sims[i], m[:, j] - mean, np.flatnonzero(m[:, j])
            else:
                sim, value, rows = sims[j], m[i], np.flatnonzero(m[i])
            near = sorted((-round(sim[v], 9), v) for v in rows if sim[v] > 0)[:K]
            near = [v for _, v in near]
            score = mean[i] if method == "user" else 0.0
            if near:
                score = (sim[near] * value[near]).sum() / sim[near].sum()
                score = np.clip(score + (mean[i] if method == "user" else 0), 0, 5)
            if score > 0:
                ranked.append((-round(score, 9), o, score))
        out |= {(u, o, round(x, 7), r + 1) for r, (_, o, x) in enumerate(sorted(ranked)[:N])}
    return out


@pytest.mark.parametrize("method", ["user", "item"])
@pytest.mark.parametrize("resident,user_work", [(4_000_000, 10**9), (8, 10**9), (4_000_000, 150)])
def test_tiles_match_brute_force(spark, monkeypatch, method, resident, user_work):
    """In one piece, with components cut up, and with busy users left to the joins."""
    monkeypatch.setattr(nt, "RESIDENT_CELLS", resident)
    monkeypatch.setattr(nt, "USER_WORK", user_work)
    monkeypatch.setattr(nt, "BLOCK_ROWS", 40)
    monkeypatch.setattr(nt, "KEPT_PAIRS", 30)
    cells, items = tables(spark)
    recommend = cf.user_cf_recommend if method == "user" else cf.item_cf_recommend
    assert rows_of(recommend(cells, items, N, K)) == brute(method, cells, items)


def test_only_the_best_rows_of_a_user_leave_a_tile(spark):
    cells, items = tables(spark)
    data = nt.coded(cells, items)
    tiles, count = nt.user_tiles(data.cells, nt.user_work(data.cells), 2)
    for method, most in (("user", 2 * N), ("item", N)):
        scored = nt.tile_scores(data, tiles, count, method, N, K)
        assert max(r["count"] for r in scored.groupBy("u").count().collect()) <= most


def test_a_tile_of_one_component_reaches_no_other(spark, monkeypatch):
    monkeypatch.setattr(nt, "RESIDENT_CELLS", 152)
    data = nt.coded(*tables(spark))
    tiles, _ = nt.user_tiles(data.cells, nt.user_work(data.cells), 1)
    reached = nt._rows_of_tiles(data.cells, tiles).join(data.users, "u").collect()
    of = {}
    for r in reached:
        of.setdefault(r.tile, set()).add("large" if r.user_id[1:].isdigit() and int(r.user_id[1:]) < 100 else "small")
    assert len(of) > 1 and all(len(kinds) == 1 for kinds in of.values())


def test_no_cells(spark):
    cells, items = tables(spark)
    assert cf.user_cf_recommend(cells.where("false"), items, N).count() == 0
    assert cf.item_cf_recommend(cells.where("false"), items, N).count() == 0


def test_settled_movies_spare_the_other_neighbours(spark, monkeypatch):
    """Most movies are settled by the nearest users; rare ones are looked up; ties go by id."""
    rng = np.random.default_rng(5)
    rows = [
        (f"u{u:03}", f"m{m:02}", float(rng.integers(1, 5)))
        for u in range(150) for m in rng.choice(10, 4, replace=False)
    ]
    rows += [("u000", "rare", 3.0), ("u001", "rare", 1.0), ("u002", "rarer", 5.0)]
    cells = spark.createDataFrame(rows, "user_id string, movie_id string, rating double")
    items = cells.select("movie_id").distinct()
    formed = []
    whole = nt._nearest
    monkeypatch.setattr(nt, "_nearest", lambda group, *rest: formed.append(len(group)) or whole(group, *rest))
    data = nt.coded(cells, items)
    tile_rows = nt._rows_of_tiles(data.cells, nt.user_tiles(data.cells, nt.user_work(data.cells), 1)[0].withColumn(
        "tile", F.lit(0))).toArrow()
    tile = nt._Tile(tile_rows)
    movies = {r.m: r.movie_id for r in data.movies.collect()}
    users = {r.u: r.user_id for r in data.users.collect()}
    best = {}
    for u, m, s in nt._user_based(tile, K, N, data.n_items):
        best.setdefault(users[tile.users[u]], []).extend(zip(-np.round(s, 9), (movies[x] for x in m), s))
    got = {
        (u, o, round(float(s), 7), r + 1) for u, found in best.items() for r, (_, o, s) in enumerate(sorted(found)[:N])
    }
    assert got == brute("user", cells, items)
    assert sum(formed) < 150 * len(rows) / 2  # about all cells per user before


@pytest.mark.parametrize("few,block,work", [(0, 300_000, 10**8), (1000, 300_000, 10**8), (1000, 40, 50)])
def test_few_movies_match_brute_force(spark, monkeypatch, few, block, work):
    """With cells in the tiles, and with the similarities of all movies in few and in many tiles."""
    monkeypatch.setattr(nt, "FEW_MOVIES", few)
    monkeypatch.setattr(nt, "BLOCK_ROWS", block)
    monkeypatch.setattr(nt, "FEW_WORK", work)
    cells, items = tables(spark)
    assert rows_of(cf.item_cf_recommend(cells, items, N, K)) == brute("item", cells, items)


def test_few_movies_send_no_cells_of_other_users(spark, monkeypatch):
    """Tiles used to get the cells of every user they reach: here nearly all of them, in each tile."""
    rows = [(f"u{u}", f"m{(u + i) % 6}", 1.0 + (u + i) % 4) for u in range(200) for i in (0, 1, 3)]
    cells = spark.createDataFrame(rows, "user_id string, movie_id string, rating double")
    data = nt.coded(cells, cells.select("movie_id").distinct())
    lists = {r.id: list(r.ms) for r in nt.movie_lists(data.cells).collect()}
    assert sorted(lists) == list(range(6)) and all(m not in ms for m, ms in lists.items())
    asked = data.users.where("u < 20")
    scored = nt.few_movies_scores(data, asked, N, K).collect()
    assert {r.u for r in scored} == set(range(20))
    assert nt.few_movies_scores(data, data.users.where("false"), N, K).count() == 0


@pytest.mark.parametrize("high", [5.0, 3.0])
def test_the_best_movies_are_found_without_scoring_all(spark, monkeypatch, high):
    """Many movies tie at the best score; few are scored from their raters, ties go by id."""
    monkeypatch.setattr(nt, "FEW_MOVIES", 0)
    monkeypatch.setattr(nt, "_search_pays", lambda *_: True)
    rng = np.random.default_rng(3)
    rows = [
        (f"u{u:02}", f"m{m:03}", min(high, float(rng.integers(1, 48)) / 8))
        for u in range(40) for m in rng.choice(120, 12, replace=False)
    ] + [("u03", "outside", 5.0), ("u04", "outside", 4.0)]
    cells = spark.createDataFrame(rows, "user_id string, movie_id string, rating double")
    items = spark.createDataFrame([(f"m{m:03}",) for m in range(120)], "movie_id string")
    data = nt.coded(cells, items)
    movies = {r.m: r.movie_id for r in data.movies.collect()}
    users = {r.u: r.user_id for r in data.users.collect()}
    own = data.users.select("u", F.lit(0).cast("bigint").alias("tile"))
    for method, run, wanted in (("user", nt._user_based, {"best_first": True}), ("item", nt._item_based, {})):
        tile = nt._Tile(nt._rows_of_all(data.cells, own, 1, bool(wanted)).orderBy("u").toArrow())
        scored, searched = {}, []
        whole = nt._best_promised
        monkeypatch.setattr(nt, "_best_promised", lambda *a: searched.append(whole(*a)) or searched[-1])
        for u, found, scores in run(tile, K, N, data.n_items, **wanted):
            scored.setdefault(users[tile.users[u]], []).extend(zip(-np.round(scores, 9), found, scores))
        monkeypatch.setattr(nt, "_best_promised", whole)
        got = {
            (u, movies[o], round(float(x), 7), r + 1)
            for u, best in scored.items() for r, (_, o, x) in enumerate(sorted(best)[:N])
        }
        assert got == brute(method, cells, items)
        assert sum(x is not None for x in searched) > 30


def test_tiles_are_no_more_than_keep_the_cores_busy(spark, monkeypatch):
    """Every tile is a copy of all cells: their number used to grow with the work."""
    monkeypatch.setattr(nt, "TILE_WORK", 5)
    data = nt.coded(*tables(spark))
    assert nt.user_tiles(data.cells, nt.user_work(data.cells), 2)[1] <= 4
