import numpy as np
import pytest

from tastemill.functions import products
from tastemill.functions.products import dot_products, grid_top_k


def matrix(seed, users=17, items=9, density=0.5):
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((users, items)) < density, rng.integers(1, 40, (users, items)) / 8, 0)
    m[:, 0] = 1.0  # one key everybody has
    return m


def cells(spark, m):
    data = [(f"u{i:02d}", f"m{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame(data, "user_id string, movie_id string, rating double")


@pytest.mark.parametrize("limit,tile", [(1000, 1024), (3, 4), (0, 2)])
def test_dot_products_exact_on_both_paths(spark, limit, tile):
    m = matrix(1)
    got = dot_products(cells(spark, m), degree_limit=limit, tile_rows=tile, block_keys=2)
    want = m @ m.T
    found = {(r.id_a, r.id_b): r.dot for r in got.collect()}
    assert len(found) == 17 * 16 // 2
    for (a, b), d in found.items():
        assert a < b and d == pytest.approx(want[int(a[1:]), int(b[1:])])


@pytest.mark.parametrize("limit", [1000, 2])
def test_dot_products_of_targets(spark, limit):
    m = matrix(2)
    table = cells(spark, m)
    chosen = table.where("user_id in ('u03', 'u05')")
    got = dot_products(chosen, table, degree_limit=limit, tile_rows=3, block_keys=2).collect()
    want = m @ m.T
    assert {r.id_a for r in got} == {"u03", "u05"} and len(got) == 2 * 16
    for r in got:
        assert r.dot == pytest.approx(want[int(r.id_a[1:]), int(r.id_b[1:])])


def vectors(spark, m):
    return spark.createDataFrame(
        [(f"v{i:02d}", [float(x) for x in row]) for i, row in enumerate(m)],
        "id string, vec array<double>",
    )


@pytest.mark.parametrize("tile", [3, 100])
def test_grid_top_k_matches_brute_force(spark, tile):
    rng = np.random.default_rng(5)
    m = rng.integers(0, 3, (14, 4)).astype(float)  # many ties
    table = vectors(spark, m)
    gone = spark.createDataFrame([("v00", "v01"), ("v02", "v13"), ("zz", "v01")], "id string, other_id string")
    got = grid_top_k(table, table, 4, exclude=gone, tile_rows=tile)
    skip = {("v00", "v01"), ("v02", "v13")}
    want = set()
    for i in range(14):
        ranked = sorted(
            (-(m[i] @ m[j]), f"v{j:02d}")
            for j in range(14)
            if j != i and (f"v{i:02d}", f"v{j:02d}") not in skip
        )
        want |= {(f"v{i:02d}", o, -s, r + 1) for r, (s, o) in enumerate(ranked[:4])}
    assert {(r.id, r.other_id, r.score, r["rank"]) for r in got.collect()} == want


@pytest.mark.parametrize("busy", [5_000, 5])
def test_pairs_are_formed_after_the_shuffle(spark, monkeypatch, busy):
    monkeypatch.setattr(products, "BUSY_ROW", busy)
    m = matrix(3)
    table = cells(spark, m).unionByName(cells(spark, m[:2]))  # two rows hold their keys twice
    got = dot_products(table, largest=19)
    scaled = m * np.where(np.arange(17) < 2, 2, 1)[:, None]
    found = {(r.id_a, r.id_b): r.dot for r in got.collect()}
    assert len(found) == got.count() == 17 * 16 // 2
    for (a, b), d in found.items():
        assert a < b and d == pytest.approx((scaled @ scaled.T)[int(a[1:]), int(b[1:])])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id_a" in plan and "Generate inline" in plan


def test_tiles_do_not_grow_with_the_rows():
    for width in (64, 100):
        small, large = (products._grid_shape(n, n, width, None) for n in (20_000, 240_000))
        assert small == large and small[0] * small[1] >= products.GROUPS
    assert products._grid_shape(10, 1_000_000, 64, None)[0] == 1
    lt, rt = products._grid_shape(4_000_000, 4_000_000, 64, None)
    assert 4_000_000 / lt * 64 * 8 <= products.TILE_BYTES and lt == rt


def test_columns_are_seen_in_growing_steps(monkeypatch):
    monkeypatch.setattr(products, "FIRST_COLUMNS", 3)
    monkeypatch.setattr(products, "COLUMNS", 8)
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 3, (5, 3)).astype(float), rng.integers(0, 3, (40, 3)).astype(float)
    b[37] = np.nan
    i, j = np.array([0, 0, 4]), np.array([0, 39, 12])
    row, col, score = products._block_top_k(a, b, 6, i, j, (0.0, 5.0))
    want = np.clip(a @ b.T, 0.0, 5.0)
    want[i, j] = np.nan
    for r in range(5):
        best = sorted((-s, c) for c, s in enumerate(want[r]) if not np.isnan(s))[:6]
        assert list(zip(-score[row == r], col[row == r])) == best
