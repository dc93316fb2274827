import numpy as np
import pytest

from tastemill.llm import embed_dup


def brute(rows, limit=0.98):
    """Links, components and verdicts by comparing all rows of a label."""
    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    near = [[] for _ in range(n)]
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v) else None for _, v, _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and units[i] is not None and units[j] is not None and rows[i][2] is not None:
                if rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= limit:
                    near[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        own = rows[i][0]
        least = None if own is None else min([rows[j][0] for j in seen if rows[j][0] is not None])
        out.append((own, len(near[i]), least, own is None or own == least))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(
        [(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, node string, x int"
    )


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def unit(v):
    return (v / np.linalg.norm(v)).tolist()


@pytest.fixture(scope="module")
def planted():
    """Groups of near copies close to the limit, a hot label, copies, and rows that take no part."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        centre = rng.normal(size=32)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.integers(1, 9))):
            noise = rng.normal(size=32)
            rows.append((len(rows), unit(centre + noise / np.linalg.norm(noise) * rng.uniform(0.02, 0.25)), 0 if k % 3 else k % 5))
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(150)]
    rows += [(2000 + i, [3.0 * x for x in rows[7][1]], rows[7][2]) for i in range(2)]
    rows += [(3000, None, 0), (3001, [None] * 32, 0), (3002, [0.0] * 32, 0), (3003, [float("nan")] * 32, 0),
             (3004, [], 0), (3005, rows[3][1], None), (None, rows[3][1], rows[3][2]), (3006, [1.0, 0.0], 0),
             (3007, [1.0, 0.01], 0), (3008, [-0.0, 1.0], 0), (3009, [0.0, 1.0], 0), (3, rows[9][1], 4), (3, rows[9][1], 4)]
    return rows


@pytest.mark.parametrize("tile", [16384, 16])
def test_against_brute_force(spark, planted, monkeypatch, tile):
    monkeypatch.setattr(embed_dup, "TILE_ROWS", tile)
    monkeypatch.setattr(embed_dup, "SLICE", 100 if tile == 16 else 1 << 20)
    monkeypatch.setattr(embed_dup, "PROBES", 5 if tile == 16 else 1024)
    got = found(embed_dup.near_vectors(table(spark, planted)))
    assert got == brute(planted)
    assert sum(r[1] > 0 for r in got) > 150


def test_tiles_split_hot_buckets(spark, planted):
    nodes = embed_dup.nodes_of(table(spark, planted))
    rows = embed_dup.table_rows(nodes, embed_dup.learn(nodes), 0.98)
    one = {tuple(r) for r in embed_dup.candidates(rows, 0.98, 16384).collect()}
    assert one == {tuple(r) for r in embed_dup.candidates(rows, 0.98, 3).collect()}


def test_rotation_is_orthonormal_and_lowers_the_quantisation_error():
    rng = np.random.default_rng(1)
    x = embed_dup.units(rng.normal(size=(600, 4)) @ rng.normal(size=(4, 24)) + 0.2 * rng.normal(size=(600, 24)))

    def error(turn):
        v = turn.values(x)
        scale = np.abs(v).mean()
        return ((v - scale * np.sign(v)) ** 2).sum() / (v**2).sum()

    start, learnt = embed_dup.fit(x, iterations=0), embed_dup.fit(x)
    assert np.allclose(learnt.axes.T @ learnt.axes, np.eye(24))
    assert error(learnt) < error(start)
    share = (learnt.values(x) >= 0).mean(axis=0)
    assert share.min() > 0.3 and share.max() < 0.7


def test_flips_are_all_sets_within_the_budget():
    values = np.random.default_rng(3).normal(size=(5, 7)).astype(np.float32)
    row, mask, wide = embed_dup.flips(values, 0.9)
    want = {
        (i, m) for i in range(5) for m in range(128)
        if sum(float(values[i, j]) ** 2 for j in range(7) if m >> j & 1) <= 0.9
    }
    assert set(zip(row.tolist(), mask.tolist())) == want and len(row) == len(want) and not len(wide)
    row, _, wide = embed_dup.flips(values, 0.9, most=4)
    sizes = [sum(i == k for i, _ in want) for k in range(5)]
    assert wide.tolist() == [k for k in range(5) if sizes[k] > 4] and set(row) == set(range(5)) - set(wide)


def test_wide_and_flat_vectors(spark):
    rng = np.random.default_rng(9)
    base = [unit(rng.normal(size=200)) for _ in range(6)]
    rows = [(10 * k + i, unit(np.array(b) + rng.normal(size=200) * 0.012), k % 2) for k, b in enumerate(base) for i in range(4)]
    rows += [(500 + i, unit(np.eye(12)[i % 12]), 7) for i in range(24)]
    rows += [(600 + i, [1e300 * (1 + i / 1e6), 1e300], 8) for i in range(3)] + [(700 + i, [1e-30, 2e-30], 8) for i in range(2)]
    scaled = [(i, [x / 1e300 for x in v] if max(map(abs, v)) > 1e200 else v, lab) for i, v, lab in rows]
    assert found(embed_dup.near_vectors(table(spark, rows))) == brute(scaled)


def test_empty_table(spark):
    assert embed_dup.near_vectors(table(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
