import pytest
from pyspark.sql import functions as F

from tastemill.llm import mixing


def shares(sizes):
    """Targets by sharing again until none is above three times its source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        open_weight = sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / open_weight for s in sizes}
        above = {s for s in sizes if target[s] > 3 * sizes[s] + 1e-9}
        if not above:
            return target
        capped |= above


def corpus():
    rows, i = [], 0
    for source, docs, base in (("a", 700, 20), ("b", 90, 40), ("é", 30, 10), ("z", 4, 5), (None, 200, 7)):
        for k in range(docs):
            rows.append((i, " ".join(["w"] * (base + k % 13)), source))
            i += 1
    return rows


def test_targets_copies_and_reruns(docs_of, by_id):
    rows = [*corpus(), (9000, None, "a"), (9001, "", None)]
    docs = docs_of(*rows)
    got = by_id(mixing.mixture(docs))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = shares(sizes)
    taken = {s: 0 for s in sizes}
    for i, text, source in rows:
        r = got[i]
        assert r["size"] == len((text or "").split()) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for source in sizes:
        assert abs(taken[source] - want[source]) <= max(0.03 * want[source], 60)
    assert got == by_id(mixing.mixture(docs.repartition(7)))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["taken"] // r["size"] for r in got.values() if r["size"]) + sum(
        1 for r in mixed.where("doc_id >= 9000").collect())


def test_more_buckets_give_the_same_mix(docs_of, by_id, monkeypatch):
    docs = docs_of(*corpus())
    want = by_id(mixing.mixture(docs))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    assert by_id(mixing.mixture(docs)) == want


def test_degenerate_tables(docs_of):
    assert mixing.mixture(docs_of((1, "a", "s")).limit(0)).count() == 0
    assert [tuple(r) for r in mixing.mixture(docs_of((1, None, None))).collect()] == [(1, 0, 0, 0.0, 0)]
    twice = mixing.mixture(docs_of((1, "a b", "s"), (1, "a b", "s")))
    assert sum(r["taken"] for r in twice.collect()) == 4


def test_size_class_is_monotone(spark):
    rows = spark.range(5000).withColumn("c", mixing.size_class(F.col("id")))
    classes = [r["c"] for r in rows.orderBy("id").collect()]
    assert classes == sorted(classes) and len(set(classes)) < 200
