import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tastemill.llm import near_dup


def sets(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    found = {i: sets(t) for i, t in rows}
    label = {i: i for i in found}
    links = [
        (a, b) for a, b in combinations(found, 2)
        if found[a] and found[b] and 100 * len(found[a] & found[b]) >= 75 * len(found[a] | found[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if (label[a], label[b]) != (m, m):
                label[a] = label[b] = m
                changed = True
    return {i: (len(found[i]), label[i], label[i] == i) for i in found}


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = ["", None, " \n", "one", "ONE", "two words", "Two  words", "É a b", "é a b", "a b c d e", "a b c d e f"]
    passage = [word() for _ in range(30)]
    for _ in range(30):
        texts.append(" ".join([word() for _ in range(60)] + passage))
    for edits in (1, 2, 3, 4, 6):
        base = [word() for _ in range(150)]
        for _ in range(25):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(150)] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(120)]
    for k in range(12):
        texts.append(" ".join(chain[k * 3 : k * 3 + 80]))
    texts += [texts[-1]] * 20
    return list(enumerate(texts, 3))


def test_same_components_as_all_pairs(docs_of, by_id):
    rows = corpus()
    got = by_id(near_dup.near_duplicates(docs_of(*rows)))
    assert {i: tuple(got[i][c] for c in ("n_shingles", "component_id", "kept")) for i in got} == brute(rows)


def test_rows_with_repeated_or_missing_ids(docs_of):
    text = " ".join(map(str, range(40)))
    docs = docs_of((4, text), (4, text), (9, text), (None, text), (None, None)).selectExpr("*", "1 AS id", "2 AS keys")
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs).collect())
    assert got == [("4", 4, True), ("4", 4, True), ("9", 4, False), ("None", None, True), ("None", None, True)]
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "None", "None"]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_pigeonhole_every_pair_under_the_distance_shares_a_key():
    rng = np.random.default_rng(3)
    places = near_dup.CHUNKS * near_dup.CHUNK
    limit = near_dup.CHUNKS * (near_dup.ERRORS + 1) - 1
    for _ in range(200):
        a = rng.integers(0, 1 << 16, places, dtype=np.uint64)
        b = a.copy()
        b[rng.choice(places, limit, replace=False)] ^= np.uint64(1)
        keys = near_dup.bucket_keys(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])
    unlike = near_dup.bucket_keys(rng.integers(0, 1 << 16, (2, places), dtype=np.uint64))
    assert not set(unlike[0]) & set(unlike[1])


@pytest.mark.parametrize("similarity", [0.6, 0.75, 0.9])
def test_signatures_estimate_similarity(similarity):
    rng = np.random.default_rng(9)
    shared = int(4000 * similarity)
    rest = (4000 - shared) // 2
    x = near_dup.mixed(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    a, b = x[: shared + rest], np.concatenate([x[:shared], x[shared + rest :]])
    same = np.mean(near_dup.signature(a) == near_dup.signature(b))
    assert abs(same - shared / len(x)) < 0.15


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)] + [(1000, k) for k in range(1001, 1100)]
    random.Random(1).shuffle(links)
    got = {r["id"]: r["label"] for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100, 1000} and len(got) == 61 + 3 + 100


def test_slices_do_not_change_the_sets(monkeypatch):
    texts = pa.array([t for _, t in corpus()])
    want = [s.tolist() for s in near_dup.shingle_sets(texts)]
    monkeypatch.setattr(near_dup, "SLICE_BYTES", 700)
    assert [s.tolist() for s in near_dup.shingle_sets(texts)] == want
    assert [len(s) for s in want] == [len(sets(t)) for t in texts.to_pylist()]


def test_texts_under_one_id_are_different_documents(docs_of):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(40))
    docs = docs_of((3, a + " more"), (5, a), (5, b), (7, b), (5, b), (6, None), (6, ""), (8, a))
    got = sorted(tuple(r) for r in near_dup.near_duplicates(docs).collect())
    assert got == sorted([
        (3, 37, 3, True), (5, 36, 3, False), (5, 36, 5, True), (5, 36, 5, True), (7, 36, 5, False),
        (6, 0, 6, True), (6, 0, 6, True), (8, 36, 3, False),
    ])
    kept = sorted((r["doc_id"], r["text"] or "") for r in near_dup.keep_first(docs).collect())
    assert kept == [(3, a + " more"), (5, b), (6, ""), (6, "")]


def test_a_third_of_all_rows_under_one_id(docs_of, spark):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, prose(k)) for k in range(50)] + [(1, prose(0))] * 50 + [(k, prose(k)) for k in range(2, 60)]
    docs = docs_of(*rows)
    kept = sorted((r["doc_id"], r["text"]) for r in near_dup.keep_first(docs).collect())
    assert kept == sorted({(1, prose(k)) for k in range(50)} | {(k, prose(k)) for k in range(50, 60)})
    assert near_dup.near_duplicates(docs).count() == len(rows)


def test_the_same_row_of_equal_texts_is_kept(docs_of):
    text = " ".join(map(str, range(40)))
    docs = docs_of(*[(4, text, f"host{i}") for i in range(20)])
    kept = {near_dup.keep_first(docs.repartition(n, "source")).first()["source"] for n in (1, 3, 7)}
    assert len(kept) == 1 and near_dup.keep_first(docs).count() == 1
