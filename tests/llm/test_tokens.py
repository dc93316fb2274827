import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tastemill.llm import packing, token_store
from tastemill.llm.tokens import WordEncoder

TEXTS = [
    "", None, " \t\n ", "<|endoftext|>hi <|startoftext|>", "a<|endoftext|>b", "Ünïcödé ÀÉÎ ß ẞ İI ǅ ﬁ",
    "é ́x Å", "don't I'LL 've 'S x's", "日本語 テスト　全角 a b", "\x1c\x1d\x85 a\x1fb\x00c",
    "😀👨‍👩‍👧 12345 ½ ²", "Σας ΟΔΟΣ", "÷×µªº ¼", "a" * 5000, "<| |> <|x", "​zero​ ﻿", "'''s '''",
    "word " * 5000, "ordinary, words. (here) 3x",
]


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = WordEncoder().tokenizer
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("cached", [3, 400_000])
def test_encoder_equals_the_tokenizer(ids_of, cached):
    encoder = WordEncoder(cached=cached)
    for _ in range(2):
        got = [ids.tolist() for _, ids in encoder.documents(pa.array(TEXTS), 9)]
        assert got == [[*ids_of(t), 9] for t in TEXTS]


def test_shard_gives_any_token():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 1 << k, 700) for k in (4, 8, 9, 16, 17, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    cuts = np.array([0, 0, 5, 513, 4000, len(ids)])
    shard = token_store.Shard(token_store.encode_shard(np.arange(5), cuts, ids))
    assert [shard.token(i) for i in range(len(ids))] == ids.tolist()
    for a, b in zip(cuts, cuts[1:]):
        assert (shard.slice(a, b) == ids[a:b]).all()
    for a in range(0, 1100, 37):
        assert (shard.slice(a, a + 530) == ids[a : a + 530]).all()
    empty = token_store.Shard(token_store.encode_shard(np.zeros(0, int), np.zeros(1, int), np.zeros(0, int)))
    assert empty.tokens == 0


def test_files_round_trip_in_id_order(docs_of, ids_of, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_TOKENS", 300)
    rows = [(7 * i % 19 - 3, t) for i, t in enumerate(TEXTS)]
    got = sorted(tuple(r) for r in token_store.round_trip(docs_of(*rows)).collect())
    want, start = [], 0
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*ids_of(text), 2]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_files_with_repeated_and_missing_ids(docs_of):
    got = token_store.round_trip(docs_of((5, "x y"), (5, "x y"), (None, "z"))).collect()
    assert sorted((r["start"], str(r["doc_id"])) for r in got) == [(0, "None"), (2, "5"), (5, "5")]
    assert token_store.round_trip(docs_of((1, "x")).limit(0)).count() == 0


def test_pieces_and_places(docs_of, ids_of):
    rows = [*enumerate(TEXTS), (3, "again"), (None, "no id")]
    got = packing.pack(docs_of(*rows)).collect()
    of_text = defaultdict(list)
    for r in got:
        of_text[r["doc_id"]].append((r["start"], r["piece"], r["length"], r["ids_crc32"]))
    for i in {i for i, _ in rows}:
        want = []
        for _, text in (r for r in rows if r[0] == i):
            ids = [*ids_of(text), 0]
            want += [(a, a // 2048, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for a in range(0, len(ids), 2048)]
        assert sorted(of_text[i]) == sorted(want)
    full(got, 2048)
    assert packing.pack(docs_of((1, "x")).limit(0)).count() == 0


def full(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("seed", range(4))
def test_program_is_near_the_lower_bound(seed):
    rng = np.random.default_rng(seed)
    kinds = [rng.integers(1, 257, 5000), np.minimum(256, rng.geometric(0.01, 5000)), rng.integers(60, 140, 5000),
             np.array([256, 128, 129, 127, 1])]
    counts = np.bincount(kinds[seed], minlength=257)
    groups = packing.solve(counts, 256, 200)
    back = np.zeros_like(counts)
    for held, many in groups:
        assert sum(k * n for k, n in held.items()) <= 256
        for length, n in held.items():
            back[length] += n * many
    assert (back == counts).all()
    bins = sum(many for _, many in groups)
    large = int((counts[129:]).sum())
    lower = max(-(-int((counts * np.arange(257)).sum()) // 256), large)
    assert bins <= 1.05 * lower + 1


def test_runs_hand_out_every_rank_once():
    groups = [({5: 2, 3: 1}, 4), ({3: 4}, 2), ({5: 1}, 1)]
    plan = packing.runs(groups)
    lengths = np.array([5] * 9 + [3] * 12)
    ranks = np.concatenate([np.arange(9), np.arange(12)])
    sequence, offset = plan.place(lengths, ranks)
    full([dict(sequence_id=s, offset=o, length=n) for s, o, n in zip(sequence, offset, lengths)], 13)
    assert len(set(zip(sequence, offset))) == 21


def test_knapsack_takes_the_best_configuration():
    price = np.zeros(11)
    price[[3, 4, 6]] = [3, 4.5, 6]
    held = packing.filled(packing.knapsack(price, 10)[1], 10)
    assert sum(price[k] * n for k, n in held.items()) == 10.5


def configurations(lengths, room):
    if not lengths:
        return [{}]
    n, rest = lengths[0], lengths[1:]
    return [{n: k, **c} for k in range(room // n + 1) for c in configurations(rest, room - n * k)]


@pytest.mark.parametrize("demand", [{3: 60, 4: 45, 5: 30, 7: 20}, {6: 100}, {4: 900, 5: 1, 10: 7}, {1: 5, 9: 40, 8: 30}])
def test_fractional_cover_against_all_configurations(demand):
    """The cover holds every length; its value is near a bound that all configurations confirm."""
    counts = np.zeros(11, np.int64)
    counts[list(demand)] = list(demand.values())
    cover = packing.fractional(counts, 10, rounds=400, step=0.05)
    for n, want in demand.items():
        assert sum(held.get(n, 0) * x for held, x in cover.weights) >= want * (1 - 1e-9)
    assert all(sum(n * k for n, k in held.items()) <= 10 for held, _ in cover.weights)
    # the optimum by the dual: no feasible prices are worth more; a grid of prices shows how close
    every = configurations(sorted(demand), 10)
    grid = np.linspace(0, 1, 61)
    best, best_dual = 0.0, None
    rng = np.random.default_rng(0)
    names = sorted(demand)
    for _ in range(4000):
        y = rng.choice(grid, len(names))
        top = max(sum(c.get(n, 0) * p for n, p in zip(names, y)) for c in every)
        if top > 0:
            best = max(best, sum(demand[n] * p for n, p in zip(names, y)) / top)
    assert cover.bound <= cover.value + 1e-9
    assert best <= cover.value * (1 + 1e-9)
    assert cover.value <= max(best, cover.bound) * 1.06


def test_most_sequences_come_from_the_rounded_cover():
    rng = np.random.default_rng(5)
    lengths = np.minimum(256, rng.geometric(1 / 70, 400_000))
    counts = np.bincount(lengths, minlength=257)
    of = packing.grouped(counts, 256)
    demand = np.bincount(of, weights=np.where(of > 0, counts, 0), minlength=257).astype(np.int64)
    assert 20 < (demand > 0).sum() <= packing.CLASSES and demand.sum() == counts[256 // packing.LONG_PARTS :].sum()
    assert all(of[n] >= n for n in np.flatnonzero(of))
    cover = packing.fractional(demand, 256)
    assert cover.bound <= cover.value <= 1.05 * cover.bound
    whole = sum(int(x) for _, x in cover.weights)
    groups = packing.solve(counts, 256)
    used = sum(m for _, m in groups)
    assert whole > 0.9 * used and used <= 1.002 * np.ceil((counts * np.arange(257)).sum() / 256)
    packed = np.zeros(257, np.int64)
    for held, many in groups:
        for n, k in held.items():
            packed[n] += k * many
    assert (packed == counts).all()
