import random
import re
from collections import Counter

import numpy as np
import pytest

from tastemill.llm import collocations


def brute(rows, least, top):
    grams, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    grams.setdefault(lang, Counter())[tuple(ws[i : i + m])] += 1
    out = []
    for lang, f in grams.items():
        often = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        rest = []
        for p, a in often.items():
            if any(
                len(q) > len(p) and 100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, n in often.items()
            ):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "'x' AS word", "1 AS code")


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocab = ["the", "of", "And", "É", "é", "naïve x", "a\x00b", "|", "zz", "New", "york", "city", "\x1ck"]
    rows = []
    for _ in range(300):
        n = rng.choice([0, 1, 3, 40])
        words = [rng.choice(vocab[: rng.choice([2, 4, 13])]) for _ in range(n)]
        rows.append(("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b", "!?"]) for w in words), rng.choice(["en", "fr", None])))
    rows += [("new york city hall " * 50, "en"), (None, "en"), ("", "fr"), ("only here", "xx")]
    rows += [("copy of a passage that repeats", "de")] * 40
    rows += [("a " * 20_000 + "b", "long")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, texts, monkeypatch, small):
    if small:  # many slices and routes, real splits, hot words
        monkeypatch.setattr(collocations, "SLICE_WORDS", 700)
        monkeypatch.setattr(collocations, "ROUTE_WORDS", 3000)
        monkeypatch.setattr(collocations, "SLICE_BYTES", 500)
        monkeypatch.setattr(collocations, "HOT_SHARE", 0.02)
    got = found(collocations.collocations(table(spark, texts), least=6, top=60))
    assert got == brute(texts, 6, 60)
    assert len(got) > 60


def sorted_counts(words, weight, known, least):
    found, splits = collocations.frequent(words, weight, known, least)
    out = {}
    for size, at, f in found:
        for k, n in zip(at, f):
            assert tuple(words[:size, k]) not in out
            out[tuple(words[:size, k].tolist())] = int(n)
    return out, splits


@pytest.mark.parametrize("small", [1, 50])
def test_quicksort_counts_equal_parts_and_abandons_rare_ones(monkeypatch, small):
    monkeypatch.setattr(collocations, "SMALL", small)
    rng = np.random.default_rng(2)
    words = np.stack([rng.zipf(1.5, 3000).clip(0, 400) * 7 - 5 for _ in range(4)]).astype(np.int64)
    for k in range(1, 4):  # pieces that end early
        words[k, (words[k - 1] == 0) | (rng.random(3000) < 0.2)] = 0
    weight, known = rng.integers(1, 4, 3000), np.ones(3000, np.int8)
    want = Counter()
    for row, w in zip(words.T.tolist(), weight.tolist()):
        for m in range(1, 5):
            if row[m - 1] != 0:
                want[tuple(row[:m])] += w
    got, splits = sorted_counts(words, weight, known, 20)
    assert got == {p: n for p, n in want.items() if n >= 20}
    assert sorted_counts(words, weight, known, 3000)[1] <= splits


def test_routes_of_hot_words_stay_bounded():
    """A word that fills nearly all places is split by the words that follow it."""
    rng = np.random.default_rng(1)
    words = np.where(rng.random(20_000) < 0.9, 1, rng.integers(10, 2000, 20_000)).astype(np.int64)
    columns, known, weight = collocations.suffixes(words, np.array([1]), 4)
    to = collocations.route("en", columns, known, 50)
    assert np.bincount(to, minlength=50).max() < 6 * len(to) / 50
    # all suffixes of a phrase that are counted for it share a route
    for d in range(4):
        phrases = {}
        for i in np.flatnonzero((known <= d + 1) & (columns[d] != 0)):
            phrases.setdefault(tuple(c[i] for c in columns[: d + 1]), set()).add(int(to[i]))
        assert all(len(r) == 1 for r in phrases.values())


def test_wide_products_and_empty_tables(spark):
    big = 8 * 10**18
    found_ = spark.createDataFrame(
        [("en", ["a"], big), ("en", ["b"], big), ("en", ["a", "b"], big - 1)], "lang string, words array<string>, f long"
    )
    assert [r["score"] for r in collocations.scored(found_).collect()] == [2_000_000 * (big - 1) // (2 * big)]
    assert collocations.collocations(table(spark, [("a b", "en")]).limit(0)).count() == 0
    assert collocations.collocations(table(spark, [("a b", "en")])).count() == 0
