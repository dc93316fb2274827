import random
import re
import zlib
from collections import Counter

import pytest

from tastemill.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    form, n_near = {}, {}
    for w in words:
        others = [v for v in words if near(w, v)]
        n_near[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], None if form[w] is None else words[form[w]]))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' AS word", "1 AS n", "'z' AS node")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(120)]
    words += ["colour", "Colour", "color", "colours", "aaaaaa", "aaaaaaa", "aaaaaaaa", "straße", "strasse", "ÀÉÎÕÜß", "àéîõüß"]
    rows = [(i, " ".join(rng.choices(words, [9 ** (k % 4) for k in range(len(words))], k=600)) + rng.choice([".", "1x", "_", ""])) for i in range(60)]
    rows += [(None, "colour " * 400), (7, "colour " * 300), (7, "colour " * 300), (8, None), (9, ""), (10, "×÷×÷×÷ " * 9)]
    return rows


def test_against_brute_force(spark, texts):
    got = found(spelling.variants(table(spark, texts)))
    assert got == brute(texts)
    assert sum(r[1] is not None for r in got) > 10 and max(r[4] for r in got) > 1


def test_neighbours_at_every_place_and_of_long_words(spark):
    rng = random.Random(3)
    words = {"abcdef", "bcdef", "abcdeg", "zbcdef", "abcdefg", "abccdef", "abcddef", "aabcdef"}
    for n in (38, 39, 40, 41, 42, 300):
        base = "".join(rng.choice("abc") for _ in range(n))
        words |= {base, base[1:], base[:-1], base + "x", "x" + base, base[:20] + "y" + base[21:], base[:20] + base[21:], base[:n - 1] + "z"}
    words |= {"b" * k for k in (38, 39, 40, 41, 42, 43)}
    table_ = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {tuple(r) for r in spelling.neighbours(table_).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_hashes_of_deletions_agree():
    word = "naïvely" * 3
    h = spelling.deletion_hashes(word)
    assert len(h) == len(word) + 1
    for i in range(len(word)):
        assert h[i + 1] == spelling.deletion_hashes(word[:i] + word[i + 1 :])[0]


def test_chains_follow_to_the_last_and_very_long_runs(spark):
    rows = [(1, "formed " * 5 + "former " * 40 + "farmer " * 300), (2, ("q" * 5000 + " ") * 6 + ("q" * 4999 + "r ") * 40)]
    got = {r[0]: r for r in found(spelling.variants(table(spark, rows)))}
    assert got["formed"][1:3] == ("former", "farmer") and got["farmer"][1:3] == (None, "farmer")
    assert found(spelling.variants(table(spark, rows))) == brute(rows)


def test_no_words(spark):
    assert spelling.variants(table(spark, [(1, "short wor ds")])).count() == 0
    assert spelling.variants(table(spark, [(1, "x")]).limit(0)).count() == 0
