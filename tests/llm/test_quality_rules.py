from collections import Counter

import pytest

from tastemill.llm import quality


def slow(text):
    words = (text or "").split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(covered),
    )


TEXTS = [
    "a b c d e f g h i j k", "x y z w v x y z w v x y z w v", "", None, " \t\n ", "one",
    "a b c d e a b c d e", "l1\nl1\n\nl2 #*\n l1\nl1", "ü 😀 " * 40,
    " ".join(f"w{i % 37}" for i in range(3000)), "b b b b b b", "a\x0bb\x0cc\rd\te\nf",
]


def test_counts_against_brute_force(docs_of, by_id):
    got = by_id(quality.assess(docs_of(*enumerate(TEXTS))).select("row.doc_id", "*"))
    for i, text in enumerate(TEXTS):
        r = got[i]
        n, chars, symbols, lines, repeats = slow(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            n, chars, symbols, lines, repeats), text
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)


def prose(n, start=0):
    return " ".join(f"word{start + i}" for i in range(n))


def test_a_host_that_fails_a_rule_loses_only_its_failing_documents(docs_of, by_id):
    bad = [(i, prose(30, 50 * i) + " ### $$$ %%%", "spam") for i in range(40)]
    clean = [(100 + i, prose(30, 50 * i), "spam") for i in range(10)]
    other = [(200 + i, prose(30, 50 * i), f"h{i % 5}") for i in range(100)]
    lone = [(400, prose(30) + " ####", "h1"), (401, prose(30), None)]
    got = by_id(quality.assess(docs_of(*bad, *clean, *other, *lone)).select("row.doc_id", "*"))
    assert not any(got[i]["kept"] for i, *_ in bad)
    assert all(got[i]["kept"] for i, *_ in clean + other + lone)
    assert got[100]["host_flagged"] and not got[400]["host_flagged"]


def test_keep_good_returns_the_documents(docs_of):
    docs = docs_of((1, prose(20), "a"), (1, prose(20), "a"), (2, "short", "a"), (None, prose(20), None))
    clash = docs.selectExpr("*", "1 AS kept", "2 AS row", "3 AS m", "4 AS host", "5 AS fails")
    kept = quality.keep_good(clash)
    assert kept.columns == clash.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "None"]
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_heavy_failures_go_in_ordinary_hosts_and_borderline_ones_only_in_bad_hosts(docs_of):
    host = lambda start, name, bad: [
        (start + i, prose(30, 50 * i) + (" ####" if i < bad else ""), name) for i in range(50)
    ]
    ordinary = [row for h in range(5) for row in host(100 * h, f"h{h}", 3)]
    worse = host(600, "worse", 40)
    heavy = (900, " ".join(w + "$$$" for w in prose(30).split()), "h0")
    lines = [(901 + i, prose(20, 30 * i) + "\nsame" * 3 + "\nother", "h1") for i in range(2)]
    docs = docs_of(*ordinary, *worse, heavy, *lines, (910, None, "h2"), (911, "\n", "h2"))
    judged = quality.assess(docs, carry=["doc_id"]).where("kept").collect()
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert kept == {i for i, *_ in ordinary + worse[40:] + lines} == {r["row"]["doc_id"] for r in judged}


def test_hosts_decide_on_the_given_table_and_leave_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = quality.assess(docs, carry=["doc_id"]).select("row.doc_id", "kept", "base_failed")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rejected = judged.where("not kept and not base_failed").join(labels, "doc_id", "left").collect()
    assert len(rejected) > 20
    assert not any(r["quality"] == 1 for r in rejected)


@pytest.mark.parametrize("n", [1, 4, 5, 6, 9])
def test_windows_at_the_edges(docs_of, n):
    text = " ".join(["w"] * n)
    assert quality.assess(docs_of((1, text))).first()["n_repeat_words"] == slow(text)[4]
