import hashlib
import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tastemill.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return (
        kind == "email"
        or (kind == "ip" and all(int(x) <= 255 for x in m.split(".")))
        or (kind == "card" and 12 <= len(d) <= 19 and luhn(d))
        or (kind == "phone" and 9 <= len(d) <= 15)
    )


def spans(text):
    found = [
        (m.start(), n, m.end(), kind)
        for n, (kind, p) in enumerate(KINDS.items())
        for m in re.finditer(p, text or "")
        if valid(kind, m[0])
    ]
    return sorted(found)


def masked(text):
    out, at = "", 0
    for start, _, stop, kind in spans(text):
        if start >= at:
            out += text[at:start] + f"<{kind.upper()}>"
        at = max(at, stop)
    return out + text[at:]


TEXTS = [
    "a@b.c_x@d.e", "a@b.c.@d.e a@b@c.d", "1.2.3.4.5.6.7.8 300.1.1.1.1 0255.00.0.1 256.1.1.1", "", None,
    "+1 (555) 123-4567 4111 1111 1111 1111 +49 4111-1111-1111-1111", "😀 é +4411223344556 x@y.z",
    "10.0.0.4 4444 4444 4444 4448", "+12 ..... 3 +1234567890123456 ++123456789", "﻿1.1.1.1﻿2.2.2.2",
    "5" * 500 + " " + "1." * 300, "a." * 3000 + "@b" + ".c" * 3000, "@@@ a@ a@b a@b. a@b.-",
]


def check(docs, rows, by_id):
    got, texts = by_id(pii.report(docs)), by_id(pii.redact(docs))
    for i, text in rows:
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans(text))
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), text
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[3] == k for x in spans(text)) for k in KINDS]
        assert texts[i]["text"] == (None if text is None else masked(text))


def test_spans_and_masks_against_brute_force(docs_of, by_id):
    rows = list(enumerate(TEXTS))
    check(docs_of(*rows), rows, by_id)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("a1.@+- (4", max_size=40), min_size=30, max_size=30))
def test_random_texts(docs_of, by_id, texts):
    rows = list(enumerate(texts))
    check(docs_of(*rows), rows, by_id)


def card(n):
    return next(f"{n}{c}" for c in "0123456789" if luhn(f"{n}{c}"))


def test_contexts_of_known_cards_find_an_unseen_one(docs_of, by_id):
    wrong = "4111111111111112"
    known = [(i, f"pay to account {card(411111111111110 + 7 * i)} now") for i in range(30)]
    rows = [*known, (99, f"pay to account {wrong} now"), (98, f"nothing {wrong} here"), (97, "year 2024 ends")]
    got = by_id(pii.report(docs_of(*rows)))
    assert got[99]["spans"] == "card:15:31" and got[99]["n_card"] == 0
    assert got[98]["spans"] == got[97]["spans"] == ""
    assert by_id(pii.redact(docs_of(*rows)))[99]["text"] == "pay to account <CARD> now"


def test_repeats_clashes_and_empty_tables(docs_of):
    docs = docs_of((1, "x 1.2.3.4"), (1, "x 1.2.3.4"), (1, "y a@b.c"), (None, "z a@b.c")).selectExpr(
        "*", "1 AS spans", "2 AS base", "3 AS _hash", "4 AS row")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted(r["text"] for r in out.collect()) == ["x <IP>", "x <IP>", "y <EMAIL>", "z <EMAIL>"]
    assert pii.report(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_contexts_find_unseen_shapes_and_spans_of_several_words(docs_of, by_id):
    rows = [(i, f"please call: +1 (555) 123-{4000 + i} today") for i in range(30)]
    rows += [(50 + i, f"write mail:u{i}@mail{i}.org soon") for i in range(30)]
    rows += [(90, "please call (555) 123-4567 today"), (91, "call 555 123 4568, then go"), (92, "mail: someone9@localhost soon")]
    got = by_id(pii.report(docs_of(*rows)))
    assert got[90]["spans"] == "phone:12:26" and got[91]["spans"] == "phone:5:17"
    assert got[92]["spans"] == "email:6:24" and got[92]["n_email"] == 0
    texts = by_id(pii.redact(docs_of(*rows)))
    assert texts[90]["text"] == "please call <PHONE> today" and texts[91]["text"] == "call <PHONE>, then go"


def test_contexts_of_accepted_instances_are_new_patterns(docs_of, by_id):
    known = [(i, f"please call +1 (555) 123-{4000 + i} today") for i in range(240)]
    number = lambda i: f"(555) 777-{1000 + i}"
    both = [(300 + 2 * i + k, f"{w} {number(i)} now") for i in range(20) for k, w in enumerate(("call", "fax"))]
    got = by_id(pii.report(docs_of(*known, *both, (900, "fax (555) 999-1234 now"))))
    assert got[900]["spans"] == "phone:4:18"


@pytest.mark.parametrize("block", [1, 3, 512])
def test_running_values_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(pii, "SCAN_BLOCK", block)
    rng = random.Random(block)
    rows = [([rng.randint(0, 9) for _ in range(n)],) for n in (0, 1, 2, 3, 7, 40)] + [(None,)]
    df = spark.createDataFrame(rows, "v array<int>")
    got = df.select("v", pii.before(F.col("v"), lambda a, b: a + b).alias("s"), pii.before(F.col("v"), lambda a, b: F.greatest(a, b)).alias("m"))
    for r in got.collect():
        v = r["v"] or []
        assert r["s"] == [sum(v[:i]) for i in range(len(v))]
        assert r["m"] == [max(v[:i], default=0) for i in range(len(v))]


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(5)
    span = lambda: (lambda a: (a, a + rng.randint(1, 6)))(rng.randint(0, 60))
    rows = [(sorted({span() for _ in range(rng.randint(0, 12))}), sorted({span() for _ in range(rng.randint(0, 8))})) for _ in range(60)]
    kind = "array<struct<start:int,stop:int>>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    for r in df.select("a", "b", pii.apart(F.col("a"), F.col("b")).alias("free"), pii.outermost(F.col("a")).alias("outer")).collect():
        a, b = ([tuple(x) for x in r[c]] for c in ("a", "b"))
        assert sorted(map(tuple, r["free"])) == [s for s in a if not any(x[0] < s[1] and s[0] < x[1] for x in b)]
        assert [tuple(x) for x in r["outer"]] == [
            s for s in a if not any(x != s and x[0] <= s[0] and x[1] >= s[1] for x in a)
        ]


def test_a_text_of_many_numbers_takes_linear_time(spark, docs_of):
    numbers = ", ".join(f"10.0.{i % 250}.{i % 199}; {i}7{i}" for i in range(100_000))
    docs = docs_of((1, numbers), (2, "mail a@b.org"))
    pii.report(docs_of((3, "a@b.org 10.0.0.1"))).collect()
    start = time.time()
    row = pii.report(docs).where("doc_id = 1").first()
    assert row["n_ip"] == 100_000
    assert time.time() - start < 40
    text = pii.redact(docs).where("doc_id = 1").first()["text"]
    assert text.count("<IP>") == 100_000 and text.endswith("999997" + "99999")
