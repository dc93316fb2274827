"""All stages of the pipeline, each on its own input, against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_mixing import shares
from test_near_dup import sets
from test_pii import masked
from test_quality_rules import slow

import corpus_pipeline
from tastemill.llm import quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, rank string"


def corpus():
    rng = random.Random(11)
    prose = lambda n: " ".join(f"{rng.choice('bcdfg')}word{rng.randrange(4000)}" for _ in range(n))
    docs = []
    add = lambda i, text, source: docs.append((i, text, "en", source, 0, f"r{len(docs) % 3}"))
    for i in range(90):
        add(i, prose(rng.randrange(12, 70)), ["a", "a", "b", "é", None][i % 5])
    base = prose(120).split()
    for i in range(100, 130):  # near copies of one text, also without an id
        copy = list(base)
        copy[rng.randrange(120)] = f"edit{i}"
        add(i if i % 10 else None, " ".join(copy), "a")
    for i in range(200, 215):  # junk in a bad source, and one clean document there
        add(i, " ".join(f"{w}$$$#" for w in prose(20).split()), "junk")
    add(215, prose(30), "junk")
    add(216, "\n".join(["the same line over and over again"] * 12), "b")
    add(5, prose(40), "b")  # a second text under one id
    add(7, docs[7][1], "a")  # the same text under one id, other columns
    docs += [docs[8], docs[8]]  # repeated rows
    add(300, None, "a"), add(301, "", None), add(302, " \n\t", "b"), add(303, "too short", "a")
    for i, found in enumerate(["x.y@mail.org", "10.0.0.7", "4111 1111 1111 1111", "+49 (30) 1234-5678"]):
        add(400 + i, f"{prose(15)} see {found}, {prose(15)}", "b")
    add(None, f"{prose(20)} q@w.net, {prose(9)}", None)
    add(500, prose(3000), "é")  # more than one sequence
    return docs


def good(rows):
    """Rows that pass the base rules and whose soft failures their host's rate does not outweigh."""
    found, hosts = [], defaultdict(list)
    for row in rows:
        n, chars, symbols, dup, repeats = slow(row["text"])
        lines = len([x for x in (row["text"] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")])
        excess = {
            "symbols": 10 * symbols / n if n else None,
            "lines": 7 * dup / (3 * (lines - dup)) if lines else None,
            "word_length": max(2 * n / chars, chars / (15 * n)) if n else None,
        }
        fails = {rule: x is not None and x > 1 for rule, x in excess.items()}
        found.append((row, n < 10 or 100 * repeats > 20 * n, excess, fails))
        hosts[row["source"]].append(fails)
    kept = []
    rate = defaultdict(dict)
    for rule in quality.SOFT_RULES:
        many = {h: (len(f), sum(x[rule] for x in f)) for h, f in hosts.items()}
        mean = sum(f for _, f in many.values()) / len(rows)
        spread = sum(n * (f / n - mean) ** 2 for n, f in many.values()) / len(rows)
        k = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1000.0
        for host, (n, f) in many.items():
            rate[host][rule] = (f + mean * k) / (n + k)
    for row, base_failed, excess, fails in found:
        limit = quality.HOST_LIMIT
        odds = rate[row["source"]]
        goes = any(
            fails[r] and (odds[r] > limit or excess[r] ** 2 * odds[r] * (1 - limit) > limit * (1 - odds[r]))
            for r in fails
        )
        if not base_failed and not goes:
            kept.append(row)
    return kept


def groups(rows):
    """Rows with an id and words by connected component."""
    own = [r for r in rows if r["doc_id"] is not None and sets(r["text"])]
    shingles = [sets(r["text"]) for r in own]
    label = list(range(len(own)))
    for i, a in enumerate(shingles):
        for j in range(i):
            if label[i] != label[j] and 100 * len(a & shingles[j]) >= 75 * len(a | shingles[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = defaultdict(list)
    for r, x in zip(own, label):
        out[x].append(r)
    return list(out.values())


def check_quality(before, after):
    assert Counter(after) == Counter(good(before))
    assert 0 < len(after) < len(before)
    # judged by the host's rate and not by the base rules alone
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} >= set(range(200, 215))
    assert 215 in {r["doc_id"] for r in after}


def check_near(before, after):
    free = [r for r in before if r["doc_id"] is None or not sets(r["text"])]
    assert not Counter(free) - Counter(after)
    rest = Counter(after) - Counter(free)
    found = groups(before)
    assert sum(rest.values()) == len(found) < len(before) - len(free)
    for group in found:
        stays = [r for r in set(group) if rest[r]]
        assert len(stays) == 1 and rest[stays[0]] == 1
        assert stays[0]["doc_id"] == min(r["doc_id"] for r in group)


def check_masks(before, after):
    as_masked = lambda r: (*r[:1], masked(r["text"] or "") if r["text"] is not None else None, *r[2:])
    assert Counter(map(tuple, after)) == Counter(map(as_masked, before))
    assert sum(any(f"<{k}>" in (r["text"] or "") for k in ("EMAIL", "IP", "CARD", "PHONE")) for r in after) == 5


def check_mix(before, after):
    times, had = Counter(after), Counter(before)
    assert set(times) <= set(had) and all(n <= 3 * had[r] for r, n in times.items())
    size = lambda r: len((r["text"] or "").split())
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size(r)
        largest[r["source"]] = max(largest[r["source"]], size(r))
    for r in after:
        taken[r["source"]] += size(r)
    for source, target in shares(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(0.1 * target, 2 * largest[source])


def check_packing(before, packed):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    want = Counter()
    for r in before:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            want[r["doc_id"], piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    held = defaultdict(list)
    for r in packed:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
    total = sum(k[3] * n for k, n in want.items())
    assert len(held) <= -(-total // 2048) + 1


def test_every_stage_equals_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    checks = [check_quality, check_near, check_masks, check_mix, check_packing]
    for (name, stage), check in zip(corpus_pipeline.STAGES, checks, strict=True):
        out = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(out)
        after = spark.read.parquet(out)
        check(docs.collect(), after.collect())
        assert check is check_packing or after.columns == columns
        docs = after
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = corpus_pipeline.run(spark, folder)
    assert Counter(whole.select(pieces).collect()) == Counter(docs.select(pieces).collect())


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None)]])
def test_nothing_left(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
