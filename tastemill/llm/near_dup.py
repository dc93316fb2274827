"""Near-duplicates by MinHash and a multi-index Hamming join, confirmed on full sets.

A document's signature has ``CHUNKS * CHUNK`` values of 16 bits, the MinHashes of
its word shingles. The signature is split into chunks. By the pigeonhole
principle two signatures that differ in fewer than ``CHUNKS * (ERRORS + 1)``
values have a chunk with at most ``ERRORS`` differences; so each chunk is indexed
once for every choice of ``ERRORS`` places to be left out, and all pairs under
that distance meet in a bucket. Pairs further apart meet with high probability
too: at similarity 0.75 values differ independently at a quarter of the places,
and the chance that none of the 16 chunks of 7 has at most one difference is
0.00008. Every link is confirmed on the full sets.

Buckets are not expanded into pairs. Equal sets are one node. Then three rounds
of candidates, each leaving out pairs that earlier links already connect:
every node with the bucket leader it meets most often, all nodes with the
leaders of their buckets, and last all remaining pairs of a bucket whose ends
lie in different components. In the last round an outline of each set bounds the
similarity of a pair before it is formed: a place of the outline that only one
side fills holds at least one shingle that is not shared. The last round
completes the search, so nothing depends on who leads.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.common import stored

SHINGLE = 5
PERCENT = 75
CHUNKS = 16
CHUNK = 7
ERRORS = 1
SEED = 7
# Places of a set's outline.
BITS = 4096
# Bytes of text worked on at a time inside a task.
SLICE_BYTES = 8_000_000

_random = np.random.default_rng(SEED)
_FLIP = _random.integers(1, 1 << 63, CHUNKS * CHUNK, dtype=np.uint64)
_TIMES = _random.integers(1, 1 << 63, CHUNKS * CHUNK, dtype=np.uint64) | np.uint64(1)
_WEIGHT = _random.integers(1, 1 << 63, (CHUNKS, CHUNK), dtype=np.uint64) | np.uint64(1)
_MASK = _random.integers(1, 1 << 63, (CHUNKS, CHUNK), dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, in order."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    parts = (np.cumsum(sizes, dtype=np.int64) - sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(texts)]
    for low, high in zip(cuts, cuts[1:]):
        part = pc.ascii_lower(pc.fill_null(texts.slice(low, high - low), ""))
        split = pc.ascii_split_whitespace(part)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        hashes = pd.util.hash_array(np.array(words + [""], dtype=object), categorize=False)[:-1]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        real = np.array([w != "" for w in words], bool)[codes] if len(codes) else codes.astype(bool)
        at = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))))
        at = np.concatenate(([0], np.cumsum(real)))[at]
        h = hashes[codes[real]]
        window = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            window = mixed(window + h[k : k + len(window)])
        for start, stop in zip(at[:-1].tolist(), at[1:].tolist()):
            if stop - start >= SHINGLE:
                yield np.unique(window[start : stop - SHINGLE + 1])
            elif stop > start:
                whole = np.array([stop - start], np.uint64)
                for k in range(start, stop):
                    whole = mixed(whole + h[k])
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16-bit MinHash values of a set that is not empty."""
    least = np.full(len(_FLIP), np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), 4096):
        part = shingles[low : low + 4096, None]
        np.minimum(least, ((part ^ _FLIP) * _TIMES).min(axis=0), out=least)
    return mixed(least) >> np.uint64(48)


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of the chunks with each choice of left-out places; one row per signature.

    With one place left out, a key is the hash of the whole chunk less that
    place's share.
    """
    values = signatures.reshape(-1, CHUNKS, CHUNK) * _WEIGHT
    keys = mixed(values.sum(axis=2, dtype=np.uint64)[:, :, None] - values + _MASK)
    return keys.reshape(len(signatures), -1)


def text_hash(text: str = "text") -> Column:
    """Tells rows apart that share an id; a null text is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, set_a, set_b, keys)``: size, identity, buckets of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, signs = [], [], [], []
            for s in shingle_sets(batch.column(1)):
                size.append(len(s))
                one.append(s.sum(dtype=np.uint64))
                two.append(mixed(s ^ _FLIP[0]).sum(dtype=np.uint64))
                if len(s):
                    signs.append(signature(s))
            full = np.array(size, np.int64) > 0
            keys = bucket_keys(np.array(signs, np.uint64).reshape(-1, CHUNKS * CHUNK))
            ends = np.cumsum(np.where(full, keys.shape[1], 0))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(keys.ravel().view(np.int64))
            )
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int64()), signed(one), signed(two), lists],
                names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, keys array<long>"
    )


def outline(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` places as 64-bit words; those that hold a shingle are set."""
    places = np.zeros(BITS, np.uint8)
    places[shingles % np.uint64(BITS)] = 1
    return np.packbits(places, bitorder="little").view("<i8")


def full_sets(texts: DataFrame) -> DataFrame:
    """``(id, shingles, bits)`` of each ``(id, text)``: its set and the set's outline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            ends = np.cumsum([0, *map(len, sets)])
            values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
            bits = np.concatenate([np.zeros(0, np.int64), *map(outline, sets)])
            every = pa.array(np.arange(len(sets) + 1) * (BITS // 64), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.ListArray.from_arrays(every, pa.array(bits))],
                names=["id", "shingles", "bits"],
            )

    return texts.select("id", "text").mapInArrow(run, "id long, shingles array<long>, bits array<long>")


def live_buckets(nodes: DataFrame) -> DataFrame:
    """``(key, id, leader)`` of all buckets with two nodes or more.

    ``nodes`` is (id, keys). One shuffle by key; both windows run over the same
    sort and hold no more than a row. A node has one row per key kind, so even a
    bucket that every node falls into has only 1 of 112 of the rows.
    """
    ordered = Window.partitionBy("key").orderBy("id")
    return (
        nodes.select("id", F.explode("keys").alias("key"))
        .select(
            "key",
            "id",
            F.first("id").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("leader"),
            F.lead("id").over(ordered).alias("next"),
        )
        .where((F.col("leader") != F.col("id")) | F.col("next").isNotNull())
        .drop("next")
    )


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    small, large = F.least(F.size("of_a"), F.size("of_b")), F.greatest(F.size("of_a"), F.size("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    both = F.size("of_a") + F.size("of_b")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where((100 * small >= percent * large) & ((100 + percent) * shared >= percent * both))
        .select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """``(id, label)`` of every linked id; the label is the smallest id reachable.

    Alternates the two star steps: larger neighbours are hung onto the smallest
    neighbour, then the smaller ones. Each step is an aggregation and a join by
    id; the edges are written after both. Ends when a round changes nothing.
    """

    def mark(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()

    edges = stored(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("hi > lo")
        .distinct(),
        "links",
    )
    seen = mark(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
            .distinct()
        )
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.explode(
                F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))
            ).alias("e")
        )
        edges = stored(small.select("e.*").where("hi > lo").distinct(), "links")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    labels = edges.select(F.col("hi").alias("id"), F.col("lo").alias("label"))
    return labels.unionByName(edges.select(F.col("lo").alias("id"), F.col("lo").alias("label"))).distinct()


def _labelled(rows: DataFrame, column: str, labels: DataFrame, name: str) -> DataFrame:
    of = labels.select(F.col("id").alias(column), F.col("label").alias("_label"))
    return rows.join(of, column, "left").withColumn(name, F.coalesce("_label", column)).drop("_label")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) in different components."""
    known = _labelled(_labelled(pairs, "a", labels, "of_a"), "b", labels, "of_b")
    return known.where("of_a != of_b").select("a", "b")


def linked(docs: DataFrame, nodes: DataFrame, live: DataFrame) -> DataFrame:
    """``(id, label)`` of all nodes with a link; see the module's text for the rounds."""
    asked = nodes.join(live.select("id").distinct(), "id", "left_semi").select("doc_id", "text_hash", "id", "copies")
    texts = docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("text_hash"))
    sets = stored(full_sets(once(texts.join(asked, ["doc_id", "text_hash"]), ["id"])), "sets")
    stars = stored(
        live.where("leader != id")
        .groupBy(F.col("leader").alias("a"), F.col("id").alias("b"))
        .agg(F.count(F.lit(1)).alias("met")),
        "stars",
    )
    first = stars.groupBy("b").agg(F.max_by("a", F.struct("met", -F.col("a"))).alias("a"))
    links = stored(confirmed(first.select("a", "b"), sets), "confirmed")
    labels = components(links)

    rest = _apart(stars.join(first, ["a", "b"], "left_anti").select("a", "b"), labels)
    links = labels.select(F.col("label").alias("a"), F.col("id").alias("b")).unionByName(
        stored(confirmed(rest, sets), "confirmed")
    )
    labels = components(links)

    # per bucket, the members outside its most frequent component meet all others
    members = stored(_labelled(live, "id", labels, "label"), "members")
    per_label = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed_keys = (
        per_label.groupBy("key")
        .agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.count(F.lit(1)).alias("labels"))
        .where("labels > 1")
        .select("key", "main")
    )
    open_rows = stored(members.join(mixed_keys, "key"), "open")
    words = range(BITS // 64)
    outlines = sets.select(
        "id",
        F.size("shingles").alias("n"),
        F.aggregate("bits", F.lit(0), lambda total, w: total + F.bit_count(w)).alias("ones"),
        *[F.get("bits", F.lit(w)).alias(f"w{w}") for w in words],
    )
    possible = open_rows.join(outlines, "id")
    names = ("id", "label", "leader", "n", "ones", *[f"w{w}" for w in words])
    side = lambda n: [F.col(c).alias(f"{c}_{n}") for c in names]
    overlap = reduce(
        lambda total, w: total + F.bit_count(F.col(f"w{w}_x").bitwiseAND(F.col(f"w{w}_y"))), words, F.lit(0)
    )
    alone = lambda n: F.col(f"ones_{n}") - overlap
    shared = F.least(F.col("n_x") - alone("x"), F.col("n_y") - alone("y"))
    pairs = (
        possible.where("label != main").select("key", *side("x"))
        .join(possible.select("key", *side("y")), "key")
        .where("label_x != label_y and id_x != leader_x and id_y != leader_y")
        .where((100 + PERCENT) * shared >= PERCENT * (F.col("n_x") + F.col("n_y")))
        .select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))
        .distinct()
    )
    more = stored(confirmed(pairs, sets), "confirmed")
    return components(
        labels.select(F.col("label").alias("a"), F.col("id").alias("b")).unionByName(more)
    )


def once(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per ``by``; only rows with ``copies`` above 1 can be repeated and are shuffled for it."""
    return rows.where("copies = 1").unionByName(rows.where("copies > 1").dropDuplicates(by))


SET = ["set_a", "set_b", "n_shingles"]


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Measured rows; distinct texts ``(doc_id, text_hash, copies, *SET)``; nodes ``(*SET, root, component_id)``.

    Only rows with an id and words. A node is a set, whatever ids its rows have, and
    is numbered when it is written; its text is that of its smallest (id, hash).
    """
    found = stored(measured(docs), "signatures")
    known = found.where("n_shingles > 0 and doc_id is not null")
    texts = stored(
        known.groupBy(*SET, "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")), "texts"
    )
    nodes = stored(
        texts.groupBy(*SET).agg(F.min(F.struct("doc_id", "text_hash", "copies")).alias("of"))
        .select(*SET, "of.*", F.monotonically_increasing_id().alias("id")),
        "nodes",
    )
    indexed = once(
        known.select("doc_id", "text_hash", "keys").join(
            nodes.select("doc_id", "text_hash", "id", "copies"), ["doc_id", "text_hash"]
        ),
        ["id"],
    )
    live = stored(live_buckets(indexed), "buckets")
    labels = linked(docs, nodes, live)
    rooted = _labelled(nodes, "id", labels, "root").select(*SET, "doc_id", "root")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found, texts, rooted.select(*SET, "root").join(least, "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every document.

    Null texts and texts without words have an empty set and link with nothing;
    a text of fewer than five words has one shingle, all its words. Rows with
    equal sets are one node, however many. A row without an id has no component
    and is kept. Repeated rows give the same result twice; rows that share an id
    but not a text are judged by their texts. Sets are compared by 64-bit hashes of
    their shingles. An empty table gives no rows.
    """
    found, _, classes = _classes(docs)
    return (
        found.select("doc_id", *SET)
        .join(classes, SET, "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns.

    It is the one with the smallest id, of texts under one id that with the smaller
    hash, of rows with equal id and text that whose columns hash lowest; so reruns
    keep the same row. Texts that share an id but nothing else are different groups.
    Rows without an id or without words stay.
    """
    found, texts, classes = _classes(docs)
    first = (
        texts.join(classes, SET).groupBy("root")
        .agg(F.min(F.struct("doc_id", "text_hash", "copies")).alias("of")).select("of.*")
    )
    first = stored(first, "kept").toDF("_id", "_hash", "_copies")
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_doc"), text_hash().alias("_text"))
    kept = named.join(first, (F.col("_doc") == F.col("_id")) & (F.col("_text") == F.col("_hash")))
    repeated = (
        kept.where("_copies > 1").groupBy("_id", "_hash")
        .agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    )
    has_words = F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    free = named.where(F.col("_doc").isNull() | ~has_words).select("row")
    every = kept.where("_copies = 1").select("row").unionByName(repeated).unionByName(free)
    return every.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
