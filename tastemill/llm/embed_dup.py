"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Unit vectors are centred, projected onto at most ``BITS`` principal axes and turned
by a rotation that iterative quantisation learns from a bounded sample: signs and
rotation are fitted to each other in turn, which balances the bits. The signs of
the turned values are the code. Codes are cut into chunks, one hash table each.

Retrieval loses nothing, whatever the rotation: centring and turning keep
distances, projecting never lengthens them. Vectors within the limit differ by at
most ``r2 = 2 - 2 * cosine`` squared, so in some chunk by at most ``r2 / chunks``.
Where a bit of that chunk differs, the values lie on both sides of zero and the
difference is at least the sum of both sizes; so for one of the two vectors the
squares of its values at the differing bits sum to half of that at most. Each
vector therefore probes the codes it reaches by flipping bits within that sum.
What a probe meets is compared on the chunk's values first; the pairs left are
ranked again by the cosine of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import stored
from tastemill.llm.near_dup import components

LIMIT = 0.98
BITS = 64
CHUNK_BITS = 16
# Vectors that the rotation is fitted on, and rounds of the fit.
SAMPLE = 4096
ITERATIONS = 30
# Fewer sample vectors of a width than this: its codes are not rotated.
MIN_SAMPLE = 128
SEED = 11
# Rows of one table tile; a bucket of more is split into tiles.
TILE_ROWS = 16384
# A vector that reaches more codes than this is compared with the whole tile.
PROBES = 1024
# Candidate pairs compared at a time inside a task.
SLICE = 1 << 20
# For the rounding of single precision.
SLACK = 1e-5


def nodes_of(vectors: DataFrame) -> DataFrame:
    """``(node, label, x, weight, first)``: one row per label and distinct vector.

    ``x`` has doubles; the node number is written with the row, so it is stable.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    valid = (
        vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
        .select(F.col("vec_id").cast("long"), "label", x.alias("x"))
        .where(finite & F.exists("x", lambda e: e != 0))
        # -0.0 and 0.0 are one value
        .withColumn("x", F.transform("x", lambda e: e + F.lit(0.0)))
    )
    grouped = valid.groupBy("label", "x").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first")
    )
    return stored(grouped.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither squares nor sums overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Rotation:
    centre: np.ndarray
    axes: np.ndarray  # width x bits, orthonormal columns

    def values(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.centre) @ self.axes


def plain(width: int, bits: int = BITS) -> Rotation:
    return Rotation(np.zeros(width), np.eye(width)[:, : min(width, bits)])


def fit(unit: np.ndarray, bits: int = BITS, iterations: int = ITERATIONS) -> Rotation:
    """Principal axes, then iterative quantisation of the sample's projections."""
    centre = unit.mean(axis=0)
    _, _, axes = np.linalg.svd(unit - centre, full_matrices=False)
    axes = axes[: min(bits, unit.shape[1])].T
    projected = (unit - centre) @ axes
    random = np.random.default_rng(SEED).normal(size=(axes.shape[1],) * 2)
    turn, _ = np.linalg.qr(random)
    for _ in range(iterations):
        signs = np.where(projected @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ signs)
        turn = left @ right
    return Rotation(centre, axes @ turn)


def learn(nodes: DataFrame, sample: int = SAMPLE) -> dict[int, Rotation]:
    """A rotation for every width that the sample holds often enough.

    The sample are the vectors with the smallest hashes, so it repeats.
    """
    taken = nodes.select("x", F.xxhash64("x").alias("h")).orderBy("h", "x").limit(sample).select("x").collect()
    by_width: dict[int, list[list[float]]] = {}
    for row in taken:
        by_width.setdefault(len(row["x"]), []).append(row["x"])
    return {
        width: fit(units(np.array(rows)))
        for width, rows in by_width.items()
        if len(rows) >= max(MIN_SAMPLE, 2 * min(width, BITS))
    }


def chunks_of(width: int) -> list[slice]:
    """The chunks of a code of that width, of nearly equal size."""
    bits = min(width, BITS)
    count = -(-bits // CHUNK_BITS)
    ends = np.linspace(0, bits, count + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def codes_of(values: np.ndarray) -> np.ndarray:
    weight = 1 << np.arange(values.shape[1], dtype=np.int64)
    return ((values >= 0) * weight).sum(axis=1)


def flips(values: np.ndarray, budget: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, mask)`` of all sets of bits whose squared values sum to ``budget`` at most.

    Sets grow by bits in order of size. Rows with more than ``most`` sets are
    returned apart, without their sets.
    """
    cost = values.astype(np.float64) ** 2
    order = np.argsort(cost, axis=1)
    cost = np.take_along_axis(cost, order, axis=1)
    bit = np.left_shift(np.int64(1), order.astype(np.int64))
    row = np.arange(len(values))
    mask, spent, last = np.zeros(len(row), np.int64), np.zeros(len(row)), np.full(len(row), -1)
    rows, masks = [row], [mask]
    sets, many = np.ones(len(values), np.int64), np.zeros(len(values), bool)
    while len(row):
        more = []
        for j in range(cost.shape[1]):
            ok = (last < j) & (spent + cost[row, j] <= budget)
            if ok.any():
                r = row[ok]
                more.append((r, mask[ok] | bit[r, j], spent[ok] + cost[r, j], np.full(len(r), j)))
        if not more:
            break
        row, mask, spent, last = (np.concatenate(part) for part in zip(*more))
        if most is not None:
            sets += np.bincount(row, minlength=len(sets))
            many = sets > most
            few = ~many[row]
            row, mask, spent, last = row[few], mask[few], spent[few], last[few]
        rows.append(row)
        masks.append(mask)
    row, mask = np.concatenate(rows), np.concatenate(masks)
    few = ~many[row]
    return row[few], mask[few], np.flatnonzero(many)


ROWS = "label {label}, width int, chunk int, prefix int, home boolean, node long, part binary"


def table_rows(nodes: DataFrame, turns: dict[int, Rotation], limit: float) -> DataFrame:
    """One row per node, chunk and code prefix that it lies in or probes.

    ``bits`` of a label is the length of the prefix: 0 for a label of few vectors,
    one more whenever the label doubles. ``part`` holds the chunk's values.
    """
    total = F.col("n") / F.lit(TILE_ROWS)
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("label"), F.greatest(F.lit(0), F.ceil(F.log2(total))).cast("int").alias("bits")
    )
    schema = ROWS.format(label=dict(nodes.dtypes)["label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            width = lists.value_lengths().to_numpy(zero_copy_only=False)
            bits = batch.column(3).to_numpy(zero_copy_only=False)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                turn = turns.get(w) or plain(w)
                values = turn.values(units(flat.reshape(len(at), w))).astype(np.float32)
                parts = chunks_of(w)
                half = (2 - 2 * limit + SLACK) / len(parts) / 2 + SLACK
                for c, part in enumerate(parts):
                    own = values[:, part]
                    code = codes_of(own)
                    for length in np.unique(bits[at]).tolist():
                        used = min(length, own.shape[1])
                        some = np.flatnonzero(bits[at] == length)
                        row, mask, _ = flips(own[some][:, :used], half)
                        prefix = (code[some][row] & ((1 << used) - 1)) ^ mask
                        rows = some[row]
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(1).take(pa.array(at[rows])),
                                pa.array(np.full(len(rows), w, np.int32)),
                                pa.array(np.full(len(rows), c, np.int32)),
                                pa.array(prefix.astype(np.int32)),
                                pa.array(mask == 0),
                                batch.column(0).take(pa.array(at[rows])),
                                pa.array([own[r].tobytes() for r in rows], pa.binary()),
                            ],
                            names=["label", "width", "chunk", "prefix", "home", "node", "part"],
                        )

    return nodes.join(sizes, "label").select("node", "label", "x", "bits").mapInArrow(run, schema)


KEYS = ["label", "width", "chunk", "prefix"]


def tiled(rows: DataFrame, tile_rows: int) -> DataFrame:
    """Rows with ``tile`` and ``seeks``: buckets of many rows are split into tiles.

    A node is stored in one tile of its own bucket and seeks in all tiles of the
    buckets it reaches.
    """
    tiles = (
        rows.where("home").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
        .select(*KEYS, F.ceil(F.col("n") / F.lit(tile_rows)).cast("int").alias("tiles"))
    )
    roles = F.explode(
        F.when(F.col("home"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
    )
    spread = F.when(F.col("seeks"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    )
    # a bucket nobody lives in has no tile
    return rows.join(tiles, KEYS).withColumn("seeks", roles).withColumn("tile", F.explode(spread))


def candidates(rows: DataFrame, limit: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(a, b)``, a < b, that come within the limit in some chunk."""

    def meet(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        seeks = found["seeks"].to_numpy(bool)
        node = found["node"].to_numpy(np.int64)
        values = np.frombuffer(b"".join(found["part"]), np.float32).reshape(len(found), -1)
        whole = (2 - 2 * limit + SLACK) / len(chunks_of(int(key[1])))
        here = np.flatnonzero(~seeks)
        code = codes_of(values[here])
        order = np.argsort(code, kind="stable")
        here, code = here[order], code[order]
        out = [np.zeros((0, 2), np.int64)]

        def compare(x: np.ndarray, first: np.ndarray, many: np.ndarray) -> None:
            """Row x[i] meets the ``many[i]`` stored rows from ``first[i]`` on, a slice at a time."""
            ends, cut = np.cumsum(many), 0
            while cut < len(many):
                stop = max(cut + 1, int(np.searchsorted(ends, ends[cut] - many[cut] + SLICE, side="right")))
                reps = many[cut:stop]
                a = np.repeat(x[cut:stop], reps)
                inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                b = here[np.repeat(first[cut:stop], reps) + inside]
                apart = ((values[a] - values[b]).astype(np.float64) ** 2).sum(axis=1)
                near = (node[a] != node[b]) & (apart <= whole + SLACK)
                out.append(np.unique(np.sort(np.stack([node[a[near]], node[b[near]]], axis=1), axis=1), axis=0))
                cut = stop

        searching = np.flatnonzero(seeks)
        for low in range(0, len(searching), 2048):
            asking = searching[low : low + 2048]
            row, mask, wide = flips(values[asking], whole / 2 + SLACK, PROBES)
            probe = codes_of(values[asking])[row] ^ mask
            first, last = np.searchsorted(code, probe), np.searchsorted(code, probe, side="right")
            hit = np.flatnonzero(last > first)
            compare(asking[row[hit]], first[hit], (last - first)[hit])
            compare(asking[wide], np.zeros(len(wide), np.int64), np.full(len(wide), len(here)))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return (
        tiled(rows, tile_rows).select(*KEYS, "tile", "seeks", "node", "part")
        .groupBy(*KEYS, "tile").applyInPandas(meet, "a long, b long").distinct()
    )


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays of doubles."""
    dot = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e
    )
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def _scaled(x: Column) -> Column:
    """The vector by a power of two that brings its largest value near 1: no overflow."""
    top = F.aggregate(x, F.lit(0.0), lambda s, e: F.greatest(s, F.abs(e)))
    return F.transform(F.array(F.pow(F.lit(2.0), -F.least(F.lit(1000), F.greatest(F.lit(-1000), F.floor(F.log2(top)))))), lambda p: F.transform(x, lambda e: e * p))[0]


def links(nodes: DataFrame, limit: float = LIMIT, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(a, b)`` of all nodes with the same label and a cosine of at least ``limit``."""
    rows = stored(table_rows(nodes, learn(nodes), limit), "vector-tables")
    pairs = candidates(rows, limit, tile_rows)
    vectors = nodes.select("node", _scaled(F.col("x")).alias("x"))
    left = vectors.select(F.col("node").alias("a"), F.col("x").alias("of_a"))
    right = vectors.select(F.col("node").alias("b"), F.col("x").alias("of_b"))
    return stored(
        pairs.join(left, "a").join(right, "b")
        .where(cosine(F.col("of_a"), F.col("of_b")) >= limit).select("a", "b"),
        "vector-links",
    )


def near_vectors(vectors: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    ``vectors`` needs ``vec_id, embedding, label``; other columns are not looked at.
    Rows with a null label, and vectors that are null, empty, zero or hold a null or
    non-finite component, link with nothing; so do vectors of different widths. Rows
    with equal label and vector are one node, however many, and link with each
    other; repeated rows and rows that share an id but not a vector count one by
    one. A row without an id counts as a link, has no component and is kept. An
    empty table gives no rows.
    """
    nodes = nodes_of(vectors)
    found = links(nodes, limit)
    ends = found.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("node"), F.col("a").alias("other")),
    )).alias("e")).select("e.*")
    weights = nodes.select(F.col("node").alias("other"), "weight")
    linked = ends.join(weights, "other").groupBy("node").agg(F.sum("weight").alias("others"))
    labels = components(found).select(F.col("id").alias("node"), F.col("label").alias("root"))
    named = nodes.select("node", "label", "x", "weight", "first").join(labels, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(
        named.join(least, "root").join(linked, "node", "left").select(
            F.col("label").alias("of_label"), F.col("x").alias("of_x"), "component_id",
            (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        ),
        "vector-classes",
    )
    x = F.transform("embedding", lambda e: e.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long"), "label", x.alias("x"))
    return (
        rows.join(classes, (F.col("label") == F.col("of_label")) & (F.col("x") == F.col("of_x")), "left")
        .select(
            "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
