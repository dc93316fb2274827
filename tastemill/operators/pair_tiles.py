"""Pairs of sparse rows in tiles, where products are formed and summed inside the task.

Summing the products of two rows in a shuffle sends one row per product, and sending a row the
lists of its keys one cell per product. Here whole rows travel to a few tiles instead: what is
shuffled are the cells times the tiles, whether the rows are connected or not.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions.ranking import dense_index
from tastemill.operators.neighbour_tiles import _blocks, _spread, _summed
from tastemill.session import materialise

# a row that alone forms more products than this is summed part by part
ROW_WORK = 2_000_000
# products, or sums of a dense block, that are held at once
BLOCK_WORK = 1_500_000
# of pairs of whole rows: cells of a tile at most and at least, groups of two tiles per core
TILE_CELLS = 16_000_000
LEAST_CELLS = 20_000
GROUPS_PER_CORE = 3
# of estimates: nearest rows that a tile keeps, and rows that wait to be compared with those
KEPT_ROWS = 6_000_000
WAITING = 4_000_000


def _row_lists(
    cells: DataFrame, row: str, key: str, own: Column, numbers: DataFrame | None = None
) -> DataFrame:
    """``(id, ks, xs, own)``: every row with its keys, as numbers in order, and its values ``x``.

    Cells without a key are in no list, but count for ``own``, which is aggregated over the row.
    """
    if numbers is None:
        numbers = dense_index(cells, key, "k").select(key, F.col("k").cast("int").alias("k"))
    return (
        cells.where(F.col(row).isNotNull())
        .join(numbers, key, "left")
        .groupBy(F.col(row).alias("id"))
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "x")))).alias("c"),
            own.alias("own"),
        )
        .select("id", F.col("c.k").alias("ks"), F.col("c.x").alias("xs"), "own")
    )


def _grid_tiles(cells: int, parallelism: int) -> int:
    """Tiles of rows of which every two meet: as few as keep the cores busy or fit ``TILE_CELLS``."""
    busy = math.ceil(math.sqrt(GROUPS_PER_CORE * 2 * parallelism))
    return max(1, math.ceil(cells / TILE_CELLS), min(busy, math.ceil(cells / LEAST_CELLS)))


def _pair_sums(at: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct positions in order and the sums of their values; one plain sort if they are sparse."""
    bits = len(at).bit_length()
    if 4 * len(at) > size or not len(at) or int(size).bit_length() + bits > 62:
        return _summed(at, values, size)
    packed = np.sort((at << bits) | np.arange(len(at)))
    place, order = packed >> bits, packed & ((1 << bits) - 1)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return place[first], np.add.reduceat(values[order], first)


def _lists_by(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys, and where the list of each begins and the last one ends."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.r_[first, len(keys)]


def _found(known: np.ndarray, start: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the list of each key begins, and its length."""
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return start[at], np.where(known[at] == keys, start[at + 1] - start[at], 0)


class _Rows:
    """Whole rows, as they come: ids, and cells ``key, x`` from ``start[i]`` on for row ``i``."""

    def __init__(self, table: pa.Table):
        flat = lambda name: np.concatenate(
            [c.flatten().to_numpy(zero_copy_only=False) for c in table[name].chunks]
        )
        self.ids = table["id"].combine_chunks()
        self.size = pc.list_value_length(table["ks"]).to_numpy().astype(np.int64)
        self.start = np.r_[0, np.cumsum(self.size)]
        self.key, self.x = flat("ks"), flat("xs")
        self.own = table["own"].to_numpy()
        if "norm" in table.column_names:
            each = lambda name: np.repeat(table[name].to_numpy(), self.size)
            self.x, self.y = self.x / each("norm"), self.x - each("mean")


class _Held(_Rows):
    """The rows of a tile under numbers in id order, with the lists of their keys."""

    def __init__(self, table: pa.Table):
        super().__init__(table)
        in_order = pc.sort_indices(self.ids)
        self.names, at = self.ids.take(in_order), in_order.to_numpy()
        self.number = np.empty(len(at), np.int64)
        self.number[at] = np.arange(len(at))
        self.carried = self.own[at]
        row = np.repeat(self.number, self.size)
        order = np.argsort((self.key.astype(np.int64) << 32) | row)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.row, self.value = row[order], self.x[order]
        self.keys, self.list_start = _lists_by(self.key[order])

    def lists_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _found(self.keys, self.list_start, keys)

    def later(self) -> tuple[np.ndarray, np.ndarray]:
        """For every cell, the cells of its key after its own."""
        at = np.searchsorted(self.list_start, self.place, "right")
        return self.place + 1, self.list_start[at] - self.place - 1


def _dots_of(rows: _Rows, held: _Held, begin: np.ndarray, count: np.ndarray):
    """``(row, other, dot)``: the rows' products with the listed cells, in bounded blocks."""
    many = len(held.names)
    formed = np.r_[0, np.cumsum(count)][rows.start]
    for block in _blocks(np.diff(formed), BLOCK_WORK):
        if not len(block):
            continue
        cells = slice(rows.start[block[0]], rows.start[block[-1] + 1])
        work = formed[block[-1] + 1] - formed[block[0]]
        if len(block) == 1 and work > ROW_WORK:
            # a row with very many cells: its sums are held, its products formed part by part
            dots, met = np.zeros(many), np.zeros(many, bool)
            for part in _blocks(count[cells], BLOCK_WORK):
                part = part + cells.start
                at = _spread(begin[part], count[part])
                dots += np.bincount(held.row[at], np.repeat(rows.x[part], count[part]) * held.value[at], many)
                met[held.row[at]] = True
            other = np.flatnonzero(met)
            yield np.full(len(other), block[0]), other, dots[other]
            continue
        at = _spread(begin[cells], count[cells])
        row = np.repeat(np.repeat(np.arange(len(block)), rows.size[block]), count[cells])
        pair, dots = _pair_sums(
            row * many + held.row[at], np.repeat(rows.x[cells], count[cells]) * held.value[at], len(block) * many
        )
        row, other = np.divmod(pair, many)
        yield block[0] + row, other, dots


def _grid_dots(batches: Iterable[pa.RecordBatch], tiles: int, least: float | None, carried: bool) -> Iterator[tuple]:
    """``(id_a, id_b, dot)`` of two tiles' rows, or of one tile's; the held tile's rows come first.

    With ``carried``, followed by the value that each row carries.
    """
    first, held, alone = [], None, False

    def out(a, b, names, own, dots):
        kept = slice(None) if least is None else dots >= least
        a, b, dots = a[kept], b[kept], dots[kept]
        return (
            *(names.take(pa.array(e)) for e in (a, b)), pa.array(dots, pa.float64()),
            *(pa.array(own[e]) for e in (a, b) if carried),
        )

    for batch in batches:
        batch = pa.Table.from_batches([batch])
        alone = alone or bool(batch.num_rows) and batch["g"][0].as_py() % (tiles + 1) == 0
        side = batch["side"].to_numpy()
        if (side == 0).any():
            first.append(batch.filter(pa.array(side == 0)))
        if not (side == 1).any() or not first:
            continue
        held = held or _Held(pa.concat_tables(first))
        rows = _Rows(batch.filter(pa.array(side == 1)))
        names = pa.concat_arrays([held.names, rows.ids])
        own = np.r_[held.carried, rows.own]
        # an id lies before the held ones from its place on
        place = np.searchsorted(held.names.to_numpy(zero_copy_only=False), rows.ids.to_numpy(zero_copy_only=False))
        for row, other, dots in _dots_of(rows, held, *held.lists_of(rows.key)):
            before, row = place[row] <= other, row + len(held.names)
            yield out(np.where(before, row, other), np.where(before, other, row), names, own, dots)
    if alone and first:
        held = _Held(pa.concat_tables(first))
        for row, other, dots in _dots_of(held, held, *held.later()):
            apart = held.number[row] != other  # a row may hold a key twice
            yield out(held.number[row][apart], other[apart], held.names, held.carried, dots[apart])


def row_dots(
    cells: DataFrame, row: str, key: str, value: str = "rating", least: float | None = None,
    carry: str | None = None,
) -> DataFrame:
    """``(id_a, id_b, dot)``: each unordered pair of rows that share a key once, exact.

    Rows travel whole, in tiles of which every two meet once: a cell is sent as often as there are
    tiles, whatever its key's other rows, and a pair is summed where its rows meet. The tile that
    is held has about ``TILE_CELLS`` cells at most, the other one passes by. For tables whose keys
    have bounded lists (``DEGREE_LIMIT`` rows). With ``least``, smaller dots stay in their task. The
    column ``carry``, one double per row, comes along as ``carry_a`` and ``carry_b``. The pairs of a
    single tile are stored, as callers read them in both directions; those of more tiles are not.
    """
    own = F.first(carry) if carry else F.first(F.lit(0.0))
    rows = materialise(_row_lists(cells.withColumn("x", F.col(value).cast("double")), row, key, own))
    total = rows.agg(F.sum(F.size("ks"))).first()[0] or 0
    tiles = _grid_tiles(total, cells.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    )
    met = dealt.select(
        (F.least("at", "other") * tiles + F.greatest("at", "other")).alias("g"),
        (F.col("at") > F.col("other")).cast("int").alias("side"), "id", "ks", "xs", "own",
    )
    kinds = {"id_a": "string", "id_b": "string", "dot": "double"}
    if carry:
        kinds |= {f"{carry}_a": "double", f"{carry}_b": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _grid_dots(batches, tiles, least, bool(carry)):
            yield pa.record_batch(list(columns), names=list(kinds))

    dots = (
        met.repartition(min(2 * tiles * (tiles + 1), 4000), "g")
        .sortWithinPartitions("g", "side")
        .groupBy("g")
        .applyInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))
    )
    return materialise(dots) if tiles == 1 else dots


class _Asked:
    """The keys that a tile's rows ask for, key by key, and the ``k`` nearest rows found for each so far."""

    def __init__(self, table: pa.Table, held: _Held, k: int):
        lists = [c for c in table["asks"].chunks if len(c)]
        flat = lambda name: [c.flatten().field(name) for c in lists]
        key = np.concatenate([c.to_numpy() for c in flat("k")])
        row = np.repeat(held.number, pc.list_value_length(table["asks"]).to_numpy())
        order = np.argsort((key.astype(np.int64) << 32) | row)
        self.row, self.ids = row[order], pa.concat_arrays(flat("key")).take(pa.array(order))
        self.keys, self.list_start = _lists_by(key[order])
        self.k, self.kth = k, np.full(len(order), -np.inf)
        self.found = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0))]
        self.waiting = 0

    def add(self, ask: np.ndarray, sim: np.ndarray, number: np.ndarray, value: np.ndarray) -> None:
        near = np.round(sim, 9) >= self.kth[ask]
        self.found.append((ask[near], sim[near], number[near], value[near]))
        self.waiting += len(ask[near])
        if self.waiting > WAITING:
            self.settle()

    def settle(self) -> tuple:
        """Keeps the ``k`` nearest rows of every asked key, ties by id; returns them in that order."""
        ask, sim, number, value = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((number, -np.round(sim, 9), ask))
        ask = ask[order]
        first = np.flatnonzero(np.r_[True, ask[1:] != ask[:-1]][: len(ask)])
        place = np.arange(len(ask)) - np.repeat(first, np.diff(np.r_[first, len(ask)]))
        order, ask = order[place < self.k], ask[place < self.k]
        kept = ask, sim[order], number[order], value[order]
        full = place[place < self.k] == self.k - 1
        self.kth[ask[full]] = np.round(kept[1][full], 9)
        self.found, self.waiting = [kept], 0
        return kept


def _near_rows(rows: _Rows, held: _Held, asked: _Asked) -> None:
    """Every row that passes is a neighbour of the held rows it shares a key with."""
    many = len(held.names)
    begin, count = held.lists_of(rows.key)
    first, asks = _found(asked.keys, asked.list_start, rows.key)
    formed = np.r_[0, np.cumsum(count + asks)][rows.start]
    for block in _blocks(np.diff(formed), BLOCK_WORK):
        if not len(block):
            continue
        cells = slice(rows.start[block[0]], rows.start[block[-1] + 1])
        row = np.repeat(np.arange(len(block)), rows.size[block])
        at = _spread(begin[cells], count[cells])
        pair, sims = _pair_sums(
            np.repeat(row, count[cells]) * many + held.row[at],
            np.repeat(rows.x[cells], count[cells]) * held.value[at], len(block) * many,
        )
        near, other = np.divmod(pair, many)
        # nobody is its own neighbour
        kept = (sims > 0) & (rows.own[block[0] + near] != held.carried[other])
        pair, sims = pair[kept], sims[kept]
        if not len(pair):
            continue
        at = _spread(first[cells], asks[cells])
        cell = np.repeat(np.arange(cells.start, cells.stop), asks[cells])
        row = np.repeat(row, asks[cells])
        wanted = row * many + asked.row[at]
        place = np.minimum(np.searchsorted(pair, wanted), len(pair) - 1)
        met = pair[place] == wanted
        asked.add(at[met], sims[place[met]], rows.own[block[0] + row[met]], rows.y[cell[met]])


def _grid_estimates(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """``(row, key, estimate)`` of a tile's asking rows, which come first; then all rows pass by."""
    first, held, asked = [], None, None
    for batch in batches:
        batch = pa.Table.from_batches([batch])
        side = batch["side"].to_numpy()
        if (side == 0).any():
            first.append(batch.filter(pa.array(side == 0)))
        if not (side == 1).any() or not first:
            continue
        if held is None:
            table = pa.concat_tables(first)
            held = _Held(table)
            asked = _Asked(table, held, k)
        _near_rows(_Rows(batch.filter(pa.array(side == 1))), held, asked)
    if asked is None:
        return
    ask, sim, _, value = asked.settle()
    begin = np.flatnonzero(np.r_[True, ask[1:] != ask[:-1]][: len(ask)])
    for part in _blocks(np.ones(len(begin), np.int64), BLOCK_WORK):
        if not len(part):
            continue
        rows = slice(begin[part[0]], begin[part[-1] + 1] if part[-1] + 1 < len(begin) else len(ask))
        cut = begin[part] - rows.start
        estimates = np.add.reduceat(sim[rows] * value[rows], cut) / np.add.reduceat(sim[rows], cut)
        found = ask[begin[part]]
        yield held.names.take(pa.array(asked.row[found])), asked.ids.take(pa.array(found)), pa.array(estimates)


def nearest_estimates(
    cells: DataFrame, pairs: DataFrame, row: str, key: str, k: int, mean_over: Column | None = None
) -> DataFrame:
    """``(row, key, estimate)`` for the asked ``pairs``.

    Rows of ``cells (row, key, rating)`` are alike by their cosine; an estimate is the mean rating of
    the ``k`` most alike rows that hold the key, weighted by likeness, ties by id. With ``mean_over``,
    ratings count less the sum of their row's ratings by that number. Pairs without such a row are
    left out. Ratings are positive, keys have bounded lists. The asking rows of a tile are held with
    the nearest rows found so far, about ``KEPT_ROWS``, while all rows pass by whole. The estimates,
    a row per pair at most, are stored, so that joins with them are planned by their size.
    """
    mean = F.lit(0.0) if mean_over is None else F.sum("x") / mean_over.cast("double")
    squares = F.sqrt(F.sum(F.col("x") * F.col("x")))
    values = cells.withColumn("x", F.col("rating").cast("double"))
    numbers = materialise(dense_index(cells, key, "k").select(key, F.col("k").cast("int").alias("k")))
    lists = _row_lists(values, row, key, F.struct(squares.alias("norm"), mean.alias("mean")), numbers)
    order = dense_index(cells, row, "number").withColumnRenamed(row, "id")
    rows = materialise(
        lists.join(order, "id").select(
            "id", "ks", "xs", F.col("number").cast("double").alias("own"), "own.norm", "own.mean"
        )
    )
    asked = pairs.join(numbers, key).groupBy(F.col(row).alias("id")).agg(
        F.collect_list(F.struct("k", F.col(key).alias("key"))).alias("asks")
    )
    held = materialise(rows.join(asked, "id"))
    total = held.agg(F.sum(F.size("asks"))).first()[0] or 0
    busy = 2 * cells.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, math.ceil(k * total / KEPT_ROWS), min(busy, math.ceil(total / LEAST_CELLS)))
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile")
    no_asks = F.lit(None).cast(held.schema["asks"].dataType).alias("asks")
    dealt = held.select(
        F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int").alias("tile"), F.lit(0).alias("side"), "*"
    ).unionByName(rows.select(every, F.lit(1).alias("side"), "*", no_asks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _grid_estimates(batches, k):
            yield pa.record_batch(list(columns), names=[row, key, "estimate"])

    return materialise(
        dealt.repartition(min(4 * tiles, 4000), "tile")
        .sortWithinPartitions("tile", "side")
        .groupBy("tile")
        .applyInArrow(run, f"{row} string, {key} string, estimate double")
    )
