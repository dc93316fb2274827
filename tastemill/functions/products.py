"""Dot products between the rows of a long sparse table, and exact top-k by blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.session import materialise

# rows with more cells keep the join, whose sums are spread over tasks by pair
BUSY_ROW = 5_000
# of top-k: groups of a grid, most bytes of doubles and least rows of a tile
GROUPS = 128
TILE_BYTES = 32_000_000
TILE_ROWS = 1024
# rows and columns multiplied at once
LEFT_ROWS = 256
FIRST_COLUMNS, COLUMNS = 128, 4096


def _block(c: str, n: int | Column) -> Column:
    return F.pmod(F.xxhash64(F.col(c)), F.lit(n) if isinstance(n, int) else n).cast("int")


def dot_products(
    left: DataFrame,
    right: DataFrame | None = None,
    row: str = "user_id",
    key: str = "movie_id",
    value: str = "rating",
    degree_limit: int = 1000,
    tile_rows: int = 1024,
    block_keys: int = 1024,
    largest: int | None = None,
) -> DataFrame:
    """``(id_a, id_b, dot)`` for every two rows that share a key; exact.

    With ``right`` omitted, each unordered pair of ``left`` rows appears once
    (``id_a < id_b``). Keys held by at most ``degree_limit`` rows are joined, so
    an input row makes at most ``degree_limit`` products, summed map-side before
    the shuffle. Keys above the limit never go through that join: their cells
    are cut into blocks (row tile x row tile x key block), multiplied as small
    matrices inside the tasks, and only the block sums leave the task. A block
    holds about ``tile_rows`` x ``block_keys`` cells whatever the table size.
    ``largest``, the row count of the most frequent key if known, lets the block
    branch be left out when no key is above the limit.
    """
    symmetric = right is None
    left = left.select(F.col(row).alias("id_a"), F.col(key).alias("k"), F.col(value).alias("x"))
    right = (
        left.select(F.col("id_a").alias("id_b"), "k", F.col("x").alias("y"))
        if symmetric
        else right.select(F.col(row).alias("id_b"), F.col(key).alias("k"), F.col(value).alias("y"))
    )
    if largest is not None and largest <= degree_limit:
        return _joined_dots(left, right, symmetric)
    heavy = (
        right.groupBy("k")
        .agg(F.count(F.lit(1)).alias("degree"))
        .where(F.col("degree") > degree_limit)
        .select("k")
    )
    light = _joined_dots(left, right.join(heavy, "k", "left_anti"), symmetric)

    dense_left = left.join(heavy, "k", "left_semi")
    dense_right = right.join(heavy, "k", "left_semi")
    seen = dense_left.select(F.col("id_a").alias("id"), "k").unionByName(
        dense_right.select(F.col("id_b").alias("id"), "k")
    )
    sizes = seen.agg(
        F.ceil(F.approx_count_distinct("id") / tile_rows).cast("int").alias("tiles"),
        F.ceil(F.approx_count_distinct("k") / block_keys).cast("int").alias("blocks"),
    )
    tiles = F.greatest(sizes.select("tiles").scalar(), F.lit(1))
    key_blocks = F.greatest(sizes.select("blocks").scalar(), F.lit(1))
    every_tile = F.sequence(F.lit(0), tiles - 1)
    a = (
        dense_left.withColumn("ta", _block("id_a", tiles))
        .withColumn("kb", _block("k", key_blocks))
        .withColumn("tb", F.explode(every_tile))
        .select("ta", "tb", "kb", F.lit(0).alias("side"), F.col("id_a").alias("id"), "k", "x")
    )
    b = (
        dense_right.withColumn("tb", _block("id_b", tiles))
        .withColumn("kb", _block("k", key_blocks))
        .withColumn("ta", F.explode(every_tile))
        .select(
            "ta", "tb", "kb", F.lit(1).alias("side"), F.col("id_b").alias("id"), "k",
            F.col("y").alias("x"),
        )
    )
    cells = a.unionByName(b)
    if symmetric:
        cells = cells.where(F.col("ta") <= F.col("tb"))
    blocks = cells.groupBy("ta", "tb", "kb").applyInArrow(
        lambda block: _block_dots(block.to_pandas(), symmetric),
        "id_a string, id_b string, dot double",
    )
    return (
        light.unionByName(blocks)
        .groupBy("id_a", "id_b")
        .agg(F.sum("dot").alias("dot"))
    )


def _joined_dots(left: DataFrame, right: DataFrame, symmetric: bool) -> DataFrame:
    if symmetric:
        busy = (
            left.groupBy("id_a")
            .agg(F.count(F.lit(1)).alias("cells"))
            .where(F.col("cells") > BUSY_ROW)
            .select("id_a")
        )
        return _listed_dots(left.join(busy, "id_a", "left_anti"), right).unionByName(
            _pair_sums(left.join(busy, "id_a", "left_semi"), right, F.col("id_a") < F.col("id_b"))
        )
    return _pair_sums(left, right, F.col("id_a") != F.col("id_b"))


def _pair_sums(left: DataFrame, right: DataFrame, kept: Column) -> DataFrame:
    pairs = left.join(right, "k").where(kept)
    return pairs.groupBy("id_a", "id_b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


def _listed_dots(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each unordered pair once; a cell travels with the list of the later rows of its key.

    All products of a row come to one task, where the pairs are formed and summed: what is
    shuffled are an id and a value per product, no pairs, and no pair table is kept before the
    shuffle. Lists hold at most ``degree_limit`` rows.
    """
    lists = right.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("id_b", "y"))).alias("c"))
    others = lists.select("k", F.col("c.id_b").alias("ids"), F.col("c.y").alias("ys"))
    # the lists are in id order: what follows a row's own place is later
    at = F.array_position("ids", F.col("id_a")).cast("int")
    rest = lambda c: F.slice(c, at + 1, F.greatest(F.size("ids") - at, F.lit(0)))
    rows = (
        left.join(others, "k")
        .where(F.col("id_a") < F.element_at("ids", -1))
        .select("id_a", "x", rest("ids").alias("ids"), rest("ys").alias("ys"))
        .repartition("id_a")
    )
    pairs = rows.select("id_a", "x", F.inline(F.arrays_zip("ids", "ys")))
    pairs = pairs.where(F.col("id_a") < F.col("ids"))  # a row may hold a key twice
    return pairs.groupBy("id_a", F.col("ids").alias("id_b")).agg(
        F.sum(F.col("x") * F.col("ys")).alias("dot")
    )


def _dense(part: pd.DataFrame, columns: pd.Index) -> tuple[np.ndarray, np.ndarray]:
    codes, ids = pd.factorize(part["id"], sort=True)
    m = np.zeros((len(ids), len(columns)))
    m[codes, columns.get_indexer(part["k"])] = part["x"]
    return np.asarray(ids, dtype=object), m


def _pairs(first: str, a, second: str, b, name: str, values) -> pa.Table:
    return pa.table(
        {
            first: pa.array(np.asarray(a, dtype=object), pa.string()),
            second: pa.array(np.asarray(b, dtype=object), pa.string()),
            name: pa.array(np.asarray(values, dtype=float), pa.float64()),
        }
    )


def _block_dots(block: pd.DataFrame, symmetric: bool) -> pa.Table:
    """Non-zero products of one block; with ``symmetric`` in id order, once each."""
    lhs, rhs = block[block["side"] == 0], block[block["side"] == 1]
    keys = pd.Index(np.intersect1d(lhs["k"].unique(), rhs["k"].unique()))
    lhs, rhs = lhs[lhs["k"].isin(keys)], rhs[rhs["k"].isin(keys)]
    if lhs.empty or rhs.empty:
        return _pairs("id_a", [], "id_b", [], "dot", [])
    ids_a, ma = _dense(lhs, keys)
    ids_b, mb = _dense(rhs, keys)
    dots = ma @ mb.T
    i, j = np.nonzero(dots)
    a, b, values = ids_a[i], ids_b[j], dots[i, j]
    if not symmetric:
        keep = a != b
    elif block["ta"].iat[0] == block["tb"].iat[0]:
        keep = a < b
    else:
        keep = np.ones(len(a), dtype=bool)
        a, b = np.where(a < b, a, b), np.where(a < b, b, a)
    return _pairs("id_a", a[keep], "id_b", b[keep], "dot", values[keep])


def _grid_shape(n_left: int, n_right: int, width: int, tile_rows: int | None) -> tuple[int, int]:
    """Tiles of the left and of the right side.

    As few as give ``GROUPS`` groups, since every tile of one side is a copy of the other; more
    only where a tile would exceed ``TILE_BYTES`` of doubles, fewer where it would have under
    ``TILE_ROWS`` rows.
    """
    if tile_rows is not None:
        return max(1, math.ceil(n_left / tile_rows)), max(1, math.ceil(n_right / tile_rows))
    fits = max(1, TILE_BYTES // (8 * max(1, width)))

    def tiles(n: int, other: int) -> int:
        wanted = math.ceil(math.sqrt(GROUPS * n / max(1, other)))
        return max(1, math.ceil(n / fits), min(wanted, math.ceil(n / TILE_ROWS)))

    return tiles(n_left, n_right), tiles(n_right, n_left)


def grid_top_k(
    left: DataFrame,
    right: DataFrame,
    k: int,
    exclude: DataFrame | None = None,
    tile_rows: int | None = None,
    clip_to: tuple[float, float] | None = None,
) -> DataFrame:
    """Exact ``k`` largest dot products per left vector: ``(id, other_id, score, rank)``.

    ``left`` and ``right`` are ``(id, vec array<double>)``, stored once here. Both sides are cut
    into tiles; every (left tile, right tile) meets in one group, is multiplied in small blocks
    and keeps ``k`` rows per left id, so the shuffle carries tiles in and ``k`` rows out, never
    all pairs. The number of tiles depends on the wanted number of groups, not on the rows, until
    a tile reaches ``TILE_BYTES``; ``tile_rows`` sets their size instead. ``exclude`` lists
    ``(id, other_id)`` not to be returned (each goes to the one group it belongs to).
    ``id == other_id`` is always left out when ``left is right``.

    Scores are clipped to ``clip_to`` if given, then compared at nine decimals,
    ties by ``other_id``.
    """
    same = left is right
    left = materialise(left.select("id", "vec"))
    right = left if same else materialise(right.select("id", "vec"))
    about = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    n_left, width = about(left)
    lt, rt = _grid_shape(n_left, n_left if same else about(right)[0], width, tile_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    no_vec = F.lit(None).cast("array<double>")
    no_id = F.lit(None).cast("string")
    grid = (
        left.select(
            _block("id", lt).alias("ta"), every(rt).alias("tb"),
            F.lit(0).alias("side"), "id", no_id.alias("other_id"), "vec",
        )
        .unionByName(
            right.select(
                every(lt).alias("ta"), _block("id", rt).alias("tb"),
                F.lit(1).alias("side"), "id", no_id.alias("other_id"), "vec",
            )
        )
    )
    if exclude is not None:
        grid = grid.unionByName(
            exclude.select(
                _block("id", lt).alias("ta"), _block("other_id", rt).alias("tb"),
                F.lit(2).alias("side"), "id", "other_id", no_vec.alias("vec"),
            )
        )
    best = grid.groupBy("ta", "tb").applyInArrow(
        lambda block: _tile_top_k(block, k, same, clip_to),
        "id string, other_id string, score double",
    )
    from tastemill.functions.ranking import top_n

    return top_n(best, k, by="id", tie="other_id")


def _side(block: pa.Table, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their vectors as a matrix."""
    rows = block.select(["side", "id", "vec"]).filter(pc.equal(block["side"], side)).sort_by("id")
    vec = rows["vec"].combine_chunks()
    sizes = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
    if len(np.unique(sizes)) > 1 or vec.null_count:
        raise ValueError("vectors must be present and of one length")
    matrix = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
    return rows["id"].to_numpy(), matrix


def _tile_top_k(
    block: pa.Table, k: int, same: bool, clip_to: tuple[float, float] | None
) -> pa.Table:
    ids, lhs = _side(block, 0)
    others, rhs = _side(block, 1)
    if not len(ids) or not len(others):
        return _pairs("id", [], "other_id", [], "score", [])
    gone = block.filter(pc.equal(block["side"], 2))
    at_row, at_col = pd.Index(ids), pd.Index(others)
    i, j = np.empty(0, int), np.empty(0, int)
    if gone.num_rows:
        i, j = at_row.get_indexer(gone["id"].to_numpy()), at_col.get_indexer(gone["other_id"].to_numpy())
    if same:
        i, j = np.append(i, np.arange(len(ids))), np.append(j, at_col.get_indexer(ids))
    hit = (i >= 0) & (j >= 0)
    i, j = i[hit], j[hit]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    found = []
    for a in range(0, len(ids), LEFT_ROWS):
        b = min(a + LEFT_ROWS, len(ids))
        own = slice(*np.searchsorted(i, [a, b]))
        row, col, score = _block_top_k(lhs[a:b], rhs, k, i[own] - a, j[own], clip_to)
        found.append((row + a, col, score))
    row, col, score = (np.concatenate(x) for x in zip(*found))
    return _pairs("id", ids[row], "other_id", others[col], "score", score)


def _block_top_k(
    lhs: np.ndarray, rhs: np.ndarray, k: int, i: np.ndarray, j: np.ndarray, clip_to: tuple[float, float] | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row of ``lhs @ rhs.T`` without the cells ``(i, j)``.

    Columns are seen in id order, so a later one must be better than the ``k``-th so far; the
    steps grow, so few cells pass after the first.
    """
    row, col, score = np.empty(0, int), np.empty(0, int), np.empty(0)
    kth = np.full(len(lhs), -np.inf)
    at, step = 0, FIRST_COLUMNS
    while at < len(rhs):
        end = min(at + step, len(rhs))
        scores = lhs @ rhs[at:end].T
        if clip_to is not None:
            np.clip(scores, *clip_to, out=scores)
        here = (j >= at) & (j < end)
        scores[i[here], j[here] - at] = -np.inf
        # rounded scores are 1e-9 apart: a better one is more than half of that above
        r, c = np.divmod(np.flatnonzero(scores > (kth + 4e-10)[:, None]), end - at)
        s = scores[r, c]
        real = np.isfinite(s)
        if real.any():
            row, col, score = np.append(row, r[real]), np.append(col, c[real] + at), np.append(score, s[real])
            order = np.lexsort((col, -np.round(score, 9), row))
            row, col, score = row[order], col[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, score = row[place < k], col[place < k], score[place < k]
            full = place[place < k] == k - 1
            kth[row[full]] = np.round(score[full], 9)
        at, step = end, min(2 * step, COLUMNS)
    return row, col, score
