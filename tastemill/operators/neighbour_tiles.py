"""Neighbourhood scores in tiles of users: a tile gets the rows it can reach once, not once per pair.

A user meets the users that share a movie with it. Forming (user, neighbour, movie) rows in a
shuffle costs about 1,000 rows per rating; here every tile of users gets the cells of all users it
reaches, forms those rows user by user inside the task and sends on ``n`` rows per user.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.ranking import dense_index
from tastemill.session import materialise

# cells that one tile may hold, 20 bytes each; up to so many, every tile holds all
RESIDENT_CELLS = 40_000_000
# (user, neighbour, movie) rows that one tile forms, if what it reaches is bounded by its component
TILE_WORK = 600_000_000
# users who alone form more rows than this are left to the joins
USER_WORK = 8_000_000
# up to so many rated movies, tiles of the item-based method get all similarities instead of cells
FEW_MOVIES = 1000
# rows that such a tile forms, and its users' cells
FEW_WORK = 100_000_000
FEW_CELLS = 1_000_000
# similarities of movies that a tile keeps, and rows that it forms at once
KEPT_PAIRS = 8_000_000
BLOCK_ROWS = 300_000
# of the user-based method: nearest users looked at first, in cells per movie and neighbour wanted
FIRST_CELLS = 6
# of the search for the best movies: cells of a neighbour read first, and rounds before all are read
BEST_CELLS, BEST_ROUNDS = 2, 4


@dataclass(frozen=True)
class Coded:
    """Rated cells under dense numbers (in id order), and the numbers' ids.

    ``cells`` is ``(u, m, rating)``; movies outside ``items`` have numbers from ``n_items`` on.
    """

    cells: DataFrame
    users: DataFrame
    movies: DataFrame
    n_items: int


def coded(cells: DataFrame, items: DataFrame) -> Coded:
    users = dense_index(cells, "user_id", "u")
    movies = dense_index(items, "movie_id", "m")
    n_items = movies.count()
    others = cells.select("movie_id").distinct().join(movies, "movie_id", "left_anti")
    movies = movies.unionByName(
        dense_index(others, "movie_id", "m").withColumn("m", F.col("m") + F.lit(n_items))
    )
    numbered = cells.join(users, "user_id").join(movies, "movie_id").select("u", "m", "rating")
    return Coded(materialise(numbered), users, movies, n_items)


def user_work(cells: DataFrame) -> DataFrame:
    """``(u, cells, met, work)``: a user's cells, the cells on its movies, and the rows its neighbours' cells make."""
    sizes = cells.groupBy("u").agg(F.count(F.lit(1)).alias("cells"))
    movies = cells.join(sizes, "u").groupBy("m").agg(
        F.count(F.lit(1)).alias("raters"), F.sum("cells").alias("reach")
    )
    work = cells.join(movies, "m").groupBy("u").agg(
        F.sum("raters").alias("met"), F.sum("reach").alias("work")
    )
    return sizes.join(work, "u")


def nearest_work(work: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """The rows that the user-based method forms at most, where a tile may hold all cells.

    A neighbour's cells are rows once, however many movies it shares, and a movie that ``k`` of the
    nearest users rated needs no others. What a tile reaches stays bounded by all cells.
    """
    total, movies = cells.agg(F.count(F.lit(1)), F.countDistinct("m")).first()
    if total > RESIDENT_CELLS:
        return work
    first = F.col("met") + F.lit(8 * FIRST_CELLS * k * movies)
    return work.withColumn("work", F.least("work", F.lit(total), first))


def _labels(cells: DataFrame) -> DataFrame:
    """``(u, label, closed)``: users of one component mostly share a label after two rounds.

    ``closed`` says that none of the user's movies is rated under another label.
    """
    rows = cells.select("u", "m", F.col("u").alias("label"))
    for _ in range(2):
        low = rows.groupBy("m").agg(F.min("label").alias("label"))
        low = rows.select("u", "m").join(low, "m").groupBy("u").agg(F.min("label").alias("label"))
        rows = cells.select("u", "m").join(low, "u")
    rows = materialise(rows)
    ends = rows.groupBy("m").agg((F.min("label") == F.max("label")).alias("alone"))
    return rows.join(ends, "m").groupBy("u").agg(
        F.min("label").alias("label"), F.min("alone").alias("closed")
    )


def user_tiles(cells: DataFrame, work: DataFrame, parallelism: int) -> tuple[DataFrame, int]:
    """``(u, tile)`` for the users of ``work``, and the number of tiles.

    What a tile reaches is about ``RESIDENT_CELLS`` cells at most: everything or its component if
    those are smaller, else the rows that its users form (``USER_WORK`` for a single user). Small
    components share tiles.
    """
    total, whole = cells.count(), work.agg(F.sum("work")).first()[0] or 0
    most = max(1, min(TILE_WORK, whole // (3 * parallelism)))
    if total <= RESIDENT_CELLS:
        # every tile is a copy of all cells: no more than keep the cores busy, whatever the work
        parts = max(1, min(2 * parallelism, -(-whole // most)))
        return work.select("u", F.pmod(F.xxhash64("u"), F.lit(parts)).alias("tile")), parts
    # a component may hold users that are not asked; one that may go on counts as everything
    labels = materialise(_labels(cells))
    users = materialise(work.join(labels, "u"))
    groups = users.groupBy("label").agg(
        F.sum("work").alias("work"), F.min("closed").alias("closed")
    )
    own = cells.join(labels.select("u", "label"), "u").groupBy("label").agg(
        F.count(F.lit(1)).alias("cells")
    )
    held = F.when(F.col("closed"), F.col("cells")).otherwise(F.lit(total))
    groups = groups.join(own, "label").withColumn("held", held)
    room = F.when(F.col("held") <= RESIDENT_CELLS, F.lit(most)).otherwise(
        F.lit(min(most, RESIDENT_CELLS))
    )
    groups = materialise(
        groups.withColumn("parts", F.ceil(F.col("work") / room).cast("bigint"))
        .withColumn("small", F.col("closed") & (F.col("parts") <= 1) & (F.col("held") < RESIDENT_CELLS // 8))
    )
    few = groups.where("small").agg(F.sum("work"), F.sum("held")).first()
    shared = max(
        -(-(few[0] or 0) // most), -(-(few[1] or 0) // (RESIDENT_CELLS // 4)), 1
    )
    large = groups.where(~F.col("small")).agg(F.sum("parts")).first()[0] or 0
    part = F.pmod(F.xxhash64("u"), F.greatest("parts", F.lit(1)))
    tile = F.when(F.col("small"), F.pmod(F.xxhash64("label"), F.lit(shared))).otherwise(
        F.xxhash64("label", part)
    )
    tiles = users.join(groups.select("label", "parts", "small"), "label").select(
        "u", tile.alias("tile")
    )
    return materialise(tiles), shared + large


def _rows_of_tiles(cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """``(tile, u, own, ms, rs, ns)``: the cells of every user that a tile reaches."""
    norms = cells.groupBy("m").agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("norm"))
    lists = (
        cells.join(norms, "m")
        .groupBy("u")
        .agg(F.sort_array(F.collect_list(F.struct("m", "rating", "norm"))).alias("c"))
        .select(
            "u", F.col("c.m").cast("array<int>").alias("ms"), F.col("c.rating").alias("rs"), F.col("c.norm").alias("ns")
        )
    )
    asked = cells.join(tiles, "u").select("tile", "m").distinct()
    reached = asked.join(cells.select("u", "m"), "m").select("tile", "u").distinct()
    marked = reached.join(
        tiles.withColumn("own", F.lit(True)), ["tile", "u"], "left"
    ).fillna(False, ["own"])
    return marked.join(lists, "u")


def _rows_of_all(cells: DataFrame, tiles: DataFrame, count: int, best_first: bool) -> DataFrame:
    """``(tile, u, own, ms, rs)``: the cells of every user in every tile.

    A user's cells are in the order of the movies, with ``best_first`` after their rounded ratings.
    """
    before = [F.round(-F.col("rating"), 9).alias("o")] if best_first else []
    lists = cells.groupBy("u").agg(F.sort_array(F.collect_list(F.struct(*before, "m", "rating"))).alias("c"))
    return lists.join(tiles.withColumnRenamed("tile", "home"), "u", "left").select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))).alias("tile"), "home",
        "u", F.col("c.m").cast("array<int>").alias("ms"), F.col("c.rating").alias("rs"),
    ).select("tile", "u", F.coalesce(F.col("home") == F.col("tile"), F.lit(False)).alias("own"), "ms", "rs")


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of several runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _summed(at: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct positions in order and the sums of their values."""
    if 4 * len(at) > size:
        seen = np.flatnonzero(np.bincount(at, minlength=size))
        return seen, np.bincount(at, values, minlength=size)[seen]
    seen, back = np.unique(at, return_inverse=True)
    return seen, np.bincount(back, values, minlength=len(seen))


def _nearest(group: np.ndarray, sims: np.ndarray, values: np.ndarray, k: int, ordered: bool):
    """Groups and weighted means of their ``k`` nearest rows; earlier rows win ties.

    ``ordered`` says that the rows come nearest first.
    """
    if not len(group):
        return group, sims
    # group above, place below: one plain sort is stable
    code = np.sort((group.astype(np.int64) << 32) | np.arange(len(group)))
    order, sorted_ = code & 0xFFFFFFFF, code >> 32
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    sizes = np.diff(np.r_[first, len(sorted_)])
    if not ordered and (sizes > k).any():
        at = _spread(first[sizes > k], sizes[sizes > k])
        rows = order[at]
        order[at] = rows[np.lexsort((rows, -np.round(sims[rows], 9), sorted_[at]))]
    kept = np.minimum(sizes, k)
    keep = order[_spread(first, kept)]
    cut = np.r_[0, np.cumsum(kept)[:-1]]
    top = np.add.reduceat(sims[keep] * values[keep], cut)
    weight = np.add.reduceat(np.abs(sims[keep]), cut)
    return sorted_[first], np.divide(top, weight, out=np.full(len(top), np.nan), where=weight != 0)


class _Tile:
    """Cells of one tile by user and by movie, under local numbers in the global order."""

    def __init__(self, table: pa.Table):
        users = table["u"].to_numpy()
        if (users[1:] < users[:-1]).any():
            table = table.combine_chunks().sort_by("u")
        flat = lambda name: np.concatenate(
            [c.flatten().to_numpy(zero_copy_only=False) for c in table[name].chunks]
        )
        self.users = table["u"].to_numpy()
        self.own = np.flatnonzero(table["own"].to_numpy())
        lengths = pc.list_value_length(table["ms"]).to_numpy().astype(np.int64)
        movie = flat("ms")
        held = np.bincount(movie)
        self.movies = np.flatnonzero(held)
        self.raters = held[self.movies]
        self.movie = (np.cumsum(held > 0) - 1).astype(np.int32)[movie]
        self.rating = flat("rs")
        self.start = np.r_[0, np.cumsum(lengths)]
        self.size = lengths
        self.user = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        code = (self.movie.astype(np.int64) << 32) | np.arange(len(movie))
        code.sort()
        self.by_movie = code.astype(np.uint32).astype(np.int32)  # the place is what the lower bits say
        del code
        self.movie_start = np.r_[0, np.cumsum(self.raters)]
        self.norms = np.empty(len(self.movies))  # of the movies
        if "ns" in table.column_names:
            self.norms[self.movie] = flat("ns")
        else:
            self.norms[:] = np.sqrt(np.bincount(self.movie, self.rating * self.rating, len(self.movies)))

    def cells_of(self, users: np.ndarray) -> np.ndarray:
        return _spread(self.start[users], self.size[users])

    def cells_on(self, movies: np.ndarray) -> np.ndarray:
        return self.by_movie[_spread(self.movie_start[movies], self.raters[movies])]


def _best(tile: _Tile, movies, scores, rated, n: int, n_items: int):
    """The ``n`` best of a user's unrated movies of the universe."""
    known = np.zeros(len(tile.movies), bool)
    known[rated] = True
    fresh = ~known[movies] & (scores > 0) & (tile.movies[movies] < n_items)
    movies, rank = movies[fresh], -np.round(scores[fresh], 9)
    scores = scores[fresh]
    if len(rank) > n:
        near = np.flatnonzero(rank <= np.partition(rank, n - 1)[n - 1])
        movies, rank, scores = movies[near], rank[near], scores[near]
    order = np.argsort(rank, kind="stable")[:n]
    return tile.movies[movies[order]], scores[order]


def _first_free(taken: np.ndarray, n: int, n_items: int) -> np.ndarray:
    """The ``n`` smallest numbers below ``n_items`` that are not taken."""
    free = np.ones(min(n_items, len(taken) + n), bool)
    free[taken[taken < len(free)]] = False
    return np.flatnonzero(free)[:n]


def _user_estimates(
    tile: _Tile, near: np.ndarray, sims: np.ndarray, rated: np.ndarray, deviation: Callable, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Movies in order and the weighted mean deviation of the ``k`` nearest users who rated them.

    What ``k`` of the nearest users rated is settled by them. The other movies are looked up from
    their raters, unless those are more rows than the neighbours' cells, which are all read then.
    """
    rank = -np.round(sims, 9)
    rows, many = tile.size[near].sum(), len(tile.movies)
    first = int(FIRST_CELLS * k * many * len(near) / max(1, rows)) + 1
    while 2 * first < len(near):
        few = np.flatnonzero(rank <= np.partition(rank, first - 1)[first - 1])
        cells = tile.cells_of(near[few])
        wanted = np.bincount(tile.movie[cells], minlength=many) < k
        settled = ~wanted
        wanted[rated] = False
        wanted = np.flatnonzero(wanted)
        first *= 4  # neighbours that rated the same movies settle few others
        looked = tile.raters[wanted].sum()
        if looked > 4 * len(cells) and 2 * first < len(near):
            continue
        if looked >= rows:
            break
        few = few[np.argsort(rank[few], kind="stable")]
        cells = tile.cells_of(near[few])
        movies, estimates = _nearest(
            tile.movie[cells], np.repeat(sims[few], tile.size[near[few]]), deviation(cells), k, True
        )
        movies, estimates = movies[settled[movies]], estimates[settled[movies]]
        cells = tile.cells_on(wanted)
        of = np.full(len(tile.users), np.nan)
        of[near] = sims
        cells = cells[~np.isnan(of[tile.user[cells]])]
        others, more = _nearest(tile.movie[cells], of[tile.user[cells]], deviation(cells), k, False)
        movies, estimates = np.r_[movies, others], np.r_[estimates, more]
        order = np.argsort(movies)
        return movies[order], estimates[order]
    order = np.argsort(rank, kind="stable")
    near, sims = near[order], sims[order]
    cells = tile.cells_of(near)
    return _nearest(tile.movie[cells], np.repeat(sims, tile.size[near]), deviation(cells), k, True)


def _first_cells(tile: _Tile, near: np.ndarray, level: np.ndarray, best_first: bool, round_: int):
    """``(movies, -promises, whole)`` from the first cells of the neighbours, in that order.

    ``level`` is what a neighbour promises for its movies, with ``best_first`` plus the cell's rating.
    Only movies that come before all that is not read are returned; ``whole`` says that all was read.
    """
    count = np.minimum(tile.size[near], BEST_CELLS * 4**round_)
    cells = _spread(tile.start[near], count)
    row = np.repeat(np.arange(len(near)), count)

    def promises(cells, row):
        raw = level[row] + tile.rating[cells] if best_first else level[row]
        return -np.round(np.minimum(raw + 1e-12, 5), 9), raw

    more = np.flatnonzero(tile.size[near] > count)
    promise, _ = promises(cells, row)
    movie = tile.movie[cells]
    if len(more):
        after = tile.start[near[more]] + count[more]
        rest, raw = promises(after, more)
        first = tile.movie[after]
        if best_first:
            # ratings that all promise the greatest score are not in the order of movies
            top = (tile.rating[after] > tile.below) & (level[more] + tile.below < 5 - 1e-9)
            first = np.where((raw <= 5) | top, first, -1)
        at = np.lexsort((first, rest))[0]
        known = (promise < rest[at]) | ((promise == rest[at]) & (movie < first[at]))
        promise, movie = promise[known], movie[known]
    order = np.lexsort((promise, movie))
    promise, movie = promise[order], movie[order]
    single = np.r_[True, movie[1:] != movie[:-1]][: len(movie)]
    promise, movie = promise[single], movie[single]
    order = np.lexsort((movie, promise))
    return movie[order], promise[order], not len(more)


def _best_promised(tile: _Tile, near, level, rated, n: int, n_items: int, least: float, best_first: bool, score):
    """The ``n`` best movies without the scores of all: ``(movies, scores)``, or None to read everything.

    A movie's score is a mean of what its raters promise, so it is at most the best promise. Movies are
    scored in the order of their promises until ``n`` of them, all above ``least``, come before the next.
    """
    for round_ in range(BEST_ROUNDS):
        movies, promise, whole = _first_cells(tile, near, level, best_first, round_)
        fresh = (tile.movies[movies] < n_items) & ~np.isin(movies, rated)
        movies, promise = movies[fresh], promise[fresh]
        found, key, at, step = np.empty(0, np.int64), np.empty(0), 0, 2 * n
        scores = np.empty(0)
        while at < len(movies) and at < 16 * n:
            part = movies[at : at + step]
            new, values = score(np.sort(part))
            found, scores = np.r_[found, new], np.r_[scores, values]
            key = -np.round(scores, 9)
            order = np.lexsort((found, key))[:n]
            found, scores, key = found[order], scores[order], key[order]
            at += step
            if len(found) < n:
                continue
            last = key[-1], found[-1]
            if -last[0] <= round(least, 9):
                return None
            if at < len(movies):
                if last <= (promise[at], movies[at]):
                    return tile.movies[found], scores
            elif whole:
                return tile.movies[found], scores
        if whole:
            return None
    return None


def _search_pays(tile: _Tile, rows: int, n: int) -> bool:
    """Scoring a few movies from their raters is less than reading what the neighbours rated."""
    return rows > 8 * n * len(tile.movie) / max(1, len(tile.movies))


def _user_based(tile: _Tile, k: int, n: int, n_items: int, best_first: bool = False):
    users = len(tile.users)
    norm = np.sqrt(np.bincount(tile.user, tile.rating * tile.rating, minlength=users))
    means = np.bincount(tile.user, tile.rating, minlength=users) / n_items if n_items else np.zeros(users)
    unit = lambda cells: tile.rating[cells] / norm[tile.user[cells]]
    deviation = lambda cells: tile.rating[cells] - means[tile.user[cells]]
    if best_first and len(tile.rating):
        lower = tile.rating[np.round(tile.rating, 9) < round(tile.rating.max(), 9)]
        tile.below = lower.max() if len(lower) else -np.inf  # the best rating but one
    for u in tile.own:
        mine = np.arange(tile.start[u], tile.start[u + 1])
        rated = tile.movie[mine]
        met = tile.cells_on(rated)
        near, sims = _summed(tile.user[met], np.repeat(unit(mine), tile.raters[rated]) * unit(met), users)
        sims, near = sims[near != u], near[near != u]

        def score(movies):
            cells = tile.cells_on(movies)
            place = np.minimum(np.searchsorted(near, tile.user[cells]), len(near) - 1)
            known = near[place] == tile.user[cells]
            cells, alike = cells[known], sims[place[known]]
            found, estimates = _nearest(tile.movie[cells], alike, deviation(cells), k, False)
            return found, np.clip(means[u] + estimates, 0, 5)

        if best_first and len(near) and _search_pays(tile, tile.size[near].sum(), n):
            best = _best_promised(tile, near, means[u] - means[near], rated, n, n_items, max(0, means[u]), True, score)
            if best is not None:
                yield (u, *best)
                continue
        movies, estimates = _user_estimates(tile, near, sims, rated, deviation, k)
        movies, estimates = movies[~np.isnan(estimates)], estimates[~np.isnan(estimates)]
        yield (u, *_best(tile, movies, np.clip(means[u] + estimates, 0, 5), rated, n, n_items))
        if means[u] > 0:  # what nobody near has rated counts the mean
            free = _first_free(tile.movies[np.r_[movies, rated]], n, n_items)
            yield u, free, np.full(len(free), means[u])


def _blocks(work: np.ndarray, most: int) -> list[np.ndarray]:
    """Positions in runs of about ``most`` work each; a larger one stays alone."""
    return np.split(np.arange(len(work)), np.flatnonzero(np.diff(np.cumsum(work) // most)) + 1)


def _movie_sims(tile: _Tile, unit: Callable, wanted: np.ndarray):
    """``(movie, others, sims)`` of every wanted movie."""
    raters = tile.cells_on(wanted)
    near = tile.user[raters]
    cells = tile.cells_of(near)
    row = np.repeat(np.repeat(np.arange(len(wanted)), tile.raters[wanted]), tile.size[near])
    products = np.repeat(unit(raters), tile.size[near]) * unit(cells)
    pair, sims = _summed(
        row * len(tile.movies) + tile.movie[cells], products, len(wanted) * len(tile.movies)
    )
    row, other = np.divmod(pair, len(tile.movies))
    apart = other != wanted[row]
    row, other, sims = row[apart], other[apart], sims[apart]
    cut = np.searchsorted(row, np.arange(1, len(wanted)))
    return zip(wanted, np.split(other, cut), np.split(sims, cut))


def _item_best(tile: _Tile, unit: Callable, u: int, k: int, n: int):
    """The same rows by the search for the best movies, or None."""
    mine = np.arange(tile.start[u], tile.start[u + 1])
    rated, ratings = tile.movie[mine], tile.rating[mine]
    met = tile.cells_on(rated)
    at = np.repeat(np.arange(len(rated)), tile.raters[rated])
    order = np.argsort(tile.user[met], kind="stable")
    met, at = met[order], at[order]
    raters, start = np.unique(tile.user[met], return_index=True)
    start = np.r_[start, len(met)]
    level = np.maximum.reduceat(ratings[at], start[:-1])
    other = raters != u

    def score(movies):
        cells = tile.cells_on(movies)
        place = np.minimum(np.searchsorted(raters, tile.user[cells]), len(raters) - 1)
        known = raters[place] == tile.user[cells]
        cells, place = cells[known], place[known]
        count = start[place + 1] - start[place]
        both = _spread(start[place], count)
        movie = np.repeat(np.searchsorted(movies, tile.movie[cells]), count)
        pair, sims = _summed(
            movie * len(rated) + at[both], np.repeat(unit(cells), count) * unit(met[both]), len(movies) * len(rated)
        )
        movie, mine_at = np.divmod(pair, len(rated))
        found, estimates = _nearest(movie, sims, ratings[mine_at], k, False)
        return movies[found], np.clip(estimates, 0, 5)

    if not other.any() or not _search_pays(tile, tile.size[raters].sum(), n):
        return None
    every = tile.movies[-1] + 1  # movies outside the universe may be recommended here
    return _best_promised(tile, raters[other], level[other], rated, n, every, 0.0, False, score)


def _item_based(tile: _Tile, k: int, n: int, n_items: int):
    unit = lambda cells: tile.rating[cells] / tile.norms[tile.movie[cells]]
    left = []
    for u in tile.own:
        best = _item_best(tile, unit, u, k, n)
        if best is None:
            left.append(u)
        else:
            yield (u, *best)
    own = np.array(left, np.int64)
    reach = np.bincount(tile.movie, tile.size[tile.user], minlength=len(tile.movies))
    before = np.r_[0, np.cumsum(reach[tile.movie])]
    work = before[tile.start[own + 1]] - before[tile.start[own]]
    found: dict[int, tuple] = {}
    kept = 0
    for block in _blocks(work, BLOCK_ROWS):
        if not len(block):
            continue
        users = own[block]
        if kept > KEPT_PAIRS:
            found, kept = {}, 0
        wanted = np.unique(tile.movie[tile.cells_of(users)])
        wanted = wanted[[m not in found for m in wanted]] if found else wanted
        for part in _blocks(reach[wanted], BLOCK_ROWS):
            for movie, others, sims in _movie_sims(tile, unit, wanted[part]):
                found[movie] = others, sims
                kept += len(others)
        for u in users:
            mine = slice(tile.start[u], tile.start[u + 1])
            rated = tile.movie[mine]
            parts = [found[m] for m in rated]
            movies, sims = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            ratings = np.repeat(tile.rating[mine], [len(p[0]) for p in parts])
            movies, estimates = _nearest(movies, sims, ratings, k, False)
            known = ~np.isnan(estimates)
            scores = np.clip(estimates[known], 0, 5)
            # movies outside the universe may be recommended here
            yield (u, *_best(tile, movies[known], scores, rated, n, tile.movies.max() + 1))


def movie_lists(cells: DataFrame) -> DataFrame:
    """``(id, ms, xs)``: every movie's similar movies and their cosines, both in id order.

    For few movies: their pairs are summed before the shuffle, which then carries at most all pairs
    per task, however many users there are.
    """
    lists = cells.groupBy("u").agg(F.collect_list(F.struct("m", "rating")).alias("c"))
    met = lists.select(F.explode("c").alias("a"), "c").select("a", F.explode("c").alias("b"))
    dots = materialise(
        met.where(F.col("a.m") <= F.col("b.m"))
        .groupBy(F.col("a.m").alias("a"), F.col("b.m").alias("b"))
        .agg(F.sum(F.col("a.rating") * F.col("b.rating")).alias("dot"))
    )
    norm = lambda side: dots.where("a = b").select(
        F.col("a").alias(side), F.sqrt("dot").alias(f"norm_{side}")
    )
    sims = dots.where("a <> b").join(norm("a"), "a").join(norm("b"), "b").select(
        "a", "b", (F.col("dot") / (F.col("norm_a") * F.col("norm_b"))).alias("sim")
    )
    both = sims.unionByName(sims.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    return materialise(_listed(both, "a", "b", "sim"))


def _listed(rows: DataFrame, by: str, number: str, value: str) -> DataFrame:
    lists = rows.groupBy(F.col(by).cast("bigint").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(number).alias("m"), F.col(value).alias("x")))).alias("c")
    )
    return lists.select("id", F.col("c.m").cast("array<bigint>").alias("ms"), F.col("c.x").alias("xs"))


def _scores_by_lists(table: pa.Table, n: int, k: int):
    """The item-based scores of a tile's users from the lists of all movies."""
    side = table["side"].to_numpy()
    flat = lambda rows, name: rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    users, lists = (table.filter(pa.array(side == s)).combine_chunks() for s in (0, 1))
    lists = lists.sort_by("id")
    ends = lambda rows: np.r_[0, np.cumsum(pc.list_value_length(rows["ms"]).to_numpy())]
    tile = SimpleNamespace(movies=np.unique(np.r_[flat(users, "ms"), lists["id"].to_numpy()]))
    many = len(tile.movies)
    local = lambda ids: np.searchsorted(tile.movies, ids)
    size = np.zeros(many, np.int64)
    size[local(lists["id"].to_numpy())] = np.diff(ends(lists))
    first = np.cumsum(size) - size
    other, sim = local(flat(lists, "ms")), flat(lists, "xs")
    movie, rating, start = local(flat(users, "ms")), flat(users, "xs"), ends(users)
    work = np.r_[0, np.cumsum(size[movie])]
    for block in _blocks(work[start[1:]] - work[start[:-1]], BLOCK_ROWS):
        if not len(block):
            continue
        mine = slice(start[block[0]], start[block[-1] + 1])
        cells = _spread(first[movie[mine]], size[movie[mine]])
        row = np.repeat(np.arange(len(block)), np.diff(start[block[0] : block[-1] + 2]))
        group = np.repeat(row, size[movie[mine]]) * many + other[cells]
        found, estimates = _nearest(group, sim[cells], np.repeat(rating[mine], size[movie[mine]]), k, False)
        known = ~np.isnan(estimates)
        row, found = np.divmod(found[known], many)
        scores = np.clip(estimates[known], 0, 5)
        cut = np.searchsorted(row, np.arange(len(block) + 1))
        for at, u in enumerate(block):
            one = slice(cut[at], cut[at + 1])
            rated = movie[start[u] : start[u + 1]]
            # movies outside the universe may be recommended here
            yield (users["id"][int(u)].as_py(), *_best(tile, found[one], scores[one], rated, n, tile.movies[-1] + 1))


def few_movies_scores(data: Coded, asked: DataFrame, n: int, k: int) -> DataFrame:
    """``(u, m, score)`` of the item-based method for a catalogue of at most ``FEW_MOVIES`` rated movies.

    The similarities grow with the movies alone; they go to every tile of users once, so the work
    grows with the users' cells and not with the raters of their movies.
    """
    lists = movie_lists(data.cells)
    own = data.cells.join(asked.select("u"), "u", "left_semi")
    users = materialise(_listed(own, "u", "m", "rating"))
    sizes = lists.select(F.col("id").alias("m"), F.size("ms").alias("size"))
    cells, work = own.join(sizes, "m").agg(F.count(F.lit(1)), F.sum("size")).first()
    least = max(1, (work or 0) // (3 * data.cells.sparkSession.sparkContext.defaultParallelism))
    parts = max(1, -(-(work or 0) // min(FEW_WORK, least)), -(-cells // FEW_CELLS))
    rows = users.select(
        F.pmod(F.xxhash64("id"), F.lit(parts)).alias("tile"), F.lit(0).alias("side"), "*"
    ).unionByName(
        lists.select(
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("tile"),
            F.lit(1).alias("side"), "*",
        )
    )
    return (
        rows.repartition(min(parts, 4000), "tile")
        .groupBy("tile")
        .applyInArrow(lambda table: _as_rows(_scores_by_lists(table, n, k)), SCORED)
    )


SCORED = "u bigint, m bigint, score double"


def _as_rows(found) -> pa.Table:
    """One table of ``(u, movies, scores)`` per user."""
    rows = [(np.full(len(m), u), m, s) for u, m, s in found]
    joined = [np.concatenate(c) for c in zip(*rows)] if rows else [[], [], []]
    kinds = (np.int64, np.int64, np.float64)
    return pa.table(
        {name: np.asarray(c, t) for name, c, t in zip(("u", "m", "score"), joined, kinds)}
    )


_METHODS = {"user": _user_based, "item": _item_based}


def tile_scores(
    data: Coded, tiles: DataFrame, count: int, method: str, n: int, k: int
) -> DataFrame:
    """``(u, m, score)``: candidates among which every tiled user's ``n`` best are."""
    n_items = data.n_items
    whole = data.cells.count() <= RESIDENT_CELLS
    extra = {"best_first": True} if whole and method == "user" else {}

    def scores(table: pa.Table) -> pa.Table:
        tile = _Tile(table)
        return _as_rows((tile.users[u], m, s) for u, m, s in _METHODS[method](tile, k, n, n_items, **extra))

    rows = _rows_of_all(data.cells, tiles, count, bool(extra)) if whole else _rows_of_tiles(data.cells, tiles)
    return (
        rows.repartition(max(1, min(4 * count, 4000)), "tile")
        .sortWithinPartitions("tile", "u")
        .groupBy("tile")
        .applyInArrow(scores, SCORED)
    )
