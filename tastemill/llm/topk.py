"""Exact top-k by distributed histogram selection.

All scores of all queries are computed, block against block, three times over,
and none is moved: a first pass counts scores in coarse bins, from which each
query's bin with its k-th value is known; a second counts the scores inside that
bin one by one, which gives the k-th value itself and how many lie above it; a
third returns the scores above it and as many ties as are still wanted, smallest
ids first. A block only reports bins down to its own k-th score, because the
k-th score over all blocks is never lower, so it sends at most k counts a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.common import stored

K = 20
SCALE = 64
EVERY = 20
# Rows of a block on either side.
QUERY_BLOCK = 2048
VECTOR_BLOCK = 16384
# Width of a first-pass bin, as a share of the largest possible score.
COARSE_BINS = 256
# Scores of integers up to this bound are exact in doubles.
EXACT = 1 << 53


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v, width)`` with ``v = floor(scale * x)``.

    Vectors that are null, empty or hold a null or non-finite component, and rows
    without an id, take no part; repeated rows count once.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    )
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .select(F.col("vec_id").cast("long"), x.alias("x"))
        .where(finite & (F.size("x") > 0))
        .select("vec_id", F.transform("x", lambda e: F.floor(scale * e)).alias("v"))
        .distinct()
        .withColumn("width", F.size("v"))
    )


def _scores(queries: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
    """Integer inner products; doubles where they are exact, as they are faster."""
    a, b = (np.stack(x["v"].to_list()).astype(np.int64) for x in (queries, rows))
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _top(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Per query, its k highest scores of the block (the query's own row left out)."""
    low = np.iinfo(np.int64).min
    scores = np.where(own, low, scores)
    k = min(k, scores.shape[1])
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]


class Grid:
    """Query blocks against vector blocks; each cell is one task's group.

    Blocks are hash groups of ids, so their number grows with the table and
    their size does not. A cell's key also has the vectors' width.
    """

    def __init__(self, queries: DataFrame, rows: DataFrame):
        sizes = queries.agg(F.count(F.lit(1))).first()[0], rows.agg(F.count(F.lit(1))).first()[0]
        self.across = -(-sizes[0] // QUERY_BLOCK) or 1
        self.down = -(-sizes[1] // VECTOR_BLOCK) or 1
        block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
        self.rows = rows.select(
            "vec_id", "v", "width", block(self.down).alias("r"),
            F.explode(self._all(self.across)).alias("q"),
        )
        # own column identities: both sides come from one table
        self.queries = queries.toDF(*queries.columns).withColumn("q", block(self.across))

    @staticmethod
    def _all(blocks: int) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))

    def run(self, extra: DataFrame | None, fn, schema: str) -> DataFrame:
        """``fn(queries, rows, scores, own)`` per cell; ``extra`` adds columns by ``vec_id``."""
        queries = self.queries if extra is None else self.queries.join(extra, "vec_id")
        queries = queries.withColumn("r", F.explode(self._all(self.down)))

        def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            own = a["vec_id"].to_numpy()[:, None] == b["vec_id"].to_numpy()[None, :]
            return fn(a, b, _scores(a, b), own)

        keys = ["q", "r", "width"]
        return (
            queries.groupBy(*keys).cogroup(self.rows.groupBy(*keys)).applyInPandas(cell, schema)
        )


def _kth(counts: DataFrame, k: int, above: bool) -> DataFrame:
    """Per query, the bin of the k-th highest score and the number of scores above it.

    With fewer than k scores, the lowest bin. At most k bins per query and block
    come here.
    """
    down = Window.partitionBy("query_id").orderBy(F.col("bin").desc())
    total = counts.groupBy("query_id", *(["above"] if above else []), "bin").agg(F.sum("n").alias("n"))
    start = F.col("above") if above else F.lit(0)
    running = total.withColumn(
        "through", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)) + start
    ).withColumn("next", F.lead("bin").over(down))
    return running.where(
        (F.col("through") - F.col("n") < k) & ((F.col("through") >= k) | F.col("next").isNull())
    ).select(F.col("query_id").alias("vec_id"), "bin", (F.col("through") - F.col("n")).alias("above"))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """Each query's k best rows: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own (rows that share its id and its vector) of the same
    width. Fewer than k candidates are all returned; ties go to the smaller id;
    an empty table gives no rows. Vectors are written once, as three passes read
    them.
    """
    rows = stored(quantised(vectors), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0)
    grid = Grid(queries, rows)
    peak = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e))).first()[0]
    width = max(1, int((peak or 0.0) * 2 / COARSE_BINS))

    def counted(a: pd.DataFrame, bins: np.ndarray, valid: np.ndarray, **more) -> pd.DataFrame:
        """Rows (query, bin, n) of a matrix with one line per query."""
        line, _ = np.nonzero(valid)
        found = pd.DataFrame({"query_id": a["vec_id"].to_numpy()[line], "bin": bins[valid]})
        for name, values in more.items():
            found[name] = values[line]
        return found.groupby(list(found.columns), as_index=False).size().rename(columns={"size": "n"})

    def coarse(a, b, scores, own):
        top = _top(scores, own, k)
        return counted(a, top // width, top > np.iinfo(np.int64).min)

    bins = stored(_kth(grid.run(None, coarse, "query_id long, bin long, n long"), k, False), "bins")

    def fine(a, b, scores, own):
        # the block's k best hold all of the bin's scores that can be the k-th
        top, at = _top(scores, own, k), a["bin"].to_numpy()[:, None]
        inside = (top > np.iinfo(np.int64).min) & (top // width == at)
        return counted(a, top, inside, above=a["above"].to_numpy())

    fine_schema = "query_id long, bin long, above long, n long"
    limits = stored(_kth(grid.run(bins, fine, fine_schema), k, True), "limits")

    def chosen(a, b, scores, own):
        kth, wanted = a["bin"].to_numpy(), k - a["above"].to_numpy()
        order = np.argsort(b["vec_id"].to_numpy(), kind="stable")
        ids, scores, own = b["vec_id"].to_numpy()[order], scores[:, order], own[:, order]
        tie = (scores == kth[:, None]) & ~own
        take = ((scores > kth[:, None]) & ~own) | (tie & (np.cumsum(tie, axis=1) <= wanted[:, None]))
        line, column = np.nonzero(take)
        return pd.DataFrame(
            {
                "query_id": a["vec_id"].to_numpy()[line],
                "vec_id": ids[column],
                "score": scores[line, column],
            }
        )

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = grid.run(limits, chosen, "query_id long, vec_id long, score long")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
