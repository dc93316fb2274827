"""Best-fit packing by a configuration linear program over the length histogram.

The tables only meet the driver as a histogram of at most ``capacity`` lengths.
Its long pieces are put into ``CLASSES`` of nearly equal size, each as long as its
longest piece (linear grouping). On the classes stands the covering program "least
total weight of configurations that holds every class as often as it occurs".
Multiplicative weights solve it: each round prices the classes by how little of
their (unchanged) demand is covered so far, a knapsack dynamic program finds the
configurations worth most at these prices, and these gain weight. The sum is
scaled and completed to a cover; prices give a lower bound beside it. The
fractional cover is rounded down once and its places are given to the pieces of
the classes. Short pieces and what the rounding leaves over are packed best-fit,
largest first, into the room of these sequences and then into new ones. Pieces
then look up their place by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.common import stored
from tastemill.llm.tokens import worker_encoder

CAPACITY = 2048
END_ID = 0
# Pricing rounds on the program.
ROUNDS = 400
# Pieces of at least capacity / LONG_PARTS are the program's, in so many classes.
LONG_PARTS = 8
CLASSES = 40
# Prices start at (length / capacity) ** POWER: of equally full sequences, that
# with larger pieces is worth more.
POWER = 1.2
# How fast a price falls with the covered share of the demand; configurations
# worth this much less than the best one are good enough for a round.
STEP = 0.1
PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, task long, place long"
)


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None
) -> DataFrame:
    """Pieces of all texts, with their place among the task's pieces of that length.

    A document is its ids and the end id; only longer ones than ``capacity`` are
    cut. A null text is empty and gives one piece, the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, number, start, length, crc, place = [], [], [], [], [], []
            for row, ids in encoder.documents(batch.column(1), end_id):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity].astype("<u4")
                    rows.append(row)
                    number.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    place.append(seen[len(part)])
                    seen[len(part)] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(number, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                    pa.array([task] * len(rows), pa.int64()),
                    pa.array(place, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


Group = tuple[dict[int, int], int]  # what one sequence holds, number of such sequences


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """With repetition: the worth of every room, and the length to put into it first (0: none).

    ``price[l]`` is the price of length l; 0 for lengths that do not occur.
    """
    worth, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        value = worth[room - 1 :: -1] + price[1 : room + 1]
        best = int(value.argmax())
        worth[room], choice[room] = value[best], best + 1
        if worth[room] <= worth[room - 1]:
            worth[room], choice[room] = worth[room - 1], 0
    return worth, choice


def filled(choice: np.ndarray, room: int) -> dict[int, int]:
    """The lengths that the dynamic program puts into a room."""
    held: dict[int, int] = {}
    while room > 0:
        length = int(choice[room])
        if length == 0:
            room -= 1
            continue
        held[length] = held.get(length, 0) + 1
        room -= length
    return held


@dataclass(frozen=True)
class Cover:
    """A fractional cover: configurations with their weights, and a lower bound of any cover."""

    weights: list[tuple[dict[int, int], float]]
    bound: float

    @property
    def value(self) -> float:
        return sum(x for _, x in self.weights)


def fractional(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> Cover:
    """The program's fractional solution by multiplicative weights.

    Each round takes, from the dearest down, configurations worth nearly as much as
    the best that share no length; each gains the weight that covers one of its
    lengths once over. Then the best
    scale is chosen; lengths it leaves short get sequences of their own.
    """
    lengths = np.flatnonzero(counts)
    demand = counts[lengths].astype(np.float64)
    if not len(lengths):
        return Cover([], 0.0)
    at = np.full(capacity + 1, -1)
    at[lengths] = np.arange(len(lengths))
    covered = np.zeros(len(lengths))
    start = (lengths / capacity) ** POWER
    weights: dict[tuple[tuple[int, int], ...], float] = {}
    bound = float((lengths * demand).sum() / capacity)
    price = np.zeros(capacity + 1)
    for _ in range(rounds):
        share = covered / demand
        price[lengths] = start * np.exp(-step * (share - share.min()))
        worth, choice = knapsack(price, capacity)
        # prices by the best worth are feasible for the dual program
        bound = max(bound, float((price[lengths] * demand).sum() / worth[capacity]))
        begun = price[lengths] + worth[capacity - lengths]
        used: set[int] = set()
        for k in np.argsort(-begun, kind="stable"):
            if begun[k] < (1 - step) * worth[capacity]:
                break
            first = int(lengths[k])
            if first in used:
                continue
            held = filled(choice, capacity - first)
            held[first] = held.get(first, 0) + 1
            if used & set(held):
                continue
            used |= set(held)
            gain = min(demand[at[n]] / c for n, c in held.items())
            key = tuple(sorted(held.items()))
            weights[key] = weights.get(key, 0.0) + gain
            for n, c in held.items():
                covered[at[n]] += c * gain
    total, alone = sum(weights.values()), capacity // lengths
    short = lambda scale: np.maximum(0.0, demand - covered / scale)
    scales = np.unique(np.quantile(np.maximum(covered / demand, 1e-9), np.linspace(0, 1, 201)))
    scale = min(scales, key=lambda c: total / c + (short(c) / alone).sum())
    cover = [(dict(key), x / scale) for key, x in weights.items()]
    cover += [({int(n): int(c)}, float(x / c)) for n, c, x in zip(lengths, alone, short(scale)) if x > 0]
    return Cover(cover, bound)


def grouped(counts: np.ndarray, capacity: int, classes: int = CLASSES) -> np.ndarray:
    """For every length its class, named by the longest of the class; 0 for short pieces."""
    of = np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths >= max(1, capacity // LONG_PARTS)]
    if len(lengths):
        before = np.cumsum(counts[lengths]) - counts[lengths]
        number = before * classes // counts[lengths].sum()
        last = np.append(np.flatnonzero(np.diff(number)), len(lengths) - 1)
        of[lengths] = lengths[last][np.searchsorted(number[last], number)]
    return of


def _handed_out(held: dict[int, int], many: int, pools: dict[int, list[list[int]]]) -> list[Group]:
    """``many`` sequences of a configuration of classes as groups of real lengths.

    A pool has ``[length, pieces left]`` of a class, the longest last.
    """
    out: list[Group] = []
    while many:
        run, real = many, {}
        for name, copies in held.items():  # how many equal sequences there are
            run = min(run, max(1, pools[name][-1][1] // copies))
        for name, copies in held.items():
            wanted = copies * run
            while wanted:
                length, n = pools[name][-1]
                # a run above one takes only from the last entry, which has enough
                used = min(n, wanted)
                real[length] = real.get(length, 0) + (copies if run > 1 else used)
                wanted -= used
                pools[name][-1][1] -= used
                if pools[name][-1][1] == 0:
                    pools[name].pop()
        out.append((real, run))
        many -= run
    return out


def _opening(held: dict[int, int]) -> dict[int, int]:
    """A configuration without one piece of its shortest class.

    Classes are as long as their longest piece; the room that real pieces leave is
    met best by choosing the last one for its exact length.
    """
    shortest = min(held)
    kept = held | {shortest: held[shortest] - 1}
    return {n: k for n, k in kept.items() if k} or held


def solve(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, classes: int = CLASSES) -> list[Group]:
    """Whole sequences: the fractional cover of the classes rounded down, the rest best-fit.

    A cover may hold more of a class than there is; a configuration then gets
    fewer sequences. The heaviest configurations come first.
    """
    counts = counts.astype(np.int64)
    of = grouped(counts, capacity, classes)
    demand = np.bincount(of, weights=np.where(of > 0, counts, 0), minlength=capacity + 1).astype(np.int64)
    pools: dict[int, list[list[int]]] = {}
    for length in np.flatnonzero(of):
        pools.setdefault(int(of[length]), []).append([int(length), int(counts[length])])
    left, groups = demand.copy(), []
    for held, x in sorted(fractional(demand, capacity, rounds).weights, key=lambda w: -w[1]):
        take = min(int(x), *(int(left[n]) // k for n, k in held.items()))
        if take:
            groups += _handed_out(_opening(held), take, pools)
            for n, k in held.items():
                left[n] -= k * take
    rest = counts.copy()
    for held, many in groups:
        for n, k in held.items():
            rest[n] -= k * many
    return best_fit(rest, capacity, groups)


def best_fit(counts: np.ndarray, capacity: int, opened: Iterable[Group] = ()) -> list[Group]:
    """Best-fit decreasing on a histogram, into the opened sequences first.

    Equal sequences are handled together.
    """
    bins: list[list[Group]] = [[] for _ in range(capacity + 1)]  # by room left
    for held, many in opened:
        bins[capacity - sum(n * k for n, k in held.items())].append((held, many))
    for length in range(capacity, 0, -1):
        n = int(counts[length])
        room = length
        while n > 0 and room <= capacity:
            if not bins[room]:
                room += 1
                continue
            held, many = bins[room].pop()
            used = min(n, many)
            n -= used
            if many > used:
                bins[room].append((held, many - used))
            bins[room - length].append((held | {length: held.get(length, 0) + 1}, used))
            room = max(length, min(room, room - length))
        each = capacity // length
        for k, many in ((each, n // each), (n % each, 1)):
            if k and many and n:
                bins[capacity - k * length].append(({length: k}, many))
    return [g for same in bins for g in same]


@dataclass(frozen=True)
class Runs:
    """Ranks [first, ...) of a length fill ``copies`` slots in each sequence from ``sequence`` on."""

    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = lambda a, b: (a.astype(np.int64) << 44) | b
        i = np.searchsorted(key(self.length, self.first), key(length, rank), side="right") - 1
        turn, slot = np.divmod(rank - self.first[i], self.copies[i])
        return self.sequence[i] + turn, self.offset[i] + slot * length


def runs(groups: list[Group]) -> Runs:
    """Number the sequences group by group and hand out the ranks of each length."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for held, many in groups:
        offset = 0
        for length in sorted(held, reverse=True):
            copies, first = held[length], used.get(length, 0)
            rows.append((length, first, copies, sequence, offset))
            used[length] = first + copies * many
            offset += copies * length
        sequence += many
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Runs(*table.T)


def histogram(cut: DataFrame, capacity: int = CAPACITY) -> np.ndarray:
    """Pieces per length; at most ``capacity`` rows come to the driver."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    return counts


def pack(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None
) -> DataFrame:
    """Place every piece of every document: ``sequence_id`` and gapless ``offset``.

    Repeated rows and repeated ids are packed one by one; a null id stays null;
    equal lengths are told apart by task and order of appearance, so no sort or
    window runs over a length; an empty table gives no rows. Pieces are written
    once, as tokenising is the dear part and a lost executor must not renumber
    them.
    """
    cut = stored(pieces(docs, capacity, end_id, path), "pieces")
    plan = runs(solve(histogram(cut, capacity), capacity))
    # one row per task that holds the length
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    firsts = (
        cut.groupBy("length", "task")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    ranked = cut.join(firsts, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.col("place")).alias("rank"),
    )

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            sequence, offset = plan.place(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        look_up,
        "doc_id long, piece int, start long, length long, ids_crc32 long,"
        " sequence_id long, offset long",
    )
