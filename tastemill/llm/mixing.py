"""Mixing sources to target weights by systematic sampling.

A source's documents stand in one fixed order; each is expected ``rate`` times.
The running sum of these expectations plus one random offset per source crosses
some integers on its way past a document: the document is emitted once for each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.ranking import dense_index
from tastemill.llm.common import stored, word_count

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
# Rows that one task orders; more rows give more buckets, not larger ones.
BUCKET_ROWS = 1 << 13


def hash32(value: Column) -> Column:
    """32 bits of the md5 of a string, as a long."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Monotone in size; sizes of a class agree in their four leading bits."""
    digits = F.rpad(F.substring(F.bin(size), 1, 4), 4, "0").cast("int")
    return F.length(F.bin(size)) * 10000 + digits


def _order_columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("class", size_class(F.col("size"))).withColumn(
        "h", hash32(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED)))
    )


@dataclass(frozen=True)
class Plan:
    """Per source: size, target and rate; per bucket: the rows before it."""

    sources: DataFrame
    buckets: DataFrame
    bits: int


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, source_size)``.

    Weights repeat over the sources in code point order, null last. All sizes
    are shared out by weight; no target exceeds ``MAX_REPEATS`` times its source,
    and the excess is shared again until none does. Each round finds one number,
    the words per unit of weight, by one aggregation.
    """
    numbers = dense_index(sizes, "source")
    known = numbers.withColumnRenamed("source", "of_source")
    last = F.coalesce(numbers.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]),
        (F.coalesce("idx", last) % len(weights) + 1).cast("int"),
    )
    table = stored(
        sizes.join(known, F.col("source") == F.col("of_source"), "left").select(
            "source", "source_size", weight.alias("weight")
        ),
        "weights",
    )
    cap = F.col("source_size") * MAX_REPEATS
    level = 0.0
    while True:
        above = cap < F.col("weight") * F.lit(level)
        row = table.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, cap)).alias("capped"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"),
        ).first()
        if not row["open"] or not row["total"]:
            break
        new = float(row["total"] - (row["capped"] or 0)) / float(row["open"])
        if new == level:
            break
        level = new
    target = F.when(cap < F.col("weight") * F.lit(level), cap.cast("double")).otherwise(
        F.col("weight") * F.lit(level)
    )
    return table.select("source", "source_size", target.alias("target"))


def plan(sized: DataFrame) -> Plan:
    """What a second pass over the rows needs; ``sized`` has source, size, class and h."""
    groups = stored(
        sized.groupBy("source", "class", F.shiftright("h", 16).alias("h16")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")
        ),
        "groups",
    )
    sizes = groups.groupBy("source").agg(F.sum("words").alias("source_size"))
    total = groups.agg(F.sum("rows")).first()[0] or 0
    bits = min(16, max(0, (total // BUCKET_ROWS).bit_length()))
    by_bucket = groups.groupBy(
        "source", "class", F.shiftright("h16", 16 - bits).alias("b")
    ).agg(F.sum("rows").alias("rows"))
    before = lambda w: F.coalesce(
        F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    # at most 2^bits rows per (source, class) and some hundreds of classes per source
    classes = by_bucket.groupBy("source", "class").agg(F.sum("rows").alias("rows"))
    classes = classes.select(
        "source", "class", before(Window.partitionBy("source").orderBy("class")).alias("first")
    )
    inner = by_bucket.withColumn("inner", before(Window.partitionBy("source", "class").orderBy("b")))
    joined = inner.alias("i").join(
        classes.alias("c"),
        F.col("i.source").eqNullSafe(F.col("c.source")) & (F.col("i.class") == F.col("c.class")),
    )
    buckets = joined.select("i.source", "i.class", "b", (F.col("first") + F.col("inner")).alias("first"))
    return Plan(stored(targets(sizes), "targets"), stored(buckets, "buckets"), bits)


def copies_of(rows: DataFrame, mix: Plan) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows with source, size, class, h.

    Rows are dealt out by (source, class, bucket), so a hot source is spread over
    as many tasks as its buckets; only rows of one bucket are ordered together.
    """
    inside = Window.partitionBy("source", "class", "b").orderBy("h", "doc_id", "size")
    placed = rows.withColumn("b", F.shiftright("h", 32 - mix.bits)).withColumn(
        "place", F.row_number().over(inside) - 1
    )
    same = lambda a, b: (
        F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    )
    placed = placed.alias("p").join(
        mix.buckets.alias("q"),
        same("p", "q") & (F.col("p.class") == F.col("q.class")) & (F.col("p.b") == F.col("q.b")),
    ).select("p.*", (F.col("place") + F.col("first")).alias("rank"))
    rated = placed.alias("p").join(mix.sources.alias("s"), same("p", "s")).select(
        "p.*",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        .otherwise(F.lit(0.0))
        .alias("rate"),
        (
            F.shiftright(
                hash32(F.concat_ws("|", F.coalesce(F.col("p.source"), F.lit("\0")), F.lit(SEED))), 16
            )
            / 65536.0
        ).alias("offset"),
    )
    upto = lambda k: F.floor(F.col("rate") * k + F.col("offset"))
    return rated.withColumn("copies", upto(F.col("rank") + 1) - upto(F.col("rank")))


def mixture(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every document.

    Null texts have size 0 and are never short of it; a null source is a source
    of its own, weighed last; repeated rows are sampled one by one; rows that tie
    in every ordering column are alike in the result; an empty table gives none.
    """
    sized = stored(
        _order_columns(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))),
        "sized",
    )
    return copies_of(sized, plan(sized)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: each repeated as often as it is taken."""
    keyed = docs.select(
        F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size")
    )
    rows = _order_columns(keyed)
    return (
        copies_of(rows, plan(rows.drop("row")))
        .where("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("row.*")
    )
