"""Quality rules with host-level evidence.

Every document is measured once. Failures are summed per host (the ``source``
column), the failure rate of each host is shrunk towards what all hosts show by
a beta prior estimated from the hosts themselves, and the verdict about the
host goes back to its documents: the rate is the prior probability that a
document of the host is bad, and how far the document is beyond the rule is the
evidence. So a borderline failure rejects only in a host that is known to fail,
a heavy one in any host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import let, stored, words

WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"
# Rules that count only together with the host's verdict.
SOFT_RULES = ("symbols", "lines", "word_length")
HOST_LIMIT = 0.3
# Bounds of the prior's weight, in documents.
PRIOR_DOCS = (1.0, 1000.0)


def _covered(positions: Column) -> Column:
    """Words under windows that start at the given ascending positions."""
    return let(
        positions,
        lambda p: F.aggregate(
            F.zip_with(
                p,
                F.slice(p, 2, F.greatest(F.size(p), F.lit(1))),
                lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
            ),
            F.lit(0),
            lambda total, n: total + n,
        ),
    )


def _exact_repeats(w: Column) -> Column:
    """Words in windows that occur twice or more, comparing the windows' words."""
    starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    ordered = F.array_sort(
        F.transform(
            starts,
            lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("w"), i.alias("i")),
        )
    )

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["w"] == F.get(s, b)["w"]
        return F.array_sort(
            F.transform(
                F.filter(
                    F.sequence(F.lit(0), F.size(s) - 1),
                    lambda k: F.coalesce(same(k, k - 1), F.lit(False))
                    | F.coalesce(same(k, k + 1), F.lit(False)),
                ),
                lambda k: F.get(s, k)["i"],
            )
        )

    return _covered(let(ordered, repeated))


def repeated_words(w: Column) -> Column:
    """Number of words in ``WINDOW``-word windows found at least twice in the text.

    Windows are first compared by hashes; only a text in which two hashes agree
    has its windows sorted, so the answer is exact.
    """

    def with_hashes(h: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
        )
        return let(windows, lambda x: F.size(F.array_distinct(x)) < F.size(x))

    suspicious = let(F.transform(w, lambda x: F.xxhash64(x)), with_hashes)
    return F.when(
        F.size(w) >= WINDOW, F.when(suspicious, _exact_repeats(w)).otherwise(F.lit(0))
    ).otherwise(F.lit(0)).cast("long")


def measures(text: Column) -> Column:
    """Struct of the counts of one text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("repeated"),
        ),
    )
    return let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            counted.alias("by_line"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def measured(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per document: its columns (or those named), host, counts, failures."""
    m = lambda name: F.col(f"m.{name}")
    base = (m("n_words") < MIN_WORDS) | (
        100 * m("n_repeat_words") > REPEAT_PERCENT * m("n_words")
    )
    soft = {
        "symbols": 10 * m("n_symbols") > m("n_words"),
        "lines": 10 * m("by_line.repeated") > 3 * m("by_line.lines"),
        "word_length": (m("word_chars") < 2 * m("n_words"))
        | (m("word_chars") > 15 * m("n_words")),
    }
    return docs.select(
        F.struct(*(carry or "*")).alias("row"),
        F.col("source").alias("host"),
        measures(F.col("text")).alias("m"),
    ).select(
        "row",
        "host",
        m("n_words").alias("n_words"),
        m("word_chars").alias("word_chars"),
        m("n_symbols").alias("n_symbols"),
        m("by_line.lines").alias("n_lines"),
        m("by_line.repeated").alias("n_dup_lines"),
        m("n_repeat_words").alias("n_repeat_words"),
        base.alias("base_failed"),
        F.struct(*[soft[r].alias(r) for r in SOFT_RULES]).alias("fails"),
    )


def host_verdicts(found: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: for each soft rule ``rates`` has the host's shrunken failure
    rate, ``flags`` says whether the host fails it.

    With f failures in n documents the shrunken rate is (f + mk) / (n + k): m is
    the rate over all hosts, k the prior's weight by the method of moments from
    the spread of the hosts' rates.
    """
    hosts = stored(
        found.groupBy("host").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(F.col(f"fails.{r}").cast("long")).alias(r) for r in SOFT_RULES],
        ),
        "hosts",
    )
    total = F.sum("n").cast("double")
    means = hosts.agg(*[(F.sum(r) / total).alias(r) for r in SOFT_RULES]).select(
        F.struct(*SOFT_RULES).alias("mean")
    )
    with_mean = hosts.withColumn("mean", means.scalar())
    spread = with_mean.agg(
        *[
            (
                F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.col(f"mean.{r}"), 2.0)) / total
            ).alias(r)
            for r in SOFT_RULES
        ]
    ).select(F.struct(*SOFT_RULES).alias("spread"))
    table = with_mean.withColumn("spread", spread.scalar())

    def rate(r: str) -> Column:
        mean, var = F.col(f"mean.{r}"), F.col(f"spread.{r}")
        weight = F.when(var > 0, mean * (1 - mean) / var - 1).otherwise(F.lit(PRIOR_DOCS[1]))
        k = F.least(F.lit(PRIOR_DOCS[1]), F.greatest(F.lit(PRIOR_DOCS[0]), weight))
        return (F.col(r) + mean * k) / (F.col("n") + k)

    return stored(
        table.select(
            "host",
            F.struct(*[rate(r).alias(r) for r in SOFT_RULES]).alias("rates"),
            F.struct(*[(rate(r) > limit).alias(r) for r in SOFT_RULES]).alias("flags"),
        ),
        "host-verdicts",
    )


def _excess(r: str) -> Column:
    """How far a document is beyond a soft rule's limit; it fails above 1."""
    words_, chars = F.col("n_words"), F.col("word_chars")
    if r == "symbols":
        return F.try_divide(10 * F.col("n_symbols"), words_)
    if r == "lines":  # a share of lines: its odds by the limit's odds
        return F.try_divide(7 * F.col("n_dup_lines"), 3 * (F.col("n_lines") - F.col("n_dup_lines")))
    return F.greatest(F.try_divide(2 * words_, chars), F.try_divide(chars, 15 * words_))


def outweighed(limit: float = HOST_LIMIT) -> Column:
    """Whether a soft rule that a document fails rejects it, by posterior odds.

    The prior odds are those of the host's shrunken rate; the square of the
    document's excess multiplies them; what is above the odds of ``limit`` goes.
    A host at the limit loses all that fails; a better host loses what is further
    beyond the rule.
    """
    rejected = F.lit(False)
    for r in SOFT_RULES:
        rate = F.col(f"rates.{r}")
        above = F.pow(_excess(r), 2.0) * rate * (1 - limit) > limit * (1 - rate)
        rejected = rejected | (
            F.col(f"fails.{r}") & (F.col(f"flags.{r}") | F.coalesce(above, F.lit(False)))
        )
    return rejected


def judged(docs: DataFrame, limit: float = HOST_LIMIT, carry: list[str] | None = None) -> DataFrame:
    """The measured documents with the ``rates`` and ``flags`` of their hosts."""
    found = stored(measured(docs, carry), "measured")
    verdicts = host_verdicts(found, limit).withColumnRenamed("host", "of_host")
    return found.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left")


def assess(
    docs: DataFrame, limit: float = HOST_LIMIT, carry: list[str] | None = None
) -> DataFrame:
    """Counts, ``base_failed``, ``host_flagged`` and ``kept`` for every document.

    ``docs`` needs ``text`` and ``source``; all its columns, or those named in
    ``carry``, come back in ``row``.
    A document goes if it fails the base rules, or fails a soft rule and is
    outweighed by its host's rate (see :func:`outweighed`); a document that passes
    all rules stays whatever its host. Null and empty texts have no words and fail;
    documents without a source form one host; repeated rows are judged one by one;
    an empty table gives no rows.

    Measured rows are written once: the sums per host and the join both read
    them. The verdicts are one small row per host; the planner broadcasts them
    if their files are small and else joins by host, splitting hot ones.
    """
    found = judged(docs, limit, carry)
    flagged = F.lit(False)
    for r in SOFT_RULES:
        flagged = flagged | F.coalesce(F.col(f"flags.{r}"), F.lit(False))
    return found.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~outweighed(limit)).alias("kept"),
        flagged.alias("host_flagged"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that :func:`assess` keeps, with their own columns."""
    return judged(docs).where(~F.col("base_failed") & ~outweighed()).select("row.*")
