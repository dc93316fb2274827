"""Personal data: fixed patterns, and identifiers found by the contexts they share.

The fixed patterns give the seeds. A lexical pattern is the word to the left,
alone or with the shape of what follows (letters as ``a``, digits as ``9``, runs
shortened); an instance is the text that follows, of one or several words.
Patterns and instances form a bipartite graph. A pattern is as sure as the share
of its instances that are of a kind; an unseen instance is as sure as its
patterns together; a few rounds of both, where the contexts of sure instances
become patterns too, and what is sure enough is added. Instances hold a digit or
an at sign; others are not looked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import let, stored

KINDS = ("email", "ip", "card", "phone")
# Java's patterns of the fixed kinds. A run is entered at its start (or where the
# match before ended) and never given back, so no text takes quadratic time.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# Words that hold a digit or an at sign.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
# Such words in a row, the later ones without letters: an identifier with blanks.
RUN = CANDIDATE + r"(?:\x20[^\sA-Za-z0-9@]*+[0-9][^\sA-Za-z@]*+)++"
# Stands for every shape.
ANY = "*"
# Code points looked at for the word to the left.
CONTEXT = 64
INSTANCE_CHARS = (5, 64)
MIN_DIGITS = 4
# Elements of an array that are worked on as one block.
SCAN_BLOCK = 512
MIN_SEEDS = 5
ROUNDS = 3
# A pattern under the first value lends nothing; what is added reaches the second.
LEND, ACCEPT = 0.5, 0.9
BOM = "0000FEFF"


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.when(
        F.length(digits).between(12, 19), F.call_function("luhn_check", digits)
    ).otherwise(F.lit(False))


def _running(values: Column, first: Column, op: Callable[[Column, Column], Column]) -> Column:
    start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(
        values,
        start,
        lambda s, x: F.struct(op(s["at"], x).alias("at"), F.array_append(s["all"], s["at"]).alias("all")),
        lambda s: s["all"],
    )


def before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of integers, ``op`` over 0 and all elements before it.

    An array grows by copying, so the elements are worked on in blocks: first the
    blocks' totals, then every block from its own start. No array that grows is
    longer than a block or than the number of blocks.
    """

    def by_block(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), op))
        parts = F.arrays_zip(blocks.alias("block"), _running(totals, F.lit(0), op).alias("first"))
        return F.flatten(F.transform(parts, lambda p: _running(p["block"], p["first"], op)))

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(v) - 1, F.lit(SCAN_BLOCK))
        return let(F.transform(starts, lambda i: F.slice(v, i + 1, SCAN_BLOCK)), by_block)

    none = F.array().cast("array<int>")
    return let(values, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(none))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def matches(text: Column, pattern: str) -> Column:
    """``(start, stop, found, left)`` of all matches, in code points.

    The text is split at the matches; a match starts after all gaps and matches
    before it. ``left`` is the last word of the gap before.
    """
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )

    def placed(p: Column) -> Column:
        sizes = F.transform(p, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["found"]), F.lit(0)))
        return F.arrays_zip(p.alias("pair"), before(sizes, _add).alias("at"))

    def one(x: Column) -> Column:
        gap, found = x["pair"]["gap"], x["pair"]["found"]
        start = x["at"] + F.length(gap)
        left = F.regexp_extract(
            F.regexp_replace(F.substring(gap, -CONTEXT, CONTEXT), r"[^\p{L}\p{N}]++$", ""), r"\S+$", 0
        )
        return F.struct(
            start.alias("start"),
            (start + F.length(found)).alias("stop"),
            found.alias("found"),
            F.regexp_replace(F.lower(left), "[0-9]", "0").alias("left"),
        )

    # the last gap has no match behind it
    found = let(pairs, lambda p: F.filter(placed(p), lambda x: x["pair"]["found"].isNotNull()))
    return F.transform(found, one)


def base_spans(text: Column) -> Column:
    """All spans of the fixed kinds, by start, then kind."""
    needs = {"email": text.contains("@"), "phone": text.contains("+")}

    def of_kind(number: int, kind: str) -> Column:
        hits = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["found"]))
        spans = F.transform(
            hits,
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(number).alias("kind"), m["stop"].alias("stop"),
                m["found"].alias("found"), m["left"].alias("left"),
            ),
        )
        return F.when(needs.get(kind, text.rlike("[0-9]")), spans)

    parts = [of_kind(n, k) for n, k in enumerate(KINDS)]
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,found:string,left:string>>")
    return F.array_sort(F.concat(*[F.coalesce(p, none) for p in parts]))


def _trimmed(hits: Column) -> Column:
    """Hits without the punctuation around them; a label glued to one is its left word.

    A bracket stays before the area code it opens.
    """

    def cut(m: Column) -> Column:
        label = F.regexp_extract(m["found"], "^[A-Za-z]++[:=]++(?=[^:=])", 0)
        rest = F.substr(m["found"], F.length(label) + 1)
        lead = F.regexp_extract(rest, r"^(?:\((?![0-9]{1,5}\)[\x20-])|[^A-Za-z0-9+(])*+", 0)
        return F.struct(
            (m["start"] + F.length(label) + F.length(lead)).alias("start"),
            F.regexp_replace(
                F.substr(rest, F.length(lead) + 1), "(?<![^A-Za-z0-9])[^A-Za-z0-9]++$", ""
            ).alias("found"),
            F.when(label != "", F.lower(F.regexp_replace(label, "[:=]", ""))).otherwise(m["left"]).alias("left"),
        )

    trimmed = F.transform(
        hits,
        lambda m: let(
            cut(m),
            lambda s: F.struct(
                s["start"].alias("start"), (s["start"] + F.length(s["found"])).alias("stop"),
                s["found"].alias("found"), s["left"].alias("left"),
            ),
        ),
    )
    enough = lambda s: F.length(F.regexp_replace(s, "[^0-9]", "")) >= MIN_DIGITS
    return F.filter(
        trimmed,
        lambda s: F.length(s["found"]).between(*INSTANCE_CHARS) & (s["found"].contains("@") | enough(s["found"])),
    )


def overlaps(spans: Column, base: Column) -> Column:
    """``(span, hit)`` of every span: whether it overlaps one of ``base``; one sort, one pass.

    It does if, of the base spans that start before its end, one ends behind its
    start. At one place ends come before starts.
    """
    point = lambda at, side, stop, span: F.struct(
        at.alias("at"), F.lit(side).alias("side"), stop.alias("stop"), span.alias("span")
    )
    asked = F.transform(spans, lambda s: point(s["stop"], 0, F.lit(0), s))
    none = F.get(spans, F.lit(-1))  # a null of the spans' type
    starts = F.transform(base, lambda b: point(b["start"], 1, b["stop"], none))

    def judged(events: Column) -> Column:
        reach = before(F.transform(events, lambda e: e["stop"]), _larger)
        met = F.arrays_zip(events.alias("event"), reach.alias("reach"))
        return F.transform(
            F.filter(met, lambda m: m["event"]["side"] == 0),
            lambda m: F.struct(
                m["event"]["span"].alias("span"), (m["reach"] > m["event"]["span"]["start"]).alias("hit")
            ),
        )

    alone = F.transform(spans, lambda s: F.struct(s.alias("span"), F.lit(False).alias("hit")))
    ordered = F.array_sort(F.concat(asked, starts))
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), let(ordered, judged)).otherwise(alone)


def apart(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``."""
    return F.transform(F.filter(overlaps(spans, base), lambda m: ~m["hit"]), lambda m: m["span"])


def outermost(spans: Column) -> Column:
    """The spans that lie in no larger one, by start; no two spans have both ends in common."""
    keyed = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s.alias("span")))
    )

    def kept(k: Column) -> Column:
        reach = before(F.transform(k, lambda e: -e["back"]), _larger)
        met = F.arrays_zip(k.alias("event"), reach.alias("reach"))
        return F.transform(
            F.filter(met, lambda m: m["reach"] < -m["event"]["back"]), lambda m: m["event"]["span"]
        )

    return let(keyed, kept)


def with_candidates(rows: DataFrame) -> DataFrame:
    """``rows`` of ``t, base`` with ``words``: what could be identifiers beside the base spans.

    Runs of words, and single words; ``whole`` is false for a word that is part of
    a run. Step by step, as what a step uses several times is a column of its own.
    """
    given = lambda pattern: F.when(
        F.col("t").rlike("[0-9@]"), _trimmed(matches(F.col("t"), pattern))
    )
    named = lambda s, whole: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), s["found"].alias("found"),
        s["left"].alias("left"), whole.alias("whole"),
    )
    return (
        rows.withColumn("runs", given(RUN)).withColumn("words", given(CANDIDATE))
        .withColumn("runs", apart(F.col("runs"), F.col("base")))
        .withColumn("words", apart(F.col("words"), F.col("base")))
        .withColumn("words", overlaps(F.col("words"), F.col("runs")))
        .withColumn(
            "words",
            F.concat(
                F.transform("runs", lambda s: named(s, F.lit(True))),
                F.transform("words", lambda m: named(m["span"], ~m["hit"])),
            ),
        )
        .drop("runs")
    )


def shape(found: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(found, "[A-Za-z]+", "a"), "[0-9]+", "9")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document, without its text: what the fixed patterns and words give."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.col("doc_id"), text.alias("t")).select(
        "doc_id", "t", F.xxhash64("t").alias("text_hash"), base_spans(F.col("t")).alias("base")
    )
    return stored(with_candidates(found).select("doc_id", "text_hash", "base", "words"), "pii-scan")


def discovered(rows: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, start, kind, stop)`` of unseen identifiers."""
    key = ["left", "shape"]
    # a known value is an instance of its left word with its shape, and with any
    seeds = stored(
        rows.select(F.inline("base")).where("left != ''")
        .select(
            "left", F.explode(F.array(shape(F.col("found")), F.lit(ANY))).alias("shape"),
            F.col("found").alias("value"), "kind",
        )
        .distinct(),
        "pii-seeds",
    )
    words = (
        rows.select("doc_id", "text_hash", F.inline("words")).where("left != ''")
        .withColumn("shape", shape(F.col("found")))
        .withColumn("shape", F.explode(F.when(F.col("whole"), F.array("shape", F.lit(ANY))).otherwise(F.array("shape"))))
        .withColumnRenamed("found", "value")
    )
    edges = stored(
        words.select(*key, "value").distinct().join(seeds.select("value").distinct(), "value", "left_anti"),
        "pii-edges",
    )
    accepted = scores = None
    for _ in range(ROUNDS):
        # patterns with enough known values of one kind, whatever else occurs in them
        known = seeds if accepted is None else seeds.unionByName(edges.join(accepted, "value"))
        strong = stored(
            known.groupBy(*key, "kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_SEEDS)
            .select(*key).distinct(),
            "pii-strong",
        )
        seen = stored(seeds.join(strong, key, "left_semi"), "pii-seen")
        unseen = stored(edges.join(strong, key, "left_semi"), "pii-unseen")
        sizes = (
            seen.select(*key, "value").unionByName(unseen.select(*key, "value")).distinct()
            .groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
        )
        sure = seen.groupBy(*key, "kind").agg(F.countDistinct("value").cast("double").alias("sure"))
        if scores is not None:
            lent = unseen.join(scores, "value").groupBy(*key, "kind").agg(F.sum("score").alias("sure"))
            sure = sure.unionByName(lent).groupBy(*key, "kind").agg(F.sum("sure").alias("sure"))
        patterns = stored(
            sure.join(sizes, key)
            .select(*key, "kind", (F.col("sure") / (F.col("size") + 1)).alias("conf"))
            .where(F.col("conf") >= LEND),
            "pii-patterns",
        )
        # of a word's pattern with and without the shape, the surer one counts
        scores = stored(
            unseen.join(patterns, key).groupBy("value", "left", "kind").agg(F.max("conf").alias("conf"))
            .groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score")),
            "pii-scores",
        )
        accepted = scores.where(F.col("score") >= ACCEPT).select("value", "kind")
    sure_edges = (
        unseen.join(patterns.where(F.col("conf") >= ACCEPT), key)
        .join(accepted, ["value", "kind"])
        .select(*key, "value", "kind")
    )
    return (
        words.join(sure_edges, [*key, "value"]).select("doc_id", "text_hash", "start", "kind", "stop").distinct()
    )


SPAN = "array<struct<start:int,kind:int,stop:int>>"


def all_spans(rows: DataFrame) -> DataFrame:
    """``rows`` with ``spans``: the base spans and what was discovered beside them.

    Where kinds claim one place, the first kind has it; overlaps with base spans
    are dropped. Documents are known by id and hash of the text, so rows that
    share an id keep their own spans.
    """
    added = (
        discovered(rows).groupBy("doc_id", "text_hash", "start", "stop").agg(F.min("kind").alias("kind"))
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"))
        .agg(F.collect_list(F.struct("start", "kind", "stop")).cast(SPAN).alias("added"))
    )
    joined = rows.join(
        stored(added, "pii-added"),
        F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")),
        "left",
    )
    base = F.transform(
        "base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))
    )
    # a word of a run that was added goes with the run
    free = joined.withColumn("added", apart(F.col("added"), F.col("base"))).withColumn(
        "added", outermost(F.col("added"))
    )
    return free.select(
        "doc_id", "text_hash", base.alias("base"),
        F.array_sort(F.concat(base, F.coalesce("added", F.array().cast(SPAN)))).alias("spans"),
    )


def written(spans: str) -> Column:
    """Spans as ``kind:start:stop``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every document.

    A null text is empty and has none; repeated rows are reported twice; an empty
    table gives no rows. Counts and the digest are of the base spans alone.
    """
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return all_spans(scan(docs)).select(
        "doc_id",
        *[count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)],
        F.sha2(written("base"), 256).alias("base_sha256"),
        written("spans").alias("spans"),
    )


def masked_text(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``<KIND>``; spans that overlap become one.

    Four bytes per code point make every cut a copy of just that piece.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def piece(wide: Column, start: Column, stop: Column) -> Column:
        cut = F.substring(wide, 4 * start + 1, 4 * (stop - start))
        return F.decode(F.concat(F.unhex(F.lit(BOM)), cut), "UTF-32")

    def build(wide: Column) -> Column:
        end = F.lit(2**29 - 1)
        stops = F.transform(spans, lambda x: x["stop"])
        last = F.array_max(stops)

        def label(m: Column) -> Column:
            x, at = m["span"], m["at"]
            return F.when(
                x["start"] >= at, F.concat(piece(wide, at, x["start"]), F.get(names, x["kind"]))
            ).otherwise(F.lit(""))

        met = F.arrays_zip(spans.alias("span"), before(stops, _larger).alias("at"))
        return F.concat(F.array_join(F.transform(met, label), ""), piece(wide, last, end))

    return F.when(F.size(spans) > 0, let(F.encode(text, "UTF-32"), build)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with all personal data masked; other columns stay as they are."""
    found = all_spans(scan(docs)).where(F.size("spans") > 0).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans")
    ).dropDuplicates(["_id", "_hash"])
    named = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_of"))
    joined = named.join(
        stored(found, "pii-found"),
        F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_hash")),
        "left",
    )
    none = F.array().cast(SPAN)
    return joined.select(
        *[
            masked_text(F.col("row.text"), F.coalesce("_spans", none)).alias("text") if c == "text"
            else F.col("row").getField(c).alias(c)
            for c in docs.columns
        ]
    )
