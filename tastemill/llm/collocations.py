"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word of a piece starts a suffix of at most ``DEPTH`` words. The suffixes are
routed over the cluster by their leading words and sorted there by a multikey
quicksort: a pivot word splits the pointers into smaller, equal and larger at one
depth, and the equal ones go on at the next depth. The size of an equal part is
the count of its phrase; a part with fewer suffixes than a phrase needs is
abandoned at once, whatever is in it.

Routing takes the leading words up to the first one that is not hot. Hot words are
those with more than ``HOT_SHARE`` of all words, so there are at most
``1 / HOT_SHARE`` of them, and no route gets more than that share of the suffixes.
Counts of phrases of hot words alone come from suffixes cut off behind them.
Before routing, equal suffixes of a slice of a task become one with a weight, so a
phrase that fills a third of the texts is a row per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.common import stored

DEPTH = 4
MIN_COUNT = 30
LONGER_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
HOT_SHARE = 1 / 4000
# Words of one route, about; and of one slice inside a task.
ROUTE_WORDS = 1_000_000
SLICE_WORDS = 1_000_000
SLICE_BYTES = 8_000_000
# Parts of fewer suffixes are sorted at once instead of being split further.
SMALL = 4096
STOPS = r"[.,;:!?\n\x0B\x0C\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A character that ends pieces is no part of any word, so it can mark their ends.
END = "."
UNKNOWN = "und"


def hash_key(seed: int) -> str:
    return f"{seed:016d}"


def hashes(words: list[str], seed: int) -> np.ndarray:
    """64-bit hashes of words; 0 is left for the end of a piece."""
    found = pd.util.hash_array(np.array([*words, ""], dtype=object), hash_key=hash_key(seed), categorize=False)[:-1]
    return np.where(found == 0, np.uint64(1), found).view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of all words; one partial count per task."""
    words = F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), r"[.,;:!?\x0A-\x0D\x20\x09]+")
    return (
        docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.explode(words).alias("word"))
        .where("word != ''")
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    )


def hashed(counts: DataFrame, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = pa.array(hashes(batch.column(1).to_pylist(), seed), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, code], names=[*batch.schema.names, "code"])

    return counts.mapInArrow(run, "lang string, word string, n long, code long")


def dictionary(docs: DataFrame) -> tuple[DataFrame, int]:
    """The word counts, and a seed under which no two words share a hash."""
    counts = stored(word_counts(docs), "word-counts")
    for seed in range(16):
        table = hashed(counts, seed)
        distinct = table.groupBy("code").agg(F.min("word").alias("a"), F.max("word").alias("b"))
        if distinct.where("a != b").isEmpty():
            return counts, seed
    raise ValueError("no seed tells all words apart")


def windows(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[str, np.ndarray]]:
    """``(lang, hashes)`` of slices of a batch: the hash of every word, 0 ends a piece."""
    langs = pc.fill_null(batch.column(0), UNKNOWN).dictionary_encode()
    of = langs.indices.to_numpy(zero_copy_only=False)
    for number, lang in enumerate(langs.dictionary.to_pylist()):
        texts = batch.column(1).take(pa.array(np.flatnonzero(of == number)))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        parts = (np.cumsum(sizes, dtype=np.int64) - sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(texts)]
        for low, high in zip(cuts, cuts[1:]):
            part = pc.ascii_lower(pc.fill_null(texts.slice(low, high - low), ""))
            part = pc.replace_substring_regex(part, STOPS, f" {END} ")
            part = pc.binary_join_element_wise(part, END, " ")
            coded = pc.ascii_split_whitespace(part).flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            known = hashes(words, seed)
            known[[i for i, w in enumerate(words) if w in (END, "")]] = 0
            # empty strings beside the blanks are no words and no ends
            code = coded.indices.to_numpy(zero_copy_only=False)
            real = np.array([w != "" for w in words], bool)[code] if len(code) else code.astype(bool)
            yield lang, known[code[real]]


def combine(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the distinct rows of equally long columns, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def suffixes(words: np.ndarray, hot: np.ndarray, depth: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """``(columns, known, weight)``: distinct suffixes of a slice, ready to be routed.

    A suffix is counted from depth ``known`` on: that of its first word that is not
    hot. Suffixes of hot words alone are repeated for each of their prefixes, cut
    off there.
    """
    n = len(words)
    ahead = np.concatenate((words, np.zeros(depth, np.int64)))
    starts = np.flatnonzero(words)
    columns = [ahead[starts]]
    for d in range(1, depth):
        nxt = ahead[starts + d]
        columns.append(np.where(columns[-1] == 0, 0, nxt))
    picked, weight = combine(columns)
    columns = [c[picked] for c in columns]
    is_hot = [np.isin(c, hot) for c in columns]
    out: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]] = []
    only = np.ones(len(weight), bool)  # all words so far are hot
    for d in range(depth):
        first_cold = only & ~is_hot[d] & (columns[d] != 0)
        at = np.flatnonzero(first_cold)
        out.append(([c[at] for c in columns], np.full(len(at), d + 1, np.int8), weight[at]))
        only &= is_hot[d]
        at = np.flatnonzero(only)
        cut = [c[at] if k <= d else np.zeros(len(at), np.int64) for k, c in enumerate(columns)]
        if len(at):
            sums, groups = combine(cut)
            order = np.lexsort(cut[::-1])
            total = np.add.reduceat(weight[at][order], np.concatenate(([0], np.cumsum(groups)[:-1])))
            out.append(([c[sums] for c in cut], np.full(len(sums), d + 1, np.int8), total))
    return (
        [np.concatenate([o[0][k] for o in out]) for k in range(depth)],
        np.concatenate([o[1] for o in out]),
        np.concatenate([o[2] for o in out]),
    )


_ODD = np.uint64(0x9E3779B97F4A7C15)


def route(lang: str, columns: list[np.ndarray], known: np.ndarray, routes: int) -> np.ndarray:
    """Route of each suffix: a hash of its language and its first ``known`` words."""
    h = np.full(len(known), hashes([lang], 0)[0]).view(np.uint64)
    for d, c in enumerate(columns):
        mixed = (h ^ c.view(np.uint64)) * _ODD
        h = np.where(known > d, mixed ^ (mixed >> np.uint64(29)), h)
    return (h % np.uint64(routes)).astype(np.int64)


def pack(columns: list[np.ndarray], known: np.ndarray, weight: np.ndarray) -> bytes:
    raw = b"".join([*[c.tobytes() for c in columns], weight.astype("<i8").tobytes(), known.tobytes()])
    return len(known).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(block: bytes, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, size = (int.from_bytes(block[k : k + 8], "little") for k in (0, 8))
    raw = pa.decompress(block[16:], decompressed_size=size, codec="zstd", asbytes=True)
    longs = np.frombuffer(raw, "<i8", (depth + 1) * n).reshape(depth + 1, n)
    return longs[:depth], longs[depth], np.frombuffer(raw, np.int8, n, 8 * (depth + 1) * n)


def routed(docs: DataFrame, seed: int, hot: np.ndarray, routes: int, depth: int) -> DataFrame:
    """``(lang, route, block)``: the suffixes of every task, per slice and route."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        held: dict[str, int] = {}

        def send(lang: str) -> Iterator[pa.RecordBatch]:
            words = np.concatenate(waiting.pop(lang))
            held.pop(lang)
            columns, known, weight = suffixes(words, hot, depth)
            if not len(known):
                return
            to = route(lang, columns, known, routes)
            order = np.argsort(to, kind="stable")
            at = np.flatnonzero(np.diff(to[order], prepend=-1))
            blocks = [
                pack([c[part] for c in columns], known[part], weight[part])
                for part in np.split(order, at[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(to[order][at]), pa.array(blocks, pa.binary())],
                names=["lang", "route", "block"],
            )

        for batch in batches:
            for lang, words in windows(batch, seed):
                waiting.setdefault(lang, []).append(words)
                held[lang] = held.get(lang, 0) + len(words)
                # whichever language is held most goes first
                while sum(held.values()) >= SLICE_WORDS:
                    yield from send(max(held, key=held.get))
        for lang in list(waiting):
            yield from send(lang)

    return docs.select("lang", "text").mapInArrow(run, "lang string, route long, block binary")


def frequent(
    words: np.ndarray, weight: np.ndarray, known: np.ndarray, least: int
) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """Multikey three-way quicksort; ``(depth, a suffix per phrase, count)`` and the splits done.

    ``words[d]`` has the words at depth d of all suffixes. Only suffixes counted
    from depth d on add to a phrase of d words.
    """
    depth = len(words)
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    stack: list[tuple[np.ndarray, int]] = [(np.arange(words.shape[1]), 0)]
    splits = 0
    while stack:
        at, d = stack.pop()
        if weight[at].sum() < least:
            continue  # abandoned
        if len(at) <= SMALL:
            found.extend(_small(words, weight, known, at, d, least))
            continue
        key = words[d][at]
        some = np.sort(key[:: max(1, len(key) // 63)])
        pivot = some[len(some) // 2]
        splits += 1
        less, more = key < pivot, key > pivot
        stack.append((at[less], d))
        stack.append((at[more], d))
        if pivot == 0:
            continue  # the piece ends here
        equal = at[~(less | more)]
        count = weight[equal][known[equal] <= d + 1].sum()
        if count >= least:
            found.append((d + 1, equal[:1], np.array([count])))
        if d + 1 < depth:
            stack.append((equal, d + 1))
    return found, splits


def _small(words, weight, known, at, d, least):
    """The equal parts of a small part, all depths at once from one sort."""
    depth = len(words)
    at = at[np.lexsort([words[k][at] for k in range(depth - 1, d - 1, -1)])]
    new = np.zeros(len(at), bool)
    new[0] = True
    for k in range(d, depth):
        key = words[k][at]
        new[1:] |= key[1:] != key[:-1]
        first = np.flatnonzero(new)
        counts = np.add.reduceat(np.where(known[at] <= k + 1, weight[at], 0), first)
        good = (counts >= least) & (key[first] != 0)
        if good.any():
            yield k + 1, at[first[good]], counts[good]


def phrase_counts(docs: DataFrame, seed: int, hot: np.ndarray, routes: int, least: int, depth: int) -> DataFrame:
    """``(lang, codes, f)`` of all phrases of 1 to ``depth`` words with f >= ``least``."""

    def count(blocks: pd.DataFrame) -> pd.DataFrame:
        none = {"lang": pd.Series(dtype=object), "codes": pd.Series(dtype=object), "f": pd.Series(dtype=np.int64)}
        out = [pd.DataFrame(none)]
        for lang, of_lang in blocks.groupby("lang"):
            parts = [unpack(b, depth) for b in of_lang["block"]]
            words = np.concatenate([p[0] for p in parts], axis=1)
            weight, known = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
            for size, at, f in frequent(words, weight, known, least)[0]:
                out.append(pd.DataFrame({"lang": lang, "codes": list(words[:size, at].T), "f": f}))
        return pd.concat(out)

    return (
        routed(docs, seed, hot, routes, depth)
        .groupBy("route").applyInPandas(count, "lang string, codes array<long>, f long")
    )


def phrases(docs: DataFrame, least: int = MIN_COUNT, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases ``(lang, words, f)`` and all words per language ``(lang, n)``."""
    counts, seed = dictionary(docs)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    every = counts.agg(F.sum("n")).first()[0] or 0
    # at most 1 / HOT_SHARE words
    rows = (
        counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > every * HOT_SHARE)
        .select("word").collect()
    )
    hot = np.sort(hashes([r["word"] for r in rows], seed))
    coded = stored(phrase_counts(docs, seed, hot, 1 + every // ROUTE_WORDS, least, depth), "phrase-codes")
    names = hashed(counts.where(F.col("n") >= least), seed).select("lang", "code", "word")
    spelled = (
        coded.select("lang", "codes", "f", F.posexplode("codes").alias("at", "code"))
        .join(names, ["lang", "code"])
        .groupBy("lang", "codes", "f")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))
        .select("lang", "words", "f")
    )
    return stored(spelled, "phrases"), totals


def scored(found: DataFrame) -> DataFrame:
    """``(lang, words, a, l, r, score)``: every phrase of two words or more at its weakest cut."""
    candidates = found.where(F.size("words") > 1)
    cuts = candidates.select(
        "lang", "words", F.col("f").alias("a"),
        F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"),
    )
    part = lambda name, count: found.select("lang", F.col("words").alias(name), F.col("f").alias(count))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    both = (
        cuts.withColumn("head", F.slice("words", 1, F.col("k")))
        .withColumn("tail", F.expr("slice(words, k + 1, size(words) - k)"))
        .join(part("head", "l"), ["lang", "head"])
        .join(part("tail", "r"), ["lang", "tail"])
        .withColumn("top", wide("a") * F.lit(SCALE).cast("decimal(8,0)"))
        .withColumn("score", F.expr("top div (cast(l as decimal(38,0)) + r)"))
    )
    return both.groupBy("lang", "words", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("c")
    ).select("lang", "words", "a", "c.l", "c.r", "c.score")


def covered(found: DataFrame, percent: int = LONGER_PERCENT) -> DataFrame:
    """``(lang, words)`` of the phrases that occur mostly inside a longer one."""
    longer = found.where(F.size("words") > 2)
    size = F.size("words")
    inside = longer.select(
        "lang", F.col("f").alias("longer_f"), "words",
        F.explode(F.sequence(F.lit(2), size - 1)).alias("m"),
    ).select(
        "lang", "longer_f",
        F.explode(F.transform(F.sequence(F.lit(1), size - F.col("m") + 1), lambda i: F.slice("words", i, F.col("m")))).alias("words"),
    )
    largest = inside.groupBy("lang", "words").agg(F.max("longer_f").alias("longer_f"))
    return found.join(largest, ["lang", "words"]).where(100 * F.col("longer_f") >= percent * F.col("f")).select("lang", "words")


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, depth: int = DEPTH) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of every language.

    ``docs`` needs ``text`` and ``lang``; other columns are not looked at. A null text
    is empty, a null language is ``und``; repeated rows count again; ties go to the
    phrase that is smaller in bytes; a language without frequent phrases, and an
    empty table, give no rows. Phrases do not reach across the ends of pieces.
    """
    found, totals = phrases(docs, least, depth)
    left = scored(found).join(covered(found), ["lang", "words"], "left_anti")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = (
        left.withColumn("phrase", F.array_join("words", " "))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    )
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
