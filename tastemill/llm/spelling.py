"""Spelling variants by a relational trie frontier.

The words form a trie whose edges are a distributed table: one row per node with
its outgoing letters. A node is named by its path. Every word walks its own path
down from the root; at each node it may also leave it once, by skipping a letter
of its own (deletion) or by following another letter than its own (replacement).
All walks of one depth are one table, the frontier, and one join with the edges of
that depth moves them all. A walk that has left its path only follows letters
that agree with the rest of its word; where it ends at the end of a word, the two
words are neighbours. Insertions are deletions seen from the other word, and of
two words that differ by a replacement only the one with the smaller letter
walks; both directions are reported.

Nodes under which a single word remains are leaves: no walk enters them, the rest
is compared at once. So the depth is that of the longest shared prefix, not of the
longest word. Words that share a very long prefix (``LONG`` code points) do not
walk: they meet over the hashes of the word and of all its one-letter deletions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import stored

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGE = 199
MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
# Words longer than this meet by deletion hashes.
LONG = 40
# Nodes of the first levels are copied this often, as all walks pass them.
SALTS = 64
SALTED_DEPTH = 2


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, less one letter where 199 divides the checksum of its id and text."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(
        h % DAMAGE == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    ).otherwise(run)


def vocabulary(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT
) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough.

    Runs are counted with a partial count per task, so a word that fills a third
    of all texts is one row per task. Short runs go before their checksum is taken.
    """
    runs = docs.select(
        "doc_id",
        F.explode(
            F.filter(
                F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0)),
                lambda r: F.length(r) >= min_chars,
            )
        ).alias("run"),
    ).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word"))
    return (
        words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .where((F.length("word") >= min_chars) & (F.col("n") >= min_count))
    )


def edge_table(words: DataFrame) -> DataFrame:
    """``(depth, node, salt, edges)``: the outgoing letters of every inner node.

    An edge is ``(letter, only)``; ``only`` is the one word below it, or null if the
    edge leads to an inner node. A word that ends at the node has the letter ''.
    A node has at most one edge per letter of the alphabet, so a row is bounded.
    """
    steps = words.select(
        "word",
        F.explode(F.sequence(F.lit(0), F.length("word"))).alias("depth"),
    ).select(
        "depth", "word",
        F.substr("word", F.lit(1), F.col("depth")).alias("node"),
        F.substr("word", F.col("depth") + 1, F.lit(1)).alias("letter"),
    )
    edges = steps.groupBy("depth", "node", "letter").agg(
        F.count(F.lit(1)).alias("below"), F.min("word").alias("first")
    )
    nodes = (
        edges.groupBy("depth", "node")
        .agg(
            F.sum("below").alias("below"),
            F.collect_list(
                F.struct("letter", F.when(F.col("below") == 1, F.col("first")).alias("only"))
            ).alias("edges"),
        )
        .where("below > 1")
    )
    copies = F.when(F.col("depth") <= SALTED_DEPTH, F.lit(SALTS)).otherwise(F.lit(1))
    return nodes.select(
        "depth", "node", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), "edges"
    )


def _rest(word: Column, at: Column) -> Column:
    return F.substr(word, at + 1)


def moved(frontier: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """One level down: ``(word, at, node, edits, found)`` after the edges of ``depth``.

    ``at`` is the word's position, ``found`` a neighbour that was reached.
    """
    salts = SALTS if depth <= SALTED_DEPTH else 1
    own = F.substr("word", F.col("at") + 1, F.lit(1))
    after = F.substr("word", F.col("at") + 2, F.lit(1))
    # a walk on its own path may skip a letter; of equal letters in a row, the last
    skip = (F.col("edits") == 0) & (own != "") & (own != after)
    here = frontier.select(
        "word", "node",
        F.explode(
            F.when(
                skip,
                F.array(
                    F.struct(F.col("at").alias("at"), F.lit(0).alias("edits")),
                    F.struct((F.col("at") + 1).alias("at"), F.lit(1).alias("edits")),
                ),
            ).otherwise(F.array(F.struct(F.col("at").alias("at"), F.col("edits").alias("edits"))))
        ).alias("s"),
    ).select(
        "word", "node", "s.at", "s.edits",
        F.pmod(F.xxhash64("word"), F.lit(salts)).cast("int").alias("salt"),
    )
    level = edges.where(F.col("depth") == depth).select("node", "salt", "edges")
    tried = here.join(level, ["node", "salt"]).select(
        "word", "node", "at", "edits", own.alias("own"), F.explode("edges").alias("e")
    )
    letter = F.col("e.letter")
    same = letter == F.col("own")
    other = (F.col("edits") == 0) & (F.col("own") != "") & (letter > F.col("own"))
    next_at = F.when(letter == "", F.col("at")).otherwise(F.col("at") + 1)
    edits = F.col("edits") + (~same).cast("int")
    only = F.col("e.only")
    # the rest of a single word below is compared at once
    ends = _rest(only, F.lit(depth) + F.length(letter)) == _rest(F.col("word"), next_at)
    found = F.when((edits == 1) & only.isNotNull() & ends, only)
    return tried.where(same | other).select(
        "word", next_at.alias("at"), F.concat("node", letter).alias("node"),
        edits.alias("edits"), only.isNull().alias("inner"), found.alias("found"),
    ).where("inner or found is not null")


def trie_pairs(words: DataFrame) -> DataFrame:
    """``(a, b)`` of neighbours, one direction or both, by walking the trie.

    Each level's frontier is written, so a lost executor costs one level.
    """
    edges = stored(edge_table(words), "trie-edges")
    deepest = edges.agg(F.max("depth")).first()[0]
    frontier = words.select(
        "word", F.lit(0).alias("at"), F.lit("").alias("node"), F.lit(0).alias("edits")
    )
    pairs = frontier.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    for depth in range(0, (-1 if deepest is None else deepest) + 1):
        level = stored(moved(frontier, edges, depth), "trie-frontier")
        pairs = pairs.unionByName(
            level.where("found is not null").select(F.col("word").alias("a"), F.col("found").alias("b"))
        )
        frontier = level.where("inner").select("word", "at", "node", "edits")
    return pairs


_STEP = np.uint64(0x9E3779B97F4A7C15)


def deletion_hashes(word: str) -> np.ndarray:
    """64-bit hashes of the word and of the word less each of its letters, in linear time."""
    codes = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(codes)
    zero, one = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate((one, np.full(n, _STEP))))
        ahead = np.concatenate((zero, np.cumsum(codes * power[:n])))
        # letters after the hole move one place to the front
        behind = np.concatenate((zero, np.cumsum(codes[1:] * power[: n - 1])))
        holes = ahead[:n] + behind[n - 1] - behind[:n]
    return np.concatenate((ahead[n:], holes))


def long_pairs(words: DataFrame) -> DataFrame:
    """``(a, b)`` of candidate neighbours among long words; to be confirmed.

    Words that differ by one edit share the hash of a deletion, or one is a
    deletion of the other. The equality of hashes is only a filter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word in batch.column(0).to_pylist():
                keys = np.unique(deletion_hashes(word)).view(np.int64)
                for low in range(0, len(keys), 10_000):
                    part = pa.array(keys[low : low + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [part, pa.array([word] * len(part))], names=["key", "word"]
                    )

    keyed = words.select("word").mapInArrow(run, "key long, word string").select(
        "key", "word", F.xxhash64("word").alias("of")
    )
    other = keyed.select("key", F.col("word").alias("b"), F.col("of").alias("of_b"))
    return keyed.join(other, "key").where("word < b").select(F.col("word").alias("a"), "b").distinct()


def one_edit(a: Column, b: Column) -> Column:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    return (a != b) & (F.levenshtein(a, b, 1) == 1)


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, near)`` in both directions, each pair once."""
    walking = words.where(F.length("word") <= LONG)
    long = words.where(F.length("word") >= LONG)
    met = long_pairs(long).where(one_edit(F.col("a"), F.col("b")))
    pairs = trie_pairs(walking).unionByName(met)
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("b").alias("near")),
            F.struct(F.col("b").alias("word"), F.col("a").alias("near")),
        )
    )
    return pairs.select(both.alias("p")).select("p.word", "p.near").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: where following ``(word, form)`` ends, by doubling the jumps.

    A form is several times as frequent as its word, so chains have no rings and
    their length is at most logarithmic in the number of occurrences.
    """
    jump = stored(forms.where("form is not null").select("word", F.col("form").alias("root")), "jumps")
    while True:
        ahead = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(
            jump.join(ahead, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"),
                F.col("further").isNotNull().alias("moved"),
            ),
            "jumps",
        )
        jump = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return jump


def variants(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of the texts.

    A word's form is its near word of largest count (ties: the smaller word), if
    that is ``ratio`` times its own. Null and empty texts have no words; a null id
    counts as an empty one in the checksum; repeated rows count twice; other
    columns are not looked at; an empty table gives no rows.
    """
    words = stored(vocabulary(docs, min_chars, min_count), "words")
    near = neighbours(words).join(
        words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near"
    )
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"),
    )
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(
            F.col("best.form").alias("form"), (-F.col("best.less")).alias("n")
        )).alias("f"),
    )
    found = stored(judged.select("word", "f.form", "n", "n_near", F.col("f.n").alias("form_n")), "forms")
    return found.join(roots(found), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
