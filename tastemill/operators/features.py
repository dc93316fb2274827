"""User, movie and text features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tastemill.functions.columns import bigrams, clean_text, tokens
from tastemill.functions.ranking import dense_index, exact_quantiles, one_row, with_row
from tastemill.session import materialise
from tastemill.functions.stopwords import ENGLISH
from tastemill.operators.clean import UNKNOWN, genres_as_array

# Fixed values --------------------------------------------------------------
ACTIVITY_LEVELS = ("low", "medium", "high", "very_high")
HARSH_BELOW, AVERAGE_BELOW = 2.5, 3.5
COUNT_SHARE, USER_SHARE = 0.7, 0.3
MAX_ONE_HOT = 50
# words that may tie for the last place of a vocabulary, in vocabularies
TIES = 10
TABLE_TERMS, CONTENT_TERMS = 100, 50
DECLARED_WEIGHTS = {
    "genres": 0.4,
    "description": 0.3,
    "directors": 0.1,
    "actors": 0.1,
    "year": 0.05,
    "rating": 0.05,
}
# the declared names that really match a feature column
AS_CODED_WEIGHTS = {"description": 0.3, "directors": 0.1, "actors": 0.1}
# ---------------------------------------------------------------------------

NUMERIC_GROUPS = {"release_year": "year", "duration_minutes": "duration", "imdb_rating": "rating"}
CATEGORICAL = ("directors", "actors", "language", "country")
TEXTS = ("description", "title")


def rating_tendency(average: str = "avg_rating") -> Column:
    """A missing average is neither below, hence ``generous``."""
    a = F.col(average)
    return (
        F.when(a < HARSH_BELOW, "harsh").when(a < AVERAGE_BELOW, "average").otherwise("generous")
    )


def activity_level(df: DataFrame, count: str = "interaction_count") -> DataFrame:
    """Quartile bins of a count, right-closed; ``low`` for all when bins collapse."""
    name = F.concat(F.lit("q"), (F.col("prob") * 4).cast("int").cast("string"))
    quantiles = exact_quantiles(df, [count], [0.0, 0.25, 0.5, 0.75, 1.0])
    out = with_row(df, one_row(quantiles, name, ["q0", "q1", "q2", "q3", "q4"], "value"), "_edge")
    edge = F.col("_edge")
    values = df.select(count).distinct().agg(F.count(F.lit(1)) >= 4)
    out = with_row(out, values, "_enough")
    all_edges = F.array(*[edge[f"q{i}"] for i in range(5)])
    usable = F.col("_enough") & (F.size(F.array_distinct(all_edges)) == 5)
    low, medium, high, very_high = ACTIVITY_LEVELS
    n = F.col(count)
    level = (
        F.when(~usable | (n <= edge["q1"]), low)
        .when(n <= edge["q2"], medium)
        .when(n <= edge["q3"], high)
        .otherwise(very_high)
    )
    return out.withColumn("activity_level", level).drop("_edge", "_enough")


def user_features(interactions: DataFrame) -> DataFrame:
    """Rating figures, activity level and tendency per user."""
    base = interactions.groupBy("user_id").agg(
        F.count("rating").alias("interaction_count"),
        F.avg("rating").alias("avg_rating"),
        F.stddev_samp("rating").alias("rating_std"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        F.countDistinct("movie_id").alias("unique_movies_rated"),
    )
    return activity_level(base).withColumn("rating_tendency", rating_tendency())


def movie_stats(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("movie_id").agg(
        F.count("rating").alias("rating_count"),
        F.avg("rating").alias("avg_rating"),
        F.stddev_samp("rating").alias("rating_std"),
        F.countDistinct("user_id").alias("unique_users"),
    )


def popularity_score() -> Column:
    return F.col("rating_count") * F.lit(COUNT_SHARE) + F.col("unique_users") * F.lit(USER_SHARE)


def movie_features_join(movies: DataFrame, interactions: DataFrame) -> DataFrame:
    """Catalogue with interaction figures; movies nobody used count zero."""
    joined = movies.join(movie_stats(interactions), "movie_id", "left").fillna(
        0, ["rating_count", "unique_users"]
    )
    return joined.withColumn("popularity_score", popularity_score())


def as_text(df: DataFrame, column: str) -> Column:
    """A categorical value as text; lists are joined, NULL is ``Unknown``."""
    col = F.col(column)
    if isinstance(df.schema[column].dataType, T.ArrayType):
        col = F.array_join(col, ", ")
    return F.coalesce(col.cast("string"), F.lit(UNKNOWN))


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_encoded``: position of the value among the sorted distinct ones."""
    for c in columns:
        texts = df.withColumn("_text", as_text(df, c))
        codes = dense_index(texts, "_text", f"{c}_encoded")
        df = texts.join(codes, "_text").drop("_text")
    return df


def min_max_normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_normalized`` in 0..1; a constant column gives 0."""
    span = df.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"{c}_lo") for c in columns],
            *[F.max(c).cast("double").alias(f"{c}_hi") for c in columns],
        ).alias("span")
    )
    out = {}
    for c in columns:
        low, high = F.col("_span")[f"{c}_lo"], F.col("_span")[f"{c}_hi"]
        scaled = F.try_divide(F.col(c).cast("double") - low, high - low)
        out[f"{c}_normalized"] = F.when(F.col(c).isNotNull(), F.coalesce(scaled, F.lit(0.0)))
    return with_row(df, span, "_span").withColumns(out).drop("_span")


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_scaled``: median fill, then centre and divide by population deviation."""
    moments = df.agg(
        F.struct(
            *[F.count(c).cast("double").alias(f"{c}_n") for c in columns],
            *[F.count_if(F.col(c).isNull()).cast("double").alias(f"{c}_gaps") for c in columns],
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.var_pop(c).alias(f"{c}_var") for c in columns],
        ).alias("moments")
    )
    medians = exact_quantiles(df, columns, [0.5])
    out = with_row(df, one_row(medians, F.col("name"), columns, "value"), "_median")
    out = with_row(out, moments, "_m")
    filled, scaled = {}, {}
    for c in columns:
        n, gaps, mean, var = (F.col("_m")[f"{c}_{k}"] for k in ("n", "gaps", "mean", "var"))
        fill = F.col("_median")[c]
        # mean and variance of the filled column: known values and gaps combined
        total = n + gaps
        centre = (n * mean + gaps * fill) / total
        spread = (n * var + n * gaps / total * (mean - fill) * (mean - fill)) / total
        deviation = F.coalesce(F.nullif(F.sqrt(spread), F.lit(0.0)), F.lit(1.0))
        filled[c] = F.coalesce(F.col(c).cast("double"), fill)
        scaled[f"{c}_scaled"] = (filled[c] - centre) / deviation
    return out.withColumns({**scaled, **filled}).drop("_median", "_m")


def term_list(
    text: Column, bigram: bool = False, stop_words: Sequence[str] | None = None
) -> Column:
    """Terms of a text: words, and word pairs built after stop words are gone."""
    stop = list(ENGLISH if stop_words is None else stop_words)
    words = tokens(text)
    if stop:
        words = F.filter(words, lambda w: ~w.isin(*stop))
    return F.concat(words, bigrams(words)) if bigram else words


def _most_frequent(terms: DataFrame, n: int) -> list[tuple[int, str]]:
    """The first ``n`` terms as ``(-rows, term)``."""
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return [(-r["n"], r["term"]) for r in counts.orderBy(F.col("n").desc(), "term").limit(n).collect()]


def _chosen_terms(
    ids: DataFrame, id_column: str, max_features: int, bigram: bool
) -> tuple[DataFrame, list[str]]:
    """Terms ``(id, term)`` that can be among the most frequent, and those that are.

    A pair is no more frequent than either of its words, so only words at least as frequent as
    the last of the ``max_features`` most frequent ones can be in a pair that is chosen. Where
    more than ``TIES`` times ``max_features`` words tie there, all pairs are counted.
    """
    words = ids.select(id_column, F.explode("_words").alias("term"))
    if max_features < 1:
        return words, []
    first = _most_frequent(words, TIES * max_features + 1 if bigram else max_features)
    if not bigram:
        return words, [w for _, w in first]
    floor = first[max_features - 1][0] if len(first) >= max_features else 0
    able = [w for n, w in first if n <= floor]
    rest = F.slice("_words", 2, F.greatest(F.size("_words") - 1, F.lit(0)))
    pairs = ids.select(id_column, F.col("_words").alias("a"), rest.alias("b")).select(
        id_column, F.inline(F.arrays_zip("a", "b"))
    )
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    if len(able) <= TIES * max_features:
        known = F.col("a").isin(able) & F.col("b").isin(able)
    pairs = pairs.where(known).select(id_column, F.concat_ws(" ", "a", "b").alias("term"))
    best = sorted(first + _most_frequent(pairs, max_features))[:max_features]
    return words.unionByName(pairs), [w for _, w in best]


def tfidf(
    docs: DataFrame,
    text: str,
    id_column: str = "movie_id",
    max_features: int = TABLE_TERMS,
    bigram: bool = False,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """``(id, term, value)``: L2-normalised tf x idf over the most frequent terms.

    The vocabulary is a top-k of at most ``max_features`` rows, so it is part of
    the plan; only cells of vocabulary terms are shuffled.
    """
    stop = [w for w in (ENGLISH if stop_words is None else stop_words)]
    # read, cleaned and cut into words once; pairs are built from the stored words
    ids = materialise(
        docs.select(id_column, term_list(F.coalesce(F.col(text), F.lit("")), False, stop).alias("_words"))
    )
    terms, chosen = _chosen_terms(ids, id_column, max_features, bigram)
    counts = (
        terms.where(F.col("term").isin(chosen))
        .groupBy(id_column, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    n = ids.agg(F.count(F.lit(1)).cast("double")).scalar()
    idf = (
        counts.groupBy("term")
        .agg(F.count(F.lit(1)).alias("doc_count"))
        .select("term", (F.log((n + 1) / (F.col("doc_count") + 1)) + 1).alias("idf"))
    )
    raw = counts.join(F.broadcast(idf), "term").select(
        id_column, "term", (F.col("tf") * F.col("idf")).alias("raw")
    )
    per_doc = Window.partitionBy(id_column)
    return raw.select(
        id_column,
        "term",
        (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(per_doc))).alias("value"),
    )


def genre_multi_hot(movies: DataFrame) -> DataFrame:
    """``(movie_id, genre, value = 1.0)`` per movie and genre."""
    genres = F.array_distinct(genres_as_array(movies))
    return movies.select("movie_id", F.explode(genres).alias("genre")).withColumn(
        "value", F.lit(1.0)
    )


def genre_wide(movies: DataFrame, genres: Sequence[str]) -> DataFrame:
    """0/1 columns for the named genres."""
    have = genres_as_array(movies)
    return movies.select(
        "movie_id",
        *[F.array_contains(have, g).cast("double").alias(f"genre_{g}") for g in genres],
    )


def first_value(df: DataFrame, column: str) -> Column:
    """First element of a list (or of comma-separated text), trimmed."""
    col = F.col(column)
    if isinstance(df.schema[column].dataType, T.ArrayType):
        text = F.try_element_at(col, F.lit(1)).cast("string")
    else:
        text = F.split_part(F.regexp_replace(col.cast("string"), r"^[\[\]]+", ""), F.lit(","), F.lit(1))
    text = F.regexp_replace(text, r"^[\[\]'\" ]+|[\[\]'\" ]+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(UNKNOWN))


def categorical_one_hot(
    df: DataFrame, column: str, max_one_hot: int = MAX_ONE_HOT
) -> DataFrame:
    """``(movie_id, feature, value)``: one-hot up to 50 values, else the label code."""
    values = df.select("movie_id", first_value(df, column).alias("_text"))
    codes = dense_index(values, "_text", "code")
    few = codes.agg(F.count(F.lit(1)) <= max_one_hot)
    return with_row(values.join(codes, "_text"), few, "_few").select(
        "movie_id",
        F.when(F.col("_few"), F.concat(F.lit(f"{column}_"), "_text"))
        .otherwise(F.lit(f"{column}_encoded"))
        .alias("feature"),
        F.when(F.col("_few"), F.lit(1.0)).otherwise(F.col("code").cast("double")).alias("value"),
    )


def long_features(movies: DataFrame, max_terms: int = CONTENT_TERMS) -> DataFrame:
    """All content features ``(movie_id, grp, feature, value)`` of the columns present."""
    have = set(movies.columns)
    parts: list[DataFrame] = []
    if "genres" in have:
        parts.append(
            genre_multi_hot(movies).select(
                "movie_id", F.lit("genres").alias("grp"),
                F.concat(F.lit("genre_"), "genre").alias("feature"), "value",
            )
        )
    for c in TEXTS:
        if c in have:
            cleaned = movies.select("movie_id", clean_text(c).alias("text"))
            parts.append(
                tfidf(cleaned, "text", max_features=max_terms, bigram=True).select(
                    "movie_id", F.lit(c).alias("grp"),
                    F.concat(F.lit(f"{c}_"), "term").alias("feature"), "value",
                )
            )
    for c in CATEGORICAL:
        if c in have:
            parts.append(
                categorical_one_hot(movies, c).select(
                    "movie_id", F.lit(c).alias("grp"), "feature", "value"
                )
            )
    numbers = [c for c in NUMERIC_GROUPS if c in have]
    if numbers:
        scaled = standard_scale(movies.select("movie_id", *numbers), numbers)
        cells = [
            F.struct(
                F.lit(NUMERIC_GROUPS[c]).alias("grp"),
                F.lit(f"{c}_scaled").alias("feature"),
                F.col(f"{c}_scaled").alias("value"),
            )
            for c in numbers
        ]
        parts.append(
            scaled.select("movie_id", F.explode(F.array(*cells)).alias("c")).select(
                "movie_id", "c.grp", "c.feature", "c.value"
            )
        )
    if not parts:
        raise ValueError("no feature columns in the catalogue")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weighted_features(
    features: DataFrame, weights: Mapping[str, float] | str = "declared"
) -> DataFrame:
    """Values times the weight of their group; groups without a weight keep 1."""
    if weights == "declared":
        weights = DECLARED_WEIGHTS
    elif weights == "as_coded":
        weights = AS_CODED_WEIGHTS
    elif isinstance(weights, str):
        raise ValueError("weights are 'declared', 'as_coded' or a mapping")
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    factor = F.coalesce(F.try_element_at(table, F.col("grp")), F.lit(1.0))
    return features.withColumn("value", F.col("value") * factor)


def unit_features(features: DataFrame) -> DataFrame:
    """``(movie_id, feature, value)`` scaled to length one; zero cells dropped."""
    w = Window.partitionBy("movie_id")
    return (
        features.where(F.col("value") != 0)
        .withColumn("norm", F.sqrt(F.sum(F.col("value") * F.col("value")).over(w)))
        .select("movie_id", "feature", (F.col("value") / F.col("norm")).alias("value"))
    )


def feature_vectors(
    features: DataFrame, vocabulary: DataFrame | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """``(movie_id, vec array<double>)``: cells in the order of the sorted features.

    ``ids`` may name rows that must be present even without a feature.
    """
    if vocabulary is None:
        vocabulary = dense_index(features, "feature", "idx")
    # lambdas cannot hold a subquery, so the slots are a column of their own
    slots = F.sequence(F.lit(0), vocabulary.agg(F.max("idx").cast("int")).scalar())
    placed = features.join(vocabulary, "feature").select("movie_id", "idx", "value")
    maps = placed.groupBy("movie_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int"), "value"))).alias("m")
    )
    if ids is not None:
        empty = F.create_map().cast("map<int,double>")
        maps = ids.join(maps, "movie_id", "left").withColumn("m", F.coalesce("m", empty))
    return maps.withColumn("slots", slots).select(
        "movie_id",
        F.transform(
            "slots",
            lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)),
        ).alias("vec"),
    )


def movie_features(movies: DataFrame, interactions: DataFrame) -> DataFrame:
    """The item table: interaction figures, popularity, label codes, scaled numbers."""
    out = movie_features_join(movies, interactions)
    out = label_encode(out, [c for c in ("genres", "language", "country") if c in out.columns])
    numbers = [c for c in NUMERIC_GROUPS if c in out.columns]
    return min_max_normalize(out, numbers) if numbers else out


def json_fields(df: DataFrame, lists: Sequence[str] = (), maps: Sequence[str] = ()) -> DataFrame:
    """JSON text columns to arrays and maps; unreadable or missing text is empty."""
    out: dict[str, Column] = {}
    for c in lists:
        out[c] = F.coalesce(
            F.from_json(c, "array<string>"), F.array().cast("array<string>")
        )
    for c in maps:
        out[c] = F.coalesce(
            F.from_json(c, "map<string,string>"),
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        )
    return df.withColumns(out)


def to_json_fields(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c in columns})
