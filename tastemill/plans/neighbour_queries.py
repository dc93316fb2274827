"""Rating matrix, neighbourhood and factorisation queries.

Similarities and predictions run on the order lines (large and sparse);
all-user recommendations on the event ratings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.operators import cf, matrix, mf, similarity_join
from tastemill.plans.registry import query
from tastemill.plans.shared import r6
from tastemill.session import materialise
from tastemill.sources.views import Views


def cells(v: Views):
    return materialise(matrix.rated_cells(v.ratings()))


def event_cells(v: Views):
    return materialise(matrix.rated_cells(v.events()))


def items(v: Views):
    return matrix.universe("movie_id", v.ratings(), v.movies())


def event_items(v: Views):
    return matrix.universe("movie_id", v.events(), v.movies())


@query(
    "rating_matrix",
    """
    SELECT user_id, movie_id,
           round(avg(least(5.0::DOUBLE, greatest(0.0::DOUBLE, rating))), 6) AS rating
    FROM v_events WHERE rating IS NOT NULL GROUP BY user_id, movie_id""",
)
def rating_matrix(v: Views):
    return matrix.rating_matrix(v.events()).withColumn("rating", r6("rating"))


@query(
    "matrix_view",
    """
    SELECT user_id, round(coalesce(max(rating) FILTER (WHERE movie_id = '1'), 0.0), 6) AS "1",
           round(coalesce(max(rating) FILTER (WHERE movie_id = '2'), 0.0), 6) AS "2",
           round(coalesce(max(rating) FILTER (WHERE movie_id = '3'), 0.0), 6) AS "3"
    FROM v_ecells WHERE movie_id IN ('1', '2', '3') GROUP BY user_id""",
)
def matrix_view(v: Views):
    out = matrix.matrix_view(matrix.rated_cells(v.events()), ["1", "2", "3"])
    return out.select("user_id", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in "123"])


@query(
    "universe_completion",
    """
    SELECT 'user' AS kind, user_id AS id FROM v_users
    WHERE user_id NOT IN (SELECT user_id FROM v_ecells)
    UNION ALL SELECT 'movie', movie_id FROM v_movies
    WHERE movie_id NOT IN (SELECT movie_id FROM v_ecells)""",
)
def universe_completion(v: Views):
    rated = matrix.rated_cells(v.events())
    return matrix.universe_completion(rated, v.users(), v.movies())


@query(
    "unrated_candidates",
    """
    SELECT u.user_id, i.movie_id FROM (SELECT DISTINCT user_id FROM v_events) u, v_eitems i
    EXCEPT SELECT user_id, movie_id FROM v_ecells""",
)
def unrated_candidates(v: Views):
    rated = matrix.rated_cells(v.events())
    return matrix.unrated_candidates(v.events().select("user_id"), event_items(v), rated)


@query(
    "global_mean", "SELECT round(avg(rating), 6) AS global_mean, count(*) AS cells FROM v_cells"
)
def global_mean(v: Views):
    return matrix.global_mean(matrix.rated_cells(v.ratings())).withColumn("global_mean", r6("global_mean"))


def cosine_sql(name: str, source: str, row: str, key: str) -> str:
    return f"""
    {name}_u AS (SELECT {row} AS id, {key} AS k,
                        rating / sqrt(sum(rating * rating) OVER (PARTITION BY {row})) AS x
                 FROM {source}),
    {name} AS (SELECT a.id AS id_a, b.id AS id_b, sum(a.x * b.x) AS sim
               FROM {name}_u a JOIN {name}_u b ON a.k = b.k AND a.id < b.id
               GROUP BY a.id, b.id),
    {name}_both AS (SELECT * FROM {name} UNION ALL SELECT id_b, id_a, sim FROM {name})"""


@query(
    "user_similarity_cosine",
    f"""
    WITH {cosine_sql("s", "v_cells", "user_id", "movie_id")}
    SELECT id_a, id_b, round(sim, 6) AS sim FROM s""",
)
def user_similarity_cosine(v: Views):
    return cf.user_similarity_cosine(cells(v)).withColumn("sim", r6("sim"))


@query(
    "item_similarity_cosine",
    f"""
    WITH {cosine_sql("s", "v_cells", "movie_id", "user_id")}
    SELECT id_a, id_b, round(sim, 6) AS sim FROM s""",
)
def item_similarity_cosine(v: Views):
    return cf.item_similarity_cosine(cells(v)).withColumn("sim", r6("sim"))


# thresholds of the similarity joins; order lines overlap little, so most pairs lie below
USERS_ALIKE, ITEMS_ALIKE = 0.15, 0.15


def above_sql(row: str, key: str, threshold: float) -> str:
    """Classes of proportional rows, and their pairs with a cosine of at least the threshold."""
    return f"""
    WITH scaled AS (SELECT {row} AS id, {key} AS k, rating,
                           rating / max(rating) OVER (PARTITION BY {row}) AS x FROM v_cells),
    marks AS (SELECT id, list((k, x) ORDER BY k) AS direction FROM scaled GROUP BY id),
    classes AS (SELECT min(id) AS id, count(*) AS members FROM marks GROUP BY direction),
    units AS (SELECT id, k, rating / sqrt(sum(rating * rating) OVER (PARTITION BY id)) AS x
              FROM scaled SEMI JOIN classes USING (id)),
    sims AS (SELECT a.id AS id_a, b.id AS id_b, round(sum(a.x * b.x), 9) AS sim
             FROM units a JOIN units b ON a.k = b.k AND a.id < b.id GROUP BY a.id, b.id)
    SELECT id_a, id_b, sim, a.members AS members_a, b.members AS members_b
    FROM sims JOIN classes a ON a.id = id_a JOIN classes b ON b.id = id_b
    WHERE sim >= {threshold}::DOUBLE"""


@query("user_similarity_above", above_sql("user_id", "movie_id", USERS_ALIKE))
def user_similarity_above(v: Views):
    return similarity_join.similar_above(cells(v), "user_id", "movie_id", USERS_ALIKE)


@query("item_similarity_above", above_sql("movie_id", "user_id", ITEMS_ALIKE))
def item_similarity_above(v: Views):
    return similarity_join.similar_above(cells(v), "movie_id", "user_id", ITEMS_ALIKE)


@query(
    "user_similarity_pearson",
    """
    WITH n AS (SELECT count(*)::DOUBLE AS n FROM v_items),
    m AS (SELECT user_id, sum(rating) AS t,
                 (SELECT n FROM n) * sum(rating * rating) - sum(rating) * sum(rating) AS s
          FROM v_cells GROUP BY user_id),
    d AS (SELECT a.user_id AS id_a, b.user_id AS id_b, sum(a.rating * b.rating) AS dot
          FROM v_cells a JOIN v_cells b ON a.movie_id = b.movie_id AND a.user_id < b.user_id
          GROUP BY a.user_id, b.user_id)
    SELECT id_a, id_b,
           round(((SELECT n FROM n) * dot - x.t * y.t) / nullif(sqrt(x.s * y.s), 0), 6) + 0.0::DOUBLE AS sim
    FROM d JOIN m x ON d.id_a = x.user_id JOIN m y ON d.id_b = y.user_id""",
)
def user_similarity_pearson(v: Views):
    out = cf.user_similarity_pearson(cells(v), matrix.item_count(items(v)))
    return out.withColumn("sim", r6("sim"))


def nearest_sql(neighbours: str, value: str) -> str:
    """Estimates from ``neighbours (user_id, movie_id, neighbour, sim, <value>)``."""
    return f"""
    SELECT user_id, movie_id, sum(sim * {value}) / nullif(sum(abs(sim)), 0) AS estimate
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, movie_id
                        ORDER BY round(sim, 9) DESC, neighbour) AS place FROM ({neighbours}))
    WHERE place <= 5 GROUP BY user_id, movie_id"""


def user_sql(source: str, universe: str) -> str:
    return f"""
    mu AS (SELECT user_id, sum(rating) / (SELECT count(*) FROM {universe})::DOUBLE AS user_mean
           FROM {source} GROUP BY user_id),
    dev AS (SELECT c.user_id AS neighbour, movie_id, rating - user_mean AS deviation
            FROM {source} c JOIN mu ON c.user_id = mu.user_id),
    {cosine_sql("us", source, "user_id", "movie_id")}"""


CLIP = "least(5.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"

USER_PREDICT_SQL = f"""
    {user_sql("v_cells", "v_items")},
    est AS ({nearest_sql('''
        SELECT p.user_id, p.movie_id, d.neighbour, s.sim, d.deviation
        FROM v_cells p JOIN dev d ON p.movie_id = d.movie_id
        JOIN us_both s ON s.id_a = p.user_id AND s.id_b = d.neighbour''', "deviation")}),
    pred AS (SELECT p.user_id, p.movie_id, p.rating,
                    CASE WHEN estimate IS NULL THEN user_mean
                         ELSE {CLIP.format(x="user_mean + estimate")} END AS score
             FROM v_cells p JOIN mu ON p.user_id = mu.user_id
             LEFT JOIN est e ON p.user_id = e.user_id AND p.movie_id = e.movie_id)"""


@query(
    "user_cf_predict",
    f"WITH {USER_PREDICT_SQL} SELECT user_id, movie_id, round(score, 6) AS score FROM pred",
)
def user_cf_predict(v: Views):
    known = cells(v)
    return cf.user_cf_predict(known, known, items(v)).withColumn("score", r6("score"))


ITEM_PREDICT_SQL = f"""
    {cosine_sql("s", "v_cells", "movie_id", "user_id")},
    est AS ({nearest_sql('''
        SELECT p.user_id, p.movie_id, c.movie_id AS neighbour, s.sim, c.rating
        FROM v_cells p JOIN v_cells c ON p.user_id = c.user_id
        JOIN s_both s ON s.id_a = p.movie_id AND s.id_b = c.movie_id''', "rating")}),
    pred AS (SELECT p.user_id, p.movie_id, p.rating,
                    {CLIP.format(x="coalesce(estimate, 0.0)")} AS score
             FROM v_cells p LEFT JOIN est e ON p.user_id = e.user_id AND p.movie_id = e.movie_id)"""


@query(
    "item_cf_predict",
    f"WITH {ITEM_PREDICT_SQL} SELECT user_id, movie_id, round(score, 6) AS score FROM pred",
)
def item_cf_predict(v: Views):
    known = cells(v)
    return cf.item_cf_predict(known, known, items(v)).withColumn("score", r6("score"))


@query(
    "k_nearest_rated",
    f"""
    WITH {cosine_sql("s", "v_ecells", "movie_id", "user_id")},
    m AS (SELECT p.user_id, p.movie_id, c.movie_id AS neighbour, sim, c.rating,
                 row_number() OVER (PARTITION BY p.user_id, p.movie_id
                                    ORDER BY round(sim, 9) DESC, c.movie_id) AS place
          FROM v_ecells p JOIN v_ecells c ON p.user_id = c.user_id
          JOIN s_both s ON s.id_a = p.movie_id AND s.id_b = c.movie_id)
    SELECT user_id, movie_id, neighbour, place, round(sim, 6) AS sim FROM m WHERE place <= 5""",
)
def k_nearest_rated(v: Views):
    known = event_cells(v)
    sims = cf.both_ways(cf.item_similarity_cosine(known)).select(
        F.col("id_a").alias("movie_id"), F.col("id_b").alias("neighbour"), "sim"
    )
    own = known.select("user_id", F.col("movie_id").alias("neighbour"), "rating")
    met = known.select("user_id", "movie_id").join(own, "user_id").join(
        sims, ["movie_id", "neighbour"]
    )
    return cf.k_nearest_rated(met).select(
        "user_id", "movie_id", "neighbour", F.col("place").cast("bigint"), r6("sim")
    )


def top_sql(scored: str, n: int, rank: str = "rank") -> str:
    return f"""
    SELECT user_id, movie_id, score, {rank} FROM (
        SELECT user_id, movie_id, score, row_number() OVER (
            PARTITION BY user_id ORDER BY round(score, 9) DESC, movie_id) AS {rank}
        FROM ({scored})) WHERE {rank} <= {n}"""


def user_recommend_sql(
    name: str, n: int, source: str = "v_ecells", universe: str = "v_eitems"
) -> str:
    """CTEs ending in ``name (user_id, movie_id, score, rank)`` over rated cells."""
    met = """
        SELECT s.id_a AS user_id, d.movie_id, d.neighbour, s.sim, d.deviation
        FROM us_both s JOIN dev d ON s.id_b = d.neighbour"""
    scored = f"""
        SELECT g.user_id, g.movie_id, CASE WHEN estimate IS NULL THEN user_mean
               ELSE {CLIP.format(x="user_mean + estimate")} END AS score
        FROM (SELECT mu.user_id, user_mean, i.movie_id FROM mu, {universe} i) g
        LEFT JOIN est e ON g.user_id = e.user_id AND g.movie_id = e.movie_id
        WHERE NOT EXISTS (SELECT 1 FROM {source} c
                          WHERE c.user_id = g.user_id AND c.movie_id = g.movie_id)"""
    return f"""
    {user_sql(source, universe)},
    est AS ({nearest_sql(met, "deviation")}),
    {name} AS ({top_sql(f"SELECT * FROM ({scored}) WHERE score > 0", n)})"""


def item_recommend_sql(name: str, n: int, source: str = "v_ecells") -> str:
    met = f"""
        SELECT c.user_id, s.id_a AS movie_id, c.movie_id AS neighbour, s.sim, c.rating
        FROM {source} c JOIN ism_both s ON s.id_b = c.movie_id"""
    scored = f"""
        SELECT e.user_id, e.movie_id, {CLIP.format(x="estimate")} AS score FROM iest e
        WHERE estimate > 0 AND NOT EXISTS (SELECT 1 FROM {source} c
              WHERE c.user_id = e.user_id AND c.movie_id = e.movie_id)"""
    return f"""
    {cosine_sql("ism", source, "movie_id", "user_id")},
    iest AS ({nearest_sql(met, "rating")}),
    {name} AS ({top_sql(scored, n)})"""


SHOWN = 'user_id, movie_id, round(score, 6) AS score, "rank"'


def shown(recs):
    return recs.select("user_id", "movie_id", r6("score"), F.col("rank").cast("bigint"))


# scores that are short decimals end in halves: a nudge rounds them alike in both engines
NUDGE = 1e-9
NUDGED = f'user_id, movie_id, round(score + {NUDGE}::DOUBLE, 6) AS score, "rank"'


def nudged(recs):
    return shown(recs.withColumn("score", F.col("score") + F.lit(NUDGE)))


@query("user_cf_recommend", f"WITH {user_recommend_sql('r', 10)} SELECT {SHOWN} FROM r")
def user_cf_recommend(v: Views):
    return shown(cf.user_cf_recommend(event_cells(v), event_items(v)))


@query("item_cf_recommend", f"WITH {item_recommend_sql('r', 10)} SELECT {SHOWN} FROM r")
def item_cf_recommend(v: Views):
    return shown(cf.item_cf_recommend(event_cells(v), event_items(v)))


@query(
    "user_cf_recommend_ratings",
    f"WITH {user_recommend_sql('r', 10, 'v_cells', 'v_items')} SELECT {NUDGED} FROM r",
)
def user_cf_recommend_ratings(v: Views):
    return nudged(cf.user_cf_recommend(cells(v), items(v)))


@query(
    "item_cf_recommend_ratings",
    f"WITH {item_recommend_sql('r', 10, 'v_cells')} SELECT {NUDGED} FROM r",
)
def item_cf_recommend_ratings(v: Views):
    return nudged(cf.item_cf_recommend(cells(v), items(v)))


@query(
    "batch_recommend",
    f"""
    WITH {item_recommend_sql("r", 20)},
    b AS (SELECT user_id FROM v_events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 100)
    SELECT {SHOWN} FROM r WHERE user_id IN (SELECT user_id FROM b)""",
)
def batch_recommend(v: Views):
    busiest = (
        v.events()
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "user_id")
        .limit(cf.MAX_BATCH_USERS)
    )
    known, listed = event_cells(v), event_items(v)
    return shown(
        cf.batch_recommend(
            lambda users, n: cf.item_cf_recommend(known, listed, n, targets=users), busiest, 20
        )
    )


@query(
    "top_n_per_user",
    f"""
    WITH r AS ({top_sql("SELECT user_id, movie_id, max(score) AS score FROM v_recs "
                        "GROUP BY user_id, movie_id", 5)})
    SELECT user_id, movie_id, score, "rank" FROM r""",
)
def top_n_per_user(v: Views):
    from tastemill.functions.ranking import top_n

    best = v.recs().groupBy("user_id", "movie_id").agg(F.max("score").alias("score"))
    return top_n(best, 5).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "pagination",
    """
    SELECT recommendation_id, user_id, score FROM v_recs
    ORDER BY v_recs.score DESC, recommendation_id LIMIT 100 OFFSET 200""",
)
def pagination(v: Views):
    from tastemill.functions.ranking import page

    order = [F.col("score").desc(), F.col("recommendation_id")]
    return page(v.recs().select("recommendation_id", "user_id", "score"), order, 100, 200)


BIAS_SQL = """
    g AS (SELECT avg(rating) AS mean FROM v_cells),
    bi AS (SELECT movie_id, sum(rating - (SELECT mean FROM g)) / (count(*) + 0.02::DOUBLE) AS bias
           FROM v_cells GROUP BY movie_id),
    bu AS (SELECT user_id,
                  sum(rating - (SELECT mean FROM g) - bias) / (count(*) + 0.02::DOUBLE) AS bias
           FROM v_cells c JOIN bi ON c.movie_id = bi.movie_id GROUP BY user_id)"""


@query(
    "mf_biases",
    f"""
    WITH {BIAS_SQL}
    SELECT 'global' AS kind, '' AS id, round(mean, 6) AS bias FROM g
    UNION ALL SELECT 'movie', movie_id, round(bias, 6) FROM bi
    UNION ALL SELECT 'user', user_id, round(bias, 6) FROM bu""",
)
def mf_biases(v: Views):
    return mf.mf_biases(cells(v)).withColumn("bias", r6("bias"))


@query(
    "rmse",
    f"""
    WITH {BIAS_SQL},
    p AS (SELECT rating, {CLIP.format(x="(SELECT mean FROM g) + bi.bias + bu.bias")} AS score
          FROM v_cells c JOIN bi ON c.movie_id = bi.movie_id JOIN bu ON c.user_id = bu.user_id)
    SELECT round(sqrt(avg((rating - score) * (rating - score))), 6) AS rmse, count(*) AS cells
    FROM p""",
)
def rmse(v: Views):
    known = cells(v)
    scored = mf.bias_predict(known, known.select("user_id", "movie_id"))
    return mf.rmse(scored, known).withColumn("rmse", r6("rmse"))


@query("mf_fit")
def mf_fit(v: Views):
    model = mf.mf_fit(cells(v))
    return model.users.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), "bias",
                              "features").unionByName(
        model.items.select(F.lit("movie").alias("kind"), F.col("movie_id").alias("id"), "bias",
                           "features")
    )


@query("mf_predict")
def mf_predict(v: Views):
    known = cells(v)
    return mf.mf_predict(mf.mf_fit(known), known.select("user_id", "movie_id"))


@query("mf_recommend")
def mf_recommend(v: Views):
    known = event_cells(v)
    return mf.mf_recommend(mf.mf_fit(known), known)


@query("mf_similar_items")
def mf_similar_items(v: Views):
    return mf.mf_similar_items(mf.mf_fit(cells(v)))


# factor tables given by the vectors: even ids are users, odd ids are movies
GIVEN_SQL = """
    u AS (SELECT CAST(vec_id AS VARCHAR) AS user_id, vec_id AS n, CAST(embedding AS DOUBLE[]) AS p,
                 label / 10.0::DOUBLE AS b FROM embeddings WHERE vec_id % 2 = 0),
    m AS (SELECT CAST(vec_id AS VARCHAR) AS movie_id, vec_id AS n, CAST(embedding AS DOUBLE[]) AS q,
                 label / 5.0::DOUBLE AS c FROM embeddings WHERE vec_id % 2 = 1),
    rated AS (SELECT u.user_id, m.movie_id FROM u JOIN m ON m.n = u.n + 1),
    scored AS (SELECT user_id, movie_id,
                      least(5.0::DOUBLE, greatest(0.0::DOUBLE,
                          2.0::DOUBLE + b + c + list_dot_product(p, q))) AS score FROM u, m)"""


def given_factors(v: Views) -> mf.Factors:
    vectors = v.vectors().withColumn("n", F.col("movie_id").cast("long"))
    label = F.col("genre").cast("double")
    users = vectors.where("n % 2 = 0").select(
        F.col("movie_id").alias("user_id"), F.col("vector").alias("features"),
        (label / 10.0).alias("bias"),
    )
    movies = vectors.where("n % 2 = 1").select(
        "movie_id", F.col("vector").alias("features"), (label / 5.0).alias("bias")
    )
    return mf.Factors(users, movies, v.spark.range(1).select(F.lit(2.0).alias("mean")))


def given_cells(v: Views):
    """Every user has rated the movie whose vector comes next."""
    model = given_factors(v)
    users = model.users.select(
        "user_id", (F.col("user_id").cast("long") + 1).cast("string").alias("movie_id")
    )
    return users.join(model.items.select("movie_id"), "movie_id", "left_semi").select(
        "user_id", "movie_id"
    )


@query(
    "mf_predict_given",
    f"""
    WITH {GIVEN_SQL}
    SELECT user_id, movie_id, round(score, 6) AS score FROM scored
    JOIN rated USING (user_id, movie_id)
    UNION ALL SELECT movie_id, user_id, 0.0::DOUBLE FROM rated""",
)
def mf_predict_given(v: Views):
    """Known pairs, and pairs of an unknown user and movie."""
    pairs = given_cells(v)
    swapped = pairs.select(F.col("movie_id").alias("user_id"), F.col("user_id").alias("movie_id"))
    out = mf.mf_predict(given_factors(v), pairs.unionByName(swapped))
    return out.withColumn("score", r6("score"))


@query(
    "mf_recommend_given",
    f"""
    WITH {GIVEN_SQL},
    open AS (SELECT s.* FROM scored s ANTI JOIN rated r
             ON s.user_id = r.user_id AND s.movie_id = r.movie_id),
    t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, movie_id)
                 AS rank FROM open WHERE score > 0)
    SELECT user_id, movie_id, round(score, 6) AS score, rank FROM t WHERE rank <= 10""",
)
def mf_recommend_given(v: Views):
    out = mf.mf_recommend(given_factors(v), given_cells(v))
    return out.select("user_id", "movie_id", r6("score"), F.col("rank").cast("bigint"))


@query(
    "mf_similar_items_given",
    f"""
    WITH {GIVEN_SQL},
    s AS (SELECT a.movie_id, b.movie_id AS similar_id,
                 list_dot_product(a.q, b.q)
                 / (sqrt(list_dot_product(a.q, a.q)) * sqrt(list_dot_product(b.q, b.q))) AS score
          FROM m a JOIN m b ON a.movie_id <> b.movie_id),
    t AS (SELECT *, row_number() OVER (PARTITION BY movie_id ORDER BY round(score, 9) DESC, similar_id)
                 AS rank FROM s)
    SELECT movie_id, similar_id, round(score, 6) AS score, rank FROM t WHERE rank <= 10""",
)
def mf_similar_items_given(v: Views):
    out = mf.mf_similar_items(given_factors(v))
    return out.select("movie_id", "similar_id", r6("score"), F.col("rank").cast("bigint"))
