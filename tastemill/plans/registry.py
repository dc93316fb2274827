"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tastemill.sources.views import Views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

# The views of tastemill.sources.views, in DuckDB's SQL.
VIEW_SQL: dict[str, str] = {
    "v_ratings": """
        SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS movie_id,
               CAST(l_quantity AS DOUBLE) / 8.0::DOUBLE AS rating, o_orderdate AS "timestamp",
               'rating' AS interaction_type
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_events": """
        SELECT CAST(event_id AS VARCHAR) AS interaction_id, CAST(user_id AS VARCHAR) AS user_id,
               regexp_extract(props, '([0-9]+)', 1) AS movie_id,
               CASE event_type WHEN 'purchase' THEN 'rating' WHEN 'view' THEN 'watch'
                    WHEN 'click' THEN 'click' WHEN 'signup' THEN 'save' ELSE 'share' END
                    AS interaction_type,
               CASE WHEN event_type = 'purchase'
                    THEN CAST(floor("value") AS DOUBLE) / 8.0::DOUBLE END AS rating,
               CASE WHEN event_type = 'view' THEN "value" END AS duration,
               ts AS "timestamp", props AS metadata
        FROM events""",
    "v_movies": """
        SELECT CAST(p_partkey AS VARCHAR) AS movie_id, p_name AS title,
               string_split(p_name, ' ') AS genres, 1950 + p_size AS release_year,
               (p_retailprice - 900.0::DOUBLE) / 10.0::DOUBLE AS imdb_rating,
               60 + 2 * p_size AS duration_minutes, p_type AS language, p_brand AS country,
               text AS description
        FROM part LEFT JOIN documents ON doc_id = p_partkey""",
    "v_users": """
        SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_mktsegment AS segment,
               CAST(c_nationkey AS VARCHAR) AS nation
        FROM customer""",
    "v_recs": """
        SELECT CAST(o_orderkey AS VARCHAR) AS recommendation_id,
               CAST(o_custkey AS VARCHAR) AS user_id,
               CAST(o_orderkey % (SELECT count(*) FROM part) AS VARCHAR) AS movie_id, o_orderpriority AS algorithm,
               o_totalprice / 100000.0::DOUBLE AS score, o_orderdate AS generated_at,
               CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate + INTERVAL 1 DAY END
                   AS served_at,
               o_orderstatus = 'F' AS clicked
        FROM orders""",
    "v_docs": """
        SELECT CAST(d.doc_id AS VARCHAR) AS movie_id, text AS description,
               [lang, source] AS genres, lang AS language, source AS country,
               CAST(n_chars AS DOUBLE) AS duration_minutes, CAST(quality AS DOUBLE) AS imdb_rating
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_vectors": """
        SELECT CAST(vec_id AS VARCHAR) AS movie_id, CAST(embedding AS DOUBLE[]) AS vec,
               CAST(label AS VARCHAR) AS genre
        FROM embeddings""",
    "v_requests": """
        SELECT CAST(event_id AS VARCHAR) AS request_id, CAST(user_id AS VARCHAR) AS client,
               ts AS "timestamp"
        FROM events""",
    # rated cells, one per user and movie, clipped to 0..5
    "v_cells": """
        SELECT user_id, movie_id, avg(least(5.0::DOUBLE, greatest(0.0::DOUBLE, rating))) AS rating
        FROM v_ratings GROUP BY user_id, movie_id
        HAVING avg(least(5.0::DOUBLE, greatest(0.0::DOUBLE, rating))) > 0""",
    "v_ecells": """
        SELECT user_id, movie_id, avg(least(5.0::DOUBLE, greatest(0.0::DOUBLE, rating))) AS rating
        FROM v_events WHERE rating IS NOT NULL GROUP BY user_id, movie_id
        HAVING avg(least(5.0::DOUBLE, greatest(0.0::DOUBLE, rating))) > 0""",
    # item universes: rated or listed
    "v_items": """
        SELECT movie_id FROM v_ratings UNION SELECT movie_id FROM v_movies""",
    "v_eitems": """
        SELECT movie_id FROM v_events UNION SELECT movie_id FROM v_movies""",
}


def _views_in(sql: str) -> list[str]:
    """Views a statement mentions, with those they build on, in definition order."""
    used = {v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)}
    while True:
        more = {
            v for v in VIEW_SQL for u in used if re.search(rf"\b{v}\b", VIEW_SQL[u])
        } - used
        if not more:
            return [v for v in VIEW_SQL if v in used]
        used |= more


def with_views(sql: str) -> str:
    """Put the definitions of the used views in front of a statement."""
    views = [f"{v} AS ({VIEW_SQL[v]})" for v in _views_in(sql)]
    if not views:
        return sql
    body = sql.strip()
    head = re.match(r"(?is)with\s+", body)
    if head:
        return "WITH " + ",\n".join(views) + ",\n" + body[head.end() :]
    return "WITH " + ",\n".join(views) + "\n" + body


def query(name: str, oracle: str | None = None):
    """Register ``fn(views) -> DataFrame`` under a name, with its SQL if there is one."""

    def add(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    from tastemill.plans import (  # noqa: F401
        asset_queries,
        catalog_queries,
        cleaning_queries,
        content_queries,
        feature_queries,
        hybrid_queries,
        neighbour_queries,
        table_queries,
    )
