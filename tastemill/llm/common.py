"""What several operators share: words, bindings inside expressions, stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.session import scratch_folder

SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Keeps Catalyst from copying an expensive expression into a lambda, where it
    would run once per element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared scratch folder and read it from there.

    Later readers neither recompute it nor depend on executors that held it, and
    the planner sees its real size.
    """
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder on the shared storage."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
