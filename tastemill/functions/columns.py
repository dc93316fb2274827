"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values --------------------------------------------------------------
RATING_MIN, RATING_MAX = 0.0, 5.0
INTERACTION_TYPES = ("rating", "watch", "click", "save", "share")
PERIOD_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365, "all_time": None}
DEFAULT_PERIOD_DAYS = 30
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv")
TITLE_ID_PATTERN = r"(tt\d{7,8})"
NUMERIC_ID_PATTERN = r"(\d{3,})"
# ---------------------------------------------------------------------------

# letters, digits and underscore of any script; Java's \w is ASCII-only
WORD_CLASS = r"\p{L}\p{N}_"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_double(c: Column | str) -> Column:
    """Numeric value, or NULL when the text is not a number."""
    return as_column(c).cast("string").try_cast("double")


def coerce_int(c: Column | str) -> Column:
    """Whole number, or NULL; goes through double so ``1999.0`` is accepted."""
    return as_column(c).cast("string").try_cast("double").try_cast("int")


def clip(c: Column | str, low: float = RATING_MIN, high: float = RATING_MAX) -> Column:
    """Clip to a range. ``least``/``greatest`` skip NULLs, so NULL is guarded."""
    c = as_column(c)
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def clean_text(c: Column | str) -> Column:
    """Lower case, keep word characters, blanks and ``.,!?``, collapse blanks."""
    kept = F.regexp_replace(F.lower(as_column(c)), rf"(?U)[^{WORD_CLASS}\s.,!?]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def parse_genres(c: Column | str) -> Column:
    """``"[Drama, 'War']"`` or ``"Drama, War"`` to an array; NULL to empty."""
    bare = F.regexp_replace(as_column(c), r"^[\[\]]+|[\[\]]+$", "")
    parts = F.transform(
        F.split(bare, ","), lambda g: F.regexp_replace(F.trim(g), r"^['\"]+|['\"]+$", "")
    )
    return F.coalesce(parts, F.array().cast("array<string>"))


def movie_id_from_filename(c: Column | str) -> Column:
    """``tt`` id anywhere in the name, else 3+ digits before the first dot."""
    name = as_column(c)
    titled = F.regexp_extract(name, TITLE_ID_PATTERN, 1)
    numeric = F.regexp_extract(F.substring_index(name, ".", 1), NUMERIC_ID_PATTERN, 1)
    empty = F.lit("")
    return F.coalesce(F.nullif(titled, empty), F.nullif(numeric, empty))


def file_extension(name: Column | str) -> Column:
    """Lower-case suffix with its dot; a name that only starts with a dot has none."""
    suffix = F.regexp_extract(as_column(name), r"^.*[^.].*?(\.[^.]*)$|^[^.]+(\.[^.]*)$", 0)
    found = F.regexp_extract(suffix, r"(\.[^.]*)$", 1)
    return F.lower(found)


def tokens(c: Column | str) -> Column:
    """Words of two characters and more."""
    return F.regexp_extract_all(F.lower(as_column(c)), F.lit(rf"[{WORD_CLASS}]{{2,}}"), F.lit(0))


def bigrams(words: Column) -> Column:
    """Neighbouring word pairs of an array of words."""
    n = F.size(words)
    pairs = F.zip_with(
        F.slice(words, F.lit(1), n - 1),
        F.slice(words, F.lit(2), n - 1),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def rank_score(c: Column | str) -> Column:
    """Scores are compared at nine decimals so summation order cannot break ties."""
    return F.round(as_column(c), 9)
