"""External movie ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_id(col: Column | str) -> Column:
    """Trim an external id and drop every literal ``.0``; unusable ids become NULL.

    ``' 862.0 '`` and ``'862'`` both give ``'862'``; ``''`` and ``'nan'`` give NULL.
    """
    c = F.col(col) if isinstance(col, str) else col
    cleaned = F.replace(F.trim(c.cast("string")), F.lit(".0"), F.lit(""))
    return F.when(~cleaned.isin("", "nan"), cleaned)


def pad_imdb_id(col: Column | str) -> Column:
    """``114709`` and ``tt0114709`` -> ``tt0114709``; longer ids stay whole; missing -> ``''``."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.coalesce(c.cast("string"), F.lit(""))
    digits = F.ltrim(text, F.lit("t"))
    # lpad cuts what is longer than the target, so it is used for short ids only.
    padded = F.when(F.length(digits) >= 7, digits).otherwise(F.lpad(digits, 7, "0"))
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("tt"), padded))
