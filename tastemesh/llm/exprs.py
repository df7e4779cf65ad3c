"""Column helpers of the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, evaluated once however often ``use`` names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def positions(first: int, count: Column) -> Column:
    """``first .. first + count - 1``; empty where ``count`` is 0 or less."""
    return F.when(count > 0, F.sequence(F.lit(first), count + (first - 1))).otherwise(F.array().cast("array<int>"))
