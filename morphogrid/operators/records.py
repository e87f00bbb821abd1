"""Attributes of submitted records: flags and dates in several spellings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spellings of flags that occur.
TRUE = ("True", "true", "T", "t", "TRUE", "1")
FALSE = ("False", "false", "F", "f", "FALSE", "0")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "yyyy-MM", "yyyy")


def flag(text: Column) -> Column:
    """A flag as a boolean; other spellings are unknown."""
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed.isin(*TRUE), True).when(trimmed.isin(*FALSE), False)


def passed(flags: Sequence[Column]) -> Column:
    """All flags hold: false where one is false, else unknown where one is; unknown without flags."""
    out = F.lit(None).cast("boolean") if not flags else flag(flags[0])
    for other in flags[1:]:
        out = out & flag(other)
    return out


def date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """A date in the first of the formats that reads it; NULL where none does."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in formats]).cast("date")
