"""Date keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "yyyy/MM/dd", "dd.MM.yyyy"]


def parse_date(text: Column, formats: list[str] | None = None) -> Column:
    """First format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats or FORMATS])


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def iso_week(date: Column) -> Column:
    """YYYY-Www with the ISO year."""
    year = F.extract(F.lit("YEAROFWEEK"), date).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))
