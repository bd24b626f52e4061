"""Date helpers: epidemiological (MMWR) weeks, horizons, end dates.

Epi weeks start on Sunday; a week belongs to the year that holds its
Wednesday, and week 1 is the week holding the year's first Wednesday.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epi_wednesday(d) -> Column:
    """Wednesday of the Sunday-started week that holds ``d``.

    ``dayofweek`` is 1 for Sunday, so Sunday moves +3 days and Saturday -3.
    """
    d = _col(d)
    return F.date_add(d, F.lit(4) - F.dayofweek(d))


def epi_year(d) -> Column:
    return F.year(epi_wednesday(d))


def epi_week(d) -> Column:
    return (F.floor((F.dayofyear(epi_wednesday(d)) - 1) / 7) + 1).cast("int")


def epi_week_end(d) -> Column:
    """Saturday that closes the epi week of ``d``."""
    d = _col(d)
    return F.date_add(d, F.lit(7) - F.dayofweek(d))


def parse_horizon(h) -> Column:
    """``"12 wk"`` -> 12 (first run of digits)."""
    return F.regexp_extract(_col(h), r"(\d+)", 1).cast("int")


def horizon_end_date(origin, horizon) -> Column:
    """``origin + 7*horizon - 1`` days: the Saturday closing week ``horizon``."""
    return F.date_add(_col(origin), _col(horizon) * 7 - 1)


def weeks_between(later, earlier) -> Column:
    """Whole-week difference ``(later - earlier) / 7`` as an int."""
    return (F.datediff(_col(later), _col(earlier)) / 7).cast("int")
