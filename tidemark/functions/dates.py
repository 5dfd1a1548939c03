from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two date formats of the input files.
ISO = "yyyy-MM-dd"
DAY_FIRST = "d/M/yyyy"


def parse_date(c: str, dayfirst: bool = False) -> Column:
    """Text to date; text in no known format becomes NULL. ISO text is read in both modes."""
    column = F.col(c)
    iso = F.try_to_date(column, ISO)
    if not dayfirst:
        return iso
    return F.coalesce(F.try_to_date(column, DAY_FIRST), iso)
