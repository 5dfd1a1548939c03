from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters kept by cleaning, and what counts as white space
# (Unicode white space and the four ASCII separators).
NOT_KEPT = r"(?U)[^a-zA-Z0-9\s\x1c-\x1f]+"
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"


def clean_text(c: str) -> Column:
    """Lower case; letters a-z, digits and white space only; NULL becomes empty text."""
    return F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), NOT_KEPT, "")


def tokens(cleaned: Column) -> Column:
    """Words of a cleaned text, in order; the first or last may be empty, and equals no word."""
    return F.split(cleaned, WHITE_SPACE)
