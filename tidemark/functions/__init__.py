"""Column functions: each takes columns and returns a column."""

from tidemark.functions.dates import parse_date
from tidemark.functions.numbers import nan_to_null, ratio
from tidemark.functions.text import clean_text, tokens

__all__ = ["clean_text", "nan_to_null", "parse_date", "ratio", "tokens"]
