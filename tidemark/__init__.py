"""Daily market panels, indicators, text sentiment and short forecasts on Spark DataFrames."""

from tidemark.series import Series

__all__ = ["Series"]
