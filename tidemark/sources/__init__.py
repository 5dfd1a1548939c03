"""Readers and writers of price, text and panel files."""

from tidemark.sources.panel import numbered_panel, panel_files, read_panel, read_panel_dates, standardize, write_panel
from tidemark.sources.prices import missing_keys, price_files, read_prices, union_prices
from tidemark.sources.tweets import read_tweets

__all__ = [
    "missing_keys", "numbered_panel", "panel_files", "price_files", "read_panel", "read_panel_dates", "read_prices", "read_tweets",
    "standardize", "union_prices", "write_panel",
]
