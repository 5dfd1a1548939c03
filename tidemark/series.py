"""How the series inside one DataFrame are named and cut into blocks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Series:
    """Many time series in one DataFrame, told apart by ``key`` and ordered by ``date``.

    A series has at most one row per (key, date): collapse ticks with ``daily_mean`` first.
    ``daily`` states that no day is missing between the first and last row of a key (what
    ``densify`` returns); row positions then come from the calendar without any shuffle.
    Work is split by (key, block of ``block_rows`` rows), so a long series never has to fit
    one task.
    """

    key: str = "Ticker"
    date: str = "Date"
    daily: bool = False
    block_rows: int = 4096

    def as_daily(self) -> "Series":
        return Series(self.key, self.date, True, self.block_rows)


SERIES = Series()
PANEL = Series(daily=True)
