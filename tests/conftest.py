import pathlib
import sys

import numpy as np
import pandas as pd
import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Invented daily prices: keys, first trading day, and days without trade at weekends.
KEYS = {"ALFA": "2019-12-31", "BETA": "2019-12-31", "^IDX": "2019-12-31", "LATE": "2020-12-10"}
LAST = "2020-12-31"


def invented_prices(key: str) -> pd.DataFrame:
    random = np.random.default_rng(sum(map(ord, key)))
    days = pd.bdate_range(KEYS[key], LAST)
    close = 80 * np.exp(random.normal(0.0004, 0.02, len(days)).cumsum())
    low, high = close * (1 - random.random(len(days)) / 50), close * (1 + random.random(len(days)) / 50)
    volume = random.integers(10**6, 9 * 10**9, len(days))
    columns = {"Date": days.strftime("%Y-%m-%d"), "Open": low, "High": high, "Low": low, "Close": close, "Adj Close": close, "Volume": volume}
    return pd.DataFrame(columns)


@pytest.fixture(scope="session")
def price_files():
    return {key: invented_prices(key) for key in KEYS}


@pytest.fixture(scope="session")
def price_folder(tmp_path_factory, price_files):
    folder = tmp_path_factory.mktemp("prices")
    for key, rows in price_files.items():
        rows.to_csv(folder / f"{key}.csv", index=False)
    return str(folder)


def dense_panel(price_files) -> pd.DataFrame:
    """All days of all keys but the late one, carried forward, with an invented sentiment on some days."""
    parts = []
    for key in ("ALFA", "BETA", "^IDX"):
        rows = price_files[key].assign(Date=lambda r: pd.to_datetime(r.Date)).set_index("Date")[["Close", "Volume"]]
        rows = rows.reindex(pd.date_range(KEYS[key], LAST)).ffill().astype(float)
        random = np.random.default_rng(len(key) + ord(key[0]))
        rows["sentiment"] = np.where(random.random(len(rows)) < 0.5, random.uniform(-1, 1, len(rows)).round(4), 0.0)
        parts.append(rows.rename_axis("Date").reset_index().assign(Ticker=key))
    return pd.concat(parts, ignore_index=True)[["Date", "Ticker", "Close", "Volume", "sentiment"]]


@pytest.fixture(scope="session")
def panel_frame(price_files):
    return dense_panel(price_files)


@pytest.fixture(scope="session")
def panel_folder(tmp_path_factory, panel_frame):
    """One file per key, as the panel is kept."""
    folder = tmp_path_factory.mktemp("panels")
    for key, rows in panel_frame.groupby("Ticker"):
        rows.assign(Date=rows.Date.dt.strftime("%Y-%m-%d")).to_csv(folder / f"{key.strip('^')}_processed.csv", index=False)
    return str(folder)
