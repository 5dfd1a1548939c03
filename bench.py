"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from tidemark.plans.queries import QUERIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = [
    "daily_mean", "densify", "ffill", "panel", "sma", "bollinger", "rsi", "ema_20", "signal_line", "obv", "stochastic_k",
    "volatility", "indicators_all", "supplier_indicators", "lexicon_score", "lexicon_negation", "daily_sentiment",
    "panel_driven", "tweet_driven", "benchmark_compare", "correlation_matrix", "return_histogram",
    "return_kde", "minmax_scale", "lookback", "feature_matrix", "ar_forecast", "ar_exog_forecast", "compare_forecast",
    "lookback_linear_forecast",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["daily_mean"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": pathlib.Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
