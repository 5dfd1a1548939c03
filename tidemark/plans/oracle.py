"""The same results as plain SQL for a single-node engine, one statement per query."""

from __future__ import annotations

from tidemark.operators.sentiment import NEGATIONS, STRONGER, WEAKER, WORDS
from tidemark.plans.queries import CORRELATED, LEVELS, PLACES

# -- common tables ----------------------------------------------------------------------------


def values(rows: list[str]) -> str:
    return "VALUES " + ", ".join(rows)


def words(items: list[str]) -> str:
    return ", ".join(f"'{item}'" for item in items)


FULL = "PARTITION BY k ORDER BY d"


def frame(n: int) -> str:
    return f"OVER ({FULL} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolled(function: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {frame(n)} = {n} THEN {function}({c}) {frame(n)} END"


def ewm(c: str, span: int) -> str:
    q = f"{1 - 2 / (span + 1)!r}"
    return f"list_reduce({c}, lambda a, x: {q} * a + (1 - {q}) * x)"


KEY_CASE = (
    "CASE doc_id % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' "
    "WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END"
)

TABLES: dict[str, str] = {
    "ticks": "SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS k, o_totalprice AS c, 1 AS v FROM orders",
    "prices": "SELECT d, k, avg(c) AS c, CAST(sum(v) AS DOUBLE) AS v FROM ticks GROUP BY d, k",
    "days": "SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM ticks",
    "grid": "SELECT days.d, keys.k, p.c, p.v FROM days CROSS JOIN (SELECT DISTINCT k FROM ticks) AS keys "
    "LEFT JOIN prices AS p ON p.d = days.d AND p.k = keys.k",
    "dense": f"SELECT d, k, last_value(c IGNORE NULLS) OVER ({FULL} ROWS UNBOUNDED PRECEDING) AS c, "
    f"last_value(v IGNORE NULLS) OVER ({FULL} ROWS UNBOUNDED PRECEDING) AS v FROM grid",
    "panel": "SELECT d, k, coalesce(c, (SELECT quantile_disc(c, 0.5) FROM dense)) AS c, coalesce(v, 0) AS v FROM dense",
    "tweets": f"SELECT doc_id, DATE '1995-01-01' + CAST((doc_id // 15) % 2405 AS INTEGER) AS d, {KEY_CASE} AS k, text FROM documents",
    "cleaned": r"SELECT doc_id, d, k, regexp_replace(lower(coalesce(text, '')), '[^a-zA-Z0-9\s]', '', 'g') AS t FROM tweets",
    "lexicon": "SELECT * FROM (" + values([f"('{w}', {s!r}::DOUBLE)" for w, s in WORDS.items()]) + ") AS l(token, valence)",
    "listed": r"SELECT doc_id, list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '') AS ws FROM cleaned",
    "tokens": "SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS nth FROM listed",
    "totals": "SELECT doc_id, sum(valence) AS s FROM tokens JOIN lexicon USING (token) GROUP BY doc_id",
    "scored": "SELECT doc_id, d, k, coalesce(round(s / sqrt(s * s + 15), 4), 0) AS score FROM tweets LEFT JOIN totals USING (doc_id)",
    "spoken": "SELECT d, k, avg(score) AS s FROM scored GROUP BY d, k",
    "full_panel": "SELECT d, k, c, v, coalesce(s, 0) AS s FROM panel LEFT JOIN spoken USING (d, k)",
    "steps": f"SELECT *, c - lag(c) OVER ({FULL}) AS dc, c / nullif(lag(c) OVER ({FULL}), 0) - 1 AS r, row_number() OVER ({FULL}) AS i FROM full_panel",
    "plain": f"""SELECT *, {rolled('avg', 'c', 20)} AS sma20, {rolled('avg', 'c', 50)} AS sma50, {rolled('stddev_samp', 'c', 20)} AS sd20,
        {rolled('min', 'c', 14)} AS lo14, {rolled('max', 'c', 14)} AS hi14,
        CASE WHEN i >= 14 THEN avg(greatest(coalesce(dc, 0), 0)) {frame(14)} END AS gain,
        CASE WHEN i >= 14 THEN avg(greatest(coalesce(-dc, 0), 0)) {frame(14)} END AS loss,
        {rolled('avg', 'dc', 14)} AS atr, {rolled('stddev_samp', 'r', 20)} * sqrt(252) AS vol, {rolled('avg', 'v', 20)} AS vma,
        sum(coalesce(sign(dc) * v, 0)) OVER ({FULL} ROWS UNBOUNDED PRECEDING) AS obv,
        {rolled('avg', 's', 7)} AS s7, {rolled('avg', 's', 14)} AS s14 FROM steps""",
    "indicators": f"""SELECT *, 100 * gain / nullif(gain + loss, 0) AS rsi, 100 * (c - lo14) / nullif(hi14 - lo14, 0) AS k14,
        v / nullif(vma, 0) AS vr, lag(s7, 7) OVER ({FULL}) AS s7l, lag(s14, 14) OVER ({FULL}) AS s14l FROM plain""",
    "histories": f"SELECT d, k, list(c) OVER ({FULL} ROWS UNBOUNDED PRECEDING) AS cs FROM panel",
    "averages": f"SELECT d, k, {ewm('cs', 20)} AS e20, {ewm('cs', 12)} - {ewm('cs', 26)} AS macd FROM histories",
    "macds": f"SELECT d, k, e20, macd, list(macd) OVER ({FULL} ROWS UNBOUNDED PRECEDING) AS ms FROM averages",
    "means": f"SELECT d, k, e20, macd, {ewm('ms', 9)} AS signal FROM macds",
    "market": "SELECT d, avg(c) AS c FROM ticks GROUP BY d",
    "market_dense": "SELECT days.d, last_value(m.c IGNORE NULLS) OVER (ORDER BY days.d ROWS UNBOUNDED PRECEDING) AS b FROM days LEFT JOIN market AS m ON m.d = days.d",
    "known_returns": "SELECT k, r AS x FROM steps WHERE r IS NOT NULL",
}

TRADED = "SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS k, avg(o_totalprice) AS c, avg(o_custkey % 100 + 1) AS v FROM orders GROUP BY 1, 2"

USES = {
    "prices": ["ticks"], "days": ["ticks"], "grid": ["days", "prices"], "dense": ["grid"], "panel": ["dense"],
    "cleaned": ["tweets"], "listed": ["cleaned"], "tokens": ["listed"], "totals": ["tokens", "lexicon"],
    "scored": ["tweets", "totals"], "spoken": ["scored"], "full_panel": ["panel", "spoken"], "steps": ["full_panel"],
    "plain": ["steps"], "indicators": ["plain"], "histories": ["panel"], "averages": ["histories"],
    "macds": ["averages"], "means": ["macds"], "market": ["ticks"], "market_dense": ["days", "market"],
    "known_returns": ["steps"],
}


def with_tables(needed: list[str], body: str, extra: dict[str, str] | None = None, instead: dict[str, str] | None = None) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for other in USES.get(name, []):
            visit(other)
        if name not in order:
            order.append(name)

    for name in needed:
        visit(name)
    parts = [f"{name} AS MATERIALIZED ({(instead or {}).get(name, TABLES[name])})" for name in order]
    parts += [f"{name} AS MATERIALIZED ({sql})" for name, sql in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def shaped(name: str, expression: str) -> str:
    if name in LEVELS:
        return f"CAST(round(CAST(({expression}) AS DECIMAL(28, 6)), 4) AS DOUBLE) AS {name}"
    if name in PLACES:
        return f"round({expression}, {PLACES[name]}) AS {name}"
    return f"{expression} AS {name}"


def panel_rows(source: str, columns: dict[str, str], extra: str = "") -> str:
    picked = ", ".join(shaped(name, expression) for name, expression in columns.items())
    return f"SELECT CAST(d AS VARCHAR) AS \"Date\", k AS \"Ticker\", {picked} FROM {source} {extra}"


PLAIN = {
    "SMA_20": "sma20", "SMA_50": "sma50", "BB_middle": "sma20", "BB_upper": "sma20 + 2 * sd20", "BB_lower": "sma20 - 2 * sd20",
    "RSI": "rsi", "ATR": "atr", "OBV": "obv", "Stochastic_K": "k14", "Daily_Return": "r", "Volatility": "vol",
    "Volume_MA": "vma", "Volume_Ratio": "vr", "Sentiment_7D_Rolling": "s7", "Sentiment_14D_Rolling": "s14",
    "Sentiment_7D_Lagged": "s7l", "Sentiment_14D_Lagged": "s14l", "Close_std_20": "sd20", "Close_min_14": "lo14", "Close_max_14": "hi14",
}
EXPONENTIAL = {"EMA_20": "e20", "MACD": "macd", "Signal_Line": "signal"}
PRICE = {"Close": "c", "Volume": "v"}


def plain(*names: str) -> str:
    return with_tables(["indicators"], panel_rows("indicators", {n: PLAIN[n] for n in names}))


def exponential(*names: str) -> str:
    return with_tables(["means"], panel_rows("means", {n: EXPONENTIAL[n] for n in names}))


def everything(names: list[str], wrap: str = "{}") -> dict[str, str]:
    both = {**PRICE, "sentiment": "s", **PLAIN, **EXPONENTIAL}
    return {n: wrap.format(both[n]) for n in names}


# -- statistics -------------------------------------------------------------------------------


def correlations(by: bool) -> str:
    columns = dict(zip(CORRELATED, ["c", "v", "sma20", "sma50", "s"]))
    parts = []
    for a, x in columns.items():
        for b, y in columns.items():
            r = f"CASE WHEN isnan(corr({x}, {y})) THEN NULL ELSE corr({x}, {y}) END"
            key, group = ("k AS \"Ticker\", ", " GROUP BY k") if by else ("", "")
            parts.append(f"SELECT {key}'{a}' AS a, '{b}' AS b, {shaped('r', r)} FROM indicators{group}")
    return with_tables(["indicators"], " UNION ALL ".join(parts))


HISTOGRAM = with_tables(
    ["known_returns"],
    f"""SELECT CAST(e.bin AS BIGINT) AS bin, {shaped('left', 'lo + e.bin * w')}, {shaped('right', 'lo + (e.bin + 1) * w')}, coalesce(n, 0) AS count
    FROM (SELECT lo, w, unnest(generate_series(0, bins - 1)) AS bin FROM sized) AS e LEFT JOIN counted USING (bin)""",
    {
        "stats": "SELECT count(x) AS n, min(x) AS lo, max(x) - min(x) AS width, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM known_returns",
        "sized": """SELECT lo, bins, width / bins AS w FROM (SELECT *, CAST(ceil(width / CASE WHEN iqr > 0
            THEN least(width / (log2(n) + 1), greatest(2 * iqr / cbrt(n), width / (2 * sqrt(n)))) ELSE width / (log2(n) + 1) END) AS BIGINT) AS bins FROM stats)""",
        "counted": "SELECT CAST(least(floor((x - lo) / w), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM known_returns CROSS JOIN sized GROUP BY 1",
    },
)

HISTOGRAM_BY_KEY = with_tables(
    ["known_returns"],
    f"""SELECT e.k AS "Ticker", CAST(e.bin AS BIGINT) AS bin, {shaped('left', 'lo + e.bin * w')}, {shaped('right', 'lo + (e.bin + 1) * w')}, coalesce(n, 0) AS count
    FROM (SELECT k, lo, w, unnest(generate_series(0, 39)) AS bin FROM sized) AS e LEFT JOIN counted ON counted.k = e.k AND counted.bin = e.bin""",
    {
        "sized": "SELECT k, min(x) AS lo, (max(x) - min(x)) / 40 AS w FROM known_returns GROUP BY k",
        "counted": "SELECT k, CAST(least(floor((x - lo) / w), 39) AS BIGINT) AS bin, count(*) AS n FROM known_returns JOIN sized USING (k) GROUP BY 1, 2",
    },
)

KDE = with_tables(
    ["known_returns"],
    f"""SELECT CAST(point AS BIGINT) AS point, {shaped('x', 'g')}, {shaped('density', 'sum(exp(-0.5 * ((g - y) / h) ** 2)) / sqrt(2 * pi()) / max(n * h)')}
    FROM (SELECT point, lo - 3 * h + point * (hi - lo + 6 * h) / 199 AS g, h, n FROM setup CROSS JOIN (SELECT unnest(generate_series(0, 199)) AS point))
    CROSS JOIN (SELECT x AS y FROM known_returns) GROUP BY point, g""",
    {"setup": "SELECT count(x) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(x), -0.2) AS h FROM known_returns"},
)

HISTOGRAM_AUTO_BY_KEY = with_tables(
    ["known_returns"],
    f"""SELECT e.k AS "Ticker", CAST(e.bin AS BIGINT) AS bin, {shaped('left', 'lo + e.bin * w')}, {shaped('right', 'lo + (e.bin + 1) * w')}, coalesce(n, 0) AS count
    FROM (SELECT k, lo, w, unnest(generate_series(0, bins - 1)) AS bin FROM sized) AS e LEFT JOIN counted ON counted.k = e.k AND counted.bin = e.bin""",
    {
        "stats": "SELECT k, count(x) AS n, min(x) AS lo, max(x) - min(x) AS width, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM known_returns GROUP BY k",
        "sized": """SELECT k, lo, bins, width / bins AS w FROM (SELECT *, CAST(ceil(width / CASE WHEN iqr > 0
            THEN least(width / (log2(n) + 1), greatest(2 * iqr / cbrt(n), width / (2 * sqrt(n)))) ELSE width / (log2(n) + 1) END) AS BIGINT) AS bins FROM stats)""",
        "counted": "SELECT k, CAST(least(floor((x - lo) / w), bins - 1) AS BIGINT) AS bin, count(*) AS n FROM known_returns JOIN sized USING (k) GROUP BY 1, 2",
    },
)

KDE_BY_KEY = with_tables(
    ["known_returns"],
    f"""SELECT k AS "Ticker", CAST(point AS BIGINT) AS point, {shaped('x', 'g')}, {shaped('density', 'density')}, {shaped('count_scaled', 'density * n * width / 40')}
    FROM (SELECT k, point, g, any_value(n) AS n, any_value(hi - lo) AS width, sum(exp(-0.5 * ((g - y) / h) ** 2)) / sqrt(2 * pi()) / max(n * h) AS density
        FROM (SELECT k, point, lo + point * (hi - lo) / 199 AS g, h, n, lo, hi FROM setup CROSS JOIN (SELECT unnest(generate_series(0, 199)) AS point))
        JOIN (SELECT k, x AS y FROM known_returns) USING (k) GROUP BY k, point, g)""",
    {"setup": "SELECT k, count(x) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(x), -0.2) AS h FROM known_returns GROUP BY k"},
)

# -- text -------------------------------------------------------------------------------------

NEGATED = with_tables(
    ["tokens", "lexicon", "tweets"],
    f"""SELECT doc_id, {shaped('sentiment', 'coalesce(round(s / sqrt(s * s + 15), 4), 0)')} FROM tweets LEFT JOIN (
        SELECT doc_id, sum(CASE WHEN negated THEN (valence + sign(valence) * boost) * -0.74 ELSE valence + sign(valence) * boost END * side) AS s
        FROM weighed JOIN lexicon USING (token) GROUP BY doc_id) USING (doc_id)""",
    {
        "context": """SELECT doc_id, token, nth, lag(token, 1) OVER w AS b1, lag(token, 2) OVER w AS b2, lag(token, 3) OVER w AS b3,
            min(CASE WHEN token = 'but' THEN nth END) OVER (PARTITION BY doc_id) AS but FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY nth)""",
        "weighed": "SELECT doc_id, token, "
        + " + ".join(
            f"CASE WHEN {b} IN ({words(STRONGER)}) THEN {0.293 * fade!r} WHEN {b} IN ({words(WEAKER)}) THEN -{0.293 * fade!r} ELSE 0.0::DOUBLE END"
            for b, fade in (("b1", 1.0), ("b2", 0.95), ("b3", 0.9))
        )
        + " AS boost, "
        + " OR ".join(f"coalesce({b} IN ({words(NEGATIONS)}), false)" for b in ("b1", "b2", "b3"))
        + " AS negated, CASE WHEN nth < but THEN 0.5 WHEN nth > but THEN 1.5 ELSE 1.0 END::DOUBLE AS side FROM context",
    },
)

# -- forecasts --------------------------------------------------------------------------------


def autoregression(source: str) -> dict[str, str]:
    return {
        "moves": f"SELECT d, k, c, c - lag(c) OVER ({FULL}) AS dc FROM {source}",
        "pairs": f"SELECT *, lag(dc) OVER ({FULL}) AS before FROM moves",
        "fits": """SELECT k, CASE WHEN isnan(regr_slope(dc, before)) THEN NULL ELSE regr_slope(dc, before) END AS b,
            regr_intercept(dc, before) AS a, arg_max(dc, d) AS dl, arg_max(c, d) AS cl, max(d) AS last FROM pairs GROUP BY k""",
        "ahead": """SELECT k, CAST(last + CAST(h AS INTEGER) AS DATE) AS d, CAST(h AS BIGINT) AS step,
            cl + h * a / (1 - b) + (dl - a / (1 - b)) * b * (1 - pow(b, h)) / (1 - b) AS forecast
            FROM fits CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS h)""",
    }


GAPPY = {
    "gappy": """SELECT CAST(o_orderdate AS DATE) AS d, o_orderpriority AS k, avg(o_custkey % 100 + 1) AS v,
        avg(CASE WHEN o_orderkey % 3 > 0 AND year(o_orderdate) > 1996 THEN o_totalprice END) AS c FROM orders GROUP BY 1, 2""",
    "gappy_carried": f"SELECT d, k, v, last_value(c IGNORE NULLS) OVER ({FULL} ROWS UNBOUNDED PRECEDING) AS c FROM gappy",
    "gappy_observed": "SELECT d, k, v, coalesce(c, (SELECT quantile_disc(c, 0.5) FROM gappy_carried)) AS c FROM gappy_carried",
    "gappy_grid": """SELECT days.d, keys.k, g.c, g.v FROM days CROSS JOIN (SELECT DISTINCT k FROM gappy) AS keys
        LEFT JOIN gappy_observed AS g ON g.d = days.d AND g.k = keys.k""",
    "gappy_dense": TABLES["dense"].replace("FROM grid", "FROM gappy_grid"),
    "gappy_panel": "SELECT d, k, coalesce(c, (SELECT quantile_disc(c, 0.5) FROM gappy_dense)) AS c, coalesce(v, 0) AS v FROM gappy_dense",
}
SCALED = {c: f"coalesce(({c} - min({c}) OVER (PARTITION BY k)) / nullif(max({c}) OVER (PARTITION BY k) - min({c}) OVER (PARTITION BY k), 0), 0)" for c in ("c", "v")}
CUMULATIVE = "c / first_value(c) OVER (PARTITION BY k ORDER BY d) - 1"
BENCHMARK_CUMULATIVE = "b / first_value(b) OVER (PARTITION BY k ORDER BY d) - 1"

SUPPLIER = {
    "prices": 'SELECT CAST(l_shipdate AS DATE) AS d, CAST(l_suppkey AS VARCHAR) AS k, avg(l_extendedprice) AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2',
    "days": "SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM prices",
    "grid": "SELECT days.d, keys.k, p.c, p.v FROM days CROSS JOIN (SELECT DISTINCT k FROM prices) AS keys LEFT JOIN prices AS p ON p.d = days.d AND p.k = keys.k",
    "dense": TABLES["dense"],
    "moves": f"SELECT *, c - lag(c) OVER ({FULL}) AS dc, row_number() OVER ({FULL}) AS i FROM dense",
}
WINDOWED = {
    "SMA_20": rolled("avg", "c", 20),
    "SMA_50": rolled("avg", "c", 50),
    "RSI": f"CASE WHEN i >= 14 THEN 100 * avg(greatest(coalesce(dc, 0), 0)) {frame(14)} / nullif(avg(greatest(coalesce(dc, 0), 0)) {frame(14)} + avg(greatest(coalesce(-dc, 0), 0)) {frame(14)}, 0) END",
    "ATR": rolled("avg", "dc", 14),
    "OBV": f"sum(coalesce(sign(dc) * v, 0)) OVER ({FULL} ROWS UNBOUNDED PRECEDING)",
    "Stochastic_K": f"100 * (c - {rolled('min', 'c', 14)}) / nullif({rolled('max', 'c', 14)} - {rolled('min', 'c', 14)}, 0)",
}
EVENT = {
    **SUPPLIER,
    "prices": "SELECT CAST(ts AS DATE) AS d, event_type AS k, avg(value) AS c, 1.0 AS v FROM events GROUP BY 1, 2",
}

ALL_NAMES = [
    "Close", "Volume", "sentiment", "SMA_20", "SMA_50", "EMA_20", "BB_middle", "BB_upper", "BB_lower", "RSI", "MACD",
    "Signal_Line", "ATR", "OBV", "Stochastic_K", "Daily_Return", "Volatility", "Volume_MA", "Volume_Ratio",
    "Sentiment_7D_Rolling", "Sentiment_14D_Rolling", "Sentiment_7D_Lagged", "Sentiment_14D_Lagged",
]
FEATURES = ["SMA_20", "SMA_50", "EMA_20", "RSI", "MACD", "ATR", "Stochastic_K", "OBV"]



def eliminated(tables: dict[str, str], before: str, size: int) -> str:
    """Add one table per input that eliminates it from ``before`` (k, r, c, v); the last one's name."""
    for p in range(size):
        tables[f"step{p}"] = f"""SELECT a.k, a.r, a.c, CASE WHEN a.r = {p} THEN a.v / pp.v ELSE a.v - rp.v * pc.v / pp.v END AS v FROM {before} AS a
            JOIN {before} AS pp ON pp.k = a.k AND pp.r = {p} AND pp.c = {p} JOIN {before} AS rp ON rp.k = a.k AND rp.r = a.r AND rp.c = {p}
            JOIN {before} AS pc ON pc.k = a.k AND pc.r = {p} AND pc.c = a.c"""
        before = f"step{p}"
    return before


def short_lookback(length: int, steps: int) -> str:
    """Least squares of the scaled price on price and volume of the days before, over all keys, rolled forward."""
    size = 2 * length
    lags = ", ".join(f"lag({c}, {length - i}) OVER ({FULL}) AS x{2 * i + j}" for i in range(length) for j, c in enumerate(("sc", "sv")))
    cells = ", ".join(f"{{'r': {r}, 'c': {c}, 'v': covar_pop(x{r}, x{c})}}" for r in range(size) for c in range(size + 1))
    means = ", ".join(f"{{'c': {c}, 'm': avg(x{c})}}" for c in range(size + 1))
    tables = {
        "limits": "SELECT k, min(c) AS c0, max(c) AS c1, min(v) AS v0, max(v) AS v1 FROM panel GROUP BY k",
        "scaled": "SELECT d, k, coalesce((c - c0) / nullif(c1 - c0, 0), 0) AS sc, coalesce((v - v0) / nullif(v1 - v0, 0), 0) AS sv FROM panel JOIN limits USING (k)",
        "inputs": f"SELECT *, sc AS x{size} FROM (SELECT *, {lags} FROM scaled) WHERE x0 IS NOT NULL",
        "cells": f"SELECT 1 AS k, unnest([{cells}], recursive := true) FROM inputs",
        "centres": f"SELECT unnest([{means}], recursive := true) FROM inputs",
    }
    last = eliminated(tables, "cells", size)
    tables["weights"] = f"SELECT list(v ORDER BY r) AS w FROM {last} WHERE c = {size}"
    tables["model"] = f"SELECT w, (SELECT sum(CASE WHEN c = {size} THEN m ELSE -w[c + 1] * m END) FROM centres) AS a FROM weights"
    ends = ", ".join(f"max(CASE WHEN n = {length - i} THEN sc END) AS c{i}, max(CASE WHEN n = {length - i} THEN sv END) AS v{i}" for i in range(length))
    tables["roll0"] = f"SELECT k, max(d) AS d, {ends} FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS n FROM scaled) WHERE n <= {length} GROUP BY k"
    for s in range(steps):
        term = " + ".join(f"w[{2 * i + 1}] * c{s + i} + w[{2 * i + 2}] * v{min(s + i, length - 1)}" for i in range(length))
        tables[f"roll{s + 1}"] = f"SELECT r.*, a + {term} AS c{s + length} FROM roll{s} AS r, model"
    paths = ", ".join(f"{{'step': {s + 1}, 'p': c{s + length}}}" for s in range(steps))
    tables["ahead"] = f"""SELECT k, CAST(d + CAST(step AS INTEGER) AS DATE) AS d, CAST(step AS BIGINT) AS step, p * (c1 - c0) + c0 AS forecast
        FROM (SELECT k, d, unnest([{paths}], recursive := true) FROM roll{steps}) JOIN limits USING (k)"""
    return with_tables(["panel"], panel_rows("ahead", {"step": "step", "forecast": "forecast"}), tables)


def over_gaps() -> str:
    """Exponential indicators of a grid with NULL prices: a recursion over the known days, repeated over the others."""
    tables = {"placed": f"SELECT *, row_number() OVER ({FULL}) AS p FROM grid"}
    joined = "placed"
    for span in (12, 20, 26):
        q = f"{1 - 2 / (span + 1)!r}"
        a = f"(pow({q}, x.p - s.p) / (pow({q}, x.p - s.p) + (1 - {q})))"
        fold = f"list_reduce(xs, lambda s, x: {{'p': x.p, 'c': {a} * s.c + (1 - {a}) * x.c}}).c"
        tables[f"e{span}"] = f"SELECT d, k, {fold} AS e{span} FROM (SELECT d, k, list({{'p': p, 'c': c}}) OVER ({FULL} ROWS UNBOUNDED PRECEDING) AS xs FROM placed WHERE c IS NOT NULL)"
        joined += f" LEFT JOIN e{span} USING (d, k)"
    held = ", ".join(f"last_value(e{span} IGNORE NULLS) OVER ({FULL} ROWS UNBOUNDED PRECEDING) AS e{span}" for span in (12, 20, 26))
    tables["held"] = f"SELECT d, k, {held} FROM {joined}"
    tables["lines"] = f"SELECT *, e12 - e26 AS macd, list(e12 - e26) FILTER (e12 IS NOT NULL) OVER ({FULL} ROWS UNBOUNDED PRECEDING) AS ms FROM held"
    return with_tables(["grid"], panel_rows("lines", {"EMA_20": "e20", "MACD": "macd", "Signal_Line": ewm("ms", 9)}), tables)


def exogenous() -> str:
    """Autoregression of the changes with the model's inputs: normal equations by elimination, one step per input."""
    names = ["before", *[everything(FEATURES)[f] for f in FEATURES], "dc"]
    size = len(names) - 1
    cells = ", ".join(f"{{'r': {r}, 'c': {c}, 'v': covar_pop(x{r}, x{c})}}" for r in range(size) for c in range(size + 1))
    means_of = ", ".join(f"{{'c': {c}, 'm': avg(x{c})}}" for c in range(size + 1))
    tables = {
        "joined": f"SELECT *, lag(dc) OVER ({FULL}) AS before FROM indicators JOIN means USING (d, k)",
        "inputs": "SELECT d, k, c, " + ", ".join(f"{n if n in ('before', 'dc') else f'coalesce({n}, 0)'} AS x{i}" for i, n in enumerate(names)) + " FROM joined",
        "cells": f"SELECT k, unnest([{cells}], recursive := true) FROM inputs WHERE x0 IS NOT NULL GROUP BY k",
        "centres": f"SELECT k, unnest([{means_of}], recursive := true) FROM inputs WHERE x0 IS NOT NULL GROUP BY k",
    }
    before = eliminated(tables, "cells", size)
    tables["weights"] = f"SELECT k, list(v ORDER BY r) AS w FROM {before} WHERE c = {size} GROUP BY k"
    tables["drifts"] = f"""SELECT k, w, sum(CASE WHEN c = {size} THEN m ELSE -w[c + 1] * m END) AS a FROM weights JOIN centres USING (k) GROUP BY k, w"""
    tables["newest"] = f"SELECT *, 8 - row_number() OVER (PARTITION BY k ORDER BY d DESC) AS h FROM inputs QUALIFY h >= 1"
    effect = " + ".join(f"w[{i + 1}] * x{i}" for i in range(1, size))
    tables["effects"] = f"SELECT k, h, a + {effect} AS e, w[1] AS b FROM newest JOIN drifts USING (k)"
    tables["ends"] = f"SELECT k, max(d) AS last, arg_max(c, d) AS cl, arg_max(x{size}, d) AS dl FROM inputs GROUP BY k"
    change = "list_reduce(list_prepend({'e': dl, 'b': 0.0::DOUBLE, 't': 0.0::DOUBLE}, es), lambda s, f: {'e': f.e + f.b * s.e, 'b': 0.0::DOUBLE, 't': s.t + f.e + f.b * s.e}).t"
    tables["paths"] = f"""SELECT k, last, cl, h, {change} AS total FROM ends JOIN
        (SELECT k, h, list({{'e': e, 'b': b, 't': 0.0::DOUBLE}}) OVER (PARTITION BY k ORDER BY h ROWS UNBOUNDED PRECEDING) AS es FROM effects) USING (k)"""
    tables["exogenous"] = "SELECT k, CAST(last + CAST(h AS INTEGER) AS DATE) AS d, CAST(h AS BIGINT) AS step, cl + total AS forecast FROM paths"
    return with_tables(["indicators", "means"], panel_rows("exogenous", {"step": "step", "forecast": "forecast"}), tables)


LISTED = with_tables(
    ["prices", "days"],
    panel_rows("filled", {"Close": "coalesce(c, (SELECT quantile_disc(c, 0.5) FROM filled))", "Volume": "coalesce(v, 0)"}),
    {
        "chosen": "SELECT * FROM prices WHERE k IN ('1-URGENT', '5-LOW')",
        "chosen_days": "SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM chosen",
        "chosen_grid": "SELECT g.d, keys.k, p.c, p.v FROM chosen_days AS g CROSS JOIN (VALUES ('1-URGENT'), ('5-LOW'), ('6-UNKNOWN')) AS keys(k) LEFT JOIN chosen AS p ON p.d = g.d AND p.k = keys.k",
        "filled": TABLES["dense"].replace("FROM grid", "FROM chosen_grid"),
    },
)

SQL: dict[str, str] = {
    "daily_mean": with_tables(["ticks"], 'SELECT CAST(d AS VARCHAR) AS "Date", k AS "Ticker", ' + shaped("Close", "avg(c)") + ', avg(v) AS "Volume" FROM ticks GROUP BY d, k'),
    "calendar": with_tables(["days"], 'SELECT CAST(d AS VARCHAR) AS "Date" FROM days'),
    "densify": with_tables(["grid"], panel_rows("grid", PRICE)),
    "densify_listed_keys": LISTED,
    "ffill": with_tables(["dense"], panel_rows("dense", PRICE)),
    "median_fill_global": with_tables(["panel"], panel_rows("panel", PRICE)),
    "median_fill_key": with_tables(["dense"], panel_rows("dense", {"Close": "coalesce(c, (SELECT quantile_disc(x.c, 0.5) FROM dense AS x WHERE x.k = dense.k))", "Volume": "coalesce(v, 0)"})),
    "median_price": with_tables(["ticks"], f"SELECT {shaped('median', 'quantile_disc(c, 0.5)')} FROM ticks"),
    "fill_neutral": with_tables(["prices", "spoken"], panel_rows("prices LEFT JOIN spoken USING (d, k)", {"sentiment": "coalesce(s, 0)"})),
    "panel": with_tables(["panel"], panel_rows("panel", PRICE)),
    "key_filter": with_tables(["ticks"], "SELECT k AS \"Ticker\", count(*) AS n, max(c) AS highest FROM ticks WHERE k IN ('2-HIGH', '5-LOW') GROUP BY k"),
    "key_filter_table": "SELECT CAST(l_suppkey AS VARCHAR) AS \"Ticker\", count(DISTINCT CAST(l_shipdate AS DATE)) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_suppkey",
    "rename_standard": with_tables(["prices"], panel_rows("prices", PRICE)),
    "union_sources": with_tables(
        ["ticks"],
        """SELECT k AS "Ticker", CAST(sum(v) AS BIGINT) AS "Volume", CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day, max(c) AS highest
        FROM (SELECT d, k, c, v FROM ticks UNION ALL SELECT CAST(ts AS DATE), event_type, value, 1 FROM events) GROUP BY k""",
    ),
    "write_read_roundtrip": with_tables(["panel"], panel_rows("panel", PRICE)),
    "read_some_keys": with_tables(["panel"], panel_rows("panel", PRICE, "WHERE k IN ('2-HIGH', '5-LOW')")),
    "csv_roundtrip": with_tables(["panel"], panel_rows("panel", {**PRICE, "nth": "row_number() OVER (PARTITION BY k, (d - DATE '1970-01-01') // 4096 ORDER BY d)"})),
    "read_some_dates": with_tables(["panel"], panel_rows("panel", PRICE, "WHERE d BETWEEN DATE '1996-01-20' AND DATE '1996-04-19'")),
    "panel_in_file_order": with_tables(["panel"], panel_rows("panel", {**PRICE, "nth": "row_number() OVER (PARTITION BY k ORDER BY d)"})),
    "price_files": with_tables(["ticks", "prices"], panel_rows("prices WHERE k IN ('1-URGENT', '5-LOW')", {"Close": "c", "Volume": "CAST(v AS BIGINT)"})),
    "price_files_missing": "SELECT unnest(['6-UNKNOWN', 'no [such] key']) AS key",
    "tweet_files": f"""SELECT strftime(CAST(DATE '1995-01-01' + CAST(doc_id // 15 % 2405 AS INTEGER) AS DATE), '%Y-%m-%d') AS "Date", {KEY_CASE} AS "Ticker",
        count(*) AS n, md5(string_agg(md5(text), ',' ORDER BY md5(text))) AS digest FROM documents WHERE doc_id % 5 IN (0, 3) GROUP BY 1, 2""",
    "panel_of_gappy_prices": with_tables(["days"], panel_rows("gappy_panel", PRICE), GAPPY),
    "tweet_driven_gappy_prices": with_tables(["days", "spoken"], panel_rows("spoken LEFT JOIN gappy_dense USING (d, k)", {**PRICE, "sentiment": "s"}), GAPPY),
    "iso_date": """SELECT CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS "Date", count(*) AS n FROM orders GROUP BY 1""",
    "rename_sentiment": with_tables(["full_panel"], panel_rows("full_panel", {**PRICE, "sentiments": "s"})),
    "rolling_minmax": plain("Close_min_14", "Close_max_14"),
    "rolling_std": plain("Close_std_20"),
    "rolling_sparse": with_tables(["prices"], panel_rows("prices", {"SMA_20": rolled("avg", "c", 20)})),
    "shift_diff": with_tables(["panel"], panel_rows("panel", {"Close_lag_7": f"lag(c, 7) OVER ({FULL})", "Close_diff": f"c - lag(c) OVER ({FULL})"})),
    "pct_change": with_tables(["panel"], panel_rows("panel", {"Close_pct": f"c / nullif(lag(c) OVER ({FULL}), 0) - 1"})),
    "cumsum": with_tables(["panel"], panel_rows("panel", {"Volume_total": f"sum(v) OVER ({FULL} ROWS UNBOUNDED PRECEDING)"})),
    "cumreturn": with_tables(["steps"], panel_rows("steps", {"Cumulative_Return": f"CASE WHEN r IS NOT NULL THEN {CUMULATIVE} END"})),
    "ema_sparse": with_tables(["prices"], panel_rows(f"(SELECT d, k, list(c) OVER ({FULL} ROWS UNBOUNDED PRECEDING) AS cs FROM prices)", {"EMA_20": ewm("cs", 20)})),
    "indicators_over_gaps": over_gaps(),
    "ema_with_gaps": with_tables(
        ["grid"],
        panel_rows(
            f"(SELECT d, k, last_value(e IGNORE NULLS) OVER ({FULL} ROWS UNBOUNDED PRECEDING) AS e FROM placed LEFT JOIN faded USING (d, k))",
            {"EMA_20": "CAST(round(CAST(e AS DECIMAL(28, 6)), 1) AS DOUBLE)"},
        ),
        {
            "placed": f"SELECT d, k, c, row_number() OVER ({FULL}) AS i FROM grid",
            "seen": f"SELECT d, k, list({{'y': c, 'i': i}}) OVER ({FULL} ROWS UNBOUNDED PRECEDING) AS l FROM placed WHERE c IS NOT NULL",
            "faded": "SELECT d, k, list_reduce(l, lambda a, b: {'y': (pow(1 - 2 / 21, b.i - a.i) * a.y + 2 / 21 * b.y) / (pow(1 - 2 / 21, b.i - a.i) + 2 / 21), 'i': b.i}).y AS e FROM seen",
        },
    ),
    "last_n": with_tables(["panel"], panel_rows("(SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS back FROM panel)", {**PRICE, "step": "8 - back"}, "WHERE back <= 7")),
    "horizon": with_tables(["panel"], "SELECT k AS \"Ticker\", CAST(h AS BIGINT) AS step, CAST(CAST(max(d) + CAST(h AS INTEGER) AS DATE) AS VARCHAR) AS \"Date\" FROM panel CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS h) GROUP BY k, h"),
    "sma": plain("SMA_20", "SMA_50"),
    "ema_20": exponential("EMA_20"),
    "bollinger": plain("BB_middle", "BB_upper", "BB_lower"),
    "rsi": plain("RSI"),
    "macd": exponential("MACD"),
    "signal_line": exponential("MACD", "Signal_Line"),
    "atr_close": plain("ATR"),
    "obv": plain("OBV"),
    "stochastic_k": plain("Stochastic_K"),
    "daily_return": plain("Daily_Return"),
    "volatility": plain("Volatility"),
    "volume_ratio": plain("Volume_MA", "Volume_Ratio"),
    "rsi_flags": with_tables(["indicators"], """SELECT k AS "Ticker", CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' WHEN rsi IS NOT NULL THEN 'neutral' END AS "RSI_flag", count(*) AS n FROM indicators GROUP BY 1, 2"""),
    "sentiment_rolling": plain("Sentiment_7D_Rolling", "Sentiment_14D_Rolling"),
    "sentiment_lagged": plain("Sentiment_7D_Lagged", "Sentiment_14D_Lagged"),
    "indicators_all": with_tables(["indicators", "means"], panel_rows("indicators JOIN means USING (d, k)", everything(ALL_NAMES))),
    "supplier_indicators": "WITH " + ", ".join(f"{n} AS ({q})" for n, q in SUPPLIER.items()) + " " + panel_rows("moves", {n: WINDOWED[n] for n in ("SMA_20", "RSI", "ATR", "OBV", "Stochastic_K")}),
    "event_indicators": "WITH " + ", ".join(f"{n} AS ({q})" for n, q in EVENT.items()) + " " + panel_rows("moves", {n: WINDOWED[n] for n in ("SMA_20", "SMA_50", "RSI", "ATR")}),
    "benchmark_compare": with_tables(
        ["steps", "market_dense"],
        panel_rows(
            f"(SELECT *, b / nullif(lag(b) OVER ({FULL}), 0) - 1 AS br FROM steps JOIN market_dense USING (d))",
            {
                "Stock_Return": "r", "Benchmark_Return": "br",
                "Stock_Cumulative_Return": f"CASE WHEN r IS NOT NULL THEN {CUMULATIVE} END",
                "Benchmark_Cumulative_Return": f"CASE WHEN br IS NOT NULL THEN {BENCHMARK_CUMULATIVE} END",
            },
        ),
    ),
    "clean_text": with_tables(["cleaned"], "SELECT doc_id, length(t) AS length, md5(t) AS digest FROM cleaned"),
    "dayfirst_date": with_tables(["tweets"], 'SELECT doc_id, CAST(d AS VARCHAR) AS "Date", k AS "Ticker" FROM tweets'),
    "lexicon_score": with_tables(["scored"], f"SELECT doc_id, {shaped('sentiment', 'score')} FROM scored"),
    "lexicon_negation": NEGATED,
    "daily_sentiment": with_tables(["spoken"], panel_rows("spoken", {"sentiment": "s"})),
    "panel_driven": with_tables(["full_panel"], panel_rows("full_panel", {**PRICE, "sentiment": "s"}), instead={"prices": TRADED}),
    "tweet_driven": with_tables(["spoken", "dense"], panel_rows("spoken LEFT JOIN dense USING (d, k)", {**PRICE, "sentiment": "s"}), instead={"prices": TRADED}),
    "correlation_matrix": correlations(False),
    "correlation_by_key": correlations(True),
    "mean_volatility": with_tables(["indicators"], f"SELECT k AS \"Ticker\", {shaped('mean_Volatility', 'avg(vol)')} FROM indicators GROUP BY k"),
    "return_histogram": HISTOGRAM,
    "return_histogram_by_key": HISTOGRAM_BY_KEY,
    "return_kde": KDE,
    "return_histogram_auto_by_key": HISTOGRAM_AUTO_BY_KEY,
    "return_kde_by_key": KDE_BY_KEY,
    "minmax_scale": with_tables(["panel"], panel_rows("panel", {"Close_scaled": SCALED["c"], "Volume_scaled": SCALED["v"]})),
    "minmax_invert": with_tables(["panel"], panel_rows("panel", {"Close": "c"})),
    "lookback": with_tables(
        ["panel"],
        panel_rows(
            f"(SELECT *, lag(c, 60) OVER w AS c60, lag(c) OVER w AS c1, sum(v) OVER (w ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS vs FROM panel WINDOW w AS ({FULL}))",
            {"length": "CAST(60 AS BIGINT)", "first_close": "c60", "last_close": "c1", "volume_sum": "vs", "y": "c"},
            "WHERE c60 IS NOT NULL",
        ),
    ),
    "feature_matrix": with_tables(["indicators", "means"], panel_rows("indicators JOIN means USING (d, k)", everything(FEATURES, "coalesce({}, 0)"))),
    "ar_forecast": with_tables(["panel"], panel_rows("ahead", {"step": "step", "forecast": "forecast"}), autoregression("panel")),
    "ar_exog_forecast": exogenous(),
    "lookback_short_forecast": short_lookback(3, 7),
    "lookback_fit_residuals": 'SELECT lag::BIGINT AS lag, "column"::BIGINT AS "column", 0.0::DOUBLE AS mean FROM range(60) AS l(lag), range(9) AS c("column")',
    "compare_forecast": with_tables(
        ["panel"],
        panel_rows("ahead JOIN panel USING (d, k)", {"step": "step", "forecast": "forecast", "actual": "c", "error": "forecast - c"}),
        {"older": "SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC) > 7", **autoregression("older")},
    ),
}
