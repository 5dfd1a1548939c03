"""Density by cells against the sum of all kernels."""

import numpy as np
import pytest

from tidemark.operators.statistics import kde


@pytest.mark.parametrize("by", [None, "k"])
def test_density_equals_the_sum_of_kernels(spark, by):
    """Against every kernel at every grid point, with far outliers, ties, a constant key, a single row and NULLs."""
    draw = np.random.default_rng(5)
    many = np.concatenate([draw.normal(3, 2, 3000), draw.normal(40, 0.1, 50), np.repeat(1.25, 700), [-900.0, 4000.0]])
    rows = [("many", float(v)) for v in many] + [("few", float(v)) for v in draw.normal(0, 1e-3, 7)] + [("flat", 2.0)] * 4 + [("one", 1.0), ("none", None)]
    if by is None:
        rows = [r for r in rows if r[0] in ("many", "none")]
    found = kde(spark.createDataFrame(rows, "k string, v double"), "v", 150, by=by, cut=2.0).toPandas()
    for key, curve in found.groupby("k") if by else [("many", found)]:
        curve = curve.sort_values("point")
        values = np.array([v for k, v in rows if k == key])
        if key in ("flat", "one"):
            assert curve.density.isna().all()
            continue
        h = values.std(ddof=1) * len(values) ** -0.2
        x = np.linspace(values.min() - 2 * h, values.max() + 2 * h, 150)
        want = np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(1) / (len(values) * h * np.sqrt(2 * np.pi))
        assert np.abs(curve.x.to_numpy() - x).max() < 1e-9 * np.abs(x).max()
        assert np.abs(curve.density.to_numpy() - want).max() < 1e-11 * want.max()
    assert by is None or set(found.k) == {"many", "few", "flat", "one"}
