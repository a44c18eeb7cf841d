"""The exact median against Spark's own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions import ranks


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [5.0] * 7, [1.0, None, 1.0, 9.0, None], list(range(999)), [1e308, -1e308, 5e-324, 0.0, 1.0, -0.0], [2.0**k for k in range(-500, 500)], [float("nan"), 1.0, 2.0, float("nan"), float("nan")], [float("nan"), 1.0]])
def test_as_spark(spark, monkeypatch, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    want = df.agg(F.median("x")).first()[0]
    for few in (100_000, 3, 1):
        monkeypatch.setattr(ranks, "FEW", few)
        got = ranks.median(df, "x")
        assert got == want or (math.isnan(got) and math.isnan(want))


def test_many_values_by_histograms(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 20)
    rng = np.random.default_rng(2)
    for x in (rng.normal(size=5001), np.exp(rng.normal(size=5000) * 20), rng.integers(0, 4, 4000).astype(float)):
        assert ranks.median(spark.createDataFrame([(float(v),) for v in x], "x double"), "x") == np.median(x)
