"""Exact quantiles against numpy, and how few rows the last step ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import quantiles

PROBS = {"lo": 0.0, "p05": 0.05, "mid": 0.5, "p95": 0.95, "hi": 1.0}


@pytest.mark.parametrize("shape", ["normal", "heavy", "ties", "constant", "signs", "huge"])
def test_equal_to_numpy(spark, shape):
    rng = np.random.default_rng(5)
    x = {"normal": rng.normal(0, 1, 30_011), "heavy": rng.pareto(0.3, 30_011), "ties": rng.integers(0, 4, 30_011).astype(float),
         "constant": np.full(12_000, 3.5), "signs": np.append(rng.normal(0, 1e-300, 15_000), rng.normal(0, 1e6, 15_000)),
         "huge": rng.choice([-1.7e308, 1.7e308, 0.0, 1.0], 20_000)}[shape]
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(5)
    got = quantiles.exact_quantiles(df, "v", PROBS).first().asDict()
    ordered = np.sort(x)
    for name, p in PROBS.items():
        pos = p * (len(x) - 1)
        a, b = ordered[int(pos)], ordered[min(int(pos) + 1, len(x) - 1)]
        want = a if pos == int(pos) else a + (b - a) * (pos - int(pos))
        assert got[name] == pytest.approx(want, rel=1e-12) or (np.isinf(want) and got[name] == want)
    first = quantiles.exact_quantiles(df, "v", {"c": 0.37}, how="ceil").first()["c"]
    assert first == ordered[int(np.ceil(round(0.37 * len(x), 9))) - 1]


def test_groups_null_ones_too(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(v)) for g, n in (("a", 11_000), ("b", 3), (None, 500)) for v in rng.normal(0, 1, n)]
    df = spark.createDataFrame([*rows, ("a", None)], "g string, v double")
    got = {r.g: r.m for r in quantiles.exact_quantiles(df, "v", {"m": 0.5}, by=["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g in got:
        assert got[g] == pytest.approx(np.median([v for k, v in rows if k == g]), abs=1e-12)


def test_last_step_does_not_grow(spark, monkeypatch):
    """Rows in the final brackets: a handful at every size."""
    seen = []
    plain = quantiles.narrowed

    def counted(named, wanted, by):
        out = plain(named, wanted, by)
        brackets = out.collect()[0]
        seen.append(named.filter(F.col("_v").between(brackets["_lo"], brackets["_hi"])).count())
        return out

    monkeypatch.setattr(quantiles, "narrowed", counted)
    for n in (100_000, 10_000_000):
        df = spark.range(n).select((F.xxhash64("id") / F.lit(2.0 ** 40)).alias("v"))
        quantiles.exact_quantiles(df, "v", {"m": 0.5}).collect()
    assert max(seen) <= 50
