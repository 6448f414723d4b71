"""Medians of large groups against numpy, whatever the shape of the values."""

import numpy as np
import pytest

from quillspan.operators import motion, selection


@pytest.mark.parametrize("shape", ["normal", "ties", "two values", "heavy tail", "sorted"])
@pytest.mark.parametrize("n", [2000, 2001])
def test_medians_of_large_groups(spark, shape, n):
    rng = np.random.default_rng(n)
    x = {"normal": rng.normal(size=n), "ties": rng.integers(0, 5, n) * 1.0, "two values": (np.arange(n) % 2) * 1.0, "heavy tail": rng.standard_cauchy(n), "sorted": np.arange(n) * 1.0}[shape]
    rows = [("hot", float(v), float(v) * 3) for v in x] + [("hot", None, 1.0)] + [("few", 3.0, 1.0), ("few", 4.0, None), ("none", None, None)]
    d = spark.createDataFrame(rows, "k string, v double, w double").repartition(4)
    got = {r.k: (r.a, r.b) for r in selection.medians(d, "k", {"a": "v", "b": "w"}, hot_rows=500).collect()}
    assert got == {"hot": (float(np.median(x)), float(np.median([*(x * 3), 1.0]))), "few": (3.5, 1.0), "none": (None, None)}
    whole = selection.medians(d, None, {"a": "v"}, hot_rows=500).collect()
    assert [tuple(r) for r in whole] == [(float(np.median([*x, 3.0, 4.0])),)]


def test_scales_are_the_same_for_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(f"k{i % 3}", float(v)) for i, v in enumerate(rng.normal(size=3000) + 5)], "k string, v double")
    want = sorted(map(tuple, motion.scales(d, "k", "v").collect()))
    monkeypatch.setattr(selection, "HOT_ROWS", 100)
    assert sorted(map(tuple, motion.scales(d, "k", "v").collect())) == want


def test_medians_of_nothing(spark):
    d = spark.createDataFrame([], "k string, v double")
    assert selection.medians(d, "k", {"a": "v"}).count() == 0
    assert selection.medians(d, None, {"a": "v"}).collect()[0].a is None
