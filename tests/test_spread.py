"""Large tables are dealt to as many tasks as their files ask for, with the same results."""

from quillspan.operators import durable
from quillspan.plans import registry


def _plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_validation_is_dealt_by_size(spark, sf_dir, monkeypatch):
    want = registry.QUERIES["validation_reasons"](spark, sf_dir)
    few, rows = _plan(want), {tuple(r) for r in want.collect()}
    monkeypatch.setattr(durable, "SPREAD_BYTES", 4096)
    got = registry.QUERIES["validation_reasons"](spark, sf_dir)
    assert "REPARTITION_BY_NUM" in _plan(got) and "REPARTITION_BY_NUM" not in few
    assert {tuple(r) for r in got.collect()} == rows


def test_segments_are_dealt_by_size(spark, sf_dir, monkeypatch):
    want = registry.QUERIES["render_segments"](spark, sf_dir)
    few, rows = _plan(want), {tuple(r) for r in want.collect()}
    monkeypatch.setattr(durable, "SPREAD_BYTES", 4096)
    got = registry.QUERIES["render_segments"](spark, sf_dir)
    assert "REPARTITION_BY_NUM" in _plan(got) and "REPARTITION_BY_NUM" not in few
    assert {tuple(r) for r in got.collect()} == rows
