"""Connected components of an edge table, by spreading the smallest label and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, owner: str, most: int = 60) -> DataFrame:
    """v, label: the smallest vertex of the component, for every vertex of edges (a, b).

    Labels are written to the shared folder after each round, so no round's plan holds another's; the driver sees one
    count per round. Each round takes the least label among neighbours and then that label's own label, so a chain's
    length shrinks by more than half. Rounds beyond `most` are an error, never a wrong result.
    """
    both = common.stored(common.few(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()), "edges", owner)
    labels = common.stored(common.few(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label"))), "labels", owner)
    for _ in range(most):
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["v"] == near["a"]).select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("j"), F.col("label").alias("far"))
        new = common.stored(common.few(step.join(jump, step["label"] == jump["j"], "left").select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label"))), "labels", owner)
        changed = new.where(F.col("old") != F.col("label")).limit(1).count()
        common.drop_stored(labels)
        labels = new.select("v", "label")
        labels.stored_at = new.stored_at
        if not changed:
            common.drop_stored(both)
            return labels
    raise RuntimeError(f"no components after {most} rounds")
