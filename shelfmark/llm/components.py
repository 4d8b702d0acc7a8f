"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.operators import stage


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over links (a, b), for every linked id.

    Every round takes the smallest label among neighbours, then the label of
    that label, so the distance covered doubles. A round is one written table;
    how many labels changed is counted in the same pass.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage(both.where("a <> b").distinct(), "edges")
    labels = stage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = (
            edges.join(labels, F.col("b") == F.col("id"))
            .groupBy("a")
            .agg(F.min("label").alias("near"))
        )
        best = labels.join(near, F.col("id") == F.col("a")).select(
            "id", "label", F.least("label", "near").alias("best")
        )
        # what the best label's own id was labelled with before this round
        ahead = labels.select(F.col("id").alias("best"), F.col("label").alias("far"))
        seen = Observation()
        moved = best.join(ahead, "best").select(
            "id", F.least("best", "far").alias("label"), (F.col("label") > F.least("best", "far")).alias("moved")
        )
        counted = moved.observe(seen, F.count_if("moved").alias("moved")).select("id", "label")
        labels = stage(counted, "labels")
        if not seen.get["moved"]:
            return labels
