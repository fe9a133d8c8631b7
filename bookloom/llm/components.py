"""Connected components of an edge table, by least labels with pointer jumping; every round is a few joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import remove, written


def components(links: DataFrame, a: str = "a", b: str = "b", spent: list[str] | None = None) -> DataFrame:
    """node, label for every node of links; label is the least node that it can reach. Tables of former rounds go."""
    spark, own, old = links.sparkSession, [], []
    ends = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    edges = written(ends.unionByName(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges", own)
    labels = written(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels", old)
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("there"))
        near = edges.join(seen, "other").groupBy("node").agg(F.min("there").alias("there"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "there").alias("label"))
        up = seen.select(F.col("other").alias("label"), F.col("there").alias("above"))
        new: list[str] = []
        moved = written(lower.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("above", "label")).alias("label")), "labels", new)
        labels = moved.select("node", "label")
        remove(spark, old)
        old = new
        if moved.where(F.col("was") != F.col("label")).isEmpty():
            remove(spark, own)
            if spent is not None:
                spent.extend(new)
            return labels
