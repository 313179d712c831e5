"""Connected components of an edge table: minimum labels spread along the edges
and pointers are halved in each round, so the rounds grow with the logarithm of
a component's diameter.  Every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meterwise.llm.common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of an edge; comp is the component's smallest node."""
    both = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
                  .unionAll(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("m", "node").alias("comp")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near")))
        hooked = staged(labels.join(near, "node")
                        .select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), "labels")
        up = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        moved = staged(hooked.join(up, "comp").select("node", "old", F.col("top").alias("comp")), "labels")
        labels = moved.select("node", "comp")
        if moved.filter("comp != old").isEmpty():
            return labels
