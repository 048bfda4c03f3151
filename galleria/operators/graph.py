"""Connected components by label propagation with pointer jumping, as joins and aggregations of an edge table.

Every round each vertex takes the smallest label among its neighbours' and then its label's label, so the number of rounds
grows with the logarithm of a component's diameter. Each round's labels are a written table in the shared scratch folder:
lineage stays one round long and a lost executor costs one round's tasks at most. Only a count returns to the driver. A
hub's rows are combined map-side in the aggregation, and AQE may split its key in the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleria.session import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", scratch: Scratch | None = None) -> DataFrame:
    """(vertex, label) for every vertex of an edge; label = smallest vertex of its component. Null ends are dropped."""
    scratch = scratch or Scratch(edges.sparkSession)
    one = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = scratch.keep(one.union(one.select("b", "a")).distinct(), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("m")).select("vertex", F.least("vertex", "m").alias("label")), "labels")
    before = labels
    while True:
        near = both.join(labels.select(F.col("vertex").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("vertex") == F.col("a")).select("vertex", F.col("label").alias("old"), F.least("label", "m").alias("new"))
        up = step.select(F.col("vertex").alias("v2"), F.col("new").alias("up"))
        after = step.join(up, F.col("new") == F.col("v2"), "left").select("vertex", "old", F.least("new", F.coalesce("up", "new")).alias("label"))
        after = scratch.keep(after, "labels")
        scratch.drop(before)
        before, labels = after, after.select("vertex", "label")
        if after.filter("old <> label").isEmpty():
            scratch.drop(both)
            return labels
