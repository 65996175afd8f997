"""Connected components by label propagation with pointer jumping; nothing but a count reaches the driver."""

from pyspark.sql import DataFrame, functions as F

from ._common import release, stored


def components(spark, edges: DataFrame) -> DataFrame:
    """(id, component) for every end of the edges (a, b); component is the smallest id that can be reached.

    In each round every node takes the smallest label among itself and its neighbours, then the
    label of that label, so that long chains halve. Rounds are written tables, so lost executors
    repeat one round at most. The result is a stored table, which the caller releases.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = stored(spark, both, "edges")
    labels = stored(spark, both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("over"))
        new = step.join(jump, "next", "left").select("id", "old", F.least("next", F.coalesce("over", "next")).alias("component"))
        new = stored(spark, new, "labels")
        changed = new.filter("old <> component").limit(1).count()
        release(spark, labels)
        labels = new
        if not changed:
            release(spark, both)
            return labels
