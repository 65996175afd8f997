"""Analyses of access traces."""

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def deviations(transitions: DataFrame, trace: DataFrame, key: str) -> DataFrame:
    """Relative standard deviation of transition counts over the whole key x key grid, zeros included but never made."""
    keys = trace.agg(F.countDistinct(key).alias("_k"))
    sums = transitions.agg(F.sum("n").alias("_s"), F.sum(F.col("n") * F.col("n")).alias("_q"))
    cells = F.col("_k") * F.col("_k")
    mean = F.col("_s") / cells
    return sums.crossJoin(keys).select(F.col("_k").alias("keys"), (F.sqrt(F.col("_q") / cells - mean * mean) / mean).alias("rsd"))


def disorder(rows: DataFrame, seq: str, value: str, block: int) -> DataFrame:
    """How often a value is below its predecessor in order of seq: lags inside blocks of seq, then over block borders."""
    b = rows.select(F.floor(F.col(seq) / block).alias("_b"), F.col(seq).alias("_s"), F.col(value).alias("_v"))
    down = (F.lag("_v").over(Window.partitionBy("_b").orderBy("_s")) > F.col("_v")).cast("long")
    at = b.withColumn("_d", down).groupBy("_b").agg(F.sum("_d").alias("_d"), F.min_by("_v", "_s").alias("_first"), F.max_by("_v", "_s").alias("_last"))
    border = (F.lag("_last").over(Window.orderBy("_b")) > F.col("_first")).cast("long")
    return at.withColumn("_x", border).agg((F.coalesce(F.sum("_d"), F.lit(0)) + F.coalesce(F.sum("_x"), F.lit(0))).alias("violations"))


def near_in_time(first: DataFrame, second: DataFrame, entity: str, span: int) -> DataFrame:
    """For each entity the first pair (t1, t2) of times at most span apart: a join on entity and time cell, not on a range."""
    a = first.select(entity, F.col("t").alias("t1")).withColumn("_c", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("t1") / span) + i)))
    b = second.select(entity, F.col("t").alias("t2")).withColumn("_c", F.floor(F.col("t2") / span))
    met = a.join(b, [entity, "_c"]).filter(F.abs(F.col("t1") - F.col("t2")) <= span)
    return met.groupBy(entity).agg(F.min(F.struct("t1", "t2")).alias("x")).select(entity, "x.t1", "x.t2")


def reuse_distances(trace: DataFrame, shard: str, key: str, seq: str) -> DataFrame:
    """Number of other keys of the shard between consecutive accesses to a key; null at its first access.

    A shard is one simulated cache, which is sequential by its nature: choose shards so that a shard's
    trace fits in a task. Rows need distinct seq inside a shard; rows with a null key or seq are left out.
    """

    def one(pdf):
        pdf = pdf.sort_values("seq", kind="stable")
        last, order, out = {}, [], []
        for i, k in enumerate(pdf["key"].tolist()):
            p = last.get(k)
            if p is None:
                out.append(None)
            else:
                j = bisect_right(order, p)
                out.append(len(order) - j)
                del order[j - 1]
            last[k] = i
            order.append(i)
        return pd.DataFrame({"shard": pdf["shard"], "key": pdf["key"], "seq": pdf["seq"], "distance": pd.array(out, dtype="Int64")})

    rows = trace.select(F.col(shard).alias("shard"), F.col(key).alias("key"), F.col(seq).alias("seq")).dropna()
    types = dict(rows.dtypes)
    return rows.groupBy("shard").applyInPandas(one, f"shard {types['shard']}, key {types['key']}, seq {types['seq']}, distance long")


def miss_curve(distances: DataFrame, capacities) -> DataFrame:
    """Misses of least-recently-used caches of several sizes from one pass: an access hits if its distance is below the size."""
    hist = distances.groupBy("distance").agg(F.count("*").alias("_n"))
    each = hist.withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in capacities])))
    miss = F.coalesce(F.col("distance") >= F.col("capacity"), F.lit(True))
    return each.groupBy("capacity").agg(F.sum("_n").alias("accesses"), F.sum(F.when(miss, F.col("_n")).otherwise(0)).alias("misses"))


def top_share(trace: DataFrame, key: str, percent: int) -> DataFrame:
    """Accesses to the top percent of keys by access count, from the counts of counts: keys are never sorted one by one."""
    counts = trace.groupBy(key).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    total = counts.agg(F.sum("k").alias("_keys"), F.sum(F.col("n") * F.col("k")).alias("accesses"))
    above = F.sum("k").over(Window.orderBy(F.desc("n"))) - F.col("k")
    cut = F.floor(F.col("_keys") * percent / 100)
    taken = counts.withColumn("_above", above).crossJoin(F.broadcast(total)).withColumn("_t", F.greatest(F.lit(0), F.least("k", cut - F.col("_above"))))
    return taken.agg(F.max(cut).alias("top_keys"), F.sum(F.col("_t") * F.col("n")).alias("top_accesses"), F.max("accesses").alias("accesses"))


def retention(trace: DataFrame, key: str, window: Column) -> DataFrame:
    """Keys of each time window seen again in each later window; pairs of windows of one key, so bounded by windows squared."""
    seen = trace.select(F.col(key).alias("_k"), window.alias("base")).distinct()
    later = seen.withColumnRenamed("base", "later")
    return seen.join(later, "_k").filter(F.col("later") >= F.col("base")).groupBy("base", "later").agg(F.count("*").alias("keys"))


def interior_points(rows: DataFrame, bin_: str, order: str, epsilon: float, u: Column) -> DataFrame:
    """One row of each bin, drawn by the exponential mechanism with a weight that grows towards the middle."""
    w = Window.partitionBy(bin_)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    weight = F.exp(epsilon * (F.least(F.col("_i"), F.col("_n") - F.col("_i")) - F.col("_n") / 2))
    run = F.sum("_w").over(w.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    drawn = ranked.withColumn("_w", weight).withColumn("_run", run).withColumn("_all", F.max("_run").over(w))
    return drawn.filter(F.col("_run") > u * F.col("_all")).groupBy(bin_).agg(F.min(order).alias(order))


def percentiles(rows: DataFrame, group: str, value: str, index: Column, bounds, percents) -> DataFrame:
    """Percentiles of a histogram with fixed bounds: linear inside the bucket, held between the smallest and the largest value."""
    hist = rows.groupBy(group, index.alias("_b")).agg(F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    w = Window.partitionBy(group)
    cum = hist.withColumn("_cum", F.sum("_n").over(w.orderBy("_b"))).withColumn("_all", F.sum("_n").over(w)).withColumn("_min", F.min("_lo").over(w)).withColumn("_max", F.max("_hi").over(w))
    each = cum.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents]))).withColumn("_t", F.col("_all") * F.col("percent") / 100.0)
    hit = each.filter((F.col("_cum") >= F.col("_t")) & (F.col("_cum") - F.col("_n") < F.col("_t")))
    edge = F.array(*[F.lit(float(b)) for b in [0, *bounds]])
    left, right = F.element_at(edge, F.col("_b") + 1), F.element_at(edge, F.col("_b") + 2)
    r = left + (right - left) * (F.col("_t") - F.col("_cum") + F.col("_n")) / F.col("_n")
    return hit.select(group, "percent", F.least(F.greatest(r, F.col("_min").cast("double")), F.col("_max").cast("double")).alias("value"))
