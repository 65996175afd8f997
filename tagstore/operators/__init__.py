"""Operators on records, versions, buckets and traces, as DataFrame transformations."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F


# -- buckets and levels
def running(df: DataFrame, key: str, order, amount: Column, out: str) -> DataFrame:
    """Add the running total of amount in order of key, then `order`, without one global window.

    Totals are made for each range of the key, the range offsets are a table of one row for each
    range, and windows run inside the ranges. A job over the keys alone finds the range bounds first, as a sort's does (as a
    part of the plan they would double it with each use); rows find their range by halving. Rows of one key stay in one
    range. Null keys come first.
    """
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ends = df.select(F.percentile_approx(key, [i / width for i in range(1, width)] or [0.5], 10000).alias("b")).first()["b"] or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(ends))]) if ends else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(width.bit_length()))])
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < F.col(key), at + step).otherwise(at))
    ranged = df.withColumn("_part", part).withColumn("_amount", amount)
    sizes = ranged.groupBy("_part").agg(F.sum("_amount").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(F.col(key), *order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.withColumn("_run", F.sum("_amount").over(inside)).join(F.broadcast(offsets), "_part")
    return ranked.withColumn(out, F.col("_run") + F.col("_offset")).drop("_part", "_amount", "_run", "_offset")


def bucketise(records: DataFrame, capacity: int) -> DataFrame:
    """Add bucket_no: records in order of key, newest first, cut every `capacity` rows."""
    ranked = running(records, "key", (F.col("ts").desc(), "op", "val"), F.lit(1).cast("long"), "_rank")
    return ranked.withColumn("bucket_no", F.floor((F.col("_rank") - 1) / F.lit(capacity)).cast("long")).drop("_rank")


def tags(bucketed: DataFrame) -> DataFrame:
    return bucketed.groupBy("bucket_no").agg(F.min("key").alias("left"), F.max("key").alias("right"), F.count("*").alias("n"))


def overlap(queries: DataFrame, tags_: DataFrame, cell: int) -> DataFrame:
    """Pairs (qid, bucket_no) whose closed intervals meet (left > right meets nothing): an equi-join on cells of the key domain, not a theta join."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    q = queries.filter(F.col("left") <= F.col("right")).withColumn("_cell", cells(F.col("left"), F.col("right")))
    t = tags_.select("bucket_no", F.col("left").alias("_l"), F.col("right").alias("_r")).withColumn("_cell", cells(F.col("_l"), F.col("_r")))
    met = q.join(t, "_cell").filter((F.col("left") <= F.col("_r")) & (F.col("right") >= F.col("_l")))
    first = F.greatest(F.floor(F.col("left") / cell), F.floor(F.col("_l") / cell))
    return met.filter(F.col("_cell") == first).select("qid", "bucket_no")


def range_records(queries: DataFrame, records: DataFrame, cell: int) -> DataFrame:
    """Records (qid, key, op, ts, val) with left <= key <= right."""
    q = queries.filter(F.col("left") <= F.col("right")).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("left") / cell), F.floor(F.col("right") / cell))))
    r = records.withColumn("_cell", F.floor(F.col("key") / cell))
    return q.join(r, "_cell").filter(F.col("key").between(F.col("left"), F.col("right"))).select("qid", "key", "op", "ts", "val")


def ieee_divide(x: Column, y: Column, zero: float = 0.0) -> Column:
    """x / y of floating-point numbers by IEEE 754, as in SQL engines that follow it; Spark raises or returns null at zero. zero: the sign that a zero y counts with."""
    inf = F.lit(math.copysign(math.inf, zero))
    at_zero = F.when(F.isnan(x) | (x == 0), F.lit(math.nan)).when(x > 0, inf).when(x < 0, -inf)
    return F.when(y == 0, at_zero).otherwise(x / F.nullif(y, F.lit(0)))


def signed_round(x: Column, digits: int) -> Column:
    """x rounded, where what rounds to zero from below keeps its sign, as in IEEE 754; Spark's own round drops it."""
    return F.when((F.round(x, digits) == 0) & (x < 0), F.lit(-0.0)).otherwise(F.round(x, digits))


def bucket_weights(tags_: DataFrame, lo: int, hi: int, range_len: int) -> DataFrame:
    """Probability that a uniform range query touches a bucket, normalised to sum 1.

    The formula holds for buckets inside [lo, hi]; those outside get what it gives there, which may be below zero.
    """
    n, r = hi - lo + 1, range_len
    x = F.least(F.lit(r + 1), F.col("left") - lo)
    y = F.least(F.lit(r + 1), F.lit(hi) - F.col("right"))
    w = 1 - (2 * F.col("left") - 1 - x) / (2.0 * n - r) * x / (r + 1.0) - (2 * n - 2 * F.col("right") + 1 - y) / (2.0 * n - r) * y / (r + 1.0)
    raw = tags_.withColumn("_w", w)
    total = raw.agg(F.sum("_w").alias("_t"))
    return raw.crossJoin(F.broadcast(total)).withColumn("weight", ieee_divide(F.col("_w"), F.col("_t"))).drop("_w", "_t")


def replicas(weights: DataFrame, overhead: float) -> DataFrame:
    """Copies of each bucket, and the weight of real and of fake reads of each copy.

    A weight below zero may round up to no copies, a zero with the sign of the weight; the weight of a fake read is infinite then.
    """
    n = weights.agg(F.count("*").alias("_b"))
    alpha, delta = 1.0 / (overhead - 1), (overhead - 1) / overhead
    out = weights.crossJoin(F.broadcast(n)).withColumn("copies", F.ceil(F.col("weight") * F.col("_b") / F.lit(alpha)).cast("long"))
    fake = (F.lit(alpha) / F.col("_b") - ieee_divide(F.col("weight"), F.col("copies"), -0.0)) / F.lit(1 / delta - 1)
    return out.withColumn("fake_weight", fake).drop("_b")


# -- versions
def latest(records: DataFrame) -> DataFrame:
    """The newest record of each key, unless it is a delete; an aggregate, so each task sends one row for each key."""
    newest = records.groupBy("key").agg(F.max_by(F.struct("op", "ts", "val"), F.struct("ts", "op", "val")).alias("x"))
    return newest.filter(F.col("x.op") != 2).select("key", F.col("x.ts").alias("ts"), F.col("x.val").alias("val"))


def visible_stack(versions: DataFrame, snapshot=None) -> DataFrame:
    """Versions that a read combines: the newest put of each key and the merge operands above it; a delete ends the stack."""
    v = versions if snapshot is None else versions.filter(F.col("seq") <= snapshot)
    ends = v.groupBy("key").agg(F.max(F.when(F.col("op") != "merge", F.col("seq"))).alias("_end"))
    live = F.col("_end").isNull() | (F.col("seq") > F.col("_end")) | ((F.col("seq") == F.col("_end")) & (F.col("op") == "put"))
    return v.join(ends, "key").filter(live).drop("_end")


def resolve(versions: DataFrame, merge=F.sum, snapshot=None) -> DataFrame:
    """Visible value of each key: its visible stack, merged."""
    return visible_stack(versions, snapshot).groupBy("key").agg(merge("value").alias("value"), F.count("*").alias("stack"))


def as_of(probes: DataFrame, versions: DataFrame, key: str, at: str, ts: str, value: str, cell: int) -> DataFrame:
    """Each probe with the newest value of its key at or before its time, else null; of equal times the greatest value counts.

    Windows run inside cells of a key's time, `cell` wide, so that a hot key is spread over tasks; what a cell takes over
    from the key's cells before it comes from a table of one row for each cell that is not empty. Null keys and times match nothing.
    """
    held = f"struct<t:{dict(versions.dtypes)[ts]},v:{dict(versions.dtypes)[value]}>"
    p = probes.select(F.col(key), F.col(at).alias("_t"), F.lit(1).alias("_probe"), F.lit(None).cast(held).alias("_v"))
    v = versions.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    v = v.select(F.col(key), F.col(ts).alias("_t"), F.lit(0).alias("_probe"), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")).alias("_v"))
    both = p.union(v).withColumn("_cell", F.floor(F.col("_t").cast("long") / cell))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    tops = both.groupBy(key, "_cell").agg(F.max("_v").alias("_top"))
    carried = tops.select(key, "_cell", F.last("_top", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(key, "_cell").orderBy("_t", "_probe", "_v.v").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_in", F.last("_v", ignorenulls=True).over(inside)).filter("_probe = 1")
    return found.join(carried, [key, "_cell"], "left").select(key, F.col("_t").alias(at), F.coalesce("_in", "_carry")["v"].alias(value))


def delete_ranges(versions: DataFrame, ranges: DataFrame, cell: int) -> DataFrame:
    """Versions that no newer range [begin, end) covers: an anti join on cells of the key domain. Empty ranges delete nothing."""
    cells = F.explode(F.sequence(F.floor(F.col("begin") / cell), F.floor((F.col("end") - 1) / cell)))
    r = ranges.filter("begin < end").select(F.col("begin").alias("_b"), F.col("end").alias("_e"), F.col("rseq").alias("_rseq"), cells.alias("_c"))
    covered = (F.floor(F.col("key") / cell) == F.col("_c")) & (F.col("key") >= F.col("_b")) & (F.col("key") < F.col("_e")) & (F.col("_rseq") > F.col("seq"))
    return versions.join(r, covered, "left_anti")


def overlay(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Uncommitted puts and deletes (key, op, value) over base (key, value)."""
    d = delta.select("key", F.col("op").alias("_op"), F.col("value").alias("_new"))
    return base.join(d, "key", "full_outer").filter(F.coalesce(F.col("_op") != "delete", F.lit(True))).select("key", F.coalesce("_new", "value").alias("value"))


def multi_get(keys: DataFrame, store: DataFrame) -> DataFrame:
    """One row for each requested key, repeats included, with null where the store has none."""
    return keys.join(store, "key", "left")


def conflicts(writes: DataFrame, versions: DataFrame) -> DataFrame:
    """Keys of a write set (key, snapshot) that have a newer version."""
    return writes.join(versions.select(F.col("key").alias("_k"), "seq"), (F.col("key") == F.col("_k")) & (F.col("seq") > F.col("snapshot")), "left_semi").select("key")


def expired(rows: DataFrame, ts: str, ttl: int, now) -> Column:
    return (F.lit(ttl) > 0) & (F.col(ts) + F.lit(ttl) < now)


# -- merge operators: operands in order of seq
def append_operands(value: str, seq: str, delimiter=",") -> Column:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(value).alias("value"))))
    return F.concat_ws(delimiter, F.transform(ordered, lambda x: x["value"].cast("string")))


def last_n(operands: DataFrame, key: str, value: str, seq: str, out: str, n=3) -> DataFrame:
    """key and the last n operands, newest first; a rank with a limit, so that a task sends n rows of a key at most."""
    newest = Window.partitionBy(key).orderBy(F.desc(seq), F.desc(value))
    kept = operands.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col(value).alias("value"))))
    return kept.groupBy(key).agg(F.concat_ws(",", F.transform(ordered, lambda x: x["value"].cast("string"))).alias(out))


def sorted_list(value: str) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(F.collect_list(value)), lambda x: x.cast("string")))


# -- traces
def transitions(trace: DataFrame, key: str, order, group=None) -> DataFrame:
    """Counts of (previous, next) over consecutive accesses, within groups if one is named."""
    w = Window.partitionBy(group) if group else Window.partitionBy()
    prev = F.lag(key).over(w.orderBy(*order))
    return trace.withColumn("prev", prev).filter(F.col("prev").isNotNull()).groupBy("prev", F.col(key).alias("next")).agg(F.count("*").alias("n"))


def reuse_gaps(trace: DataFrame, key: str, ts: str, order) -> DataFrame:
    return trace.withColumn("gap", F.col(ts) - F.lag(ts).over(Window.partitionBy(key).orderBy(*order))).filter(F.col("gap").isNotNull())


def bursts(series: DataFrame, entity: str, ts: str, value: str, window: int, threshold: float) -> DataFrame:
    w = Window.partitionBy(entity).orderBy(ts)
    rate = (F.col(value) - F.lag(value, window).over(w)) / (F.col(ts) - F.lag(ts, window).over(w))
    return series.withColumn("rate", rate).filter(F.col("rate") >= threshold)
