"""Operators of a key-value store's read and maintenance paths: noise trees, scans, merges, draws, rewrites and triggers."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import hash_uniform, laplace
from . import ieee_divide, running


# -- noise and loads
def noisy_prefixes(loads: DataFrame, bin_: str, load: str, epsilon: float, capacity: int, bits: int = 40) -> DataFrame:
    """Prefix sums of bin loads by the binary tree mechanism: bin, load, noisy, error.

    Prefix t is the sum of the noisy dyadic blocks that make up 1..t, cut to a whole number, held within `capacity` of the
    true sum and never falling. A block ends at t with some low bits cleared, and its noise is drawn by hash from
    its end. Since the true sums never fall, holding and not falling one after the other
    equals a running maximum of the held values. Bins must be distinct; they are a table of aggregates.
    """
    order = Window.orderBy(bin_)
    rows = loads.select(F.col(bin_).alias("bin"), F.col(load).alias("load")).withColumn("_t", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("_s", F.sum("load").over(Window.orderBy("bin")))

    def noise(i):
        end = F.shiftleft(F.shiftright(F.col("_t"), i), i)
        return F.when(F.shiftright(F.col("_t"), i).bitwiseAND(F.lit(1)) == 1, laplace(hash_uniform(end), 1.0 / epsilon)).otherwise(F.lit(0.0))

    drawn = F.col("_s") + sum((noise(i) for i in range(1, bits)), noise(0))
    held = F.greatest(F.col("_s") - capacity, F.least(F.greatest(F.floor(drawn), F.lit(0)), F.col("_s") + capacity), F.lit(0))
    out = rows.withColumn("noisy", F.max(held).over(Window.orderBy("bin")))
    return out.select("bin", "load", "noisy", F.abs(F.col("_s") - F.col("noisy")).alias("error"))


def capped_loads(loads: DataFrame, bin_: str, load: str, total: Column) -> DataFrame:
    """Loads in order of bin while `total` lasts: each is cut to what the bins before it have left."""
    upto = F.sum(load).over(Window.orderBy(bin_)) - F.col(load)
    return loads.withColumn("taken", F.greatest(F.lit(0), F.least(F.col(load), total - upto)))


def weighted_pick(draws: DataFrame, u: str, choices: DataFrame, name: str, weight: str, out: str) -> DataFrame:
    """draws with the first choice, in order of name, whose running weight is above u times the total.

    Running weights are cut to steps of 2^-40 of the total; the choices go to the draws through
    floor_lookup, so neither side is crossed with the other.
    """
    from .layers import floor_lookup

    upto = running(choices.select(name, weight), name, (), F.col(weight), "_upto")
    total = choices.agg(F.sum(weight).alias("_all"))
    scale = float(1 << 40)
    starts = upto.crossJoin(F.broadcast(total)).select(F.col(name).alias(out), F.floor((F.col("_upto") - F.col(weight)) / F.col("_all") * scale).alias("_from"))
    at = draws.withColumn("_at", F.floor(F.col(u) * scale))
    return floor_lookup(at, starts, "_at", "_from", out, 1 << 34).drop("_at")


def replica_weights(weights: DataFrame, overhead: float) -> DataFrame:
    """bucket_no, copies, real_weight, fake_weight, is_dummy: one row for each bucket, and one for the dummies behind them.

    A weight below zero may round up to no copies, a zero without a sign; the weight of a fake read is infinite then.
    """
    alpha, delta = 1.0 / (overhead - 1), (overhead - 1) / overhead
    n = weights.agg(F.count("*").alias("_b"))
    rows = weights.crossJoin(F.broadcast(n)).withColumn("copies", F.ceil(F.col("weight") * F.col("_b") / F.lit(alpha)).cast("long"))
    level = F.lit(alpha) / F.col("_b")
    fake = lambda w: w / F.lit(1 / delta - 1)
    real = rows.select("bucket_no", "copies", F.col("weight").alias("real_weight"), fake(level - ieee_divide(F.col("weight"), F.col("copies"))).alias("fake_weight"), F.lit(False).alias("is_dummy"))
    rest = rows.agg(F.max("_b").alias("_b"), F.sum("copies").alias("_c"))
    dummy = rest.select(F.col("_b").alias("bucket_no"), (F.ceil(F.col("_b") * F.lit(overhead)) - F.col("_c")).cast("long").alias("copies"), F.lit(0.0).alias("real_weight"), fake(level).alias("fake_weight"), F.lit(True).alias("is_dummy"))
    return real.unionByName(dummy)


# -- scans
def scan(records: DataFrame, lower=None, upper=None, reverse=False, most=None) -> DataFrame:
    """Records in order of key from lower (inclusive) to upper (exclusive), or backwards; the first `most` of them if given."""
    if lower is not None:
        records = records.filter(F.col("key") >= lower)
    if upper is not None:
        records = records.filter(F.col("key") < upper)
    out = records.orderBy(F.col("key").desc() if reverse else F.col("key").asc(), F.desc("ts"), "op", "val")
    return out if most is None else out.limit(most)


def neighbours(keys: DataFrame, key: str, cell: int) -> DataFrame:
    """Each distinct key with the key before and the key after it: windows inside cells, and the cells' first and last keys across them."""
    k = keys.select(F.col(key).alias("key")).distinct().withColumn("_c", F.floor(F.col("key") / cell))
    ends = k.groupBy("_c").agg(F.min("key").alias("_lo"), F.max("key").alias("_hi"))
    by = Window.orderBy("_c")
    ends = ends.select("_c", F.lag("_hi").over(by).alias("_before"), F.lead("_lo").over(by).alias("_after"))
    w = Window.partitionBy("_c").orderBy("key")
    inside = k.withColumn("_p", F.lag("key").over(w)).withColumn("_n", F.lead("key").over(w))
    return inside.join(ends, "_c").select("key", F.coalesce("_p", "_before").alias("prev"), F.coalesce("_n", "_after").alias("next"))


def prefix_domain(value: Column, n: int):
    """(fixed, capped): the fixed prefix is null for values shorter than n, the capped one is the whole of them."""
    return F.when(F.length(value) >= n, F.substring(value, 1, n)), F.substring(value, 1, n)


# -- versions
def history(versions: DataFrame, ts: str, since, until) -> DataFrame:
    """All versions with since <= ts <= until, as an iterator with a start time gives them."""
    return versions.filter(F.col(ts).between(since, until))


def single_deletes(versions: DataFrame) -> DataFrame:
    """What is left when each single delete cancels the newest older put of its key; versions (key, seq, op, value), op put or single_delete.

    A single delete that finds a put directly below goes with it, by the contract that a key is not written over; any
    other single delete stays, as it may cancel a put in an older run.
    """
    w = Window.partitionBy("key").orderBy("seq")
    v = versions.withColumn("_below", F.lag("op").over(w)).withColumn("_above", F.lead("op").over(w))
    gone = ((F.col("op") == "single_delete") & F.coalesce(F.col("_below") == "put", F.lit(False))) | ((F.col("op") == "put") & F.coalesce(F.col("_above") == "single_delete", F.lit(False)))
    return v.filter(~gone).drop("_below", "_above")


def search_levels(*levels: DataFrame) -> DataFrame:
    """The newest record of each key over an incoming batch and the levels below it; the lower a level's number the newer it is. Deletes hide older records."""
    every = levels[0].withColumn("_level", F.lit(0))
    for i, x in enumerate(levels[1:], 1):
        every = every.unionByName(x.withColumn("_level", F.lit(i)))
    top = every.groupBy("key").agg(F.min_by(F.struct("op", "ts", "val", "_level"), F.struct("_level", (-F.col("ts")).alias("t"), (-F.col("op")).alias("o"), (-F.col("val")).alias("v"))).alias("x"))
    return top.filter(F.col("x.op") != 2).select("key", F.col("x._level").alias("level"), F.col("x.ts").alias("ts"), F.col("x.val").alias("val"))


def wal_filter(log: DataFrame, seq: str, ignore: Column, stop: Column) -> DataFrame:
    """Records that recovery replays: those before the first one that stops it, without the ignored ones."""
    first = log.filter(stop).agg(F.min(seq).alias("_stop"))
    return log.crossJoin(F.broadcast(first)).filter((F.col("_stop").isNull() | (F.col(seq) < F.col("_stop"))) & ~F.coalesce(ignore, F.lit(False))).drop("_stop")


# -- table files
def table_properties(bucketed: DataFrame) -> DataFrame:
    """What a properties collector keeps of each file: entries, deletions, key bytes, oldest and newest time, and a checksum over the sorted rows."""
    row = F.concat_ws("|", F.col("key").cast("string"), F.col("op").cast("string"), F.col("ts").cast("string"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("key", "ts", "op", row.alias("r")))), lambda x: x["r"])  # a bucket holds a fixed number of rows
    return bucketed.groupBy("bucket_no").agg(
        F.count("*").alias("entries"), F.sum((F.col("op") == 2).cast("long")).alias("deletions"), F.sum(F.length(F.col("key").cast("string"))).cast("long").alias("key_bytes"),
        F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.md5(F.concat_ws("\n", rows)).alias("checksum"),
    )


def delete_density(bucketed: DataFrame, window: int, deletions: int, ratio: float) -> DataFrame:
    """Files to be rewritten: some `window` consecutive entries hold at least `deletions` deletes, or their share is at least `ratio`."""
    w = Window.partitionBy("bucket_no").orderBy("key", F.desc("ts"), "op", "val").rowsBetween(1 - window, 0)
    dead = bucketed.withColumn("_d", (F.col("op") == 2).cast("long"))
    by = dead.withColumn("_w", F.sum("_d").over(w)).groupBy("bucket_no").agg(F.max("_w").alias("densest"), F.sum("_d").alias("_n"), F.count("*").alias("_all"))
    return by.select("bucket_no", "densest", (F.col("_n") / F.col("_all")).alias("ratio")).filter((F.col("densest") >= deletions) | (F.col("ratio") >= ratio))


# -- coding
def varint_hex(value: Column) -> Column:
    """Hexadecimal of a non-negative number in groups of seven bits, the lowest first, all but the last marked."""
    groups = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double")) / 7).cast("int")))
    last = F.element_at(groups, -1)
    byte = lambda i: F.floor(value / F.pow(F.lit(128.0), i)).cast("long").bitwiseAND(F.lit(127)) + F.when(i < last, 128).otherwise(0)
    return F.array_join(F.transform(groups, lambda i: F.lpad(F.lower(F.hex(byte(i))), 2, "0")), "")


# -- conditions
def conditions(stats: DataFrame, entity: str, name: str, value: str, names, expression: str) -> DataFrame:
    """Entities whose statistics, one column for each name (0 where there is none), fulfil an SQL expression."""
    wide = stats.groupBy(entity).pivot(name, list(names)).agg(F.sum(value)).na.fill(0, list(names))
    return wide.filter(F.expr(expression))
