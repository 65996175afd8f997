"""Operators on layers of stored data: lookups by order, stripes, rewrites, column rows, tombstone pieces, replicas."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import overlap, running


def floor_lookup(probes: DataFrame, entries: DataFrame, at: str, ts: str, value: str, cell: int, descending=False) -> DataFrame:
    """Each probe with `value` of the greatest entry ts <= at (descending: of the smallest ts >= at), else null.

    Windows run inside cells of the ordered domain; what a cell takes over from cells before it
    comes from a table of one row for each cell that is not empty. Of equal ts, the greatest value counts.
    """
    sign = -1 if descending else 1
    kind = dict(entries.dtypes)[value]
    p = probes.withColumn("_x", F.col(at) * sign).withColumn("_probe", F.lit(1)).withColumn("_e", F.lit(None).cast(f"struct<x:bigint,v:{kind}>"))
    e = entries.filter(F.col(ts).isNotNull()).select((F.col(ts) * sign).cast("long").alias("_x"), F.lit(0).alias("_probe"), F.struct((F.col(ts) * sign).cast("long").alias("x"), F.col(value).alias("v")).alias("_e"))
    both = p.unionByName(e, allowMissingColumns=True).withColumn("_cell", F.floor(F.col("_x") / cell))
    tops = both.groupBy("_cell").agg(F.max("_e").alias("_top"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select("_cell", F.last("_top", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy("_cell").orderBy("_x", "_probe", "_e.v").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_in", F.last("_e", ignorenulls=True).over(inside)).filter("_probe = 1")
    return found.join(carried, "_cell", "left").select(*probes.columns, F.coalesce("_in", "_carry")["v"].alias(value))


def stripes(versions: DataFrame, snapshots) -> DataFrame:
    """The newest version of each key in each stripe between snapshots; what a rewrite must keep for them."""
    stripe = sum(((F.col("seq") > n).cast("int") for n in snapshots), F.lit(0))
    newest = versions.groupBy("key", stripe.alias("stripe")).agg(F.max(F.struct("seq", "op", "value")).alias("x"))
    return newest.select("key", "stripe", "x.seq", "x.op", "x.value")


def rewrite(rows: DataFrame, remove: Column, change: Column, value: str, changed: Column) -> DataFrame:
    """Rows that a rewrite keeps, with changed values; an undecided (null) condition keeps the row as it is."""
    kept = rows.filter(~F.coalesce(remove, F.lit(False)))
    return kept.withColumn(value, F.when(F.coalesce(change, F.lit(False)), changed).otherwise(F.col(value)))


def column_rows(cells: DataFrame, tombstones: DataFrame, now: int, ttl: int) -> DataFrame:
    """Merged rows of columns (key, idx, ts, kind, value) under row tombstones (key, ts).

    Of each column the newest cell counts, if it is newer than the newest tombstone of its row; expired
    cells turn into tombstones; rows without columns go. Returns key, idx, kind, value, one row for each column.
    """
    newest = cells.groupBy("key", "idx").agg(F.max(F.struct("ts", "kind", "value")).alias("x"))
    dead = tombstones.groupBy("key").agg(F.max("ts").alias("_dead"))
    live = newest.join(dead, "key", "left").filter(F.col("_dead").isNull() | (F.col("x.ts") > F.col("_dead")))
    kind = F.when((F.col("x.kind") == "expiring") & (F.col("x.ts") + ttl < now), "tombstone").otherwise(F.col("x.kind"))
    return live.select("key", "idx", kind.alias("kind"), F.when(kind != "tombstone", F.col("x.value")).alias("value"))


def fragments(ranges: DataFrame, group: str, cell: int) -> DataFrame:
    """Ranges [begin, end) of a group cut at every end of a range and at cell borders: pieces with their newest rseq."""
    c = F.col("_c")
    cut = ranges.filter("begin < end").withColumn("_c", F.explode(F.sequence(F.floor(F.col("begin") / cell), F.floor((F.col("end") - 1) / cell))))
    cut = cut.select(group, "_c", F.greatest("begin", c * cell).alias("_b"), F.least("end", (c + 1) * cell).alias("_e"), "rseq")
    points = cut.select(group, "_c", F.explode(F.array("_b", "_e")).alias("begin")).distinct()
    pieces = points.withColumn("end", F.lead("begin").over(Window.partitionBy(group, "_c").orderBy("begin"))).filter("end IS NOT NULL")
    met = pieces.join(cut, [group, "_c"]).filter((F.col("_b") <= F.col("begin")) & (F.col("_e") >= F.col("end")))
    return met.groupBy(group, "begin", "end").agg(F.max("rseq").alias("rseq"))


def remap_pending(queries: DataFrame, old: DataFrame, new: DataFrame, cell: int) -> DataFrame:
    """Outstanding buckets of each query (qid, left, right) after a merge of buckets: each (query, old bucket)
    is cut to their common interval and matched with the new tags; qid, cnt, where 0 means complete."""
    o = old.select("bucket_no", F.col("left").alias("_l"), F.col("right").alias("_r"))
    met = overlap(queries, old, cell).join(queries, "qid").join(o, "bucket_no")
    parts = met.select(F.struct("qid", "bucket_no").alias("qid"), F.greatest("left", "_l").alias("left"), F.least("right", "_r").alias("right"))
    matches = overlap(parts, new, cell).groupBy(F.col("qid.qid").alias("qid")).agg(F.count("*").alias("n"))
    return queries.select("qid").join(matches, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("cnt"))


def replica_starts(copies: DataFrame) -> DataFrame:
    """First replica number of each bucket (bucket_no, copies): running totals, less the bucket's own."""
    return running(copies, "bucket_no", (), F.col("copies"), "_upto").withColumn("start", F.col("_upto") - F.col("copies")).drop("_upto")


def smoothing(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Frequency smoothing of keys with counts: replicas ceil(p * keys), fake probability 1/keys - p/replicas, dummies up to 2 * keys."""
    total = counts.agg(F.count("*").alias("_k"), F.sum(n).alias("_t"))
    p = F.col(n) / F.col("_t")
    out = counts.crossJoin(F.broadcast(total)).withColumn("replicas", F.ceil(p * F.col("_k")).cast("long"))
    dummies = out.agg((2 * F.max("_k") - F.sum("replicas")).alias("dummies"))
    return out.crossJoin(F.broadcast(dummies)).select(key, "replicas", (1 / F.col("_k") - p / F.col("replicas")).alias("fake"), "dummies")


def fold_named(operands: DataFrame, base=None) -> DataFrame:
    """Operands (key, seq, fn, value) folded in order of seq, each by its own function: sum, multiply, max or min.

    A change of function folds what came before first; without a base (key, value) the first operand starts
    the stack. An unknown function makes the result null, and `failed` true. A key's operands are
    those since its last rewrite, which bounds the list.
    """
    stack = operands.select("key", F.struct(F.col("seq").cast("long").alias("seq"), "fn", F.col("value").cast("double").alias("value")).alias("x"))
    if base is not None:
        stack = stack.unionByName(base.select("key", F.struct(F.lit(None).cast("long").alias("seq"), F.lit("sum").alias("fn"), F.col("value").cast("double").alias("value")).alias("x")))
    known = ("sum", "multiply", "max", "min")
    lists = stack.groupBy("key").agg(F.array_sort(F.collect_list("x"), _by_seq).alias("_xs"), (~F.min(F.coalesce(F.col("x.fn").isin(*known), F.lit(False)))).alias("failed"))

    def step(acc, x):
        v = x["value"]
        return F.when(x["fn"] == "sum", acc + v).when(x["fn"] == "multiply", acc * v).when(x["fn"] == "max", F.greatest(acc, v)).otherwise(F.least(acc, v))

    folded = F.aggregate(F.slice("_xs", 2, F.greatest(F.size("_xs"), F.lit(1))), F.element_at("_xs", 1)["value"], step)
    return lists.select("key", F.when(~F.col("failed"), folded).alias("value"), "failed")


def _by_seq(a, b):
    """The base (a null seq) first, then by seq, function and value."""
    rank = lambda x: F.struct(F.coalesce(x["seq"], F.lit(-(2**63))).alias("s"), x["fn"].alias("f"), x["value"].alias("v"))
    return F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)


def xor_bytes(operands: DataFrame, key: str, value: str) -> DataFrame:
    """Bytewise exclusive or of the binary operands of a key, shorter ones extended by zeros; nulls and empty ones change nothing.

    Operands are cut to words of four bytes, which tasks combine before the shuffle.
    """
    hexed = operands.select(key, F.hex(F.col(value).cast("binary")).alias("_h"))
    words = hexed.select(key, F.length("_h").alias("_len"), F.posexplode_outer(F.regexp_extract_all("_h", F.lit("(.{1,8})"))).alias("_pos", "_w"))
    part = words.groupBy(key, "_pos").agg(F.bit_xor(F.conv(F.rpad("_w", 8, "0"), 16, 10).cast("long")).alias("_x"), F.max("_len").alias("_len"))
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda s: F.coalesce(F.lpad(F.hex(s["_x"]), 8, "0"), F.lit(""))))
    return part.groupBy(key).agg(F.max("_len").alias("_len"), text.alias("_t")).select(key, F.lower(F.substring("_t", F.lit(1), F.coalesce("_len", F.lit(0)))).alias("hex"))
