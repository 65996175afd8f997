"""Queries on a key-value store's noise, scans, versions, draws, table files, merges, coding and conditions."""

from pyspark.sql import Window, functions as F

from . import BKT, CAPACITY, CELL, REC, _qlog, _recs, _vers
from ..functions import geometric_weights, hash_uniform
from ..operators import bucket_weights, bucketise, overlap, running, signed_round, tags
from ..operators import store as ops
from ..operators.layers import floor_lookup
from ..sources import table
from ._registry import query

U = "('0x' || substr(md5('17:' || {}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"
LOADS = "h AS (SELECT floor(epoch(ts) / 3600)::BIGINT AS bin, count(*) AS load FROM events GROUP BY 1)"
BIN = 8  # capacity of a bin


def _loads(s, d):
    return table(s, d, "events").groupBy(F.floor(F.unix_timestamp("ts") / 3600).alias("bin")).agg(F.count("*").alias("load"))


# -- noise and loads
@query(f"WITH {LOADS}, t AS (SELECT *, row_number() OVER (ORDER BY bin) AS t, sum(load) OVER (ORDER BY bin)::BIGINT AS s FROM h), e AS (SELECT t, (t >> i) << i AS e FROM t, range(0, 40) r(i) WHERE (t >> i) & 1 = 1), u AS (SELECT t, {U.format('e')} AS u FROM e), n AS (SELECT t, sum(-sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5))) AS noise FROM u GROUP BY t), x AS (SELECT bin, load, s, greatest(s - {BIN}, least(greatest(floor(s + noise), 0), s + {BIN}), 0)::BIGINT AS x FROM t JOIN n USING (t)) SELECT bin, load, max(x) OVER (ORDER BY bin) AS noisy, abs(s - max(x) OVER (ORDER BY bin)) AS error FROM x")
def noisy_prefix_sums(s, d):
    return ops.noisy_prefixes(_loads(s, d), "bin", "load", 1.0, BIN)


@query(f"WITH {LOADS}, n AS (SELECT floor(sum(load) / 2)::BIGINT AS total FROM h) SELECT bin, load, greatest(0, least(load, total - (sum(load) OVER (ORDER BY bin) - load)))::BIGINT AS taken FROM h, n")
def capped_bin_loads(s, d):
    h = _loads(s, d)
    total = h.agg(F.floor(F.sum("load") / 2).alias("total"))
    return ops.capped_loads(h.crossJoin(F.broadcast(total)), "bin", "load", F.col("total")).select("bin", "load", "taken")


@query(f"WITH w AS (SELECT i, (1 - exp(-1::DOUBLE)) / (1 + exp(-1::DOUBLE) - 2 * exp(-{BIN // 2 + 1}::DOUBLE)) * exp(-(abs(i - {BIN // 2}) * (abs(i - {BIN // 2}) + 1) // 2)::DOUBLE) AS w FROM range(0, {BIN + 1}) r(i)), c AS (SELECT i, sum(w) OVER (ORDER BY i) / sum(w) OVER () AS upto FROM w), e AS (SELECT DISTINCT floor(epoch(ts) / 3600)::BIGINT AS bin FROM events) SELECT bin, (SELECT min(i) FROM c WHERE upto > {U.format('bin')}) AS load FROM e")
def truncated_geometric_samples(s, d):
    w = geometric_weights(BIN, 1.0)
    upto = [sum(w[: i + 1]) / sum(w) for i in range(BIN + 1)]
    u, load = hash_uniform("bin"), F.lit(BIN)
    for i in reversed(range(BIN)):
        load = F.when(u < upto[i], F.lit(i)).otherwise(load)
    return table(s, d, "events").select(F.floor(F.unix_timestamp("ts") / 3600).alias("bin")).distinct().withColumn("load", load.cast("long"))


@query("WITH g AS (SELECT unnest([0.001, 0.0025, 0.005, 0.01, 0.02]) AS selectivity), c AS (SELECT unnest(range(256, 2561, 256)) AS capacity), l AS (SELECT unnest([256, 512, 1024, 2048, 4096]) AS \"lambda\") SELECT selectivity::DOUBLE AS selectivity, capacity, \"lambda\"::BIGINT AS \"lambda\", floor(selectivity::DOUBLE * 999999)::BIGINT AS range_len, ceil(1000000 * selectivity::DOUBLE / 2 / capacity * 2.5)::BIGINT AS batch, 1000000 // capacity * capacity AS records, round(2.0::DOUBLE * capacity / (64 * (1 - 1 / (ln(\"lambda\") * ln(\"lambda\")))), 9) AS bin_factor, round(exp(-ln(\"lambda\") * ln(\"lambda\")), 12) AS delta, (capacity + 20 + 15) // 16 * 16 AS aligned FROM g, c, l")
def parameter_grid(s, d):
    """Range length, batch size, records rounded to buckets, bins for each bucket, failure probability and aligned size, over the grid of parameters."""
    each = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    g = s.range(1).select(each([0.001, 0.0025, 0.005, 0.01, 0.02]).alias("selectivity")).withColumn("capacity", F.explode(F.sequence(F.lit(256), F.lit(2560), F.lit(256)).cast("array<bigint>"))).withColumn("lambda", F.explode(F.array(*[F.lit(x).cast("long") for x in (256, 512, 1024, 2048, 4096)])))
    log = F.log(F.col("lambda").cast("double"))
    return g.select(
        "selectivity", "capacity", "lambda", F.floor(F.col("selectivity") * 999999).alias("range_len"), F.ceil(1000000 * F.col("selectivity") / 2 / F.col("capacity") * 2.5).alias("batch"),
        (F.floor(F.lit(1000000) / F.col("capacity")) * F.col("capacity")).cast("long").alias("records"), F.round(2.0 * F.col("capacity") / (64 * (1 - 1 / (log * log))), 9).alias("bin_factor"),
        F.round(F.exp(-log * log), 12).alias("delta"), (F.floor((F.col("capacity") + 35) / 16) * 16).cast("long").alias("aligned"),
    )


# -- draws
WEIGHTS = f"{BKT}, w AS (SELECT bucket_no, 1 - (2*\"left\" - 1 - least(101, \"left\" - 1)) / (2.0::DOUBLE*1000000 - 100) * least(101, \"left\" - 1) / 101.0::DOUBLE - (2000000 - 2*\"right\" + 1 - least(101, 1000000 - \"right\")) / (2.0::DOUBLE*1000000 - 100) * least(101, 1000000 - \"right\") / 101.0::DOUBLE AS w FROM t)"


def _weights(s, d):
    return bucket_weights(tags(bucketise(_recs(s, d), CAPACITY)), 1, 1000000, 100)


@query(f"WITH {WEIGHTS}, x AS (SELECT bucket_no, w / sum(w) OVER () AS weight, count(*) OVER () AS b FROM w), c AS (SELECT *, ceil(weight * b / (1 / 0.5::DOUBLE))::BIGINT AS copies FROM x) SELECT bucket_no, copies, round(weight, 9) AS real_weight, round((2.0::DOUBLE / b - weight / copies) / (3.0::DOUBLE - 1), 9) + 0.0 AS fake_weight, false AS is_dummy FROM c UNION ALL SELECT max(b), (ceil(max(b) * 1.5) - sum(copies))::BIGINT, 0.0, round((2.0::DOUBLE / max(b)) / (3.0::DOUBLE - 1), 9), true FROM c")
def replica_weights(s, d):
    out = ops.replica_weights(_weights(s, d).select("bucket_no", "weight"), 1.5)
    return out.select("bucket_no", "copies", signed_round(F.col("real_weight"), 9).alias("real_weight"), (F.round("fake_weight", 9) + 0.0).alias("fake_weight"), "is_dummy")


@query(f"WITH {BKT}, p AS (SELECT c_custkey AS draw, {U.format('c_custkey')} AS u FROM customer), c AS (SELECT bucket_no, floor((sum(n) OVER (ORDER BY bucket_no) - n) / (sum(n) OVER ())::DOUBLE * 1099511627776)::BIGINT AS lo FROM t) SELECT draw, bucket_no FROM (SELECT draw, floor(u * 1099511627776)::BIGINT AS pos FROM p) z ASOF JOIN c ON z.pos >= c.lo")
def weighted_draws(s, d):
    """A bucket for each draw, by the records it holds: the smallest one whose running weight is above the draw."""
    draws = table(s, d, "customer").select(F.col("c_custkey").alias("draw"), hash_uniform("c_custkey").alias("u"))
    return ops.weighted_pick(draws, "u", tags(bucketise(_recs(s, d), CAPACITY)).select("bucket_no", "n"), "bucket_no", "n", "bucket_no").select("draw", "bucket_no")


ROUND = 64  # draws of a round


@query(f"WITH {BKT}, q AS (SELECT c_custkey AS qid, c_custkey * 10 AS \"left\", c_custkey * 10 + 50 AS \"right\" FROM customer), p AS (SELECT qid, bucket_no FROM q JOIN t ON q.\"left\" <= t.\"right\" AND q.\"right\" >= t.\"left\"), k AS (SELECT bucket_no, 2 * count(*) AS w FROM p GROUP BY 1), c AS (SELECT bucket_no, floor((sum(w) OVER (ORDER BY bucket_no) - w) / (sum(w) OVER ())::DOUBLE * 1099511627776)::BIGINT AS lo FROM k), dr AS (SELECT i AS draw, {U.format('i')} < 0.5 AS is_real, floor({U.format('(i + 1000)')} * 1099511627776)::BIGINT AS pos FROM range(0, {ROUND}) r(i)), a AS (SELECT bucket_no, floor((bucket_no)::DOUBLE / (SELECT count(*) FROM t) * 1099511627776)::BIGINT AS lo FROM t), g AS (SELECT bucket_no FROM dr ASOF JOIN c ON dr.pos >= c.lo WHERE is_real UNION SELECT bucket_no FROM dr ASOF JOIN a ON dr.pos >= a.lo WHERE NOT is_real), z AS (SELECT qid, count(*) AS cnt, count(g.bucket_no) AS served FROM p LEFT JOIN g USING (bucket_no) GROUP BY 1) SELECT qid, served, cnt - served AS outstanding FROM z WHERE served > 0")
def search_round(s, d):
    """One round of the search loop: half of the draws real, by pending weight, half fake, over all buckets alike; both serve what is pending on the buckets they read."""
    t = tags(bucketise(_recs(s, d), CAPACITY))
    pending = overlap(_qlog(s, d), t, CELL)
    draws = s.range(ROUND).select(F.col("id").alias("draw"), (hash_uniform("id") < 0.5).alias("real"), hash_uniform(F.col("id") + 1000).alias("u"))
    real = ops.weighted_pick(draws.filter("real"), "u", pending.groupBy("bucket_no").agg((2 * F.count("*")).alias("w")), "bucket_no", "w", "bucket_no")
    fake = ops.weighted_pick(draws.filter("not real"), "u", t.select("bucket_no", F.lit(1).alias("w")), "bucket_no", "w", "bucket_no")
    read = real.select("bucket_no").union(fake.select("bucket_no")).distinct().withColumn("_hit", F.lit(1))  # no more than draws
    left = pending.join(F.broadcast(read), "bucket_no", "left").groupBy("qid").agg(F.count("*").alias("cnt"), F.count("_hit").alias("served"))
    return left.filter("served > 0").select("qid", "served", (F.col("cnt") - F.col("served")).alias("outstanding"))


@query(f"WITH {BKT} SELECT bucket_no, row_number() OVER (ORDER BY ('0x' || substr(md5('17:' || bucket_no), 1, 15))::BIGINT, bucket_no) - 1 AS position FROM t")
def replica_shuffle(s, d):
    """Buckets in the order of a keyed hash, numbered without one global window."""
    b = tags(bucketise(_recs(s, d), CAPACITY)).select("bucket_no", F.conv(F.substring(F.md5(F.concat(F.lit("17:"), F.col("bucket_no").cast("string"))), 1, 15), 16, 10).cast("long").alias("h"))
    return running(b, "h", ("bucket_no",), F.lit(1).cast("long"), "position").select("bucket_no", (F.col("position") - 1).alias("position"))


# -- scans
@query(f"WITH {REC} SELECT key, op, ts, val FROM r WHERE key >= 1000 AND key < 5000 ORDER BY key, ts DESC, op, val LIMIT 500")
def bounded_scan(s, d):
    return ops.scan(_recs(s, d), 1000, 5000, most=500)


@query(f"WITH {REC} SELECT key, op, ts, val FROM r WHERE key < 5000 ORDER BY key DESC, ts DESC, op, val LIMIT 300")
def reverse_scan(s, d):
    return ops.scan(_recs(s, d), upper=5000, reverse=True, most=300)


@query(f"WITH {REC} SELECT key, op, ts, val FROM r")
def full_scan(s, d):
    return ops.scan(_recs(s, d))


@query("WITH k AS (SELECT DISTINCT o_custkey AS key FROM orders) SELECT key, lag(key) OVER (ORDER BY key) AS prev, lead(key) OVER (ORDER BY key) AS next FROM k")
def next_and_prev(s, d):
    return ops.neighbours(table(s, d, "orders"), "o_custkey", CELL)


@query("SELECT c_custkey AS key, c_name AS name FROM customer WHERE starts_with(c_name, 'Customer#0000000')")
def prefix_scan(s, d):
    return table(s, d, "customer").filter(F.col("c_name").startswith("Customer#0000000")).select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))


@query("SELECT p_partkey AS key, CASE WHEN length(p_name) >= 12 THEN substr(p_name, 1, 12) END AS fixed, substr(p_name, 1, 12) AS capped, p_name AS whole FROM part")
def prefix_transforms(s, d):
    fixed, capped = ops.prefix_domain(F.col("p_name"), 12)
    return table(s, d, "part").select(F.col("p_partkey").alias("key"), fixed.alias("fixed"), capped.alias("capped"), F.col("p_name").alias("whole"))


@query("SELECT 'orders' AS family, o_custkey AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'events', user_id, count(*) FROM events GROUP BY 2")
def family_iterators(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n")).withColumn("family", F.lit("orders"))
    e = table(s, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n")).withColumn("family", F.lit("events"))
    return o.unionByName(e).select("family", "key", "n")


@query("SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def key_may_exist(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("key")).join(table(s, d, "orders").select(F.col("o_custkey").alias("key")), "key", "left_semi")


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), k AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer) SELECT position, key, n FROM k JOIN c ON key = user_id")
def key_space_accesses(s, d):
    """Accessed keys with their place in the whole key space."""
    k = running(table(s, d, "customer").select(F.col("c_custkey").alias("key")), "key", (), F.lit(1).cast("long"), "position")
    n = table(s, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"))
    return k.join(n, "key").select((F.col("position") - 1).alias("position"), "key", "n")


@query(f"WITH {BKT} SELECT bucket_no, \"left\", \"right\" FROM t WHERE \"left\" <= 40000")
def domain_cut(s, d):
    return tags(bucketise(_recs(s, d), CAPACITY)).filter(F.col("left") <= 40000).select("bucket_no", "left", "right")


# -- versions and levels
@query("SELECT o_custkey AS key, o_orderdate AS ts, o_orderkey AS seq, o_totalprice AS value FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
def version_history(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return ops.history(o, "ts", F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp"))


SD = "v AS (SELECT l_orderkey AS key, l_linenumber AS seq, max(CASE WHEN l_returnflag = 'R' THEN 'single_delete' ELSE 'put' END) AS op, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {SD}, x AS (SELECT *, lag(op) OVER w AS below, lead(op) OVER w AS above FROM v WINDOW w AS (PARTITION BY key ORDER BY seq)) SELECT key, seq, op, value FROM x WHERE NOT (op = 'single_delete' AND coalesce(below = 'put', false)) AND NOT (op = 'put' AND coalesce(above = 'single_delete', false))")
def single_delete(s, d):
    op = F.when(F.col("l_returnflag") == "R", "single_delete").otherwise("put")
    v = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("seq")).agg(F.max(op).alias("op"), F.max("l_extendedprice").alias("value"))
    return ops.single_deletes(v)


@query(f"WITH {REC}, l AS (SELECT key % 5000 AS key, CASE WHEN ts >= 915148800 THEN 0 WHEN ts >= 852076800 THEN 1 ELSE 2 END AS level, op, ts, val FROM r) SELECT key, level, ts, val FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY level, ts DESC, op DESC, val DESC) = 1) WHERE op <> 2")
def search_levels(s, d):
    """An incoming batch over two older levels: the newest record of a key in the newest level that has it."""
    r = _recs(s, d).withColumn("key", F.col("key") % 5000)
    return ops.search_levels(r.filter("ts >= 915148800"), r.filter("ts >= 852076800 AND ts < 915148800"), r.filter("ts < 852076800"))


@query("WITH l AS (SELECT event_id, event_type, value FROM events), x AS (SELECT min(event_id) AS stop FROM l WHERE event_type = 'error' AND value > 99) SELECT event_id, event_type FROM l, x WHERE (stop IS NULL OR event_id < stop) AND NOT coalesce(event_type = 'view' AND value < 50, false)")
def wal_filter(s, d):
    e = table(s, d, "events").select("event_id", "event_type", "value")
    return ops.wal_filter(e, "event_id", (F.col("event_type") == "view") & (F.col("value") < 50), (F.col("event_type") == "error") & (F.col("value") > 99)).select("event_id", "event_type")


@query(f"WITH {REC}, f AS (SELECT c_custkey AS key, 1 AS op, 2000000000::BIGINT AS ts, c_acctbal AS val FROM customer), a AS (SELECT * FROM r UNION ALL SELECT * FROM f) SELECT key, ts, val FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, op DESC, val DESC) = 1) WHERE op <> 2")
def ingest_files(s, d):
    """Files taken in above all that is stored: their records hide older ones."""
    from ..operators import latest

    f = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(1).alias("op"), F.lit(2000000000).cast("long").alias("ts"), F.col("c_acctbal").alias("val"))
    return latest(_recs(s, d).unionByName(f))


@query(f"WITH {REC} SELECT key, op, ts, val FROM r WHERE key >= 2000 AND key < 9000")
def clip(s, d):
    return _recs(s, d).filter((F.col("key") >= 2000) & (F.col("key") < 9000))


# -- table files
PROPS = f"{BKT}, pr AS (SELECT bucket_no, count(*) AS entries, sum(CASE WHEN op = 2 THEN 1 ELSE 0 END)::BIGINT AS deletions, sum(length(key::VARCHAR))::BIGINT AS key_bytes, min(ts) AS oldest, max(ts) AS newest, md5(string_agg(key || '|' || op || '|' || ts, chr(10) ORDER BY key, ts, op)) AS checksum FROM b GROUP BY 1)"


@query(f"WITH {PROPS} SELECT * FROM pr")
def table_properties(s, d):
    return ops.table_properties(bucketise(_recs(s, d), CAPACITY))


@query(f"WITH {PROPS} SELECT key, op, ts, val FROM b WHERE bucket_no IN (SELECT bucket_no FROM pr WHERE deletions >= 15)")
def table_filter(s, d):
    """Records of the files whose properties pass: the properties decide, the files' rows are only read then."""
    b = bucketise(_recs(s, d), CAPACITY)
    return b.join(ops.table_properties(b).filter("deletions >= 15").select("bucket_no"), "bucket_no", "left_semi").select("key", "op", "ts", "val")


@query(f"WITH {BKT}, w AS (SELECT bucket_no, op, sum(CASE WHEN op = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY bucket_no ORDER BY key, ts DESC, op, val ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS x FROM b) SELECT bucket_no, max(x)::BIGINT AS densest, sum(CASE WHEN op = 2 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS ratio FROM w GROUP BY 1 HAVING max(x) >= 5 OR sum(CASE WHEN op = 2 THEN 1 ELSE 0 END) / count(*)::DOUBLE >= 0.09")
def delete_density(s, d):
    return ops.delete_density(bucketise(_recs(s, d), CAPACITY), 32, 5, 0.09)


@query(f"WITH {BKT} SELECT bucket_no, CASE WHEN max(ts) < 852076800 THEN 'cold' WHEN min(ts) < 852076800 THEN 'warm' ELSE 'hot' END AS tier FROM b GROUP BY 1")
def placement_by_age(s, d):
    tier = F.when(F.max("ts") < 852076800, "cold").when(F.min("ts") < 852076800, "warm").otherwise("hot")
    return bucketise(_recs(s, d), CAPACITY).groupBy("bucket_no").agg(tier.alias("tier"))


# -- merges
@query("SELECT l_orderkey AS key, string_agg(x::VARCHAR, ',' ORDER BY x) AS merged FROM (SELECT l_orderkey, unnest([l_partkey, l_suppkey]) AS x FROM lineitem) GROUP BY 1")
def merge_sorted_lists(s, d):
    """Sorted comma lists of numbers merged into one: an operand is a list, duplicates stay."""
    lists = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.concat_ws(",", F.array_sort(F.array("l_partkey", "l_suppkey"))).alias("list"))
    numbers = lists.select("key", F.explode(F.split("list", ",").cast("array<bigint>")).alias("x"))
    return numbers.groupBy("key").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("x")), lambda v: v.cast("string"))).alias("merged"))


@query("WITH o AS (SELECT l_orderkey AS key, l_partkey AS a, l_suppkey AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem), f AS (SELECT key, unnest([a, b]) AS x, unnest([0, 1]) AS i, r FROM o WHERE r <= 3) SELECT key, string_agg(x::VARCHAR, ',' ORDER BY r, i) AS last3 FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY r, i) <= 3) GROUP BY 1")
def merge_last3_of_lists(s, d):
    """The last three elements over lists as operands, the newest list first; a rank keeps three operands of a key, so no list is unbounded."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("a"), F.desc("b"))
    o = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    kept = o.withColumn("_r", F.row_number().over(w)).filter("_r <= 3").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_r", "a", "b"))).alias("l"))
    flat = F.slice(F.flatten(F.transform("l", lambda x: F.array(x["a"], x["b"]))), 1, 3)
    return kept.select("key", F.concat_ws(",", F.transform(flat, lambda x: x.cast("string"))).alias("last3"))


@query("SELECT p_size AS key, max(p_name) AS value FROM part GROUP BY 1")
def merge_max_bytes(s, d):
    """The bytewise greatest operand; a key without operands has none."""
    return table(s, d, "part").groupBy(F.col("p_size").alias("key")).agg(F.max("p_name").alias("value"))


@query("WITH n AS (SELECT max(floor(epoch(ts)))::BIGINT AS now FROM events) SELECT user_id AS key, count(*) AS operands, sum(length(event_type))::BIGINT AS value, any_value(now) AS stamp FROM events, n WHERE NOT (floor(epoch(ts))::BIGINT + 2592000 < now) GROUP BY 1")
def merge_with_ttl(s, d):
    """Operands without their times are merged, and the result is stamped anew; stale ones are gone."""
    e = table(s, d, "events").withColumn("t", F.unix_timestamp("ts"))
    live = e.crossJoin(F.broadcast(e.agg(F.max("t").alias("now")))).filter(F.col("t") + 2592000 >= F.col("now"))
    return live.groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("operands"), F.sum(F.length("event_type")).alias("value"), F.max("now").alias("stamp"))


@query("SELECT floor(epoch(ts) / 86400)::BIGINT * 86400 AS \"from\", count(*) AS n FROM events GROUP BY 1")
def ttl_histogram(s, d):
    return table(s, d, "events").groupBy((F.floor(F.unix_timestamp("ts") / 86400) * 86400).alias("from")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS key, c_custkey AS id, c_mktsegment AS value FROM customer WHERE length(c_mktsegment) > 0")
def remove_empty_values(s, d):
    c = table(s, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    return c.filter(F.length("value") > 0)


@query(f"WITH {REC} SELECT key || ' ==> ' || CASE op WHEN 2 THEN 'delete' ELSE 'insert' END || ' ' || ts AS line FROM r")
def dump_rows(s, d):
    return _recs(s, d).select(F.concat(F.col("key").cast("string"), F.lit(" ==> "), F.when(F.col("op") == 2, "delete").otherwise("insert"), F.lit(" "), F.col("ts").cast("string")).alias("line"))


# -- coding and order
@query("WITH k AS (SELECT l_orderkey * 1000 + l_linenumber AS n FROM lineitem), g AS (SELECT DISTINCT n, greatest(0, floor(log2(greatest(n, 1)) / 7))::BIGINT AS last FROM k) SELECT n, string_agg(lower(right('0' || hex(((n >> (7 * i)) & 127) + CASE WHEN i < last THEN 128 ELSE 0 END), 2)), '' ORDER BY i) AS code FROM (SELECT n, last, unnest(range(0, last + 1)) AS i FROM g) GROUP BY n")
def varint_coding(s, d):
    n = table(s, d, "lineitem").select((F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("n")).distinct()
    return n.select("n", ops.varint_hex(F.col("n")).alias("code"))


@query("SELECT c_custkey AS key, lower(hex(c_mktsegment)) AS hex, lower(right('0' || hex(length(c_mktsegment)), 2)) || lower(hex(c_mktsegment)) AS prefixed FROM customer")
def length_prefixed(s, d):
    h = F.lower(F.hex(F.col("c_mktsegment").cast("binary")))
    return table(s, d, "customer").select(F.col("c_custkey").alias("key"), h.alias("hex"), F.concat(ops.varint_hex(F.octet_length("c_mktsegment").cast("long")), h).alias("prefixed"))


@query("SELECT o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders")
def timestamped_order(s, d):
    """Versions of a user key in the order of a comparator with times: the newest first."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.row_number().over(w).alias("rank"))


# -- traces and conditions
@query("WITH m AS (SELECT event_id AS seq, floor(epoch(ts))::BIGINT AS pos FROM events WHERE event_type = 'click'), f AS (SELECT pos, max(seq) AS seq FROM m GROUP BY 1), p AS (SELECT o_orderkey AS id, o_custkey * 1800 + 1704067000 AS t FROM orders) SELECT id, seq FROM p ASOF LEFT JOIN f ON p.t >= f.pos")
def time_to_sequence(s, d):
    """The newest mapped sequence number at or before a time: the inverse of sequence_to_time."""
    m = table(s, d, "events").filter("event_type = 'click'").select(F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("seq"))
    p = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 1800 + 1704067000).alias("t"))
    return floor_lookup(p, m, "t", "at", "seq", 86400).select("id", "seq")


@query("WITH q AS (SELECT event_type, floor(epoch(ts))::BIGINT AS second, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS seconds, max(n) AS peak, round(sum(n) / (max(second) - min(second) + 1)::DOUBLE, 9) AS mean FROM q GROUP BY 1")
def ops_per_second(s, d):
    q = table(s, d, "events").groupBy("event_type", F.unix_timestamp("ts").alias("second")).agg(F.count("*").alias("n"))
    return q.groupBy("event_type").agg(F.count("*").alias("seconds"), F.max("n").alias("peak"), F.round(F.sum("n") / (F.max("second") - F.min("second") + 1), 9).alias("mean"))


@query("WITH h AS (SELECT event_type, length(props) // 2 AS interval, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY interval) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM h) SELECT event_type, min(interval) * 2 + 1.0::DOUBLE AS median FROM c WHERE 2 * cum >= total GROUP BY 1")
def value_size_median(s, d):
    """The median of value sizes, estimated as the middle of its interval."""
    h = table(s, d, "events").groupBy("event_type", F.floor(F.length("props") / 2).alias("interval")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type")
    c = h.withColumn("cum", F.sum("n").over(w.orderBy("interval"))).withColumn("total", F.sum("n").over(w))
    return c.filter("2 * cum >= total").groupBy("event_type").agg((F.min("interval") * 2 + 1.0).alias("median"))


@query("WITH k AS (SELECT c_custkey // 32 AS block, count(*) AS keys FROM customer GROUP BY 1), a AS (SELECT user_id // 32 AS block, count(DISTINCT user_id) AS used FROM events GROUP BY 1) SELECT floor(10.0::DOUBLE * coalesce(used, 0) / keys)::BIGINT AS tenth, count(*) AS blocks FROM k LEFT JOIN a USING (block) GROUP BY 1")
def spatial_locality(s, d):
    """Blocks by the share of their keys that were accessed, in tenths."""
    k = table(s, d, "customer").groupBy(F.floor(F.col("c_custkey") / 32).alias("block")).agg(F.count("*").alias("keys"))
    a = table(s, d, "events").groupBy(F.floor(F.col("user_id") / 32).alias("block")).agg(F.countDistinct("user_id").alias("used"))
    return k.join(a, "block", "left").groupBy(F.floor(F.lit(10.0) * F.coalesce("used", F.lit(0)) / F.col("keys")).alias("tenth")).agg(F.count("*").alias("blocks"))


@query("WITH g AS (SELECT event_type, (floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id))))::DOUBLE AS gap FROM events) SELECT event_type, count(*) AS n, round(avg(gap), 6) AS mean, round(stddev_pop(gap), 6) AS std, round(quantile_cont(gap, 0.25), 6) AS q1, round(quantile_cont(gap, 0.5), 6) AS median, round(quantile_cont(gap, 0.75), 6) AS q3 FROM g WHERE gap IS NOT NULL GROUP BY 1")
def latency_summary(s, d):
    """Completion less arrival, where an event completes what the user's event before it began: mean, deviation and box-plot quantiles."""
    t = F.unix_timestamp("ts")
    gap = (t - F.lag(t).over(Window.partitionBy("user_id").orderBy("event_id"))).cast("double")
    g = table(s, d, "events").withColumn("gap", gap).filter("gap IS NOT NULL")
    q = lambda p, n: F.round(F.percentile("gap", F.lit(p)), 6).alias(n)
    return g.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 6).alias("mean"), F.round(F.stddev_pop("gap"), 6).alias("std"), q(0.25, "q1"), q(0.5, "median"), q(0.75, "q3"))


KINDS = ("click", "error", "purchase", "view")


@query("WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT user_id, coalesce(sum(n) FILTER (event_type = 'click'), 0)::BIGINT AS click, coalesce(sum(n) FILTER (event_type = 'error'), 0)::BIGINT AS error, coalesce(sum(n) FILTER (event_type = 'purchase'), 0)::BIGINT AS purchase, coalesce(sum(n) FILTER (event_type = 'view'), 0)::BIGINT AS \"view\" FROM s GROUP BY 1) SELECT * FROM w WHERE error > purchase AND click >= 2")
def expression_condition(s, d):
    n = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return ops.conditions(n, "user_id", "event_type", "n", KINDS, "error > purchase AND click >= 2")


@query("SELECT event_type, count(*) AS n FROM events WHERE regexp_matches(props, '\"[a-z]+\": *\"?[0-9a-z]*7') GROUP BY 1")
def log_condition(s, d):
    """Log lines that a regular expression finds, by kind."""
    return table(s, d, "events").filter(F.col("props").rlike('"[a-z]+": *"?[0-9a-z]*7')).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 50 INTERSECT SELECT user_id FROM events WHERE event_type = 'click' GROUP BY 1 HAVING count(*) >= 2 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def rule_conjunction(s, d):
    """Entities on which all conditions of a rule hold: each condition gives its entities once, and the rule joins them."""
    e = table(s, d, "events")
    clicks = e.filter("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 2").select("user_id")
    rich = table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    hit = e.filter("event_type = 'error' AND value > 50").select("user_id").distinct()
    return hit.join(clicks, "user_id", "left_semi").join(rich, "user_id", "left_semi")


@query(f"SELECT event_type, count(*) AS n FROM events WHERE {U.format('user_id')} < 0.1 GROUP BY 1")
def trace_sample(s, d):
    """Down-sampling of a trace by key, so that all accesses to a sampled key stay: a tenth of the keys by hash."""
    return table(s, d, "events").filter(hash_uniform("user_id") < 0.1).groupBy("event_type").agg(F.count("*").alias("n"))
