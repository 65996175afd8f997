"""Registered queries over the base tables, each with the SQL that gives the same rows."""

from pyspark.sql import Window, functions as F

from ..functions import convolve, geometric_pmf, level_schedule
from ..operators import append_operands, as_of, bucket_weights, bucketise, bursts, conflicts, delete_ranges, last_n, latest, multi_get, overlap, overlay, range_records, replicas, resolve, reuse_gaps, signed_round, sorted_list, tags, transitions
from ..sources import records, table, versions
from ._registry import ORACLE_SQL, QUERIES, query

CAPACITY, CELL, SPAN = 256, 1000, 50

REC = "r AS (SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 2 ELSE 1 END AS op, epoch(o_orderdate)::BIGINT AS ts, o_totalprice AS val FROM orders)"
BKT = REC + f", b AS (SELECT *, (row_number() OVER (ORDER BY key, ts DESC, op, val) - 1) // {CAPACITY} AS bucket_no FROM r), t AS (SELECT bucket_no, min(key) AS \"left\", max(key) AS \"right\", count(*) AS n FROM b GROUP BY 1)"
QLOG = f"q AS (SELECT c_custkey AS qid, c_custkey * 10 AS \"left\", c_custkey * 10 + {SPAN} AS \"right\" FROM customer)"
VER = "v AS (SELECT l_orderkey AS key, l_linenumber AS seq, CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'merge' ELSE 'put' END AS op, l_extendedprice AS value FROM lineitem)"


def _recs(s, d):
    return records(table(s, d, "orders"))


def _vers(s, d):
    return versions(table(s, d, "lineitem"))


def _qlog(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") * 10).alias("left"), (F.col("c_custkey") * 10 + SPAN).alias("right"))


@query(f"WITH {REC} SELECT key, op, ts, val FROM r WHERE key BETWEEN 1000 AND 5000")
def range_search(s, d):
    return _recs(s, d).filter(F.col("key").between(1000, 5000))


@query(f"WITH {REC} SELECT key, op, ts, val FROM r WHERE key = 77")
def point_read(s, d):
    return _recs(s, d).filter(F.col("key") == 77)


@query(f"WITH {BKT} SELECT bucket_no, \"left\", \"right\", n FROM t")
def bucket_tags(s, d):
    return tags(bucketise(_recs(s, d), CAPACITY))


@query(f"WITH {BKT} SELECT bucket_no, key, op, ts, val FROM b WHERE bucket_no IN (SELECT bucket_no FROM t WHERE \"right\" >= 1000 AND \"left\" <= 2000)")
def bucket_pruning(s, d):
    b = bucketise(_recs(s, d), CAPACITY)
    keep = tags(b).filter((F.col("right") >= 1000) & (F.col("left") <= 2000)).select("bucket_no")
    return b.join(keep, "bucket_no", "left_semi").select("bucket_no", "key", "op", "ts", "val")


@query(f"WITH {BKT}, {QLOG} SELECT qid, bucket_no FROM q JOIN t ON q.\"left\" <= t.\"right\" AND q.\"right\" >= t.\"left\"")
def interval_overlap(s, d):
    return overlap(_qlog(s, d), tags(bucketise(_recs(s, d), CAPACITY)), CELL)


@query(f"WITH {BKT}, {QLOG} SELECT bucket_no, count(*) AS pending, 2 * count(*) AS increment_weight, 1 AS constant_weight, power(2.0::DOUBLE, count(*)) AS multiplied_weight FROM q JOIN t ON q.\"left\" <= t.\"right\" AND q.\"right\" >= t.\"left\" GROUP BY 1")
def pending_weights(s, d):
    met = overlap(_qlog(s, d), tags(bucketise(_recs(s, d), CAPACITY)), CELL)
    return met.groupBy("bucket_no").agg(F.count("*").alias("pending"), (2 * F.count("*")).alias("increment_weight"), F.lit(1).alias("constant_weight"), F.pow(F.lit(2.0), F.count("*")).alias("multiplied_weight"))


@query(f"WITH {REC}, {QLOG} SELECT qid, key, op, ts, val FROM q JOIN r ON key BETWEEN q.\"left\" AND q.\"right\"")
def range_containment(s, d):
    return range_records(_qlog(s, d), _recs(s, d), CELL)


@query(f"WITH {BKT}, w AS (SELECT *, 1 - (2*\"left\" - 1 - least(101, \"left\" - 1)) / (2.0::DOUBLE*1000000 - 100) * least(101, \"left\" - 1) / 101.0::DOUBLE - (2000000 - 2*\"right\" + 1 - least(101, 1000000 - \"right\")) / (2.0::DOUBLE*1000000 - 100) * least(101, 1000000 - \"right\") / 101.0::DOUBLE AS w FROM t), x AS (SELECT *, w / sum(w) OVER () AS weight, count(*) OVER () AS nb FROM w) SELECT bucket_no, round(weight, 9) AS weight, ceil(weight * nb / (1.0::DOUBLE))::BIGINT AS copies, round((1.0::DOUBLE / nb - weight / ceil(weight * nb)) / 1.0::DOUBLE, 9) + 0.0 AS fake_weight FROM x")
def bucket_replicas(s, d):
    out = replicas(bucket_weights(tags(bucketise(_recs(s, d), CAPACITY)), 1, 1000000, 100), 2.0)
    return out.select("bucket_no", signed_round(F.col("weight"), 9).alias("weight"), "copies", (F.round("fake_weight", 9) + 0.0).alias("fake_weight"))


@query(f"WITH {REC}, x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, op DESC, val DESC) AS rn FROM r) SELECT key, ts, val FROM x WHERE rn = 1 AND op <> 2")
def latest_version(s, d):
    return latest(_recs(s, d))


RES = VER + ", x AS (SELECT *, max(CASE WHEN op <> 'merge' THEN seq END) OVER (PARTITION BY key) AS e FROM v), z AS (SELECT * FROM x WHERE e IS NULL OR seq > e OR (seq = e AND op = 'put'))"


@query(f"WITH {RES} SELECT key, round(sum(value), 2) AS value, count(*) AS stack FROM z GROUP BY key")
def merge_sum(s, d):
    return resolve(_vers(s, d)).withColumn("value", F.round("value", 2))


@query(f"WITH {RES} SELECT key, max(value) AS value, count(*) AS stack FROM z GROUP BY key")
def merge_max(s, d):
    return resolve(_vers(s, d), F.max)


@query(f"WITH {RES.replace('FROM v)', 'FROM v WHERE seq <= 3)')} SELECT key, round(sum(value), 2) AS value, count(*) AS stack FROM z GROUP BY key")
def snapshot_read(s, d):
    return resolve(_vers(s, d), snapshot=3).withColumn("value", F.round("value", 2))


@query(f"WITH {VER} SELECT key, string_agg(op, ',' ORDER BY seq, op) AS ops, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS sorted_seqs, max_by(op, seq) AS put FROM (SELECT DISTINCT key, seq, op FROM v QUALIFY row_number() OVER (PARTITION BY key, seq ORDER BY op) = 1) GROUP BY key")
def merge_append(s, d):
    one = _vers(s, d).groupBy("key", "seq").agg(F.min("op").alias("op"))
    return one.groupBy("key").agg(append_operands("op", "seq").alias("ops"), sorted_list("seq").alias("sorted_seqs"), F.max_by("op", "seq").alias("put"))


@query(f"WITH {VER}, o AS (SELECT key, seq, min(op) AS op FROM v GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM o) SELECT key, string_agg(op, ',' ORDER BY seq DESC) AS last3 FROM n WHERE rn <= 3 GROUP BY key")
def merge_last3(s, d):
    one = _vers(s, d).groupBy("key", "seq").agg(F.min("op").alias("op"))
    return last_n(one, "key", "op", "seq", "last3")


@query("SELECT l_orderkey AS key, bit_xor(l_partkey) AS x, sum(l_linenumber)::BIGINT AS added FROM lineitem GROUP BY 1")
def merge_xor_add(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.bit_xor("l_partkey").alias("x"), F.sum("l_linenumber").alias("added"))


@query(f"WITH {VER}, rd AS (SELECT s_suppkey * 100 AS b, s_suppkey * 100 + 30 AS e, s_nationkey % 7 AS rs FROM supplier) SELECT key, seq, op, value FROM v WHERE NOT EXISTS (SELECT 1 FROM rd WHERE key >= b AND key < e AND rs > seq)")
def range_delete(s, d):
    r = table(s, d, "supplier").select((F.col("s_suppkey") * 100).alias("begin"), (F.col("s_suppkey") * 100 + 30).alias("end"), (F.col("s_nationkey") % 7).alias("rseq"))
    return delete_ranges(_vers(s, d), r, CELL)


@query("SELECT c_custkey, max(o_orderdate) AS at, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1997-01-01' GROUP BY 1")
def read_at_timestamp(s, d):
    o = table(s, d, "orders").filter("o_orderdate <= TIMESTAMP '1997-01-01'")
    got = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("at"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("price"))
    return got.join(table(s, d, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query("WITH p AS (SELECT user_id AS k, event_id AS at FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id AS k, event_id AS ts, value FROM events WHERE event_type = 'click') SELECT p.k, p.at, v.value FROM p ASOF LEFT JOIN v ON p.k = v.k AND p.at >= v.ts")
def as_of_join(s, d):
    e = table(s, d, "events")
    p = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("k"), F.col("event_id").alias("at"))
    v = e.filter("event_type = 'click'").select(F.col("user_id").alias("k"), F.col("event_id").alias("ts"), "value")
    return as_of(p, v, "k", "at", "ts", "value", 1 << 20)


@query("WITH b AS (SELECT c_custkey AS key, c_acctbal AS value FROM customer), x AS (SELECT o_custkey AS key, CASE WHEN max(o_orderkey) % 5 = 0 THEN 'delete' ELSE 'put' END AS op, max(o_totalprice) AS value FROM orders GROUP BY 1) SELECT coalesce(b.key, x.key) AS key, coalesce(x.value, b.value) AS value FROM b FULL JOIN x ON b.key = x.key WHERE x.op IS NULL OR x.op <> 'delete'")
def batch_overlay(s, d):
    base = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("key"))
    return overlay(base, o.agg(F.when(F.max("o_orderkey") % 5 == 0, "delete").otherwise("put").alias("op"), F.max("o_totalprice").alias("value")))


@query("SELECT c_custkey AS key, value FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS value FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def multi_key_get(s, d):
    store = table(s, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("value"))
    return multi_get(table(s, d, "customer").select(F.col("c_custkey").alias("key")), store)


@query(f"WITH {VER} SELECT DISTINCT o_orderkey AS key FROM orders WHERE EXISTS (SELECT 1 FROM v WHERE v.key = o_orderkey AND v.seq > 4)")
def conflict_detection(s, d):
    return conflicts(table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.lit(4).alias("snapshot")), _vers(s, d)).distinct()


@query("SELECT event_id, user_id FROM events, (SELECT max(floor(epoch(ts)))::BIGINT AS now FROM events) WHERE NOT (floor(epoch(ts))::BIGINT + 864000 < now)")
def ttl_filter(s, d):
    e = table(s, d, "events").withColumn("t", F.unix_timestamp("ts"))
    now = e.agg(F.max("t").alias("now"))
    return e.join(F.broadcast(now), F.col("t") + 864000 >= F.col("now")).select("event_id", "user_id")


@query("SELECT * FROM (SELECT event_id AS seq, user_id, event_type FROM events WHERE event_id >= 500)")
def change_feed(s, d):
    return table(s, d, "events").filter("event_id >= 500").select(F.col("event_id").alias("seq"), "user_id", "event_type")


@query("SELECT substr(c_name, 1, 12) AS prefix, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def prefix_stats(s, d):
    return table(s, d, "customer").groupBy(F.substring("c_name", 1, 12).alias("prefix")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT c_custkey AS key, array_to_string(map_keys(m), ',') AS names, m['seg'] AS seg FROM (SELECT c_custkey, MAP {'': c_name, 'seg': c_mktsegment} AS m FROM customer) WHERE m[''] IS NOT NULL")
def wide_columns(s, d):
    m = F.create_map(F.lit(""), "c_name", F.lit("seg"), "c_mktsegment")
    w = table(s, d, "customer").select("c_custkey", m.alias("m")).filter(F.element_at("m", "").isNotNull())
    return w.select(F.col("c_custkey").alias("key"), F.array_join(F.map_keys("m"), ",").alias("names"), F.element_at("m", "seg").alias("seg"))


@query("WITH x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) SELECT prev, event_type AS next, count(*) AS n FROM x WHERE prev IS NOT NULL GROUP BY 1, 2")
def transition_matrix(s, d):
    return transitions(table(s, d, "events"), "event_type", ("ts", "event_id"), "user_id")


@query("WITH x AS (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) SELECT floor(log2(gap))::BIGINT AS bucket, count(*) AS n FROM x WHERE gap IS NOT NULL GROUP BY 1")
def reuse_interval(s, d):
    g = reuse_gaps(table(s, d, "events"), "user_id", "event_id", ("event_id",))
    return g.groupBy(F.floor(F.log2("gap")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS accesses, count(DISTINCT user_id) AS keys, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def trace_key_stats(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("accesses"), F.countDistinct("user_id").alias("keys"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT n AS accesses, count(*) AS keys FROM c GROUP BY 1")
def access_count_distribution(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).groupBy(F.col("n").alias("accesses")).agg(F.count("*").alias("keys"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top_keys(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("SELECT event_type, floor(epoch(ts) / 3600)::BIGINT AS hour, count(*) AS ops FROM events GROUP BY 1, 2")
def ops_per_hour(s, d):
    return table(s, d, "events").groupBy("event_type", F.floor(F.unix_timestamp("ts") / 3600).alias("hour")).agg(F.count("*").alias("ops"))


@query("WITH f AS (SELECT user_id, min(floor(epoch(ts) / 3600)::BIGINT) AS hour FROM events GROUP BY 1), c AS (SELECT hour, count(*) AS fresh FROM f GROUP BY 1) SELECT hour, sum(fresh) OVER (ORDER BY hour)::BIGINT AS seen FROM c")
def unique_keys_so_far(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.min(F.floor(F.unix_timestamp("ts") / 3600)).alias("hour"))
    return e.groupBy("hour").agg(F.count("*").alias("fresh")).select("hour", F.sum("fresh").over(Window.orderBy("hour")).alias("seen"))


@query("SELECT event_type, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean, max_by(event_id, (ts, event_id)) AS latest, min_by(event_id, (ts, event_id)) AS oldest FROM events GROUP BY 1")
def series_aggregates(s, d):
    at = F.struct("ts", "event_id")
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"), F.round(F.avg("value"), 6).alias("mean"), F.max_by("event_id", at).alias("latest"), F.min_by("event_id", at).alias("oldest"))


@query("WITH x AS (SELECT user_id, event_id, value, lag(value, 2) OVER w AS v, lag(event_id, 2) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id FROM x WHERE (value - v) / (event_id - t) >= 0.5")
def burst_detection(s, d):
    return bursts(table(s, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 2, 0.5).select("user_id", "event_id")


@query("SELECT event_type, user_id % 4 AS shard, count(*) AS n, grouping(event_type) AS g FROM events GROUP BY ROLLUP (event_type, shard)")
def rollup_summary(s, d):
    e = table(s, d, "events").withColumn("shard", F.col("user_id") % 4)
    return e.rollup("event_type", "shard").agg(F.count("*").alias("n"), F.grouping("event_type").cast("long").alias("g"))


@query(None)
def level_counters(s, d):
    rows = [(i + 1, at, l, n) for i, (at, held) in enumerate(level_schedule(4, 64)) for l, n in enumerate(held)]
    return s.createDataFrame(rows, "insert_no int, landing int, level int, batches long")


@query("WITH w AS (SELECT unnest(range(0, 9)) AS i), g AS (SELECT i, exp(-abs(i - 4)::DOUBLE) / (SELECT sum(exp(-abs(i - 4)::DOUBLE)) FROM w) AS p FROM w), c AS (SELECT a.i + b.i AS i, sum(a.p * b.p) AS p FROM g a, g b GROUP BY 1) SELECT a.i + b.i AS total, round(sum(a.p * b.p), 12) AS p FROM c a, c b GROUP BY 1")
def bin_load_distribution(s, d):
    return s.createDataFrame([(i, round(p, 12)) for i, p in enumerate(convolve(geometric_pmf(8, 1.0), 4))], "total long, p double")


from . import layers, store, traces  # noqa: E402, F401  further queries register themselves
