"""Queries on layers of stored data: lookups by order, rewrites, column rows, tombstones, replicas, bucket names."""

from pyspark.sql import functions as F

from . import BKT, CAPACITY, CELL, QLOG, REC, RES, VER, _qlog, _recs, _vers
from ..functions import BUCKET_SEED, MIX, SHIFT, bucket_id
from ..operators import append_operands, bucket_weights, bucketise, overlap, replicas, tags, visible_stack
from ..operators.layers import column_rows, floor_lookup, fold_named, fragments, remap_pending, replica_starts, rewrite, smoothing, stripes, xor_bytes
from ..sources import table
from ._registry import query

DAY = 86400
NEW = f", b2 AS (SELECT key, (row_number() OVER (ORDER BY key, ts DESC, op, val) - 1) // {2 * CAPACITY} AS bucket_no FROM r), t2 AS (SELECT bucket_no, min(key) AS \"left\", max(key) AS \"right\" FROM b2 GROUP BY 1)"


@query("WITH k AS (SELECT DISTINCT o_orderkey AS key FROM orders), p AS (SELECT c_custkey AS id, c_custkey * 10 + 3 AS t FROM customer) SELECT p.id, f.key AS at_or_before, c.key AS at_or_after FROM p ASOF LEFT JOIN k f ON p.t >= f.key ASOF LEFT JOIN k c ON p.t <= c.key")
def seek(s, d):
    k = table(s, d, "orders").select(F.col("o_orderkey").alias("key"))
    p = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 10 + 3).alias("t"))
    low = floor_lookup(p, k.withColumn("at_or_before", F.col("key")), "t", "key", "at_or_before", CELL)
    return floor_lookup(low, k.withColumn("at_or_after", F.col("key")), "t", "key", "at_or_after", CELL, descending=True).drop("t")


@query("WITH m AS (SELECT event_id AS seq, floor(epoch(ts))::BIGINT AS at FROM events WHERE event_id % 100 = 0), p AS (SELECT event_id AS seq FROM events WHERE event_type = 'error') SELECT p.seq, m.at FROM p ASOF LEFT JOIN m ON p.seq >= m.seq")
def sequence_to_time(s, d):
    e = table(s, d, "events")
    m = e.filter("event_id % 100 = 0").select(F.col("event_id").alias("m"), F.unix_timestamp("ts").alias("at"))
    return floor_lookup(e.filter("event_type = 'error'").select(F.col("event_id").alias("seq")), m, "seq", "m", "at", CELL)


@query(f"WITH {VER}, x AS (SELECT *, CASE WHEN seq > 4 THEN 2 WHEN seq > 2 THEN 1 ELSE 0 END AS stripe FROM v) SELECT key, stripe, seq, op, value FROM x QUALIFY row_number() OVER (PARTITION BY key, stripe ORDER BY seq DESC, op DESC, value DESC) = 1")
def snapshot_stripes(s, d):
    return stripes(_vers(s, d), [2, 4])


@query(f"WITH {RES} SELECT key, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS operands FROM z GROUP BY key")
def merge_operands(s, d):
    return visible_stack(_vers(s, d)).groupBy("key").agg(append_operands("seq", "seq").alias("operands"))


@query("SELECT l_partkey AS key, (sum(l_suppkey::HUGEINT * 18446744073709551615) % 18446744073709551616)::VARCHAR AS total FROM lineitem GROUP BY 1")
def merge_uint64_add(s, d):
    operand = F.col("l_suppkey").cast("decimal(18,0)") * F.lit("18446744073709551615").cast("decimal(20,0)")
    total = F.sum(operand.cast("decimal(28,0)")) % F.lit("18446744073709551616").cast("decimal(20,0)")
    return table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(total.cast("decimal(20,0)").cast("string").alias("total"))


@query("SELECT l_orderkey AS key, l_linenumber AS seq, CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity END AS value FROM lineitem WHERE NOT (l_linestatus = 'F' AND l_quantity < 5)")
def compaction_filter(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").alias("value"), "l_linestatus", "l_discount")
    out = rewrite(rows, (F.col("l_linestatus") == "F") & (F.col("value") < 5), F.col("l_discount") == 0, "value", F.lit(0.0))
    return out.select("key", "seq", "value")


NOW, TTL = 883612800, 365 * DAY  # the start of 1998; one year


@query(f"WITH c AS (SELECT l_orderkey AS key, l_linenumber % 4 AS idx, epoch(l_shipdate)::BIGINT AS ts, CASE l_returnflag WHEN 'R' THEN 'tombstone' WHEN 'A' THEN 'expiring' ELSE 'live' END AS kind, l_partkey AS value FROM lineitem), n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key, idx ORDER BY ts DESC, kind DESC, value DESC) = 1), t AS (SELECT o_orderkey AS key, max(epoch(o_orderdate)::BIGINT + {60 * DAY}) AS dead FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0 GROUP BY 1), k AS (SELECT n.key, idx, CASE WHEN kind = 'expiring' AND ts + {TTL} < {NOW} THEN 'tombstone' ELSE kind END AS kind, value FROM n LEFT JOIN t ON n.key = t.key WHERE dead IS NULL OR ts > dead) SELECT key, idx, kind, CASE WHEN kind <> 'tombstone' THEN value END AS value FROM k")
def column_row_merge(s, d):
    kind = F.when(F.col("l_returnflag") == "R", "tombstone").when(F.col("l_returnflag") == "A", "expiring").otherwise("live")
    cells = table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") % 4).alias("idx"), F.unix_timestamp("l_shipdate").alias("ts"), kind.alias("kind"), F.col("l_partkey").alias("value"))
    dead = table(s, d, "orders").filter("o_orderstatus = 'F' AND o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("key"), (F.unix_timestamp("o_orderdate") + 60 * DAY).alias("ts"))
    return column_rows(cells, dead, NOW, TTL)


@query("WITH r AS (SELECT s_nationkey AS grp, s_suppkey * 10 AS b, s_suppkey * 10 + 135 AS e, s_suppkey % 7 AS rseq FROM supplier), c AS (SELECT grp, greatest(b, x * 1000) AS b, least(e, x * 1000 + 1000) AS e, x, rseq FROM (SELECT *, unnest(generate_series(b // 1000, (e - 1) // 1000)) AS x FROM r)), p AS (SELECT grp, x, b AS p FROM c UNION SELECT grp, x, e FROM c), i AS (SELECT grp, x, p AS b, lead(p) OVER (PARTITION BY grp, x ORDER BY p) AS e FROM p) SELECT i.grp, i.b AS \"begin\", i.e AS \"end\", max(rseq) AS rseq FROM i JOIN c ON i.grp = c.grp AND i.x = c.x AND c.b <= i.b AND c.e >= i.e GROUP BY 1, 2, 3")
def tombstone_fragments(s, d):
    r = table(s, d, "supplier").select(F.col("s_nationkey").alias("grp"), (F.col("s_suppkey") * 10).alias("begin"), (F.col("s_suppkey") * 10 + 135).alias("end"), (F.col("s_suppkey") % 7).alias("rseq"))
    return fragments(r, "grp", CELL)


@query(f"WITH {BKT}, {QLOG}{NEW}, o AS (SELECT qid, greatest(q.\"left\", t.\"left\") AS l, least(q.\"right\", t.\"right\") AS h FROM q JOIN t ON q.\"left\" <= t.\"right\" AND q.\"right\" >= t.\"left\"), n AS (SELECT qid, count(*) AS n FROM o JOIN t2 ON l <= t2.\"right\" AND h >= t2.\"left\" GROUP BY 1) SELECT q.qid, coalesce(n, 0) AS cnt FROM q LEFT JOIN n ON q.qid = n.qid")
def pending_remap(s, d):
    r = _recs(s, d)
    return remap_pending(_qlog(s, d), tags(bucketise(r, CAPACITY)), tags(bucketise(r, 2 * CAPACITY)), CELL)


@query(f"WITH {BKT}, {QLOG} SELECT qid, sum(n)::BIGINT AS size FROM q JOIN t ON q.\"left\" <= t.\"right\" AND q.\"right\" >= t.\"left\" GROUP BY 1")
def approximate_sizes(s, d):
    t = tags(bucketise(_recs(s, d), CAPACITY))
    return overlap(_qlog(s, d), t, CELL).join(t.select("bucket_no", "n"), "bucket_no").groupBy("qid").agg(F.sum("n").alias("size"))


def _copies(s, d):
    return replicas(bucket_weights(tags(bucketise(_recs(s, d), CAPACITY)), 1, 1000000, 100), 2.0).select("bucket_no", "copies")


COPIES = f"{BKT}, w AS (SELECT bucket_no, 1 - (2*\"left\" - 1 - least(101, \"left\" - 1)) / (2.0::DOUBLE*1000000 - 100) * least(101, \"left\" - 1) / 101.0::DOUBLE - (2000000 - 2*\"right\" + 1 - least(101, 1000000 - \"right\")) / (2.0::DOUBLE*1000000 - 100) * least(101, 1000000 - \"right\") / 101.0::DOUBLE AS w FROM t), c AS (SELECT bucket_no, ceil(w / sum(w) OVER () * count(*) OVER ())::BIGINT AS copies FROM w), st AS (SELECT *, (sum(copies) OVER (ORDER BY bucket_no) - copies)::BIGINT AS start FROM c)"


@query(f"WITH {COPIES} SELECT bucket_no, copies, start FROM st")
def replica_offsets(s, d):
    return replica_starts(_copies(s, d))


@query(f"WITH {COPIES}, i AS (SELECT c_custkey AS replica FROM customer WHERE c_custkey < (SELECT sum(copies) FROM c)) SELECT replica, bucket_no FROM i ASOF LEFT JOIN st ON replica >= start")
def replica_lookup(s, d):
    starts = replica_starts(_copies(s, d))
    total = starts.agg(F.sum("copies").alias("_n"))
    ids = table(s, d, "customer").select(F.col("c_custkey").alias("replica")).join(F.broadcast(total), F.col("replica") < F.col("_n")).drop("_n")
    return floor_lookup(ids, starts, "replica", "start", "bucket_no", CELL)


@query("WITH c AS (SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1), x AS (SELECT key, n / sum(n) OVER ()::DOUBLE AS p, count(*) OVER () AS k FROM c), y AS (SELECT *, ceil(p * k)::BIGINT AS replicas FROM x) SELECT key, replicas, round(1.0::DOUBLE / k - p / replicas, 9) + 0.0 AS fake, (2 * k - sum(replicas) OVER ())::BIGINT AS dummies FROM y")
def frequency_smoothing(s, d):
    c = table(s, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"))
    return smoothing(c, "key", "n").withColumn("fake", F.round("fake", 9) + 0.0)


def _mul(x):
    return f"(((({x}) & 4294967295)::HUGEINT * {MIX}::HUGEINT + (((({x}) >> 32)::HUGEINT * {MIX & 0xFFFFFFFF}::HUGEINT) % 4294967296) * 4294967296) % 18446744073709551616)"


@query(f"WITH {BKT}, p AS (SELECT bucket_no, (1 + bucket_no)::HUGEINT AS s FROM t), c AS (SELECT bucket_no, s * (s + 1) // 2 + bucket_no AS s FROM p), e AS (SELECT bucket_no, (s % 4294967296 + 2) % 4294967296 AS s FROM c), f AS (SELECT bucket_no, (s * (s + 1) // 2 + 2)::HUGEINT AS h FROM e), g AS (SELECT bucket_no, {_mul('h')} AS h FROM f), i AS (SELECT bucket_no, xor(h, h >> {SHIFT}) AS h FROM g), j AS (SELECT bucket_no, xor({_mul('h')}, {BUCKET_SEED ^ MIX}::HUGEINT) AS h FROM i), k AS (SELECT bucket_no, {_mul('h')} AS h FROM j), l AS (SELECT bucket_no, xor(h, h >> {SHIFT}) AS h FROM k), m AS (SELECT bucket_no, {_mul('h')} AS h FROM l) SELECT bucket_no, lower(hex(xor(h, h >> {SHIFT})::UBIGINT)) AS bucket_id FROM m")
def bucket_ids(s, d):
    b = tags(bucketise(_recs(s, d), CAPACITY)).select("bucket_no", F.lit(1).alias("_level"), F.lit(2).alias("_replica"))
    return bucket_id(b, "_level", "bucket_no", "_replica", "bucket_id").drop("_level", "_replica")


@query(f"WITH {REC} SELECT CASE op WHEN 2 THEN 'delete' ELSE 'insert' END AS kind, md5(key::VARCHAR) AS blob_ref, val FROM r WHERE val > 200000")
def large_values(s, d):
    """Large values kept in a table of their own and joined back by reference."""
    r = _recs(s, d).withColumn("blob_ref", F.md5(F.col("key").cast("string")))
    keys = r.filter("val > 200000").select(F.when(F.col("op") == 2, "delete").otherwise("insert").alias("kind"), "blob_ref")
    return keys.join(r.filter("val > 200000").select("blob_ref", "val"), "blob_ref")


@query(f"WITH {VER}, l AS (SELECT key, list({{'fn': CASE op WHEN 'put' THEN 'sum' WHEN 'merge' THEN 'multiply' ELSE 'max' END, 'value': (1 + seq)::DOUBLE}} ORDER BY seq, CASE op WHEN 'put' THEN 'sum' WHEN 'merge' THEN 'multiply' ELSE 'max' END, seq) AS xs FROM v GROUP BY key) SELECT key, list_reduce(xs, lambda a, x: {{'fn': x.fn, 'value': CASE x.fn WHEN 'sum' THEN a.value + x.value WHEN 'multiply' THEN a.value * x.value ELSE greatest(a.value, x.value) END}}).value AS value FROM l")
def merge_named(s, d):
    fn = F.when(F.col("op") == "put", "sum").when(F.col("op") == "merge", "multiply").otherwise("max")
    return fold_named(_vers(s, d).select("key", "seq", fn.alias("fn"), (1 + F.col("seq")).alias("value"))).select("key", "value")


@query("WITH c AS (SELECT c_nationkey AS key, hex(c_mktsegment) AS h FROM customer), p AS (SELECT key, length(h) AS n, unnest(generate_series(0, length(h) // 2 - 1)) AS i, h FROM c), b AS (SELECT key, i, bit_xor(('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS x FROM p GROUP BY 1, 2) SELECT key, lower(string_agg(right('0' || hex(x), 2), '' ORDER BY i)) AS hex FROM b GROUP BY 1")
def merge_bytes_xor(s, d):
    return xor_bytes(table(s, d, "customer").withColumnRenamed("c_nationkey", "key"), "key", "c_mktsegment")
