"""Queries on access traces, all over events, and histograms."""

from pyspark.sql import Window, functions as F

from ..functions import bucket_index, hash_uniform, histogram_bounds
from ..operators import transitions
from ..operators.traces import deviations, disorder, interior_points, miss_curve, near_in_time, percentiles, retention, reuse_distances, top_share
from ..sources import table
from ..streaming.pool import pooled
from ._registry import query

SHARDS, CAPACITIES = 16, (4, 8, 16, 32)
U = "('0x' || substr(md5('17:' || {}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"
REUSE = f"x AS (SELECT user_id % {SHARDS} AS shard, user_id AS key, event_id AS seq, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events), d AS (SELECT x.shard, x.key, x.seq, CASE WHEN any_value(x.p) IS NOT NULL THEN count(DISTINCT o.key) END AS distance FROM x LEFT JOIN x o ON o.shard = x.shard AND o.seq > x.p AND o.seq < x.seq GROUP BY 1, 2, 3)"


def _events(s, d):
    return table(s, d, "events")


def _distances(s, d):
    return reuse_distances(_events(s, d).withColumn("shard", F.col("user_id") % SHARDS), "shard", "user_id", "event_id")


@query(f"WITH {REUSE} SELECT shard, key, seq, distance FROM d")
def reuse_distance(s, d):
    return _distances(s, d)


@query(f"WITH {REUSE} SELECT capacity, count(*) AS accesses, count(*) FILTER (distance IS NULL OR distance >= capacity) AS misses FROM d, (SELECT unnest([{', '.join(map(str, CAPACITIES))}]) AS capacity) GROUP BY 1")
def miss_ratio_curve(s, d):
    return miss_curve(_distances(s, d), CAPACITIES)


@query("WITH x AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), n AS (SELECT count(*) AS n FROM x WHERE prev IS NOT NULL GROUP BY prev, event_type), k AS (SELECT count(DISTINCT event_type) AS keys FROM events) SELECT keys, round(sqrt(sum(n * n) / (keys * keys) - (sum(n) / (keys * keys)) ** 2) / (sum(n) / (keys * keys)), 6) AS rsd FROM n, k GROUP BY keys")
def transition_deviation(s, d):
    e = _events(s, d)
    return deviations(transitions(e, "event_type", ("ts", "event_id"), "user_id"), e, "event_type").withColumn("rsd", F.round("rsd", 6))


@query("WITH x AS (SELECT user_id, lag(user_id) OVER (ORDER BY event_id) AS p FROM events) SELECT count(*) FILTER (user_id < p) AS violations FROM x")
def sortedness(s, d):
    return disorder(_events(s, d), "event_id", "user_id", 4096)


@query("WITH x AS (SELECT user_id, event_type, event_id, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events) SELECT event_type, count(*) AS n, sum(event_id - p)::BIGINT AS gap FROM x WHERE p IS NOT NULL GROUP BY 1")
def operation_pairs(s, d):
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = _events(s, d).withColumn("_p", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(before))
    return e.filter("_p IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("event_id") - F.col("_p")).alias("gap"))


@query("WITH e AS (SELECT user_id, event_type, floor(epoch(ts))::BIGINT AS t FROM events), m AS (SELECT a.user_id, a.t AS t1, b.t AS t2 FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error' AND abs(a.t - b.t) <= 36000) SELECT user_id, t1, t2 FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t1, t2) = 1")
def temporal_proximity(s, d):
    e = _events(s, d).select("user_id", "event_type", F.unix_timestamp("ts").alias("t"))
    return near_in_time(e.filter("event_type = 'click'"), e.filter("event_type = 'error'"), "user_id", 36000)


@query("SELECT DISTINCT a.user_id FROM events a WHERE event_type = 'click' AND value > 90 INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 90")
def triggered_intersection(s, d):
    e = _events(s, d).filter("value > 90")
    return e.filter("event_type = 'click'").select("user_id").intersect(e.filter("event_type = 'error'").select("user_id"))


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS i, floor(count(*) OVER () * 10 / 100)::BIGINT AS cut FROM c) SELECT max(cut) AS top_keys, coalesce(sum(n) FILTER (i <= cut), 0)::BIGINT AS top_accesses, sum(n)::BIGINT AS accesses FROM r")
def skewness(s, d):
    return top_share(_events(s, d), "user_id", 10)


@query("WITH s AS (SELECT DISTINCT user_id, floor(epoch(ts) / 604800)::BIGINT AS w FROM events) SELECT a.w AS base, b.w AS later, count(*) AS keys FROM s a JOIN s b ON a.user_id = b.user_id AND b.w >= a.w GROUP BY 1, 2")
def reuse_timeline(s, d):
    return retention(_events(s, d), "user_id", F.floor(F.unix_timestamp("ts") / 604800))


@query("SELECT user_id, max(floor(epoch(ts))::BIGINT) - min(floor(epoch(ts))::BIGINT) AS lifetime FROM events GROUP BY 1")
def reuse_lifetime(s, d):
    t = F.unix_timestamp("ts")
    return _events(s, d).groupBy("user_id").agg((F.max(t) - F.min(t)).alias("lifetime"))


@query("WITH g AS (SELECT event_type, event_id - lag(event_id) OVER w AS p, lead(event_id) OVER w - event_id AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_type, count(*) AS pairs, round(corr(p, n), 6) AS correlation FROM g WHERE p IS NOT NULL AND n IS NOT NULL GROUP BY 1")
def gap_correlation(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    g = _events(s, d).select("event_type", (F.col("event_id") - F.lag("event_id").over(w)).alias("p"), (F.lead("event_id").over(w) - F.col("event_id")).alias("n")).dropna(subset=["p", "n"])
    return g.groupBy("event_type").agg(F.count("*").alias("pairs"), F.round(F.corr("p", "n"), 6).alias("correlation"))


@query("WITH t AS (SELECT count(*) AS t FROM events) SELECT event_type, user_id % 4 AS shard, count(*) AS n, round(100.0::DOUBLE * count(*) / any_value(t), 6) AS percent FROM events, t GROUP BY ROLLUP (event_type, shard)")
def access_share(s, d):
    e = _events(s, d).withColumn("shard", F.col("user_id") % 4)
    n = e.rollup("event_type", "shard").agg(F.count("*").alias("n"))
    total = e.agg(F.count("*").alias("_t"))
    return n.crossJoin(F.broadcast(total)).withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.col("_t"), 6)).drop("_t")


@query("WITH q AS (SELECT event_type, floor(epoch(ts) / 60)::BIGINT AS m, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, max(n) AS peak, round(avg(n), 6) AS mean FROM q GROUP BY 1")
def peak_rates(s, d):
    q = _events(s, d).groupBy("event_type", F.floor(F.unix_timestamp("ts") / 60).alias("m")).agg(F.count("*").alias("n"))
    return q.groupBy("event_type").agg(F.max("n").alias("peak"), F.round(F.avg("n"), 6).alias("mean"))


@query("SELECT length(props) // 2 AS interval, count(*) AS n FROM events GROUP BY 1")
def value_size_distribution(s, d):
    return _events(s, d).groupBy(F.floor(F.length("props") / 2).alias("interval")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, 'top' AS side FROM (SELECT * FROM c ORDER BY n DESC, user_id LIMIT 5) UNION ALL SELECT user_id, n, 'bottom' FROM (SELECT * FROM c ORDER BY n, user_id LIMIT 5)")
def top_and_bottom_keys(s, d):
    c = _events(s, d).groupBy("user_id").agg(F.count("*").alias("n"))
    top, bottom = c.orderBy(F.desc("n"), "user_id").limit(5), c.orderBy("n", "user_id").limit(5)
    return top.withColumn("side", F.lit("top")).unionAll(bottom.withColumn("side", F.lit("bottom")))


@query(f"WITH h AS (SELECT floor(epoch(ts) / 86400)::BIGINT AS bin, event_id, row_number() OVER (PARTITION BY floor(epoch(ts) / 86400) ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY floor(epoch(ts) / 86400)) AS n FROM events), w AS (SELECT *, sum(exp(0.5::DOUBLE * (least(i, n - i) - n / 2.0::DOUBLE))) OVER (PARTITION BY bin ORDER BY i) AS run, {U.format('bin')} AS u FROM h), z AS (SELECT *, max(run) OVER (PARTITION BY bin) AS total FROM w) SELECT bin, min(event_id) AS event_id FROM z WHERE run > u * total GROUP BY 1")
def interior_point(s, d):
    e = _events(s, d).select(F.floor(F.unix_timestamp("ts") / 86400).alias("bin"), "event_id")
    return interior_points(e, "bin", "event_id", 0.5, hash_uniform("bin"))


@query(f"SELECT event_type, CASE WHEN {U.format('event_id')} < 0.5 THEN 'real' ELSE 'fake' END AS draw, count(*) AS n FROM events GROUP BY 1, 2")
def real_fake_draws(s, d):
    return _events(s, d).groupBy("event_type", F.when(hash_uniform("event_id") < 0.5, "real").otherwise("fake").alias("draw")).agg(F.count("*").alias("n"))


BOUNDS = [b for b in histogram_bounds() if b < 10**9]


@query(f"WITH b AS (SELECT unnest([{', '.join(map(str, BOUNDS))}]) AS hi, unnest([0, {', '.join(map(str, BOUNDS[:-1]))}]) AS lo), v AS (SELECT l_returnflag, floor(l_extendedprice)::BIGINT AS v FROM lineitem), h AS (SELECT l_returnflag, lo, hi, count(*) AS n, min(v) AS mn, max(v) AS mx FROM v JOIN b ON v > lo AND v <= hi GROUP BY 1, 2, 3), c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY lo) AS cum, sum(n) OVER (PARTITION BY l_returnflag) AS total, min(mn) OVER (PARTITION BY l_returnflag) AS a, max(mx) OVER (PARTITION BY l_returnflag) AS z FROM h), p AS (SELECT *, total * percent / 100.0::DOUBLE AS t FROM c, (SELECT unnest([50, 99]) AS percent)) SELECT l_returnflag, percent, round(least(greatest(lo + (hi - lo) * (t - cum + n) / n, a::DOUBLE), z::DOUBLE), 6) AS value FROM p WHERE cum >= t AND cum - n < t")
def histogram_percentiles(s, d):
    v = table(s, d, "lineitem").select("l_returnflag", F.floor("l_extendedprice").alias("v"))
    return percentiles(v, "l_returnflag", "v", bucket_index(F.col("v"), BOUNDS), BOUNDS, (50, 99)).withColumn("value", F.round("value", 6))


@query(None)
def decorrelation_pool(s, d):
    return pooled(_events(s, d), "user_id", "event_id", "event_type", 3, "linear")
