"""Golden cases and edges of the store's operators."""

import math

import pytest
from pyspark.sql import Row, functions as F

from tagstore.functions import align, bin_factor, geometric_weights
from tagstore.operators import as_of, bucket_weights, last_n, replicas, running, signed_round
from tagstore.operators import store as ops

# Fixed values of the golden cases: four buckets over [1, 100], range length 9, overhead 2; and loads up to 8 with epsilon 1.
TAGS = [(0, 1, 25), (1, 26, 50), (2, 51, 75), (3, 76, 100)]
REAL = [0.229358, 0.270642, 0.270642, 0.229358]
COPIES = [1, 2, 2, 1]
FAKE = [0.020642, 0.114679, 0.114679, 0.020642]
DUMMY_COPIES, DUMMY_FAKE = 2, 0.25
WEIGHTS = [0.0000212, 0.0011569, 0.0232364, 0.171695, 0.466715]
WEIGHT_SUM = 0.858934


def test_replicas_with_dummies(spark):
    tags = spark.createDataFrame(TAGS, "bucket_no long, left long, right long")
    got = sorted(ops.replica_weights(bucket_weights(tags, 1, 100, 9).select("bucket_no", "weight"), 2.0).collect())
    assert [round(r.real_weight, 6) for r in got] == [*REAL, 0.0] and [r.copies for r in got] == [*COPIES, DUMMY_COPIES]
    assert [round(r.fake_weight, 6) for r in got] == [*FAKE, DUMMY_FAKE] and [r.is_dummy for r in got] == [False] * 4 + [True]
    assert sum(r.copies for r in got) == 8


BEYOND = [(0, 0, 255), (1, 256, 511), (2, 999900, 1200000), (3, 3000000, 3000255), (4, 8999000, 8999999)]  # of [1, 1000000]


def _beyond(spark, sql):
    """Weights of these buckets, some below zero so that no copies are left, and what DuckDB makes of them."""
    import duckdb

    weights = bucket_weights(spark.createDataFrame(BEYOND, "bucket_no long, left long, right long"), 1, 1000000, 100).select("bucket_no", "weight")
    x = weights.toPandas()  # noqa: F841  read by DuckDB
    return weights, duckdb.sql(sql).fetchall()


def test_replicas_of_keys_beyond_the_domain(spark):
    weights, want = _beyond(spark, "SELECT bucket_no, ceil(weight * 5)::BIGINT, round(1.0::DOUBLE / 5 - weight / ceil(weight * 5), 9) FROM x ORDER BY 1")
    got = replicas(weights, 2.0).orderBy("bucket_no").select("bucket_no", "copies", F.round("fake_weight", 9)).collect()
    assert [tuple(r) for r in got] == want and -math.inf in [r[2] for r in want]


def test_signed_round(spark):
    got = spark.sql("SELECT explode(array(-1e-12D, 1e-12D, -0.25D)) AS x").select(signed_round(F.col("x"), 9)).collect()
    assert [repr(r[0]) for r in got] == ["-0.0", "0.0", "-0.25"]


def test_replica_weights_of_keys_beyond_the_domain(spark):
    weights, want = _beyond(spark, "WITH c AS (SELECT *, ceil(weight * 5 / 2)::BIGINT AS copies FROM x) SELECT bucket_no, copies, round((2.0::DOUBLE / 5 - weight / copies) / 2, 9) FROM c ORDER BY 1")
    got = ops.replica_weights(weights, 1.5).filter("not is_dummy").orderBy("bucket_no").select("bucket_no", "copies", F.round("fake_weight", 9)).collect()
    assert [tuple(r) for r in got] == want and math.inf in [r[2] for r in want]


def test_load_weights():
    w = geometric_weights(8, 1.0)
    assert all(abs(a - b) < 5e-7 for a, b in zip(w, WEIGHTS)) and w == w[::-1] and abs(sum(w) - WEIGHT_SUM) < 1e-6
    assert align(20) == (16, 32) and align(32) == (32, 32)
    assert abs(bin_factor(512, 64, 512) - 2 * 512 / (64 * (1 - 1 / math.log(512) ** 2))) < 1e-9


def test_noisy_prefixes_step_by_step(spark):
    loads = [5, 0, 9, 3, 3, 20, 1, 7, 2, 2, 30]
    d = spark.createDataFrame(list(enumerate(loads)), "bin long, load long")
    got = sorted(ops.noisy_prefixes(d, "bin", "load", 0.25, 6).collect())
    import hashlib

    def lap(t):
        u = int(hashlib.md5(f"17:{t}".encode()).hexdigest()[:8], 16) / 2**32
        return -4.0 * math.copysign(1, u - 0.5) * math.log(1 - 2 * abs(u - 0.5))

    sums, noisy, level, last = 0, [0.0] * 8, [0] * 8, 0
    for t, load in enumerate(loads, 1):  # a counter of noisy blocks, one step for each bin
        sums += load
        i = (t & -t).bit_length() - 1
        level[i] = load + sum(level[:i])
        noisy[i] = level[i] + lap(t)
        level[:i], noisy[:i] = [0] * i, [0.0] * i
        x = max(int(sum(noisy[j] for j in range(8) if t >> j & 1)), 0)
        last = min(max(x, last), sums + 6)
        last = sums - 6 if last + 6 < sums else last
        assert (got[t - 1].noisy, got[t - 1].error) == (last, abs(sums - last))


def test_scan_bounds_reverse_and_limit(spark):
    r = spark.createDataFrame([(k, 1, t, 0.5) for k, t in ((1, 1), (2, 1), (2, 9), (3, 1), (None, 1))], "key long, op int, ts long, val double")
    keys = lambda **how: [(x.key, x.ts) for x in ops.scan(r, **how).collect()]
    assert keys(lower=2, upper=3) == [(2, 9), (2, 1)] and keys(lower=2) == [(2, 9), (2, 1), (3, 1)]
    assert keys(upper=3, reverse=True, most=2) == [(2, 9), (2, 1)] and keys(lower=3, upper=3) == [] and len(keys()) == 5
    got = {x.key: (x.prev, x.next) for x in ops.neighbours(spark.createDataFrame([(1,), (7,), (7,), (2500,)], "k long"), "k", 1000).collect()}
    assert got == {1: (None, 7), 7: (1, 2500), 2500: (7, None)}


def test_single_delete_cancels_one_put(spark):
    rows = [(1, 1, "put"), (1, 2, "single_delete"), (2, 1, "put"), (2, 2, "put"), (2, 3, "single_delete"), (3, 1, "single_delete"), (4, 1, "put")]
    v = spark.createDataFrame([(k, s, o, 0.0) for k, s, o in rows], "key long, seq int, op string, value double")
    assert sorted((r.key, r.seq, r.op) for r in ops.single_deletes(v).collect()) == [(2, 1, "put"), (3, 1, "single_delete"), (4, 1, "put")]


def test_search_levels_newer_level_wins_and_deletes_hide(spark):
    level = lambda rows: spark.createDataFrame(rows, "key long, op int, ts long, val double")
    got = ops.search_levels(level([(1, 2, 5, 0.0), (2, 1, 1, 2.0)]), level([(1, 1, 9, 1.0), (2, 1, 9, 9.0), (3, 1, 1, 3.0)]))
    assert sorted((r.key, r.level, r.val) for r in got.collect()) == [(2, 0, 2.0), (3, 1, 3.0)]


def test_weighted_pick(spark):
    c = spark.createDataFrame([(0, 1), (1, 0), (2, 3)], "b long, w long")
    d = spark.createDataFrame([(0, 0.0), (1, 0.2499), (2, 0.25), (3, 0.999)], "i long, u double")
    assert sorted((r.i, r.pick) for r in ops.weighted_pick(d, "u", c, "b", "w", "pick").collect()) == [(0, 0), (1, 0), (2, 2), (3, 2)]


def test_wal_filter_stops_and_ignores(spark):
    log = spark.createDataFrame([(i, k) for i, k in enumerate(["a", "skip", None, "stop", "a"])], "seq long, k string")
    got = ops.wal_filter(log, "seq", F.col("k") == "skip", F.col("k") == "stop")
    assert [r.seq for r in got.orderBy("seq").collect()] == [0, 2]
    assert ops.wal_filter(log.filter("seq < 3"), "seq", F.col("k") == "skip", F.col("k") == "stop").count() == 2


@pytest.mark.parametrize("n", [0, 1, 127, 128, 300, 16383, 16384, 2**40])
def test_varint(spark, n):
    want, x = [], n
    while True:
        want.append(x & 127 | (128 if x > 127 else 0))
        x >>= 7
        if not x:
            break
    assert spark.range(1).select(ops.varint_hex(F.lit(n).cast("long")).alias("v")).first().v == bytes(want).hex()


def test_as_of_across_cells(spark):
    """A hot key over many cells, probes before the first version, equal times, null values, keys and times."""
    versions = [(1, t, t * 7 % 11) for t in range(5, 400, 13)] + [(1, 18, 100), (1, 200, None), (2, -30, 1), (None, 3, 9), (2, None, 9)]
    probes = [(1, t) for t in range(0, 420, 3)] + [(1, 18), (2, -31), (2, 500), (3, 1), (None, 3), (2, None)]
    got = as_of(spark.createDataFrame(probes, "k int, at long"), spark.createDataFrame(versions, "k int, ts long, v int"), "k", "at", "ts", "v", 10)

    def newest(k, at):
        older = [(t, -1 if v is None else v) for key, t, v in versions if None not in (k, at, t) and key == k and t <= at]
        return None if not older or max(older)[1] < 0 else max(older)[1]

    assert sorted(map(repr, got.collect())) == sorted(repr(Row(k=k, at=at, v=newest(k, at))) for k, at in probes)


def test_running_over_skewed_keys(spark):
    """Nulls first, a key with half of all rows, more ranges than keys, only nulls and no rows."""
    keys = [None, None, *[7] * 40, *range(-20, 20)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key int, i int")
    want = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
    got = running(rows, "key", ("i",), F.lit(1).cast("long"), "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, len(keys) + 1)) and [r.i for r in got] == want
    assert [r.n for r in running(rows.filter("key IS NULL"), "key", ("i",), F.lit(1).cast("long"), "n").collect()] == [1, 2]
    assert running(rows.filter("i < 0"), "key", ("i",), F.lit(1).cast("long"), "n").count() == 0


def test_last_n(spark):
    rows = spark.createDataFrame([(1, i, i * i) for i in range(50)] + [(2, 5, 1), (2, 5, 2), (3, 1, None)], "key int, seq int, v int")
    got = {r.key: r.last for r in last_n(rows, "key", "v", "seq", "last").collect()}
    assert got == {1: "2401,2304,2209", 2: "2,1", 3: ""}
