import math

import duckdb
import pytest

from tagstore import plans
from tagstore.functions import geometric_pmf, level_schedule, stationary

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _rows(rows):
    def plain(x):
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float) and math.isnan(x):
            return "nan"
        return round(x, 6) if isinstance(x, float) else x

    return sorted(repr(tuple(plain(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(spark, name):
    df = plans.QUERIES[name](spark, SF)
    if name not in plans.ORACLE_SQL:
        assert df.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({plans.ORACLE_SQL[name]})").fetchall()
    assert _rows(tuple(r) for r in df.select(*cols).collect()) == _rows(want)


def test_level_schedule():
    got = level_schedule(3, 10)
    assert [at for at, _ in got] == [2, 1, 0, 2, 1, 0, 1, 0, 0, 2]
    assert [h for _, h in got][:6] == [[0, 0, 1], [0, 1, 1], [1, 1, 1], [0, 0, 4], [0, 1, 4], [1, 1, 4]]
    assert [at for at, _ in level_schedule(8, 9)] == [7, 6, 5, 4, 3, 2, 1, 0, 7]


def test_distributions():
    p = geometric_pmf(8, 1.0)
    assert abs(sum(p) - 1) < 1e-12 and abs(p[4] - 0.466715) < 1e-3 and abs(p[0] - 0.008548) < 1e-3
    assert [round(x, 4) for x in stationary([[0.3, 0.65, 0.05], [0.9, 0, 0.1], [0.7, 0.3, 0]])] == [0.5543, 0.38, 0.0657]


def test_empty_tables(spark):
    from tagstore.operators import bucketise, latest, resolve, tags

    r = spark.createDataFrame([], "key long, op int, ts long, val double")
    assert tags(bucketise(r, 4)).count() == 0 and latest(r).count() == 0
    assert resolve(spark.createDataFrame([], "key long, seq int, op string, value double")).count() == 0


def test_bucket_names(spark):
    from tagstore.functions import bucket_id

    want = {(0, 0, 0): "3f0686c1119f1f89", (0, 0, 1): "31671266a99b0d6c", (0, 1, 0): "2d76e8b125a90999", (7, 0, 0): "df6b7d109033caa0", (7, 122, 3): "26e56bd74c7f1b5c", (2, 1000, 0): "4245d88d540f1f7b"}
    df = spark.createDataFrame(list(want), "l int, b long, r int")
    assert {(x.l, x.b, x.r): x.id for x in bucket_id(df, "l", "b", "r", "id").collect()} == want


def test_histogram_bounds():
    from tagstore.functions import histogram_bounds

    b = histogram_bounds()
    assert b[:16] == [1, 2, 3, 4, 6, 10, 15, 22, 34, 51, 76, 110, 170, 250, 380, 580] and b == sorted(set(b)) and b[-1] < 2**64


def test_floor_lookup_edges(spark):
    from tagstore.operators.layers import floor_lookup

    p = spark.createDataFrame([(1, -5), (2, 0), (3, 7), (4, 9000), (5, None)], "id int, at long")
    e = spark.createDataFrame([(0, 1), (0, 3), (7, 2), (None, 9)], "ts long, v int")
    got = {r.id: r.v for r in floor_lookup(p, e, "at", "ts", "v", 10).collect()}
    assert got == {1: None, 2: 3, 3: 2, 4: 2, 5: None}
    assert {r.id: r.v for r in floor_lookup(p, e, "at", "ts", "v", 10, descending=True).collect()} == {1: 3, 2: 3, 3: 2, 4: None, 5: None}
    assert floor_lookup(p.limit(0), e, "at", "ts", "v", 10).count() == 0


def test_lru_against_simulation(spark):
    import random

    from tagstore.operators.traces import miss_curve, reuse_distances

    rng = random.Random(3)
    rows = [(0, rng.randrange(12), i) for i in range(300)]
    got = {r.capacity: r.misses for r in miss_curve(reuse_distances(spark.createDataFrame(rows, "s int, k int, q int"), "s", "k", "q"), (1, 3, 8)).collect()}
    for c in got:
        cache, misses = [], 0
        for _, k, _ in rows:
            misses += k not in cache
            cache = ([k] + [x for x in cache if x != k])[:c]
        assert got[c] == misses


def test_bin_capacity():
    from tagstore.functions import bin_capacity, convolve, geometric_pmf

    z = bin_capacity(20, 4, 1.0, 1e-3)
    fill = lambda n: sum(convolve(geometric_pmf(n, 1.0), 4)[:20])
    assert z % 2 == 0 and fill(z) <= 1e-3 < fill(z - 2)


def test_queries_over_all_orders(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    keys = {r.key for r in plans.QUERIES["conflict_detection"](spark, SF).collect()}
    assert {k % 10 for k in keys} == set(range(10))
    buyers = {r.o_custkey for r in o.select("o_custkey").distinct().collect()}
    got = {r.key: r.value for r in plans.QUERIES["multi_key_get"](spark, SF).collect()}
    assert {k for k, v in got.items() if v is not None} == buyers & set(got)
    last = {r.k: r.o for r in o.groupBy(o.o_custkey.alias("k")).agg({"o_orderkey": "max"}).toDF("k", "o").collect()}
    assert {k for k, x in last.items() if x % 5 == 0}.isdisjoint(r.key for r in plans.QUERIES["batch_overlay"](spark, SF).collect())
