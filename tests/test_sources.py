from pyspark.sql import functions as F

from tagstore import sources
from tagstore.operators import range_records
from tagstore.operators.layers import fold_named, xor_bytes
from tagstore.streaming import feed, ingest, windowed_counts
from tagstore.streaming.pool import pooled, pooled_stream

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_workloads(spark):
    keys = sources.uniform_keys(spark, 500, 10, 20)
    assert keys.collect() == sources.uniform_keys(spark, 500, 10, 20).collect()
    assert {r.key for r in keys.collect()} == set(range(10, 21))
    mix = sources.mixed_workload(spark, 2000, 1, 1000, {"point": 5, "small": 5, "large": 50, "insert": 40}, 10, 50).collect()
    assert all(1 <= r.left <= r.right <= 1000 and r.right - r.left == {"small": 10, "large": 50}.get(r.kind, 0) for r in mix)
    assert 900 < sum(r.kind == "large" for r in mix) < 1100


def test_markov_chains(spark):
    m = [[0.3, 0.65, 0.05], [0.9, 0, 0.1], [0.7, 0.3, 0]]
    rows = sources.markov_queries(spark, 40, 200, m).orderBy("chain", "seq").collect()
    assert len(rows) == 8000 and all(r.state == 0 for r in rows if r.seq == 0)
    steps = [(a.state, b.state) for a, b in zip(rows, rows[1:]) if a.chain == b.chain]
    assert (1, 1) not in steps and (2, 2) not in steps
    share = sum(s == (0, 1) for s in steps) / sum(s[0] == 0 for s in steps)
    assert abs(share - 0.65) < 0.03


def test_sealing_and_files(spark, tmp_path):
    df = spark.createDataFrame([(3, b"c"), (1, b""), (2, None)], "key int, v binary")
    sealed = sources.sealed(df, "v", b"0" * 16)
    assert [len(r.v) for r in sealed.orderBy("key").collect() if r.v is not None] == [28, 29]
    sources.write_sorted(sealed, str(tmp_path / "t"))
    back = sources.opened(spark.read.parquet(str(tmp_path / "t")), "v", b"0" * 16)
    assert {r.key: r.v and bytes(r.v) for r in back.collect()} == {1: b"", 2: None, 3: b"c"}


def test_inverted_and_null_ranges(spark):
    q = spark.createDataFrame([(1, 5, 2), (2, 0, 3), (3, None, 9)], "qid int, left long, right long")
    r = spark.createDataFrame([(0, 1, 1, 1.0), (3, 1, 1, 1.0), (None, 1, 1, 1.0)], "key long, op int, ts long, val double")
    assert {(x.qid, x.key) for x in range_records(q, r, 2).collect()} == {(2, 0), (2, 3)}


def test_named_folds(spark):
    rows = [("foo", 1, "sum", 10), ("foo", 2, "sum", 20), ("foo", 3, "sum", 15), ("foo2", 1, "sum", 10), ("foo2", 2, "sum", 20)]
    rows += [("bar2", 1, "multiply", 10), ("bar2", 2, "multiply", 20), ("bar2", 3, "sum", 30), ("bar2", 4, "sum", 40)]
    rows += [("foo3", i, "multiply", 10) for i in (1, 2, 3)] + [("foo3", 4, "sum", 10), ("bad", 1, "sum", 1), ("bad", 2, "other", 1)]
    base = spark.createDataFrame([("foo2", 30), ("only", 7)], "key string, value int")
    got = {r.key: (r.value, r.failed) for r in fold_named(spark.createDataFrame(rows, "key string, seq int, fn string, value int"), base).collect()}
    assert got == {"foo": (45, False), "foo2": (60, False), "bar2": (270, False), "foo3": (1010, False), "bad": (None, True), "only": (7, False)}


def test_xor_bytes(spark):
    rows = [(1, b"abcde"), (1, b"\x01"), (1, None), (2, b""), (3, None), (4, b"\x0f" * 9), (4, b"\xf0" * 4)]
    got = {r.k: r.hex for r in xor_bytes(spark.createDataFrame(rows, "k int, v binary"), "k", "v").collect()}
    assert got == {1: "6062636465", 2: "", 3: "", 4: "ff" * 4 + "0f" * 5}


def test_streaming_counts_and_ingest(spark, tmp_path):
    e = spark.read.parquet(EVENTS)
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = feed(spark, str(tmp_path / "in"), e.schema)
    q = windowed_counts(stream, late="60 days").writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    seen = spark.table("counts").groupBy("window", "event_type").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    assert seen == e.count()
    q = ingest(stream.withColumnRenamed("event_id", "key"), str(tmp_path / "runs"), str(tmp_path / "cp"), 100)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "runs")).count() == e.count()


def test_pool_stream_equals_table(spark, tmp_path):
    e = spark.read.parquet(EVENTS).withColumn("g", F.col("user_id") % 5)
    half = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    e.filter(F.col("event_id") <= half).coalesce(1).write.parquet(str(tmp_path / "in"))
    e.filter(F.col("event_id") > half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = {(r.grp, r.round): (r.served, r.waiting) for r in pooled(e, "g", "event_id", "event_type", 3, "exponential").collect()}
    out = pooled_stream(feed(spark, str(tmp_path / "in"), e.schema), "g", "event_id", "event_type", 3, "exponential")
    q = out.writeStream.format("memory").queryName("pool").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.grp, r.round): (r.served, r.waiting) for r in spark.table("pool").collect()} == whole
    assert max(n for _, n in whole.values()) == 3
    asked = {(r.g, r.event_type): r["count"] for r in e.groupBy("g", "event_type").count().collect()}
    for (g, k), n in asked.items():
        assert sum(s == k for (gg, _), (s, _) in whole.items() if gg == g) in range(n - 3, n + 1)
