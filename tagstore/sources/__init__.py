"""Sources: records, versions, query logs and traces projected from the base tables, synthetic workloads, and table files."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

OP_INSERT, OP_DELETE = 1, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(orders: DataFrame) -> DataFrame:
    """key, op, ts, val; a null key is refused by leaving it out."""
    deleted = (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0)
    return orders.filter(F.col("o_orderkey").isNotNull()).select(
        F.col("o_orderkey").alias("key"), F.when(deleted, OP_DELETE).otherwise(OP_INSERT).alias("op"),
        F.unix_timestamp("o_orderdate").alias("ts"), F.col("o_totalprice").alias("val"),
    )


def versions(lineitem: DataFrame) -> DataFrame:
    """key, seq (newest is highest), op (put, merge or delete), value."""
    op = F.when(F.col("l_returnflag") == "R", "delete").when(F.col("l_returnflag") == "A", "merge").otherwise("put")
    return lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("seq"), op.alias("op"), F.col("l_extendedprice").alias("value"))


def uniform_keys(spark: SparkSession, n: int, lo: int, hi: int, seed: int = 28603) -> DataFrame:
    """n integer keys spread over [lo, hi] by a seeded hash; reruns agree."""
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(hi - lo + 1))
    return spark.range(n).select("id", (u + lo).alias("key"))


def mixed_workload(spark: SparkSession, n: int, lo: int, hi: int, weights: dict, small: int, large: int, seed: int = 28603) -> DataFrame:
    """Queries (qid, kind, left, right) drawn by weight among point, small, large, insert and delete; ranges stay inside the domain."""
    kinds, total = list(weights), float(sum(weights.values()))
    u = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * total
    kind, upto = F.lit(kinds[-1]), total
    for k in reversed(kinds[:-1]):
        upto -= weights[kinds[kinds.index(k) + 1]]
        kind = F.when(u < upto, k).otherwise(kind)
    length = F.when(F.col("kind") == "small", small).when(F.col("kind") == "large", large).otherwise(0)
    rows = spark.range(n).withColumn("kind", kind).withColumn("len", length)
    left = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(hi - lo + 1) - F.col("len")) + lo
    return rows.select(F.col("id").alias("qid"), "kind", left.alias("left"), (left + F.col("len")).alias("right"))


def markov_queries(spark: SparkSession, chains: int, length: int, matrix, seed: int = 28603) -> DataFrame:
    """States (chain, seq, state) of independent Markov chains that start at state 0; a chain is one row until its states are exploded."""
    n = len(matrix)

    def after(state, u):
        out = F.lit(n - 1)
        for i in reversed(range(n)):
            nxt = F.lit(n - 1)
            for j in reversed(range(n - 1)):
                nxt = F.when(u < sum(matrix[i][: j + 1]), F.lit(j)).otherwise(nxt)
            out = F.when(state == i, nxt).otherwise(out)
        return out

    u = lambda i: F.pmod(F.xxhash64(F.lit(seed), "chain", i), F.lit(1 << 30)) / F.lit(float(1 << 30))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(length - 1)), F.array(F.lit(0)), lambda acc, i: F.concat(acc, F.array(after(F.element_at(acc, -1), u(i))))) if length > 1 else F.array(F.lit(0))
    return spark.range(chains).withColumnRenamed("id", "chain").select("chain", F.posexplode(walk).alias("seq", "state"))


def write_sorted(df: DataFrame, path: str, keys=("key",), codec="zstd") -> None:
    """An external table file set: range-partitioned and sorted by key, so that footers prune."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").option("compression", codec).parquet(path)


def change_feed(log: DataFrame, since: int) -> DataFrame:
    return log.filter(F.col("seq") >= since)


def sealed(df: DataFrame, column: str, key) -> DataFrame:
    """AES-GCM of a binary column: a 12-byte nonce, the text and a 16-byte tag."""
    return df.withColumn(column, F.aes_encrypt(F.col(column).cast("binary"), F.lit(key), F.lit("GCM")))


def opened(df: DataFrame, column: str, key) -> DataFrame:
    return df.withColumn(column, F.aes_decrypt(column, F.lit(key), F.lit("GCM")))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("DataFrame", "SparkSession", "Window", "F")]
