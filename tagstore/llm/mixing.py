"""Mixing sources to target weights, with DataFrame functions only."""

from pyspark.sql import DataFrame, Window, functions as F

WORDS = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 100_000  # a source table of at most so many rows is broadcast


def size(text="text"):
    """The words of the whole text; null and empty texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=(5, 2, 1), share=1.5, most=2.0) -> DataFrame:
    """One row per source of rows (source, size): source, source_size, target.

    Sources stand by code point, null last, and take `weights` in turn. The targets share
    `share` times all sizes by weight, none above `most` times its source's size; what a source
    cannot take is shared again by weight. That fixed point is found in closed form: with sources
    by size over weight, the capped ones are a prefix, and the water level is the greatest over all prefixes. Sources of size 0 have target 0.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    x = by_source.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    x = (
        x.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_left"))
        .withColumn("level", F.max("level").over(every))
    )
    return x.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def plan_mix(docs: DataFrame, weights=(5, 2, 1), share=1.5, most=2.0, seed=17) -> DataFrame:
    """One row per row of docs: doc (all its columns), size, source_size, target, copies.

    The rate of a source is its target over its size. A document is taken floor(rate) times, and
    once more if a hash of the seed and its doc_id, read as a number in [0, 1), is below the
    rate's fraction. Rows with equal doc_id share that draw; a null doc_id draws as the text
    'null'. Reruns agree. Columns of docs may have any names. An empty table gives no rows.
    """
    sources = source_targets(docs.select("source", size().alias("size")), weights, share, most)
    known = sources.select(F.col("source").alias("_s"), "source_size", "target")
    if docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), size().alias("size"))
    joined = sized.join(known, F.col("doc.source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("null")))), 1, 8), 16, 10)
    copies = F.floor(rate) + (draw.cast("double") / F.lit(4294967296.0) < rate - F.floor(rate)).cast("long")
    return joined.select("doc", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row of docs as often as plan_mix says, with the columns of docs."""
    planned = plan_mix(docs, **how)
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return planned.filter(F.col("copies") > 0).select("doc", copy).select("doc.*")


def op5(spark, sf_dir):
    planned = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return planned.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
  source_size * 2.0::DOUBLE AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
l AS (SELECT *, max((total - cap_before) / w_left) OVER () AS level FROM v),
t AS (SELECT source, source_size, least(cap, level * w) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN
  ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
