"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Null and empty texts are ordinary, alone and clean, have no words to mix and a token sequence of the end id alone; the mix takes
such documents as often as its source's rate says. Repeated rows are copies: near-dedup keeps one. Empty tables stay
empty, and columns may have any names.
"""

from pyspark.sql import Window, functions as F

from tagstore.llm import _common, huffman, minhash, mixing, suffix_search, toxicity


def _toxicity(spark, docs, sf_dir):
    """Documents that the classifier does not reject; null and empty texts stay."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates: one with the smallest doc_id, nulls last. Documents without words stay.

    Rows are told apart by their number in the files of docs, since doc_ids may be null or repeated: a file's rows follow
    those of the files before it. So the rows kept are one bit each, and texts are not dealt out for them.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index")]
    sizes = docs.select(*place).groupBy("file").agg((F.max("index") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    files = _common.stored(spark, sizes.select("file", before.alias("before")), "files")

    def numbered(*columns):
        rows = docs.select(*columns, *place).join(F.broadcast(files), "file")
        return rows.withColumn("row", F.col("before") + F.col("index")).drop("file", "index", "before")

    near = minhash.near_duplicates(numbered("doc_id", "text"), row="row")
    kept = _common.stored(spark, near.filter("kept").select("row"), "kept")
    _common.release(spark, near)
    rows = numbered(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    if (kept.agg(F.max("row")).first()[0] or 0) < minhash.MOST_BITS:
        return _common.within(rows, F.col("row"), _common.bitmaps(kept, "row")).select("doc.*")
    return rows.join(kept.hint("merge"), "row", "left_semi").select("doc.*")


def _decontamination(spark, docs, sf_dir):
    """Documents that hold no window of a benchmark item; null and empty texts stay."""
    return suffix_search.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixing(spark, docs, sf_dir):
    """Documents as often as the mix takes them; rows with one doc_id, and rows without, share a draw."""
    return mixing.mix(docs)


def _token_ids(spark, docs, sf_dir):
    """Offsets, lengths and checksums of the token ids, read back from their files; one row for each document, null ids first."""
    return huffman.digests(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("near_dedup", _near_dedup),
    ("decontamination", _decontamination),
    ("mixing", _mixing),
    ("token_ids", _token_ids),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of sf_dir; what a stage wrote is deleted when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = _common.stored(spark, stage(spark, docs, sf_dir), name)
        if before is not None:
            _common.release(spark, before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    _common.release(spark, docs)
    return out
