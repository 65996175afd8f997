"""Shared pieces: the shared folder, Arrow text buffers, word spans and word hashes.

Arrow batches are bounded in bytes by spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set), whatever
the length of texts; workers cut them further where they need more memory than the text.
"""

import contextlib
import os
import tempfile
import uuid

import numpy as np

MAX_ID = 2**63 - 1  # what a null doc_id counts as: larger than every other


def partitions(spark):
    """Number of groups that a whole-corpus exchange is dealt into: what the cluster set for shuffles."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark):
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only a local session, as in tests, may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "tagstore-local")
    return base.rstrip("/")


def fresh_path(spark, name):
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark, df, name):
    """Write df to the shared folder and read it again; cuts lineage and survives lost executors."""
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def release(spark, *dfs):
    """Delete what stored() wrote for these."""
    for df in dfs:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


AUTO_BROADCAST = 256 << 10  # bytes of a table or exchange, compressed, up to which Spark may choose to broadcast it


@contextlib.contextmanager
def small_broadcasts(spark):
    """While this lasts, Spark itself broadcasts only small tables, and before as after what the session says.

    Spark judges a table by its bytes in files, and tables of numbers are many times as large in the driver's
    memory, where several are built at once. Broadcasts that the code asks for are not concerned.
    """
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    state = spark._jsparkSession.sessionState().conf()
    adaptive = state.getConf(spark._jvm.org.apache.spark.sql.internal.SQLConf.ADAPTIVE_AUTO_BROADCASTJOIN_THRESHOLD())
    least = min(AUTO_BROADCAST, state.autoBroadcastJoinThreshold())
    try:
        for k, now in zip(kept, (least, min(AUTO_BROADCAST, adaptive.get()) if adaptive.isDefined() else least)):
            spark.conf.set(k, now)
        yield
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bitmaps(numbers, column):
    """A set of whole numbers from 0 up, one bit each: _block and _map, a row of 4 KB for each block of 32,768 numbers that holds any."""
    from pyspark.sql import functions as F

    bits = numbers.select(F.bitmap_bucket_number(column).alias("_block"), F.bitmap_bit_position(column).alias("_bit")).repartition("_block")
    return bits.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_map"))


def within(rows, number, maps):
    """The rows whose number is in the set. The maps are broadcast, so the rows are not dealt out."""
    from pyspark.sql import functions as F

    bit = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(number) == F.col("_block"))
    return met.filter(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1).drop("_block", "_map")


def drop_unused_shuffles(spark):
    """Shuffle files go when the driver's garbage is collected; ask for that between large steps."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def worker_cache():
    """A dict that lives as long as a Python worker. Functions travel by value, so globals of this package are new in each task; this one hangs on a module of its own."""
    import sys
    import types

    return vars(sys.modules.setdefault("_tagstore_worker_cache", types.ModuleType("_tagstore_worker_cache")))


def text_buffer(column):
    """(bytes as uint8, offsets of rows, one more than rows) of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def lut(pattern):
    """Table of 256 booleans: which UTF-8 bytes belong to a word. 'space': all but ASCII white space; 'alnum': digits, letters and all non-ASCII."""
    t = np.ones(256, bool)
    if pattern == "space":
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[:0x80] = False
        t[0x30:0x3A] = t[0x61:0x7B] = t[0x41:0x5B] = True
    return t


def lower_ascii(buf):
    """A-Z to a-z, other bytes unchanged."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t[buf]


def word_spans(buf, off, table):
    """Starts and ends of all words, and the row of each; words never cross rows."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = off[:-1][off[:-1] < n]
    before[edges] = False
    edges = off[1:][off[1:] > 0]
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def mix(x):
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_MASKS = np.array([(1 << (8 * min(n, 8))) - 1 for n in range(9)], np.uint64)
LONG = 256  # bytes; longer words are hashed one by one


def word_hashes(buf, starts, ends):
    """64-bit hashes of words, the same for equal bytes wherever they stand: words are read eight bytes at a time."""
    import hashlib

    n = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    eights = np.ndarray((len(buf) + 1,), "<u8", np.append(buf, np.zeros(8, np.uint8)), strides=(1,))
    with np.errstate(over="ignore"):
        out = mix((eights[starts] & _MASKS[np.minimum(n, 8)]) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        live, at = np.flatnonzero((n > 8) & (n <= LONG)), 8
        while len(live):
            part = eights[starts[live] + at] & _MASKS[np.minimum(n[live] - at, 8)]
            out[live] = mix(out[live] * np.uint64(0x9E3779B97F4A7C15) + part)
            at += 8
            live = live[n[live] > at]
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(words, k):
    """Hash of words[i:i+k] for each i; the caller drops those that cross rows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        return mix(h + np.uint64(k))


def split(keys, n):
    """(bucket, rows of it) for keys modulo n."""
    bucket = (keys % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)) if len(order) else np.zeros(0, np.int64)
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
        yield int(bucket[order[a]]), order[a:z]
