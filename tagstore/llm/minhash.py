"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets.

A signature has 64 symbols of 16 bits, cut into 16 chunks of 4. Two signatures that differ in at
most 31 symbols agree, by the pigeonhole principle, in some chunk but for one symbol at most. So
each chunk is filed once under each of its 4 patterns with one symbol left out; documents that
meet under a key are candidates. At a similarity of 0.75 a pair differs in 16 symbols on average
and is missed with a probability below 1e-9, since each chunk alone meets with probability 0.74.
Candidates are confirmed on full sets of 64-bit shingle hashes.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._common import bitmaps, drop_unused_shuffles, gram_hashes, lower_ascii, lut, mix, partitions, release, small_broadcasts, split, stored, text_buffer, within, word_hashes, word_spans
from ._graph import components

SYMBOLS, CHUNKS = 64, 16
SHINGLE, SIMILAR = 5, (75, 100)
FARTHEST = 36  # differing symbols beyond which a candidate is not confirmed: at 0.75 that has a probability below 1e-7
MOST_BITS = 1 << 27  # of a set that is broadcast as bitmaps: 16 MB
HOT = 1000  # a class with more than one in so many rows is broadcast instead of dealt out by its key
CROWD, BLOCK = 100, 512  # members of a crowded key; documents of a block in which a crowd is compared

_rng = np.random.Generator(np.random.PCG64(20240229))
_MUL = (_rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def shingle_sets(buf, off, k=SHINGLE):
    """Sorted distinct shingle hashes of each row; a row of fewer words is one shingle, a row without words has none."""
    buf = lower_ascii(buf)
    s, e, row = word_spans(buf, off, lut("space"))
    h = word_hashes(buf, s, e)
    grams = gram_hashes(h, k)
    bounds = np.searchsorted(row, np.arange(len(off)))
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if z - a >= k:
            out.append(np.unique(grams[a : z - k + 1]))
        elif z > a:
            out.append(gram_hashes(h[a:z], z - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes):
    """16 chunks of four 16-bit minima, as 64-bit numbers."""
    with np.errstate(over="ignore"):
        low = np.full(SYMBOLS, np.uint64(2**64 - 1))
        for i in range(0, len(hashes), 4096):
            x = hashes[None, i : i + 4096] * _MUL[:, None]
            x += _ADD[:, None]
            x ^= x >> np.uint64(32)
            x *= _MUL[::-1, None]
            low = np.minimum(low, x.min(1))
        m = (mix(low) >> np.uint64(48)).reshape(CHUNKS, 4)
        return (m[:, 0] << np.uint64(48)) | (m[:, 1] << np.uint64(32)) | (m[:, 2] << np.uint64(16)) | m[:, 3]


def set_key(hashes):
    """Two 64-bit sums over the set, and its size."""
    with np.errstate(over="ignore"):
        return np.array([hashes.sum(dtype=np.uint64), mix(hashes).sum(dtype=np.uint64), len(hashes)], np.uint64).tobytes()


def _rows(batches, f):
    """Row blocks of about 4 MB of text: (batch, first row, last row, buf, off)."""
    for b in batches:
        buf, off = text_buffer(b.column(b.num_columns - 1))
        lo = 0
        while lo < len(off) - 1:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (4 << 20), side="right")) - 1)
            yield from f(b, lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            lo = hi


def signatures(docs: DataFrame, row=None) -> DataFrame:
    """doc_id, row (the column named so, or null), n_shingles, set_key (two 64-bit sums over the set), sig; rows without words have no sig."""
    import pyarrow as pa


    def made(b, lo, hi, buf, off):
        sets = shingle_sets(buf, off)
        keys = [set_key(x) for x in sets]
        sigs = [signature(x).view(np.int64) if len(x) else None for x in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
            names=["doc_id", "row", "n_shingles", "set_key", "sig"],
        )

    known = F.lit(None).cast("long") if row is None else F.col(row)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), known.alias("row"), "text").mapInArrow(
        lambda batches: _rows(batches, made), "doc_id long, row long, n_shingles long, set_key binary, sig array<long>"
    )


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and set (sorted hashes) of the classes wanted (id, doc_id, set_key).

    Hashes of their doc_ids, one bit in 16 or more, are broadcast and only spare reading other texts; what
    else gets through is dropped by set_key.
    """
    import pyarrow as pa

    most = F.lit(max(1, min(16 * wanted.count(), MOST_BITS)))
    place = F.pmod(F.xxhash64("doc_id"), most)
    rows = within(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), place, bitmaps(wanted, place)).select("doc_id", "text")

    def made(b, lo, hi, buf, off):
        sets = shingle_sets(buf, off)
        yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["set_key", "set"])

    sets = rows.mapInArrow(lambda batches: _rows(batches, made), "set_key binary, set binary").dropDuplicates(["set_key"])
    return sets.join(wanted.select("set_key", "id"), "set_key").select("id", "set")


def _confirm(pairs: DataFrame, sets: DataFrame, similar) -> DataFrame:
    """The pairs (a, b) whose sets have intersection over union of at least `similar`; both joins are on a key that AQE can split."""
    import pyarrow as pa

    num, den = similar
    both = pairs.join(sets.withColumnsRenamed({"id": "b", "set": "set_b"}), "b").join(sets.withColumnsRenamed({"id": "a", "set": "set_a"}), "a").select("a", "b", "set_a", "set_b")

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = den * n >= num * (len(x) + len(y) - n)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _shared_with_others(rows: DataFrame) -> DataFrame:
    """id, c, and shared: how many of the set's shingles some row of another component has, too.

    No row of another component can share more. Groups of rows report each shingle once, with
    the smallest and largest component, so a common shingle has no more reports than groups.
    """
    import pyarrow as pa

    groups = partitions(rows.sparkSession)
    dealt = rows.select("id", "c", "set", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("p"))

    def flat(table):
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(x) for x in sets], np.int64)

    def report(table):
        h, n = flat(table)
        c = np.repeat(np.asarray(table.column("c")), n)
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(h)) - 1
        known = h[first]
        cols = [known, c[first], c[last]]
        made = [(b, *[x[at].tobytes() for x in cols]) for b, at in split(known, groups)]
        p = table.column("p")[0].as_py()
        return pa.table({"bucket": pa.array([m[0] for m in made], pa.int32()), "p": pa.array([p] * len(made), pa.int32()), **{k: pa.array([m[i] for m in made], pa.binary()) for i, k in ((1, "h"), (2, "lo"), (3, "hi"))}})

    def common(table):
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("h")]
        h = np.concatenate(parts)
        lo, hi = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column(k)]) for k in ("lo", "hi"))
        values, at = np.unique(h, return_inverse=True)
        least, most = np.full(len(values), 2**63 - 1), np.full(len(values), -(2**63))
        np.minimum.at(least, at, lo)
        np.maximum.at(most, at, hi)
        several = values[least < most]
        out = [(p, x[np.isin(x, several)].tobytes()) for p, x in zip(table.column("p").to_pylist(), parts)]
        return pa.table({"p": pa.array([o[0] for o in out], pa.int32()), "h": pa.array([o[1] for o in out], pa.binary())})

    def count(left, right):
        if not left.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "shared": pa.array([], pa.int64())})
        h, n = flat(left)
        known = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x.as_buffer(), np.uint64) for x in right.column("h")]])
        total = np.append(0, np.cumsum(np.isin(h, known)))
        ends = np.cumsum(n)
        return pa.table({"id": left.column("id"), "c": left.column("c"), "shared": pa.array(total[ends] - total[ends - n], pa.int64())})

    by = dealt.groupBy("p")
    back = by.applyInArrow(report, "bucket int, p int, h binary, lo binary, hi binary").groupBy("bucket").applyInArrow(common, "p int, h binary")
    return by.cogroup(back.groupBy("p")).applyInArrow(count, "id long, c long, shared long")


def _confirm_crowds(members: DataFrame, similar) -> DataFrame:
    """Links (a, b) between components within each crowd, a set of documents that meet under crowded keys.

    A crowd is cut into blocks, and each pair of blocks is one task: it holds two blocks of sets at
    most, compares signatures of documents of different components, confirms those within the
    distance on full sets, and skips what it has linked already. No pairs are written but links.
    """
    import pyarrow as pa

    num, den = similar
    blocks = members.groupBy("crowd").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "crowd").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(table):
        table = table.sort_by("id")
        ids, own = np.asarray(table.column("id")), np.asarray(table.column("own"))
        shared = np.asarray(table.column("shared"))
        comp = np.unique(np.asarray(table.column("c")), return_inverse=True)[1]
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        size = np.array([len(x) for x in sets])
        sig = np.array(table.column("sig").to_pylist(), np.int64).view(np.uint16)
        inside = bool((own == own[0]).all())
        parent = list(range(int(comp.max()) + 1))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x in range(len(ids)):
            y = np.arange(x + 1, len(ids))
            ok = (comp[y] != comp[x]) & (np.minimum(shared[y], shared[x]) * (num + den) >= (size[y] + size[x]) * num) & (np.minimum(size[y], size[x]) * den >= np.maximum(size[y], size[x]) * num)
            if not inside:
                ok &= own[y] != own[x]
            y = y[ok]
            if not len(y):
                continue
            far = (sig[y] != sig[x]).sum(1)
            y = y[far <= FARTHEST][np.argsort(far[far <= FARTHEST], kind="stable")]
            for z in y.tolist():
                p, q = find(comp[x]), find(comp[z])
                if p != q:
                    n = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
                    if den * n >= num * (size[x] + size[z] - n):
                        parent[max(p, q)] = min(p, q)
                        out.append((ids[x], ids[z]))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return dealt.groupBy("crowd", "i", "j").applyInArrow(compare, "a long, b long")


def _near(x, y):
    """Whether two signatures differ in at most FARTHEST symbols; sizes must allow the similarity."""
    differ = F.aggregate(
        F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q)),
        F.lit(0),
        lambda n, d: n + sum((d.bitwiseAND(F.lit(m)) != 0).cast("int") for m in (0xFFFF, 0xFFFF << 16, 0xFFFF << 32, -(1 << 48))),
    )
    return differ <= FARTHEST


def _named(classes, named, reps, used):
    """set_key, copies, component (smallest doc_id) and keeper (the row that is kept of the component) of every class.

    As in _members, the components that hold more than one in HOT of the linked classes are
    broadcast and only the others are dealt out.
    """
    linked = classes.join(named, "id")
    alone = classes.join(named.select("id"), "id", "left_anti")
    limit = named.count() // HOT
    size = named.groupBy("component").agg(F.count("*").alias("size"))
    roots = stored(reps.sparkSession, size.join(reps.select(F.col("id").alias("component"), "doc_id", "row"), "component"), "roots")
    used.append(roots)
    hot, cold = F.broadcast(roots.filter(F.col("size") > limit)), roots.filter(F.col("size") <= limit)
    linked = linked.drop("doc_id", "row")
    plain = linked.join(hot.select("component"), "component", "left_anti").join(cold, "component")
    columns = ["set_key", "copies", F.col("doc_id").alias("component"), F.col("row").alias("keeper")]
    return alone.select(*columns).unionByName(linked.join(hot, "component").select(*columns)).unionByName(plain.select(*columns))


def _members(table, classes):
    """doc_id, row, n_shingles, component, keeper of every row of the table, by its class.

    A class that holds more than one in HOT rows is broadcast: there are fewer than HOT of them
    at any size of the input. Only the other classes are dealt out by set_key, so no task
    reads a large group of copies; rows without a set need no class.
    """
    rows = table.filter(F.col("sig").isNotNull()).select("doc_id", "row", "n_shingles", "set_key")
    limit = table.count() // HOT
    hot = F.broadcast(classes.filter(F.col("copies") > limit).select("set_key", "component", "keeper"))
    cold = classes.filter(F.col("copies") <= limit).select("set_key", "component", "keeper")
    plain = rows.join(hot.select("set_key"), "set_key", "left_anti").join(cold, "set_key")
    alone = table.filter(F.col("sig").isNull()).select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component"), F.col("row").alias("keeper"))
    columns = ["doc_id", "row", "n_shingles", "component", "keeper"]
    return rows.join(hot, "set_key").select(*columns).unionByName(plain.select(*columns)).unionByName(alone)


def near_duplicates(docs: DataFrame, similar=SIMILAR, row=None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, and the column named by row, whose long is another in every row.

    Equal sets are one class, numbered in the order of their smallest doc_ids. Each class is compared with one
    leader, of the smallest classes under its keys the one it shares most keys with; the
    components of confirmed links leave few keys that still hold several components. In a second
    round the leader of such a key is its class with the largest share of shingles that other
    components have, too, which in a large group is the text that the others were made from. Under the
    keys that are still open all pairs of different components are candidates, by a join or, for
    documents that meet under crowded keys, block by block, if their sizes, their
    signatures and the numbers of shingles shared with other components allow the similarity. Pairs
    within a component need no comparison. A component is named by its smallest doc_id, where a
    null counts as larger than all others, and keeps one row of that doc_id; rows of one doc_id
    but different texts are different classes. Rows without words are linked with nothing and kept. doc_id
    must be a whole number or null; other columns of docs are ignored. An empty table gives no rows. The result is a stored
    table; all that leads to it is deleted.
    """
    with small_broadcasts(docs.sparkSession):
        return _searched(docs, similar, row)


def _searched(docs, similar, row):
    spark = docs.sparkSession
    num, den = similar
    table = signatures(docs, row)
    if row is None:  # written once, so it stays the same
        table = table.withColumn("row", F.monotonically_increasing_id())
    table, used = stored(spark, table, "signatures"), []

    def keep(df, name):  # until the end of this call
        used.append(stored(spark, df, name))
        return used[-1]

    used.append(table)
    reps = table.filter(F.col("sig").isNotNull()).groupBy("set_key").agg(F.min_by(F.struct("doc_id", "row", "n_shingles", "sig"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("x"), F.count("*").alias("copies"))
    reps = reps.select("set_key", "copies", "x.doc_id", "x.row", F.col("x.n_shingles").alias("n"), "x.sig").sort(F.col("doc_id").asc_nulls_last(), "set_key")
    reps = keep(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    classes = reps.select("id", "set_key", "copies", "doc_id", "row")
    masks = F.array(*[F.lit(x) for x in ((1 << 48) - 1, ~(0xFFFF << 32), ~(0xFFFF << 16), ~0xFFFF)])
    keyed = reps.select("id", F.posexplode("sig").alias("chunk", "s")).select("id", "chunk", "s", F.posexplode(masks).alias("hole", "mask")).select(F.xxhash64("chunk", "hole", F.col("s").bitwiseAND(F.col("mask"))).alias("key"), "id")
    shared = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("key", "first")
    met = keep(keyed.join(shared, "key").select("key", "first", "id"), "met")
    drop_unused_shuffles(spark)
    small = reps.select("id", "n", "sig")

    def fits(pairs):
        a, b = small.withColumnsRenamed({"id": "a", "n": "na", "sig": "sa"}), small.withColumnsRenamed({"id": "b", "n": "nb", "sig": "sb"})
        both = pairs.join(a, "a").join(b, "b")
        return both.filter((F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & _near("sa", "sb")).select("a", "b")

    wanted = keep(reps.select("id", "doc_id", "set_key").join(met.select("id").distinct(), "id", "left_semi"), "wanted")
    sets = keep(full_sets(docs, wanted), "sets")
    led = met.filter("first < id").select("id", "first")
    links = named = None
    for more in (True, False):
        led = led.groupBy("id", "first").agg(F.count("*").alias("n")).groupBy("id").agg(F.max(F.struct("n", (-F.col("first")).alias("f"))).alias("x"))
        led = led.select(F.least(-F.col("x.f"), "id").alias("a"), F.greatest(-F.col("x.f"), "id").alias("b")).distinct()
        found = keep(_confirm(fits(led), sets, similar), "links")
        links = found if links is None else links.unionByName(found)
        drop_unused_shuffles(spark)
        if named is not None:
            release(spark, named)
        named = components(spark, links)
        of = met.select("key", "id").join(named, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
        open_keys = of.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
        rest = keep(of.join(open_keys, "key", "left_semi"), "open")
        shared = _shared_with_others(rest.select("id", "c").distinct().join(sets, "id")).join(small, "id").filter(F.col("shared") * den >= F.col("n") * num)
        rest = rest.select("key", "id").join(keep(shared, "possible"), "id")
        if more:
            hub = rest.groupBy("key").agg(F.max(F.struct((F.col("shared") / F.col("n")).alias("part"), (-F.col("id")).alias("f"), "c")).alias("hub"))
            led = rest.select("key", "id", "c").join(hub, "key").filter("c <> hub.c").select("id", (-F.col("hub.f")).alias("first"))
    crowded = rest.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("b")).filter(F.col("m") > CROWD).select("key", "b")
    used.append(components(spark, rest.join(crowded, "key").select(F.col("id").alias("a"), "b").distinct()))
    crowds = used[-1].withColumnRenamed("component", "crowd")
    rest = rest.join(crowds, "id", "left")
    sides = [rest.select("key", *[F.col(x).alias(x + s) for x in ("id", "c", "n", "shared", "sig", "crowd")]) for s in "ab"]
    bound = F.least("shareda", "sharedb") * (num + den) >= (F.col("na") + F.col("nb")) * num
    apart = F.coalesce(F.col("crowda") != F.col("crowdb"), F.lit(True))
    more = sides[0].join(sides[1], "key").filter((F.col("ida") < F.col("idb")) & (F.col("ca") != F.col("cb")) & apart & bound & _near("siga", "sigb"))
    more = keep(more.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct(), "pairs")
    links = links.unionByName(_confirm(more, sets, similar))
    members = rest.dropDuplicates(["id"]).filter(F.col("crowd").isNotNull()).select("id", "crowd", "c", "shared", "sig").join(sets, "id")
    links = links.unionByName(_confirm_crowds(members, similar))
    links = keep(links, "links")
    release(spark, named)
    named = components(spark, links)
    classes = stored(spark, _named(classes, named, reps, used), "classes")
    out = _members(table, classes)
    also = [] if row is None else [F.col("row").alias(row)]
    out = stored(spark, out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("row") == F.col("keeper")).alias("kept"), *also), "near")
    release(spark, classes, named, *used)
    return out


def op10(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
