"""Benchmark decontamination: suffix arrays over shards of the documents, searched by every test suffix.

A shard is about 8 MB of texts within one Arrow batch. Its suffix array holds the suffixes that can match at
all: those whose first words are test words for as long as the shortest test window. It is sorted by the first
WINDOW words. Every test suffix that a window starts is searched in it by binary search; each
occurrence is extended word by word to the longest verbatim match, and matches that could be
extended to the left are dropped, since the one that starts there holds them.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ._common import lower_ascii, lut, release, stored, text_buffer, word_hashes, word_spans

WINDOW = 10
BLOCK_BYTES = 16 << 20  # test texts of one block, which a worker holds at once
PASS_BLOCKS = 16  # blocks that one pass over the documents searches one after the other
SHARD = 8 << 20
PAIRS = 1 << 20  # occurrences that are extended at once

MATCH = "struct<item:string,item_start:int,start:int,length:int>"


def test_blocks(benchmark: DataFrame, block_bytes=BLOCK_BYTES):
    """Blocks of (item_id as string, text) of at most block_bytes, one text at least; the test set is streamed."""
    block, size = [], 0
    for r in benchmark.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").toLocalIterator():
        n = len(r[1].encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


class Tests:
    """A block of test items: word numbers, and the distinct windows in order, each with the test suffixes that it starts."""

    def __init__(self, block, window=WINDOW):
        import pyarrow as pa

        self.window, self.names = window, [n for n, _ in block]
        buf, off = text_buffer(pa.array([t for _, t in block], pa.string()))
        buf = lower_ascii(buf)
        s, e, row = word_spans(buf, off, lut("alnum"))
        h = word_hashes(buf, s, e)
        self.vocabulary = np.unique(h)
        self.ids = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int64)
        self.item, bounds = row, np.searchsorted(row, np.arange(len(block) + 1))
        self.first, n = bounds[:-1], np.diff(bounds)
        self.end = bounds[1:]
        at = np.arange(len(row))
        size = np.minimum(window, n)
        suffix = at[at - self.first[row] <= n[row] - size[row]] if len(row) else at
        size = size[row[suffix]]
        keys = self.keys(self.ids, suffix, size)
        _, one, which = np.unique(keys, return_index=True, return_inverse=True)
        order = np.argsort(which, kind="stable")
        self.suffix, self.starts = suffix[order], np.searchsorted(which[order], np.arange(len(one) + 1))
        self.size = size[one]
        self.low = keys[one]
        self.high = np.array([k.ljust(4 * n, b"\0")[: 4 * n].ljust(4 * window, b"\xff") for k, n in zip(self.low.tolist(), self.size.tolist())], f"S{4 * window}")
        self.shortest = int(self.size.min()) if len(one) else 1

    def keys(self, ids, at, size):
        """The first words of suffixes as byte strings that sort like them; size words each, filled with 0."""
        cols = np.zeros((len(at), self.window), ">u4")
        for j in range(self.window):
            ok = size > j
            cols[ok, j] = ids[at[ok] + j]
        return np.ascontiguousarray(cols).view(f"S{4 * self.window}").ravel()

    def suffix_array(self, ids, row):
        """(positions in the order of their suffixes, sorted keys) of a shard; other words have the number 0."""
        n = len(ids)
        at = np.arange(n)
        other = np.append(np.flatnonzero(ids == 0), n)
        last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1
        run = np.minimum(other[np.searchsorted(other, at)], last[np.searchsorted(last, at, side="right")]) - at
        pos = np.flatnonzero(run >= self.shortest)
        keys = self.keys(ids, pos, run[pos])
        order = np.argsort(keys, kind="stable")
        return pos[order], keys[order]

    def search(self, h, row, last):
        """Longest matches in a shard, as arrays (position of the first word, number of words, position in the test words).

        h holds the shard's word hashes, row the row of each word, last the end of each row.
        """
        none = np.zeros(0, np.int64)
        if not len(h) or not len(self.low):
            return none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == h, at + 1, 0)
        array, keys = self.suffix_array(ids, row)
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        met = np.flatnonzero(hi > lo)
        tests = np.diff(self.starts)
        found, i = [], 0
        while i < len(met):  # windows are taken together up to PAIRS pairs of an occurrence and a test suffix
            total = np.cumsum((hi[met[i:]] - lo[met[i:]]) * tests[met[i:]])
            j = i + max(1, int(np.searchsorted(total, PAIRS, side="right")))
            w = met[i:j]
            many, each = hi[w] - lo[w], tests[w]
            which = np.repeat(np.arange(len(w)), many * each)
            k = np.arange(len(which)) - np.repeat(np.cumsum(many * each) - many * each, many * each)
            q = array[lo[w][which] + k // each[which]]
            p = self.suffix[self.starts[w][which] + k % each[which]]
            inner = (p > self.first[self.item[p]]) & (q > 0)
            left = inner & (row[q] == row[np.maximum(q - 1, 0)]) & (self.ids[np.maximum(p - 1, 0)] == ids[np.maximum(q - 1, 0)])
            p, q, n = p[~left], q[~left], self.size[w][which[~left]]
            live = np.arange(len(p))
            while len(live):
                a, b = p[live] + n[live], q[live] + n[live]
                ok = (a < self.end[self.item[p[live]]]) & (b < last[row[q[live]]])
                live, a, b = live[ok], a[ok], b[ok]
                live = live[self.ids[a] == ids[b]]
                n[live] += 1
            found.append((q, n, p))
            i = j
        if not found:
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))


def _shards(off):
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SHARD, side="right")) - 1)
        yield lo, hi
        lo = hi


def _search(column, blocks, window):
    """(first row, last row, n_words of each row, matches as rows, items, item starts, starts, lengths), shard by shard; blocks gives each block in turn."""
    buf, off = text_buffer(column)
    for lo, hi in _shards(off):
        part = lower_ascii(buf[off[lo] : off[hi]])
        s, e, row = word_spans(part, off[lo : hi + 1] - off[lo], lut("alnum"))
        h = word_hashes(part, s, e)
        bounds = np.searchsorted(row, np.arange(hi - lo + 1))
        got = []
        for tests in blocks():
            q, n, p = tests.search(h, row, bounds[1:])
            item = tests.item[p]
            got.append((row[q], np.array(tests.names, object)[item] if len(p) else np.zeros(0, object), p - tests.first[item], q - bounds[row[q]], n))
        cols = [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, np.int64)] * 5
        order = np.lexsort((cols[3], cols[2], cols[1].astype(str), cols[0]))
        yield lo, hi, np.diff(bounds), *[c[order] for c in cols]


def _passes(spark, benchmark, window, block_bytes):
    """Lists of broadcast blocks, PASS_BLOCKS at most, with a function for workers that gives them one after the other; one empty list without test texts."""
    def worker(sent):
        def blocks():
            for b in sent:
                tests = Tests.__new__(Tests)
                vars(tests).update(b.value)
                yield tests

        return blocks

    sent = []
    for block in test_blocks(benchmark, block_bytes):
        sent.append(spark.sparkContext.broadcast(vars(Tests(block, window))))
        if len(sent) == PASS_BLOCKS:
            yield worker(sent)
            sent = []
    yield worker(sent)


def matches(docs: DataFrame, benchmark: DataFrame, window=WINDOW, block_bytes=BLOCK_BYTES) -> list:
    """Per row of docs: all columns of docs but text, then n_words and matches, the longest verbatim matches with their places.

    A match is (item, item_start, start, length), in words; it holds a whole window of `window` words, or the whole
    item if that is shorter. Every pair of places has its own match, so matches of several items, or of one item at several places,
    stay apart. Null and empty texts have no words; nothing is joined, so
    repeated and null ids do not matter; columns of docs named n_words or matches give way. A list of DataFrames
    comes back, one for each PASS_BLOCKS blocks of test texts; with none, one without matches.
    """
    import pyarrow as pa

    docs = docs.select(*[c for c in docs.columns if c not in ("text", "n_words", "matches")], "text")
    last = len(docs.columns) - 1
    names = [*docs.columns[:last], "n_words", "matches"]
    kind = pa.struct([("item", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
    schema = docs.drop("text").schema.add("n_words", "long").add("matches", T._parse_datatype_string(f"array<{MATCH}>"))

    def searched(blocks):
        def run(batches):
            for b in batches:
                for lo, hi, n_words, row, item, item_start, start, length in _search(b.column(last), blocks, window):
                    rows = pa.StructArray.from_arrays([pa.array(item.tolist(), pa.string()), *[pa.array(x, pa.int32()) for x in (item_start, start, length)]], fields=list(kind))
                    at = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)), pa.int32())
                    yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in b.columns[:last]], pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(at, rows)], names=names)

        return docs.mapInArrow(run, schema)

    return [searched(blocks) for blocks in _passes(docs.sparkSession, benchmark, window, block_bytes)]


def clean(docs: DataFrame, benchmark: DataFrame, window=WINDOW, block_bytes=BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no test window occurs, with all columns under their names.

    Null and empty texts stay; repeated rows and ids are judged row by row; an empty table stays empty. One pass over the texts for each
    PASS_BLOCKS blocks of test texts.
    """
    import pyarrow as pa

    at = docs.columns.index("text")

    def kept(docs, blocks):
        def run(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, _, _, row, *_ in _search(b.column(at), blocks, window):
                    keep[lo + row] = False
                yield b.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    for blocks in _passes(docs.sparkSession, benchmark, window, block_bytes):
        docs = kept(docs, blocks)
    return docs


def _spans(found):
    """found with starts and ends of the words that matches cover (overlapping matches joined) and items, sorted and distinct."""
    import pyarrow as pa

    names = ["doc_id", "n_words", "items", "starts", "ends", "matches"]

    def run(batches):
        for b in batches:
            items, starts, ends = [], [], []
            for m in b.column(2).to_pylist():
                a, z = [], []
                for x in sorted(m, key=lambda x: x["start"]):
                    p, q = x["start"], x["start"] + x["length"]
                    if z and p < z[-1]:
                        z[-1] = max(z[-1], q)
                    else:
                        a.append(p)
                        z.append(q)
                items.append(sorted({x["item"] for x in m}))
                starts.append(a)
                ends.append(z)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(items, pa.list_(pa.string())), pa.array(starts, ints), pa.array(ends, ints), b.column(2)], names=names)

    fields = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words long, items array<string>, starts array<int>, ends array<int>, matches array<{MATCH}>"
    return found.select("doc_id", "n_words", "matches").mapInArrow(run, fields)


def contaminated(docs: DataFrame, benchmark: DataFrame, window=WINDOW, block_bytes=BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items, starts, ends, matches, contaminated.

    Other columns of docs are ignored; an empty table gives no rows. With more test texts than one pass takes, the rows are
    numbered and written once, and the matches of a row are united by its number, so null and repeated doc_ids stay
    apart and the rows are the same at any number of blocks and passes.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    found = matches(docs, benchmark, window, block_bytes)
    if len(found) == 1:
        out = found[0]
    else:
        rows = stored(spark, docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
        every = [stored(spark, x if i == 0 else x.filter(F.size("matches") > 0), "matches") for i, x in enumerate(matches(rows, benchmark, window, block_bytes))]
        out = every[0]
        for x in every[1:]:
            out = out.unionByName(x)
        united = F.array_sort(F.flatten(F.collect_list("matches")))
        out = out.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), united.alias("matches"))
        out = stored(spark, out, "united")
        release(spark, rows, *every)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return _spans(out).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "starts", "ends", "matches").withColumn("contaminated", F.col("n_hit") > 0)


def op8(spark, sf_dir):
    out = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM ip),
ks AS (SELECT DISTINCT k FROM items),
dp AS (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
dwin AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM dp),
hits AS (SELECT rid, i, dwin.k, item_id FROM dwin JOIN items ON dwin.win = items.win AND dwin.k = items.k),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM hits)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
