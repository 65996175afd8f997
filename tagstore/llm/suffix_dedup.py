"""Substring dedup: suffix trees over word sequences, partitioned by variable-length prefixes.

A sparse suffix tree is built: of the suffixes only those near an anchor are kept, the
7-gram with the least hash among the 7 that a window of 13 words holds. Equal windows have equal
anchors at equal places, so no repeat is lost.

1. Each group of rows (about GROUP_BYTES of text, dealt by a hash of the row) reports the hashes of its anchors once; anchors that only one group
   knows and that it knows once cannot start a repeat and are dropped.
2. What the windows around a remaining anchor cover is dealt out by its prefix: the anchor's 7 words, or, where more than a share of all groups knows an anchor, the
   whole window of 13 words. A group reports equal segments once, with the smallest and largest
   doc_id, so no prefix holds more rows than there are groups and a common passage stays small.
3. In each prefix partition the words get exact numbers, the suffixes of 13 words or more are sorted, and the common
   prefixes of neighbours give the subtree. The leaves of a node of string depth 13 or more repeat each other; the
   node's smallest doc_id goes back to the groups that have a larger one.
4. Each group marks the words that such windows cover in its documents; windows next to each other
   make up the maximal repeats.

Words are compared as such inside the subtrees; windows find their way back within a group by a 64-bit hash.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._common import gram_hashes, lut, partitions, split, text_buffer, word_hashes, word_spans

WINDOW = 13
GROUP_BYTES = 8 << 20  # text of a group of rows
LAST = 2**63 - 1


class Words:
    """Words of a group of texts, their hashes, and the anchor of each window."""

    def __init__(self, column, window):
        self.buf, self.off = text_buffer(column)
        self.start, self.end, self.row = word_spans(self.buf, self.off, lut("space"))
        self.hash = word_hashes(self.buf, self.start, self.end)
        n, self.anchor_words = len(self.hash) - window + 1, (window + 1) // 2
        self.gram = gram_hashes(self.hash, self.anchor_words)
        if n <= 0:
            self.window, self.anchor = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        span = window - self.anchor_words + 1
        bits = np.uint64(span.bit_length())  # the place in the window stands in the lowest bits, so the least number tells it
        best = self.gram[:n] >> bits << bits
        for j in range(1, span):
            best = np.minimum(best, self.gram[j : j + n] >> bits << bits | np.uint64(j))
        self.window = np.flatnonzero(self.row[:n] == self.row[window - 1 :])  # windows within one text
        self.anchor = self.window + (best[self.window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _pack(segments, low, high, null):
    """Segments with their smallest and largest doc_id; null holds 1 where all, 2 where some doc_ids are null, which count as larger than all others."""
    import zstandard

    head = np.array([len(segments)], "<i8").tobytes()
    sizes = np.array([len(s) for s in segments], "<i4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, sizes, np.array(low, "<i8").tobytes(), np.array(high, "<i8").tobytes(), bytes(null), *segments]))


def _unpack(blob):
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at = 8 + 4 * n
    low, high = np.frombuffer(raw, "<i8", n, at), np.frombuffer(raw, "<i8", n, at + 8 * n)
    return np.frombuffer(raw, "<i4", n, 8).astype(np.int64), low, high, np.frombuffer(raw, np.uint8, n, at + 16 * n), raw[at + 17 * n :]


def _column(table, name):
    return np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(name)]])


class Subtree:
    """The suffix tree of some word sequences, down to `most` words: suffixes in order, and what neighbours share.

    words are numbers, row tells the sequences apart; suffixes shorter than `least` words are left out.
    """

    def __init__(self, words, row, least, most):
        n = len(words)
        end = np.searchsorted(row, row, side="right") if n else np.zeros(0, np.int64)
        at = np.flatnonzero(end - np.arange(n) >= least)
        size = np.minimum(end[at] - at, most)
        number = np.append(words.astype(np.uint64) + np.uint64(1), np.zeros(most, np.uint64))
        width = max(1, int(number.max()).bit_length())
        per = max(1, 64 // width)
        keys = []
        for j in range(0, most, per):  # several words in each sort key; 0 stands behind an end
            key = np.zeros(len(at), np.uint64)
            for k in range(j, j + per):
                key = key << np.uint64(width) | (np.where(size > k, number[at + k], np.uint64(0)) if k < most else np.uint64(0))
            keys.append(key)
        order = np.lexsort(keys[::-1]) if len(at) else at
        self.suffix = at[order]
        shared, same = np.zeros(max(0, len(at) - 1), np.int64), np.ones(max(0, len(at) - 1), bool)
        for key in keys:
            sorted_ = key[order]
            differ = sorted_[1:] ^ sorted_[:-1]
            words_ = np.full(len(differ), per, np.int64)
            some = differ > 0
            if some.any():
                words_[some] = (per * width - 1 - np.floor(np.log2(differ[some].astype(np.float64))).astype(np.int64)) // width
            shared += np.where(same, words_, 0)
            same &= ~some
        short = np.minimum(size[order][1:], size[order][:-1])
        self.shared = np.minimum(shared, short)  # words that a suffix has in common with the one before it

    def deep(self, depth):
        """First leaves of the highest nodes of at least this string depth, and of the leaves that repeat nothing; the end is the last number."""
        if not len(self.suffix):
            return np.zeros(1, np.int64)
        return np.append(np.flatnonzero(np.append(True, self.shared < depth)), len(self.suffix))

    def nodes(self, depth):
        """Internal nodes of at least this string depth: (string depth, first leaf, leaf behind the last), inner nodes first."""
        stack = []
        for i, h in enumerate([*self.shared.tolist(), 0]):
            first = i
            while stack and stack[-1][0] > h:
                d, first = stack.pop()
                if d >= depth:
                    yield d, first, i + 1
            if h and (not stack or stack[-1][0] < h):
                stack.append((h, first))

    def maximal(self, words, row, depth):
        """Maximal repeats (string depth, positions): nodes whose leaves are preceded by different words or by none."""
        for d, a, z in self.nodes(depth):
            at = self.suffix[a:z]
            before = {int(words[i - 1]) if i and row[i - 1] == row[i] else -1 - int(row[i]) for i in at.tolist()}
            if len(before) > 1:
                yield d, np.sort(at)


def _numbers(buf, start, end):
    """Exact numbers of words."""
    import pyarrow as pa

    n = end - start
    off = np.append(0, np.cumsum(n))
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    data = buf[np.cumsum(inside[:-1]).astype(bool)]
    if off[-1] < 2**31:
        column = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
    else:
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])
    return np.asarray(column.dictionary_encode().indices).astype(np.int64)


def repeats(docs: DataFrame, window=WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, starts and ends of removed spans (in words), kept_text.

    A word goes if a window over it also starts in a document with a smaller doc_id. Rows with
    equal doc_id never remove each other's words; a null doc_id counts as larger than all others.
    Null and empty texts have no words and an empty kept_text. An empty table gives no rows; other columns of docs are
    ignored. Rows are dealt into groups by a hash of the whole row and its input partition, so many rows of one doc_id, or none, spread.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(2 * partitions(spark), -(-size // GROUP_BYTES))
    heavy = max(32, groups // 8)
    ident = F.col("doc_id").cast("long")
    texts = docs.select(ident.alias("id"), "text", F.pmod(F.xxhash64(ident, "text", F.spark_partition_id()), F.lit(groups)).cast("int").alias("p"))

    def known_ids(column):
        """Numbers with LAST for null, and which of them are null."""
        null = np.asarray(column.is_null())
        return np.asarray(column.fill_null(LAST)), null

    def report(table):
        w = Words(table.column("text"), window)
        known = np.unique(w.gram[np.unique(w.anchor)])
        p = table.column("p")[0].as_py()
        rows = [(b, known[at].tobytes()) for b, at in split(known, groups)]
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "p": pa.array([p] * len(rows), pa.int32()), "hashes": pa.array([h for _, h in rows], pa.binary())})

    def common(table):
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        many, most = values[counts > 1], values[counts > heavy]
        out = []
        for p, x in zip(table.column("p").to_pylist(), parts):
            both = x[np.isin(x, many)]
            if len(both):
                out.append((p, both.tobytes(), both[np.isin(both, most)].tobytes()))
        return pa.table({"p": pa.array([o[0] for o in out], pa.int32()), "hashes": pa.array([o[1] for o in out], pa.binary()), "heavy": pa.array([o[2] for o in out], pa.binary())})

    def cut(left, right):
        empty = pa.table({"prefix": pa.array([], pa.int32()), "p": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        if not left.num_rows:
            return empty
        w = Words(left.column("text"), window)
        if not len(w.window):
            return empty
        at = np.unique(w.anchor)
        values, counts = np.unique(w.gram[at], return_counts=True)
        many = np.union1d(values[counts > 1], _column(right, "hashes"))
        most = _column(right, "heavy")
        of = w.gram[w.anchor]
        keep = np.isin(of, many)
        win, anchor, of = w.window[keep], w.anchor[keep], of[keep]
        if not len(win):
            return empty
        long = np.isin(of, most)
        first = np.append(True, (np.diff(anchor) != 0) | (np.diff(win) != 1)) | long
        a = np.flatnonzero(first)
        z = np.append(a[1:], len(win)) - 1
        whole = gram_hashes(w.hash, window)
        key = np.where(long[a], whole[win[a]], of[a])
        lo, hi = w.start[win[a]], w.end[win[z] + window - 1]
        ids, null = known_ids(left.column("id"))
        row = w.row[win[a]]
        raw, seen = w.buf.tobytes(), {}
        keys, segments, low, high, missing = [], [], [], [], []
        for k, b, e, i, m in zip(key.tolist(), lo.tolist(), hi.tolist(), ids[row].tolist(), null[row].tolist()):
            s = raw[b:e]
            j = seen.setdefault(s, len(segments))
            if j == len(segments):
                keys.append(k)
                segments.append(s)
                low.append(i)
                high.append(i)
                missing.append(int(m))
                continue
            if m != missing[j]:
                missing[j] = 2
            if i < low[j]:
                low[j] = i
            elif i > high[j]:
                high[j] = i
        rows = [(b, _pack(*([y[j] for j in x] for y in (segments, low, high, missing)))) for b, x in ((b, x.tolist()) for b, x in split(np.array(keys, np.uint64), groups))]
        p = left.column("p")[0].as_py()
        return pa.table({"prefix": pa.array([b for b, _ in rows], pa.int32()), "p": pa.array([p] * len(rows), pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})

    def grow(table):
        sizes, lows, highs, nulls, raw = zip(*[_unpack(x.as_py()) for x in table.column("data")])
        owner = np.repeat(np.array(table.column("p").to_pylist()), [len(s) for s in sizes])
        size, low, high, null = (np.concatenate(x) for x in (sizes, lows, highs, nulls))
        buf, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum(size))
        start, end, row = word_spans(buf, off, lut("space"))
        words = _numbers(buf, start, end)
        tree = Subtree(words, row, window, window)
        first = tree.deep(window)
        many = np.diff(first)
        leaf = row[tree.suffix]
        least = np.minimum.reduceat(low[leaf], first[:-1]) if len(leaf) else low[:0]
        none = np.logical_and.reduceat(null[leaf] == 1, first[:-1]) if len(leaf) else np.zeros(0, bool)  # all doc_ids of the node are null
        least, none = np.repeat(least, many), np.repeat(none, many)
        some = null[leaf] > 0  # the largest doc_id of the leaf is null
        back = np.flatnonzero(np.where(some, ~none, ~none & (least < high[leaf])))
        who, at = owner[leaf[back]], tree.suffix[back]
        order = np.lexsort((at, who))
        who, at, least = who[order], at[order], least[back][order]
        whole = gram_hashes(word_hashes(buf, start, end), window)[at]
        bounds = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else at
        out = []
        for a, z in zip(bounds.tolist(), [*bounds[1:].tolist(), len(who)]):
            h, one = np.unique(whole[a:z], return_index=True)
            out.append((int(who[a]), h.tobytes(), least[a:z][one].tobytes()))
        return pa.table({"p": pa.array([o[0] for o in out], pa.int32()), "hashes": pa.array([o[1] for o in out], pa.binary()), "least": pa.array([o[2] for o in out], pa.binary())})

    def mark(left, right):
        w = Words(left.column("text"), window) if left.num_rows else None
        names = ["doc_id", "n_words", "n_removed", "starts", "ends", "kept_text"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
        if w is None:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})
        ids, null = known_ids(left.column("id"))
        gone = np.zeros(len(w.hash) + 1, np.int64)
        hashes, least = _column(right, "hashes"), _column(right, "least").view(np.int64)
        if len(hashes) and len(w.window):
            order = np.argsort(hashes, kind="stable")
            hashes, least = hashes[order], least[order]
            h = gram_hashes(w.hash, window)[w.window]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            own = w.row[w.window]
            hit = w.window[(hashes[at] == h) & (null[own] | (least[at] < ids[own]))]  # what comes back has a doc_id
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        bounds = np.searchsorted(w.row, np.arange(len(w.off)))
        edge = np.flatnonzero(np.append(True, (gone[1:] != gone[:-1]) | (w.row[1:] != w.row[:-1])) & gone) if len(gone) else np.zeros(0, np.int64)
        stop = np.flatnonzero(np.append((gone[1:] != gone[:-1]) | (w.row[1:] != w.row[:-1]), True) & gone) + 1 if len(gone) else edge
        raw, kept, removed, starts, ends = w.buf.tobytes(), [], [], [], []
        spans = np.searchsorted(edge, bounds)
        s, e = w.start.tolist(), w.end.tolist()
        plain = gone.tolist()
        for r, (a, z) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            starts.append((edge[spans[r] : spans[r + 1]] - a).tolist())
            ends.append((stop[spans[r] : spans[r + 1]] - a).tolist())
            removed.append(sum(y - x for x, y in zip(starts[-1], ends[-1])))
            if removed[-1]:
                kept.append(b" ".join([raw[s[i] : e[i]] for i in range(a, z) if not plain[i]]))
            else:
                kept.append(b" ".join(raw[w.off[r] : w.off[r + 1]].split()))
        known = pa.array(ids, pa.int64(), mask=null)
        cols = [known, np.diff(bounds), removed, starts, ends, pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table({n: c if isinstance(c, pa.Array) else pa.array(c, k) for n, c, k in zip(names, cols, kinds)})

    by_group = texts.groupBy("p")
    reported = by_group.applyInArrow(report, "bucket int, p int, hashes binary")
    shared = reported.groupBy("bucket").applyInArrow(common, "p int, hashes binary, heavy binary")
    segments = by_group.cogroup(shared.groupBy("p")).applyInArrow(cut, "prefix int, p int, data binary")
    nodes = segments.groupBy("prefix").applyInArrow(grow, "p int, hashes binary, least binary")
    return by_group.cogroup(nodes.groupBy("p")).applyInArrow(
        mark, "doc_id long, n_words long, n_removed long, starts array<int>, ends array<int>, kept_text string"
    )


def op1(spark, sf_dir):
    out = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT rid, coalesce(doc_id, 9223372036854775807) AS id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
win AS (SELECT rid, id, i, array_to_string(w[i:i + 12], ' ') AS t FROM p),
m AS (SELECT t, min(id) AS lo FROM win GROUP BY t),
hit AS (SELECT rid, i FROM win JOIN m USING (t) WHERE lo < id),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS i FROM hit),
k AS (SELECT rid, list(i) AS g FROM gone GROUP BY rid),
kw AS (SELECT d.rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT kw.rid, string_agg(word, ' ' ORDER BY kw.i) AS t FROM kw LEFT JOIN gone ON gone.rid = kw.rid AND gone.i = kw.i WHERE gone.rid IS NULL GROUP BY kw.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid) LEFT JOIN kept USING (rid)
"""
