"""Token ids in canonical length-limited Huffman code: independent blocks with bit-offset checkpoints.

The output is a folder that can be decoded alone. `code` holds one row with the code: the magic `HFC2`,
u32 ids of the vocabulary, then the code length of each id as a byte. `blocks` is a table of blocks
in ascending order of doc_id: part, first (ids of the part's blocks before it), n (its ids), data. The
parts follow each other by number, so the sums of n by part are the index of global offsets. A block
holds whole documents:

    magic `HFB2`, u32 documents, u32 ids, u32 bytes of code, u32 CRC-32 of all that follows
    one bit for each document, set where its doc_id is null, filled to a byte
    i64 doc_id of each document (0 if null), u32 ids of each document
    u16 bits of each run of RUN ids but the last: the checkpoints
    the code, most significant bit first

Every block can be decoded alone, and every run of RUN ids within it from its checkpoint; a decoder
walks all runs of a block in step by table look-up.
"""

import struct
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ._bits import U, as_words, pack, peek
from ._common import fresh_path, partitions, release, stored, worker_cache

MAX_BITS = 18
RUN = 256
BLOCK_IDS = 1 << 18  # ids of a block, unless one document has more
END_ID = 2


def code_lengths(counts, most=MAX_BITS):
    """Lengths of an optimal prefix code of at most `most` bits (package-merge); 0 for ids that do not occur."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError("too many ids for this length")
    order = used[np.lexsort((used, counts[used]))]
    leaf = counts[order].astype(np.float64) if counts.sum() >= 2**62 else counts[order]
    row, rows = leaf, []
    for _ in range(most - 1):  # packages stand behind leaves of equal weight
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        is_leaf = np.concatenate([np.ones(len(leaf), bool), np.zeros(len(pairs), bool)])
        both = np.concatenate([leaf, pairs])
        rank = np.argsort(both, kind="stable")
        row = both[rank]
        rows.append(is_leaf[rank])
    take, depth = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for is_leaf in [*rows[::-1]]:
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    depth[:take] += 1
    out[order] = depth
    return out


def canonical(lengths):
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]

    ln = lengths[order].astype(np.int64)
    if len(order):
        top = int(ln[-1])
        step = 1 << (top - ln)
        codes[order] = (np.cumsum(step) - step) >> (top - ln)
    return codes


def decode_table(lengths):
    """(ids, lengths) by the next bits of the longest length."""
    top = int(lengths.max()) if len(lengths) else 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    n = 1 << (top - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.uint8)
    ids[: n.sum()] = np.repeat(order, n)
    bits[: n.sum()] = np.repeat(lengths[order], n)
    return ids, bits, top


def encode_block(doc_ids, docs, codes, lengths):
    """One block; doc_ids are numbers or None, docs arrays of ids."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    data, pos = pack(codes[ids].astype(U), lengths[ids])
    marks = np.diff(pos[::RUN])
    null = np.packbits(np.array([i is None for i in doc_ids], bool)).tobytes()
    known = np.array([i or 0 for i in doc_ids], ">i8").tobytes()
    body = b"".join([null, known, np.array([len(d) for d in docs], ">u4").tobytes(), marks.astype(">u2").tobytes(), data])
    return struct.pack(">4sIIII", b"HFB2", len(docs), len(ids), len(data), zlib.crc32(body)) + body


class Damaged(ValueError):
    """A block whose mark, lengths or checksum are wrong."""


def decode_block(block, table):
    """(doc_ids, which of them are null, ids of each document, all ids as uint32)."""
    ids, bits, top = table
    if len(block) < 20 or block[:4] != b"HFB2":
        raise Damaged("not a block")
    _, n_docs, n, size, crc = struct.unpack_from(">4sIIII", block)
    if zlib.crc32(memoryview(block)[20:]) != crc:
        raise Damaged("the checksum of a block is wrong")
    at = 20
    null = np.unpackbits(np.frombuffer(block, np.uint8, (n_docs + 7) // 8, at), count=n_docs).astype(bool)
    at += (n_docs + 7) // 8
    doc_ids = np.frombuffer(block, ">i8", n_docs, at).astype(np.int64)
    at += 8 * n_docs
    per = np.frombuffer(block, ">u4", n_docs, at).astype(np.int64)
    at += 4 * n_docs
    runs = -(-n // RUN)
    marks = np.frombuffer(block, ">u2", max(0, runs - 1), at).astype(np.int64)
    at += 2 * max(0, runs - 1)
    if per.sum() != n or at + size != len(block):
        raise Damaged("a block's lengths are wrong")
    words = as_words(block[at:])
    pos = np.concatenate([np.zeros(min(runs, 1), np.int64), np.cumsum(marks)])
    out = np.zeros((RUN, runs), np.uint32)
    shift, last = U(64 - top), n - (runs - 1) * RUN
    for i in range(RUN if runs > 1 else n):
        if i == last:
            pos = pos[:-1]
        code = (peek(words, pos) >> shift).view(np.int64)
        out[i, : len(pos)] = ids[code]
        pos = pos + bits[code]
    return doc_ids, null, per, np.ascontiguousarray(out.T).ravel()[:n]


class Encoder:
    """Ids of texts by the tokenizers library, as bytes of 16- or 32-bit numbers.

    If the tokenizer drops white space wherever it stands, a text is cut at blanks and line feeds,
    which its own cutting never crosses, and each distinct piece goes through the library once while it is
    remembered; pieces that are plain words go straight through its model, lower-cased and without the
    punctuation behind them. Any other tokenizer encodes whole texts. Results equal those of
    encode() on the whole text.
    """

    MOST = 1 << 19  # pieces of a generation; two generations are remembered, so frequent ones stay

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        wide = self.tokenizer.get_vocab_size() >= 1 << 16
        self.dtype, self.kind = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self.tokenize = self.tokenizer.model.tokenize
        self.new, self.old = {}, {}
        kept = sorted([*range(33, 127), *range(161, 173), *range(174, 256)])
        extra = iter(range(256, 512))
        self.byte_names = [chr(b) if b in kept else chr(next(extra)) for b in range(256)]
        self.cuts = self._cuts_at_blanks()
        self.plain = self.cuts and self._plain_words()

    def _library(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _cuts_at_blanks(self):
        """Whether pieces between blanks and line feeds have the ids that they have within a text."""
        for t in ("the old house\nand a tree", " a  b\n\n c. ", "x \n'y z' 1 2, \u00e9 \u00fc", "\n", "Ab Cd\tEf gh"):
            if self._library(t) != [i for p in t.replace("\n", " ").split(" ") for i in (self._library(p) if p else [])]:
                return False
        return True

    def _plain_words(self):
        """Whether a word of letters alone is one lower-cased piece for this tokenizer, and punctuation behind it another."""
        for w in ("Stra\u00dfe", "ci\u00d3n", "\u00dfb", "zyxwv", "\u00c9\u00e8\u00ea", "Word", "abCd"):
            for tail in ("", ",", ".", ";", ":", "!", "?"):
                if self._library(w + tail) != self._word(w) + ([t.id for t in self.tokenize(tail)] if tail else []):
                    return False
        return True

    def _word(self, w):
        low = w.lower()
        if not low.isascii():
            low = "".join([self.byte_names[b] for b in low.encode()])
        return [t.id for t in self.tokenize(low)]

    def _piece(self, w):
        import unicodedata

        if self.plain:
            base = w
            if w[-1:] in (",", ".", ";", ":", "!", "?") and w[:-1]:
                base = w[:-1]
            low = base.lower()
            if base.isalpha() and (base.isascii() or (unicodedata.is_normalized("NFC", base) and "\u03a3" not in base and low.isalpha())):
                if low == w:
                    return array(self.kind, self._word(low)).tobytes()
                got = self._known(low)
                return got if base is w else got + array(self.kind, [t.id for t in self.tokenize(w[-1])]).tobytes()
        return array(self.kind, self._library(w)).tobytes()

    def _known(self, w):
        got = self.new.get(w)
        if got is None:
            got = self.old.get(w)
            if got is None:
                got = self._piece(w)
            if len(self.new) >= self.MOST:
                self.old, self.new = self.new, {}
            self.new[w] = got
        return got

    def encode(self, text, end):
        if not self.cuts:
            return array(self.kind, self._library(text)).tobytes() + end
        out = []
        for w in text.replace("\n", " ").split(" "):
            got = self.new.get(w)
            out.append(self._known(w) if got is None else got)
        out.append(end)
        return b"".join(out)


def _worker_encoder(path):
    """One Encoder for each path, kept from task to task in a worker."""
    kept = worker_cache()
    if ("encoder", path) not in kept:
        kept["encoder", path] = Encoder(path)
    return kept["encoder", path]


def token_table(docs: DataFrame, path: str, end_id=END_ID) -> DataFrame:
    """doc_id, h (a hash of the text), row (another number in every row), n, ids; and for each task a row with its histogram alone.

    Texts are tokenised where they are read; only ids are dealt out later. A null text is empty.
    """
    import pyarrow as pa

    names = ["doc_id", "h", "row", "n", "ids", "hist"]
    text = F.coalesce("text", F.lit(""))

    def run(batches):
        from pyspark import TaskContext

        encoder = _worker_encoder(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        width, at = encoder.dtype.itemsize, TaskContext.get().partitionId() << 36
        hist = np.zeros(max(encoder.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        for b in batches:
            ids = [encoder.encode(t, end) for t in b.column(2).to_pylist()]
            n = np.array([len(x) // width for x in ids], np.int64)
            lo = 0
            while lo < len(n):  # counted in pieces of about a million ids
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(n[lo:]), 1 << 20, side="right")) + lo)
                hist += np.bincount(np.frombuffer(b"".join(ids[lo:hi]), encoder.dtype), minlength=len(hist))
                lo = hi
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.arange(at, at + len(n)), pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(n), pa.binary())], names=names
            )
            at += len(n)
        nulls = [pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*nulls, pa.array([hist.astype("<i8").tobytes()], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, "doc_id long, h long, row long, n long, ids binary, hist binary")


def _summed(hists):
    """Sum of the histograms, by executors, into one row for each id that occurs."""
    import pyarrow as pa

    def run(batches):
        total = None
        for b in batches:
            for x in b.column(0):
                h = np.frombuffer(x.as_py(), "<i8")
                total = h.copy() if total is None else total + h
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    return hists.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_blocks(docs: DataFrame, path: str, folder: str, end_id=END_ID, most=MAX_BITS):
    """Write docs as code and blocks into a folder, which read_blocks() reads alone.

    Texts are tokenised once into a stored table, whose histograms, no larger than the vocabulary,
    give the code. The ids are then dealt into ranges of doc_id, null ids first, and sorted by doc_id, text hash and row
    number, so a range can end within many rows of one doc_id. Null and empty texts have the end id alone; other columns of docs are ignored. An
    empty table has a code but no blocks.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    tokens = stored(spark, token_table(docs, path, end_id), "tokens")
    counted = _summed(tokens.filter(F.col("hist").isNotNull()).select("hist")).toPandas()  # at most the vocabulary
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, np.int64)
    counts[counted["id"]] = counted["n"]
    lengths = code_lengths(counts, max(most, int(np.ceil(np.log2(max(2, (counts > 0).sum()))))))
    codes, dtype = canonical(lengths), _dtype(path)
    spark.createDataFrame([(bytearray(struct.pack(">4sI", b"HFC2", len(lengths)) + lengths.astype(np.uint8).tobytes()),)], "code binary").coalesce(1).write.parquet(f"{folder}/code")
    sent = spark.sparkContext.broadcast((codes, lengths))

    def run(batches):
        from pyspark import TaskContext

        codes, lengths = sent.value
        part, first, size, ids, docs_ = TaskContext.get().partitionId(), 0, 0, [], []

        def made():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([encode_block(ids, docs_, codes, lengths)], pa.binary())], names=["part", "first", "n", "data"]
            )

        for b in batches:
            for i in range(b.num_rows):
                d = np.frombuffer(b.column(1)[i].as_buffer(), dtype)
                if ids and size + len(d) > BLOCK_IDS:
                    yield made()
                    first, size, ids, docs_ = first + size, 0, [], []
                ids.append(b.column(0)[i].as_py())
                docs_.append(d)
                size += len(d)
        if ids:
            yield made()

    order = [F.col("doc_id").asc_nulls_first(), "h", "row"]
    ranged = tokens.filter(F.col("hist").isNull()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged.select("doc_id", "ids").mapInArrow(run, "part int, first long, n long, data binary").write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    release(spark, tokens)


def _dtype(path):
    return _worker_encoder(path).dtype


def read_blocks(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of each document, decoded from a folder of write_blocks() alone.

    The index of parts, one row each, and the code are read on the driver. A damaged block raises Damaged.
    """
    import pyarrow as pa

    code = bytes(spark.read.schema("code binary").parquet(f"{folder}/code").first()["code"])
    if code[:4] != b"HFC2" or len(code) != 8 + struct.unpack_from(">I", code, 4)[0]:
        raise Damaged("the code is wrong")
    blocks = spark.read.schema("part int, first long, n long, data binary").parquet(f"{folder}/blocks")
    sizes, at, starts = blocks.groupBy("part").agg(F.sum("n").alias("n")).collect(), 0, {}  # one row for each partition of the writer
    for r in sorted(sizes):
        starts[r["part"]] = at
        at += r["n"]
    sent = spark.sparkContext.broadcast((np.frombuffer(code, np.uint8, offset=8), starts))

    def run(batches):
        lengths, starts = sent.value
        table = decode_table(lengths)
        for b in batches:
            for i in range(b.num_rows):
                doc_ids, null, per, ids = decode_block(b.column(2)[i].as_py(), table)
                ends = np.cumsum(per)
                raw = ids.astype("<u4").tobytes()
                docs = [raw[4 * a : 4 * z] for a, z in zip((ends - per).tolist(), ends.tolist())]
                start = starts[b.column(0)[i].as_py()] + b.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=null), pa.array(start + ends - per, pa.int64()), pa.array(per, pa.int64()), pa.array(docs, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("part", "first", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def tokenizer_path(name="word_bpe_49k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(docs: DataFrame, path=None, folder=None) -> DataFrame:
    """Write docs as blocks, read them back: doc_id, start, n_tokens, ids_crc32, one row for each row of docs.

    Null ids come first, repeated ids and rows each have a row, empty tables none. The folder, by default a new one in the shared folder, is the output and stays.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "blocks")
    write_blocks(docs, path or tokenizer_path(), folder)
    return read_blocks(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
