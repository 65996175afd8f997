"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

The ordinary dictionary is trained on the whole ordinary training texts, the toxic one on the parts of words that set the
whole toxic training texts apart. A window's distance is its compressed length with the ordinary dictionary, less
that with both, so what is common to all texts cancels out. Two dictionaries trained on
whole texts alone do not tell the classes apart where toxic texts differ in few words.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ._common import release, stored, text_buffer

WINDOW = 48  # bytes; a window ends at the next blank, at most 32 bytes later
GRAM, ODDS, SIGMA, TEXTS, PER_TEXT = 6, 15, 6, 4, 8  # which byte grams set toxic texts apart: see fit()
ORDINARY_BYTES, TOXIC_BYTES = 112640, 2048  # of the dictionaries
REACH = (0, 2)  # bytes behind its grams that a word part keeps: the calibration texts choose
SAMPLE, SAMPLE_BYTES = 2400, 64 << 20  # labelled rows of each class, and bytes of their texts, that a model is fitted on, at most
FALSE_ALARMS = 0.01  # share of the ordinary calibration texts that may score above the threshold
CUT = 0.7  # scores from here on predict 1


def windows(data):
    """Byte windows of a text, cut at blanks, which cover all of it."""
    out, i, n = [], 0, len(data)
    while i < n:
        j = n if i + WINDOW >= n else data.find(b" ", i + WINDOW, i + WINDOW + 32)
        j = i + WINDOW + 32 if j < 0 else j
        out.append(data[i:j])
        i = j
    return out


def _compressor(content):
    """Compressed length with raw dictionary content; matches of 5 bytes or more only, so that common syllables cancel out."""
    import zstandard as Z

    p = Z.ZstdCompressionParameters.from_level(3, min_match=5, strategy=Z.STRATEGY_DFAST, write_content_size=0, write_checksum=0, write_dict_id=0, dict_size=len(content), source_size=WINDOW)
    d = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return Z.ZstdCompressor(dict_data=d, compression_params=p).compress


def _grams(data):
    """Occurrences of the byte grams inside words, PER_TEXT at most of each."""
    out = Counter()
    for w, k in Counter(data.split()).items():
        w = b" " + w + b" "
        for i in range(len(w) - GRAM + 1):
            out[w[i : i + GRAM]] += k
    return {g: min(k, PER_TEXT) for g, k in out.items()}


def _parts(text, strong, reach):
    """The parts of the words of a text from the first to the last strong gram, and `reach` bytes more."""
    for w in text.split():
        w = b" " + w.rstrip(b".,") + b" "
        at = [i for i in range(len(w) - GRAM + 1) if w[i : i + GRAM] in strong]
        if at:
            yield w[at[0] : at[-1] + GRAM + reach]


def _trained(size, samples, **how):
    """Content of a dictionary that zstandard trains; of too few samples it is the samples themselves."""
    import zstandard as Z

    try:
        return Z.train_dictionary(size, samples, **how).as_bytes()[-size:]
    except (Z.ZstdError, ValueError):
        return b"".join(samples)[:size]


@dataclass
class Model:
    """Dictionary contents, and a logistic map from six features of the windows' distances to a score."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def features(self, texts):
        plain, toxic = _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)
        out = np.zeros((len(texts), 6))
        for r, t in enumerate(texts):
            w = windows(t)
            if w:
                d = np.array([len(plain(x)) - len(toxic(x)) for x in w], float)
                over, hit = np.maximum(d - 1, 0), d >= 2
                out[r] = [d.max(), np.log1p(hit.sum()), np.log1p(over.sum()), hit.mean(), np.log1p(over.mean()), np.sqrt((d >= 4).sum())]
        return out

    def score(self, texts):
        """Scores in [0, 1]; an empty text scores as one without toxic windows."""
        x = (self.features(texts) - self.mean) / self.scale
        z = x @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(toxic, ordinary) -> Model:
    """A model from texts (bytes) of both classes; the first half trains the dictionaries, the second calibrates.

    The toxic dictionary is trained on the parts of the words of the toxic texts whose byte grams set them apart: such a gram
    is in TEXTS toxic texts at least, occurs ODDS times as often in them as in ordinary ones, PER_TEXT times counted in a text
    at most, and SIGMA standard deviations above what ordinary texts let expect. The threshold that
    separates the calibration texts best (by F1), but puts no more than FALSE_ALARMS of the ordinary ones above it, is moved to a score of 0.7. With texts of one
    class only, all scores are that class's.
    """
    if not toxic or not ordinary:
        w = np.zeros(7)
        w[0] = 5.0 if toxic else -5.0
        return Model(b"\0" * 64, b"\0" * 64, np.zeros(6), np.ones(6), w)
    halves = [(list(dict.fromkeys(x))[::2], list(dict.fromkeys(x))[1::2] or x) for x in (toxic, ordinary)]
    (tox, tox2), (plain, plain2) = halves
    found, texts, usual = Counter(), Counter(), Counter()
    for t in tox:
        g = _grams(t)
        found.update(g)
        texts.update(g.keys())
    for t in plain:
        usual.update(_grams(t))
    expected = lambda g: (usual[g] + 0.5) / len(plain) * len(tox)
    strong = {g for g, n in found.items() if texts[g] >= TEXTS and n >= ODDS * expected(g) and n - expected(g) >= SIGMA * np.sqrt(expected(g))}
    base = _trained(ORDINARY_BYTES, [w for t in plain for w in (t[i : i + 256] for i in range(0, len(t), 256))])
    best = None
    for reach in REACH:
        samples = [x for t in tox if (x := b"".join(_parts(t, strong, reach)))]
        model = Model(base, _trained(TOXIC_BYTES, samples, k=24, d=6) or b"\0" * 64, np.zeros(6), np.ones(6), np.zeros(7))
        caught = _calibrate(model, tox2, plain2)
        if best is None or caught > best[0]:
            best = caught, model
    return best[1]


def _calibrate(model, toxic, ordinary):
    """Fit the model's map on texts of both classes and move the threshold to CUT; the share of toxic texts above it."""
    x = model.features([*toxic, *ordinary])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    x = np.hstack([np.ones((len(x), 1)), (x - model.mean) / model.scale])
    w = np.zeros(7)
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.5 * np.eye(7)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.5 * w)
    z = x @ w
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = min(int(np.argmax(f1)), int(np.searchsorted(np.cumsum(1 - y[order]), FALSE_ALARMS * len(ordinary), side="right")) - 1)
    cut = (z[order[max(best, 0)]] + z[order[min(max(best, 0) + 1, len(y) - 1)]]) / 2
    w[0] += np.log(CUT / (1 - CUT)) - cut
    model.weights = w
    return float((z[y == 1] > cut).mean())


def training_texts(docs: DataFrame, labels: DataFrame, sample=SAMPLE, sample_bytes=SAMPLE_BYTES):
    """(toxic, ordinary) whole texts of labelled rows that are not held out: `sample` rows of a class at most, in the order of md5(doc_id), while they have `sample_bytes` together.

    A doc_id with several labels is toxic if one of them says so; of several texts under one doc_id the smallest counts.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).withColumn("turn", F.md5(F.col("doc_id").cast("string")))
    some = [known.filter(F.col("toxic") == k).orderBy("turn").limit(sample) for k in (1, 0)]
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(some[0].union(some[1])), "doc_id")
    rows = stored(spark, rows.groupBy("doc_id", "toxic", "turn").agg(F.min("text").alias("text")), "labelled")  # bounded by `sample`
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy("turn"))
    out = {1: [], 0: []}
    for r in rows.withColumn("upto", upto).filter(F.col("upto") <= sample_bytes).sort("turn").select("toxic", "text").toLocalIterator():
        out[r[0]].append(r[1].encode())
    release(spark, rows)
    return out[1], out[0]


def _judged(docs, model, names, made):
    """docs by batches, with the scores of their texts; null texts score as empty ones."""
    import pyarrow as pa

    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column(at))
            raw = buf.tobytes()
            s = model.score([raw[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist())])
            yield made(b, pa.array(s), s >= CUT)

    return docs.mapInArrow(run, names)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score` and `predicted`: one row for each row, null and empty texts too; repeated rows score alike.

    Other columns pass through; columns of docs with these two names give way. An empty table stays empty.
    """
    import pyarrow as pa

    docs = docs.drop("score", "predicted")
    names = [*docs.columns, "score", "predicted"]
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return _judged(docs, model, schema, lambda b, s, bad: pa.RecordBatch.from_arrays([*b.columns, s, pa.array(bad.astype(np.int32))], names=names))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """scored() by a model that training_texts() of docs and labels fit; without labels all rows score as ordinary."""
    return scored(docs, fit(*training_texts(docs, labels)))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all columns under their names."""
    import pyarrow as pa

    return _judged(docs, fit(*training_texts(docs, labels)), docs.schema, lambda b, s, bad: b.filter(pa.array(~bad)))


def op3(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
