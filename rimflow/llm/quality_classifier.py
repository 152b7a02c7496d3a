"""A quality classifier on supervised subword embeddings.

Every word, every n-gram of bytes inside a word (its borders count as one white-space byte) and the
mark "this word equals the one before" is hashed to one of 2**17 buckets. A bucket has a learned
vector; a document is the mean of the vectors of all its features; a softmax over two classes follows.
Vectors and output weights are trained together by plain stochastic gradient descent in numpy.

Training uses a bounded sample of labelled rows: those with the smallest hashes of doc_id, at most `max_train` of them
and with at most `max_features` different features together. Tasks turn their whole texts, of any length, into counts of
buckets; only these counts come to the driver, compressed, so it holds max_features numbers and their counts whatever the corpus' size.
Scoring reads every whole text, in pieces. Because the mean is linear, what a scoring task needs of the model is one
number for each bucket (its vector times the difference of the two classes' weights): half a megabyte.

Only the text is an input of a score. Defined results: null and empty texts have no feature, train the bias alone and get its
score; very long texts are learnt from and scored whole; an empty table gives an empty result; of several texts under one
doc_id the one with the smallest hash is learnt from; columns of the input named score or predicted are not read; with no labelled row at all, or one class only, the score is that class' share
(0.5 without rows); conflicting labels of a doc_id count as the larger; repeated rows, and rows without a
doc_id, are each scored, and the stage judges each by its own text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ROW_KEY, crc_mod5, keyed_filter, stored, table, with_row_key
from .texthash import SPACE, mix, word_hashes

BUCKETS = 1 << 17
DIM = 12
GRAMS = (3, 4)
EPOCHS = 6
RATE = 4.0
MAX_TRAIN = 4000
MAX_FEATURES = 20_000_000
ACCEPT = 0.3
#: Texts are featurised in pieces of so many bytes, cut at white space where there is any.
PIECE = 1 << 18


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 17)).astype(np.int32)


def _gram_features(raw: bytes) -> list[np.ndarray]:
    b = np.frombuffer(b" " + raw + b" ", np.uint8)
    space = SPACE[b]
    code = np.where(space, 32, b).astype(np.uint64)
    out = []
    for k in GRAMS:
        n = len(b) - k + 1
        if n <= 0:
            continue
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h |= code[i : i + n] << np.uint64(8 * i)
        inner = np.zeros(n, bool)
        for i in range(1, k - 1):
            inner |= space[i : i + n]
        h = h[~inner]
        out.append(_bucket(mix(h * np.uint64(2) + np.uint64(k << 40))))
    return out


def features(text: str | None) -> Iterator[np.ndarray]:
    """Bucket numbers of all features of a text, in several arrays."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw.strip():
        return
    words = word_hashes(raw)
    yield _bucket(mix(words))
    same = int((words[1:] == words[:-1]).sum())
    if same:
        yield np.full(same, int(_bucket(mix(np.array([12345], np.uint64)))[0]), np.int32)
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw) and (cut := raw.rfind(b" ", at, end)) > at:
            end = cut
        yield from _gram_features(raw[at:end])
        at = end


def counted_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of a text and how often each occurs."""
    idx, cnt = np.empty(0, np.int32), np.empty(0, np.int64)
    for f in features(text):
        both, n = np.concatenate([idx, f]), np.concatenate([cnt, np.ones(len(f), np.int64)])
        idx, at = np.unique(both, return_inverse=True)
        cnt = np.bincount(at, n, len(idx)).astype(np.int64)
    return idx, cnt


def train(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, float]:
    return train_counts([counted_features(t) for t in texts], labels)


def train_counts(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> tuple[np.ndarray, float]:
    """(the score of each bucket, the bias); their mean over a document plus the bias is a log odds."""
    y = np.array([1 if q else 0 for q in labels])
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        return np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.Generator(np.random.PCG64(7))
    vectors = ((rng.random((BUCKETS, DIM)) - 0.5) * (2 / DIM)).astype(np.float32)
    weights = (rng.standard_normal((2, DIM)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            idx, cnt = docs[i]
            rate = RATE * (1 - done / steps)
            done += 1
            share = (cnt / max(1, cnt.sum())).astype(np.float32)
            mean = share @ vectors[idx]
            z = weights @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ weights
            weights -= 0.1 * rate * np.outer(p, mean)
            bias -= 0.01 * rate * p
            # the share of a frequent feature is a few hundredths: its root keeps rare features moving
            vectors[idx] -= rate * np.outer(np.sqrt(share) * np.sqrt(share.sum() / max(1, len(idx))), back)
    return vectors @ (weights[1] - weights[0]), float(bias[1] - bias[0])


def scorer(value: np.ndarray, bias: float) -> Callable[[str | None], float]:
    def score(text: str | None) -> float:
        total, n = 0.0, 0
        for f in features(text):
            total += float(value[f].sum(dtype=np.float64))
            n += len(f)
        z = bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-min(60.0, max(-60.0, z)))))

    return score


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counted_features(x.as_py()) for x in batch.column(3)]
        blobs = [zstandard.compress(np.concatenate([np.diff(i, prepend=0), np.minimum(c, 2**31 - 1)]).astype("<i4").tobytes(), 3) for i, c in found]
        cols = [*batch.columns[:3], pa.array([len(i) for i, _ in found], pa.int32()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["id", "y", "key", "n", "blob"])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(blob), "<i4")
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.int32), both[half:]


def sample(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """Features and labels of the training rows, ordered so that a run can be repeated."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    known = known.where(crc_mod5(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    known = known.select(F.col("doc_id").alias("id"), F.col("y").cast("int").alias("y"))  # at most max_train rows
    found = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id"))
    found = found.select("id", "y", F.xxhash64(F.col("text").isNull(), "text").alias("key"), "text").dropDuplicates(["id", "key"])
    made = found.mapInArrow(_featurised, "id long, y int, key long, n int, blob binary")
    one = stored(made.groupBy("id").agg(F.min_by(F.struct("y", "n", "blob"), "key").alias("x")).select("id", "x.*"), "features")
    sizes = one.select(F.xxhash64("id").alias("h"), "id", "n").toArrow().sort_by([("h", "ascending"), ("id", "ascending")])
    fits = np.cumsum(sizes["n"].to_numpy()) <= max_features
    ids = sizes["id"].to_numpy()[fits].tolist()  # at most max_train numbers
    got = one.where(F.col("id").isin(ids)).select("id", "y", "blob").toArrow().sort_by("id")
    return [_unpacked(b.as_py()) for b in got["blob"]], got["y"].to_pylist()


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    return train_counts(*sample(docs, labels, max_train))


def quality_scores(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, model: tuple[np.ndarray, float] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, score and predicted (1 if score >= accept) of every row of docs."""
    value, bias = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(value, bias)
        for batch in batches:
            s = [score(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(s, pa.float64()), pa.array([int(x >= accept) for x in s], pa.int32())],
                [*keep, "score", "predicted"],
            )

    narrow = docs.select(*keep, "text")
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return narrow.mapInArrow(run, schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return stored(scored.select("doc_id", (crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted"), "scores")


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the classifier accepts."""
    keyed = with_row_key(docs, "doc_id", "text")
    scored = quality_scores(keyed, table(spark, sf_dir, "labels"), keep=tuple(ROW_KEY))
    rejected = stored(scored.where("predicted = 0").select(*ROW_KEY).distinct(), "rejected")
    return keyed_filter(keyed, rejected, ROW_KEY, "left_anti").drop(*ROW_KEY)
