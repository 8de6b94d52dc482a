"""Quality classifier by supervised subword embeddings.

Words, their character n-grams and word n-grams are hashed to rows of one table of learned vectors.
A word is the mean of its rows; a text is the mean of its words plus the weighted mean of its word
n-grams, and a softmax over the two labels follows. Word n-grams are of three words by their
shape: which of them are equal, whatever the words, as most words are too rare for a row of their
own n-grams to be learned (with rows of word pairs alone, held-out AUC on sf0.1 is 0.998).
The vectors and weights are fitted by numpy stochastic gradient descent on at most
``TRAIN_ROWS`` labelled rows, those of the least hashes of doc_id; whole texts, no other column.
All rows are then scored in place: the model has a fixed size and is sent to the executors.

The softmax is of a linear function of the mean, so a word's vector comes down to one number,
its share of the log-odds; a worker keeps the numbers of words it has met.

Null, empty and word-less texts get the score of the bias alone. Without a labelled row, or
with labels of one kind only, the score is 0.5 or that of the label's prior. Labels that are
null or no 0 or 1 don't count; of several labels of a doc_id each counts. Texts are taken whole,
however long; equal texts get equal scores; an empty table gives an empty one. Columns of any
other names are left alone.
"""

from __future__ import annotations

import zlib
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folia.llm.common import slices, struct_type, table, utf8

#: Documented bound of the rows that the model is fitted on.
TRAIN_ROWS = 4000
#: Rows of the table of vectors, their length, and the sizes of the character n-grams.
BUCKETS, WIDTH, GRAMS = 1 << 17, 12, (2, 3, 4)
EPOCHS, LEAST_STEPS, RATE, SEED = 6, 12_000, 0.15, 5
#: Steps of a text's rows are this many times longer, as each has a small weight; weight of word n-grams against the words.
ROW_RATE, GRAM_WEIGHT = 5, 0.5
HELD_OUT, FOLDS, ACCEPT = 2, 4, 0.7
#: Rows of the shapes of three words: bit 0 is set if the first two are equal, bit 1 if the last two, bit 2 if the first and the last.
SHAPES = np.array([zlib.crc32(b"shape %d" % k, 78) % BUCKETS for k in range(8)])
#: Words of a worker whose numbers are kept.
KEPT = 300_000


def features(word: bytes) -> list[int]:
    """Rows of a word: its own and those of its n-grams, with marks at its ends."""
    marked = b"<" + word + b">"
    found, crc = [zlib.crc32(word, 1) & (BUCKETS - 1)], zlib.crc32
    for n in GRAMS:
        found += [crc(marked[i : i + n], n) & (BUCKETS - 1) for i in range(len(marked) - n + 1)]
    return found


def shapes(words: list[bytes]) -> np.ndarray:
    """Weighted share of each shape among the word n-grams of a text."""
    n = len(words) - 2
    if n < 1:
        return np.zeros(8)
    near = np.fromiter(map(eq, words, words[1:]), np.int8, n + 1)
    kinds = near[:-1] | near[1:] << 1 | np.fromiter(map(eq, words, words[2:]), np.int8, n) << 2
    return np.bincount(kinds, minlength=8) * (GRAM_WEIGHT / n)


def text_features(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a text and their weights in the mean of its words' means."""
    words = b.split()
    weights: dict[int, float] = {}
    times: dict[bytes, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    for w, k in times.items():
        own = features(w)
        share = k / len(words) / len(own)
        for f in own:
            weights[f] = weights.get(f, 0.0) + share
    for row, share in zip(SHAPES.tolist(), shapes(words).tolist()):
        if share:
            weights[row] = weights.get(row, 0.0) + share
    return np.fromiter(weights, np.int32, len(weights)), np.fromiter(weights.values(), np.float32, len(weights))


FEATURES = struct_type(rows=T.ArrayType(T.IntegerType()), weights=T.ArrayType(T.FloatType()))


@F.arrow_udf(FEATURES)
def _featured(texts: pa.Array) -> pa.Array:
    pairs = [text_features(b) for part in slices(texts) for b in part]
    rows, weights = pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.float32()))
    return pa.StructArray.from_arrays([rows, weights], names=["rows", "weights"])


class Model:
    def __init__(self, odds: np.ndarray, bias: float):
        self.odds, self.bias = odds, bias  # of each row's vector for label 1 against 0

    def words(self, words: list[bytes]) -> list[float]:
        """Each word's share of the log-odds, of all words at once."""
        own = [features(w) for w in words]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        rows = np.fromiter(chain.from_iterable(own), np.int64, int(sizes.sum()))
        return (np.add.reduceat(self.odds[rows].astype(np.float64), np.cumsum(sizes) - sizes) / sizes).tolist()

    def score(self, log_odds: float) -> float:
        return 1 / (1 + np.exp(-log_odds)) if log_odds >= 0 else (e := np.exp(log_odds)) / (1 + e)


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Model:
    """Stochastic gradient descent over the texts' rows and weights, one text a step."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(texts)))
    steps, done = epochs * len(texts), 0
    for _ in range(epochs):
        for k in rng.permutation(len(texts)).tolist():
            rate = RATE * (1 - done / steps)
            done += 1
            rows, weights = texts[k]
            mean = weights @ vectors[rows]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            vectors[rows] -= np.outer(weights * (rate * ROW_RATE), back)
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """A model of ``labels.quality``, from at most ``rows`` labelled rows whose fold isn't held out."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    # At most ``rows`` pairs of numbers are broadcast, and as many texts' rows and weights are collected.
    found = docs.select("doc_id", utf8(text).alias("b")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", _featured("b").alias("f"))
    got = found.toArrow().combine_chunks()
    if not len(got):
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    ids, quality, own = got["doc_id"].to_numpy(), got["quality"].to_numpy(), got["f"].combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    order = np.lexsort((quality, ids)).tolist()
    rows, weights = own.field("rows"), own.field("weights")
    texts = [(rows[k].values.to_numpy(), weights[k].values.to_numpy()) for k in order]
    return train(texts, quality[order].tolist())


def score(spark: SparkSession, model: Model):
    """A function of a column of bytes to the model's probability of label 1."""
    sent = spark.sparkContext.broadcast(model)
    kept: dict[bytes, float] = {}

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        own, out = sent.value, []
        for part in slices(texts):
            texts_words = [b.split() for b in part]
            new = list(set().union(*texts_words).difference(kept))
            if new:
                kept.update(zip(new, own.words(new)))
            for words in texts_words:
                mean = sum(map(kept.__getitem__, words)) / len(words) if words else 0.0
                mean += float(shapes(words) @ own.odds[SHAPES])
                out.append(float(own.score(mean + own.bias)))
            if len(kept) > KEPT:
                kept.clear()
        return pa.array(out, pa.float64())

    return scored


def classify(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row; a row without doc_id is not held out."""
    model = fit(docs, labels, text)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), score(docs.sparkSession, model)(utf8(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}
