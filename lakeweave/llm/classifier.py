"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal.

Features of a whole text are its words and word pairs, each once with its case and its letters as
they are and once as a shape (letters to a or A, digits to 0, other characters as they are, runs
shortened), and whether each pair is one word twice, hashed into 2^``bits`` weights. The value of a feature is its count over the root of the
number of features, so that a score is one sparse dot product: a gather and a sum.

Training takes at most ``max_train_rows`` labelled rows, those whose ids hash lowest, so the choice
neither follows the order of the input nor its size; one Python task reads their features in that
order, however large the corpus is. The per-coordinate FTRL updates (McMahan et al., 2013) are done
for a text's features at once. The model is 2^bits floats, whatever the input.

Defined results: a null text is empty, has no features and scores sigmoid(bias); without labels of
both kinds the score is the labels' smoothed rate; labels that are null or neither 0 nor 1 teach
nothing; ids with several different labels teach once for each; of documents with one id the text whose
hash is lowest teaches, so that the sample is bounded in rows; repeated rows are scored one by one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm import _common as c


@dataclass(frozen=True)
class Ftrl:
    """Settings; `max_train_rows` bounds the labelled sample."""

    bits: int = 18
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    max_train_rows: int = 12_000


#: Words that a worker keeps with their hashes; when full, the cache starts over.
CACHE_WORDS = 200_000

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_CAPITALS = re.compile(rb"[A-Z]{2,}")
_DIGITS = re.compile(rb"[0-9]+")


def shape(word: bytes) -> bytes:
    return _LETTERS.sub(b"a", _CAPITALS.sub(b"AA", _DIGITS.sub(b"0", word)))


class Hasher:
    """Texts to feature numbers."""

    def __init__(self, bits: int):
        self.bits = bits
        self.known: dict[bytes, int] = {}

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for w in words.difference(self.known):
            self.known[w] = zlib.crc32(w) | zlib.crc32(shape(w), 7) << 32

    def features(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").split()
        if not words:
            return np.empty(0, np.int64)
        self._learn(set(words))
        both = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        out = []
        for kind, h in enumerate((both & np.uint64(0xFFFFFFFF), both >> np.uint64(32))):
            own = (h + np.uint64(1 + kind)) * np.uint64(0x9E3779B97F4A7C15)
            out += [own, (own[:-1] ^ (own[1:] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)]
        again = (both[1:] == both[:-1]).astype(np.uint64) + np.uint64(5)  # a pair's shape: the same word twice, or not
        out.append(again * np.uint64(0xD6E8FEB86659FD93))
        return (np.concatenate(out) >> np.uint64(64 - self.bits)).astype(np.int64)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


class Model:
    """Weights, the last of which is the bias."""

    def __init__(self, settings: Ftrl):
        self.s = settings
        n = (1 << settings.bits) + 1
        self.z, self.n = np.zeros(n), np.zeros(n)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        s, z = self.s, self.z[at]
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2))

    def learn(self, features: np.ndarray, label: int) -> None:
        at, counts = np.unique(features, return_counts=True)
        at = np.append(at, len(self.z) - 1)
        x = np.append(counts / np.sqrt(max(1, len(features))), 1.0)
        w = self.weights(at)
        g = (sigmoid(w @ x) - label) * x
        was = self.n[at]
        self.z[at] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / self.s.alpha * w
        self.n[at] = was + g * g

    def packed(self) -> np.ndarray:
        return self.weights(slice(None)).astype(np.float32)


def score(weights: np.ndarray, features: np.ndarray) -> float:
    """The chance of label 1 for one text."""
    dot = float(weights[features].sum(dtype=np.float64)) / len(features) ** 0.5 if len(features) else 0.0
    return sigmoid(dot + float(weights[-1]))


def remainder(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 marks held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _train(batches: Iterator[pa.RecordBatch], settings: Ftrl) -> Iterator[pa.RecordBatch]:
    hasher, model, seen = Hasher(settings.bits), Model(settings), [0, 0]
    for whole in batches:
        for b in c.slices(whole):
            for t, label in zip(c.texts(b), b.column("label").to_pylist()):
                model.learn(hasher.features(t), label)
                seen[label] += 1
    weights = model.packed()
    if not all(seen):
        weights[:] = 0
        weights[-1] = np.log((seen[1] + 1) / (seen[0] + 1))
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", settings: Ftrl = Ftrl()) -> np.ndarray:
    """Weights from the rows of docs that have a label and are not held out. Only the model comes to the driver."""
    c.ship(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("_id").isNotNull()).distinct()
    # the sample is chosen among ids, before any text is read or moved; what is chosen is bounded, so it may be broadcast
    order = F.xxhash64(F.col("_id").cast("string"))
    present = docs.select(F.col(id_col).alias("_present")).distinct()
    usable = c.materialize(marked.where(remainder("_id") != 0).join(present, F.col("_id") == F.col("_present"), "left_semi"), "train-labels")
    # all but about four times the sample is dropped where it lies, so that the sort meets a bounded number of rows
    step = max(1, usable.count() // (4 * settings.max_train_rows))
    chosen = c.materialize(usable.where(F.pmod(order, F.lit(step)) == 0).orderBy(order, "_id", "label").limit(settings.max_train_rows), "train-ids")
    rows = docs.select(F.col(id_col).alias("_doc"), F.col("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "label", c.clean_text().alias("text"))
    # of an id's texts one, chosen where they lie before any is moved: max_train_rows rows at most
    rows = rows.groupBy("_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("_id", "label", "t.text")
    ordered = rows.repartition(1).sortWithinPartitions(order, "_id", "label", F.xxhash64("text")).select("text", "label")
    found = ordered.mapInArrow(lambda it: _train(it, settings), "weights binary").first()
    if found is None:  # a partition without rows need not run
        return np.zeros((1 << settings.bits) + 1, np.float32)
    return np.frombuffer(found["weights"], np.float32)


def _score(batches: Iterator[pa.RecordBatch], get, bits: int, text_col: str, drop_text: bool) -> Iterator[pa.RecordBatch]:
    weights, hasher = get(), Hasher(bits)
    for whole in batches:
        for b in c.slices(whole):
            out = pa.array([score(weights, hasher.features(t)) for t in c.texts(b, text_col)], pa.float64())
            names = [n for n in b.schema.names if not (drop_text and n == text_col)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(n)) for n in names), out], names=[*names, "score"])


def with_score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """docs and `score` (a column of that name is replaced); a pass without a shuffle."""
    spark = docs.sparkSession
    c.ship(spark)
    docs = docs.drop("score")
    shared = spark.sparkContext.broadcast(np.asarray(weights, np.float32))
    bits = (len(weights) - 1).bit_length() - 1
    fields = [f for f in docs.schema.fields if not (drop_text and f.name == text_col)]
    return docs.mapInArrow(lambda it: _score(it, lambda: shared.value, bits, text_col, drop_text), T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Ftrl = Ftrl()) -> DataFrame:
    """The documents that score at least `threshold`, with the columns they came with."""
    weights = train(docs, labels, settings=settings)
    rows = c.wrapped(docs, text=F.col("text"))
    return c.unwrapped(with_score(rows, weights, drop_text=True).where(F.col("score") >= threshold))
