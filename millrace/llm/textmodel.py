"""Sparse text features and linear models that are fitted on a bounded sample of labelled documents.

Features are the presence of words (A-Z lower-cased, parted by bytes that are neither ASCII letters or digits nor part
of a longer character) and of the first five bytes of longer words, by hash. The sample's features are counted on
Spark; the driver gets the chosen features, at most `features` of them, and the sample's rows over those alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import FOLDED, id_key, materialise, mix, prefix_sums, salts, slices, span_hashes, utf8, word_spans

#: Labelled rows that a model is fitted on at most: those of the smallest id hashes.
SAMPLE = 8192
FEATURES = 4096
STEM = 5
#: Fewest sample documents that a feature occurs in.
LEAST = 4

#: Bytes that part words: all but ASCII letters and digits and bytes of longer characters.
PARTING = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])
_UPPER = np.array([ord("A") <= b <= ord("Z") for b in range(256)])
_DIGIT = np.array([ord("0") <= b <= ord("9") for b in range(256)])
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"!?()-" for b in range(256)])
_STEM_SALT = salts(1, 31)[0]

#: Names of the dense features: shares of bytes and words, and the mean length of words.
DENSE = ("upper", "digits", "symbols", "exclamations", "distinct", "length", "words")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of all words and stems, with repeats, and the dense features of each row; offsets[0] is 0."""
    starts, ends, first = word_spans(data, offsets, PARTING)
    sums = prefix_sums(data, FOLDED)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    words = span_hashes(sums, starts, ends)
    long = np.flatnonzero(ends - starts > STEM)
    stems = mix(span_hashes(sums, starts[long], starts[long] + STEM) ^ _STEM_SALT)
    size = np.maximum(np.diff(offsets), 1)
    share = [np.diff(np.concatenate([[0], np.cumsum(t[data])])[offsets]) / size for t in (_UPPER, _DIGIT, _SYMBOL, np.arange(256) == ord("!"))]
    count = np.diff(first)
    own = mix(words) ^ mix(row.astype(np.uint64) + np.uint64(1))
    owner = row[np.unique(own, return_index=True)[1]]
    distinct = np.bincount(owner, minlength=len(count)) / np.maximum(count, 1)
    mean = np.bincount(row, weights=ends - starts, minlength=len(count)) / np.maximum(count, 1)
    dense = np.stack([*share, distinct, mean / 10, np.log1p(count) / 10], axis=1)
    return np.concatenate([row, row[long]]), np.concatenate([words, stems]), dense


@dataclass
class TextModel:
    """Hashes of the chosen features in ascending order; how dense features are scaled; weights (features + dense, k)."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(len(DENSE)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(DENSE)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1))
    use_dense: bool = False

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (row, place) of the chosen features, and the dense features scaled."""
        row, hashes, dense = features(data, offsets)
        if not len(self.hashes):
            return row[:0], row[:0], (dense - self.centre) / self.scale
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        pairs = np.unique(row[hit] * len(self.hashes) + at[hit])
        return pairs // len(self.hashes), pairs % len(self.hashes), (dense - self.centre) / self.scale

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, k): weighted sums plus bias."""
        row, at, dense = self.rows(data, offsets)
        n, f = len(offsets) - 1, len(self.hashes)
        out = np.stack([np.bincount(row, weights=self.weights[at, k], minlength=n) if len(row) else np.zeros(n) for k in range(self.weights.shape[1])], axis=1)
        return out + (dense @ self.weights[f:] if self.use_dense else 0) + self.bias


@dataclass
class Sample:
    """The sample over the chosen features: row and place of each occurrence, dense features, class of each row."""

    row: np.ndarray
    at: np.ndarray
    dense: np.ndarray
    label: np.ndarray
    keys: np.ndarray
    #: Of each feature how many standard errors its share in each class is above that of the others.
    lean: np.ndarray


def labelled(df: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE) -> DataFrame:
    """(key, text, label) of at most `most` labelled documents, those of the smallest id hashes.

    label: SQL for the class of a labels row, from 0; rows where it is null are left out, and of several rows of a
    document the largest class counts. The ids are so few by the bound that they are broadcast.
    """
    ids = labels.select(id_key().alias("key"), F.expr(label).cast("int").alias("label")).where("label IS NOT NULL").groupBy("key").agg(F.max("label").alias("label"))
    ids = materialise(ids.orderBy(F.xxhash64("key"), "key").limit(most), "label-sample")
    docs = df.select(id_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialise(docs.join(F.broadcast(ids), "key"), "labelled")


def choose_features(sample: DataFrame, classes: int, most: int = FEATURES) -> tuple[TextModel, Sample]:
    """The features whose share differs most between classes, and the sample over them."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for i, j in slices(offsets):
                row, found, _ = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                order = np.lexsort((found, row))  # one row per document and feature
                r, h = row[order], found[order]
                new = np.ones(len(r), dtype=bool)
                new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(label[i + r[new]].astype(np.int32))], names=["hash", "label"])

    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    total = max(sum(sizes.values()), 1)
    counts = sample.mapInArrow(hashes, "hash long, label int").groupBy("hash").agg(F.count("*").alias("n"), *(F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(classes))).where(F.col("n") >= LEAST)
    share = F.col("n") / F.lit(float(total))
    leans = []
    for k in range(classes):
        own, rest = float(max(sizes.get(k, 0), 1)), float(max(total - sizes.get(k, 0), 1))
        spread = F.sqrt(share * (1 - share) * (1 / own + 1 / rest)) + 1e-9
        leans.append(((F.col(f"n{k}") / own - (F.col("n") - F.col(f"n{k}")) / rest) / spread).alias(f"z{k}"))
    scored = counts.select("hash", *leans).withColumn("z", F.greatest(*(F.abs(F.col(f"z{k}")) for k in range(classes)), F.lit(0.0)))
    chosen = scored.orderBy(F.desc("z"), "hash").limit(most).collect()
    values = np.array([r["hash"] for r in chosen], dtype=np.int64).view(np.uint64)
    order = np.argsort(values)
    lean = np.array([[r[f"z{k}"] for k in range(classes)] for r in chosen]).reshape(len(chosen), classes)[order]
    model = TextModel(hashes=values[order])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                row, at, dense = model.rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), batch.column("label").slice(i, j - i), pa.array([at[a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.int32())), pa.array(list(dense), pa.list_(pa.float64()))], names=["key", "label", "at", "dense"])

    got = sorted(sample.mapInArrow(rows, "key long, label int, at array<int>, dense array<double>").collect(), key=lambda r: r.key)
    dense = np.array([r.dense for r in got]).reshape(len(got), len(DENSE))
    if len(got):
        model.centre, model.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    return model, Sample(
        np.repeat(np.arange(len(got)), [len(r.at) for r in got]).astype(np.int64), np.array([x for r in got for x in r.at], dtype=np.int64), (dense - model.centre) / model.scale,
        np.array([r.label for r in got], dtype=np.int64), np.array([r.key for r in got], dtype=np.int64), lean,
    )


def descend(weights: np.ndarray, gradient, steps: int, rate: float = 0.05) -> np.ndarray:
    """Full-batch Adam: gradient(weights) to new weights, `steps` times."""
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, steps + 1):
        g = gradient(weights)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return weights


def fit_softmax(model: TextModel, sample: Sample, classes: int, ridge: float = 1e-3, steps: int = 200) -> TextModel:
    """Multinomial logistic regression over chosen and dense features; a class without rows has a small prior."""
    f, d, n = len(model.hashes), len(DENSE), max(len(sample.label), 1)
    truth = np.zeros((len(sample.label), classes))
    truth[np.arange(len(sample.label)), sample.label] = 1
    prior = np.log((truth.sum(axis=0) + 0.5) / (n + 0.5 * classes))

    def scores(w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(sample.row, weights=w[sample.at, k], minlength=len(truth)) for k in range(classes)], axis=1) + sample.dense @ w[f : f + d] + w[-1] + prior

    def gradient(w: np.ndarray) -> np.ndarray:
        p = softmax(scores(w)) - truth
        top = np.stack([np.bincount(sample.at, weights=p[sample.row, k], minlength=f) for k in range(classes)], axis=1)
        return np.concatenate([top, sample.dense.T @ p, p.sum(axis=0, keepdims=True)]) / n + ridge * np.concatenate([w[:-1], np.zeros((1, classes))])

    w = np.zeros((f + d + 1, classes))
    if len(sample.label):
        w = descend(w, gradient, steps)
    model.weights, model.bias, model.use_dense = w[:-1], w[-1] + prior, True
    return model


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
