"""Fitted models against plain versions: the ordinal likelihood, grades by the other half, softmax posteriors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import textmodel, toxicity


def small_sample(seed: int, rows: int, features: int, classes: int) -> textmodel.Sample:
    rng = np.random.default_rng(seed)
    has = rng.random((rows, features)) < 0.4
    label = np.clip(has[:, 0].astype(int) + has[:, 1] - (rng.random(rows) < 0.3), 0, classes - 1)
    row, at = np.nonzero(has)
    return textmodel.Sample(row, at, rng.normal(size=(rows, len(textmodel.DENSE))), label, np.arange(rows), np.zeros((features, classes)))


def plain_loss(sample: textmodel.Sample, grade: np.ndarray, weights: list[float], thresholds: list[float], ridge: float) -> float:
    """Minus the mean log-likelihood plus the ridge, text by text."""
    total = 0.0
    for i, g in enumerate(grade):
        score = sum(weights[at] for row, at in zip(sample.row, sample.at, strict=True) if row == i)
        below = [0.0, *(1 / (1 + math.exp(score - t)) for t in thresholds), 1.0]
        total -= math.log(below[g + 1] - below[g])
    return total / len(grade) + ridge / 2 * sum(w * w for w in weights)


@pytest.mark.parametrize("seed", [1, 2])
def test_ordinal_fit_is_the_most_likely(seed):
    sample = small_sample(seed, 40, 3, 3)
    model = textmodel.TextModel(hashes=np.arange(3, dtype=np.uint64))
    toxicity.fit_ordinal(model, sample, sample.label, ridge=0.01, steps=3000)
    assert np.array_equal(model.weights[:, 0], model.weights[:, 1]) and model.bias[0] > model.bias[1]
    # a search by ever smaller steps along each parameter, which knows no gradient
    point, step = [0.0, 0.0, 0.0, -0.5, 0.5], 0.5
    loss = lambda p: plain_loss(sample, sample.label, p[:3], p[3:], 0.01) if p[3] < p[4] else math.inf
    best = loss(point)
    while step > 1e-4:
        moved = False
        for k in range(5):
            for d in (step, -step):
                other = [x + d * (j == k) for j, x in enumerate(point)]
                if (value := loss(other)) < best:
                    point, best, moved = other, value, True
        step = step if moved else step / 2
    fitted = [*model.weights[:, 0], *-model.bias]
    assert loss(fitted) <= best + 1e-5
    assert np.allclose(fitted, point, atol=0.02)


def test_grades_do_not_depend_on_the_own_half():
    rows = 400
    rng = np.random.default_rng(5)
    label = (np.arange(rows) % 3 == 0).astype(int)
    has = rng.random((rows, 12)) < np.where(label[:, None] == 1, 0.5, 0.02)
    lone = np.zeros((rows, 1), dtype=bool)
    row, at = np.nonzero(np.concatenate([has, lone], axis=1))
    sample = textmodel.Sample(row, at, np.zeros((rows, len(textmodel.DENSE))), label, np.arange(rows), np.zeros((13, 2)))
    got = toxicity.grades(sample)
    assert set(got[label == 0]) == {0} and set(got[label == 1]) == {1, 2}
    counts = has.sum(axis=1)
    assert counts[got == 2].min() >= counts[got == 1].max() - 1
    # a feature that only one half holds grades none of that half's texts
    half = (toxicity.mix(sample.keys.view(np.uint64)) & np.uint64(1)).astype(bool)
    lone[half & (label == 1)] = True
    row, at = np.nonzero(np.concatenate([has, lone], axis=1))
    again = toxicity.grades(textmodel.Sample(row, at, sample.dense, label, sample.keys, sample.lean))
    assert np.array_equal(again[half], got[half])
    none = textmodel.Sample(row[:0], at[:0], sample.dense[:0], label[:0], sample.keys[:0], sample.lean)
    assert len(toxicity.grades(none)) == 0
    assert set(toxicity.grades(textmodel.Sample(row, at, sample.dense, np.ones(rows, dtype=int), sample.keys, sample.lean))) == {1}


def test_softmax_posteriors_equal_a_plain_fit():
    sample = small_sample(3, 60, 4, 3)
    model = textmodel.TextModel(hashes=np.arange(4, dtype=np.uint64))
    textmodel.fit_softmax(model, sample, 3, ridge=0.05, steps=3000)
    n, f = 60, 4
    x = np.concatenate([np.zeros((n, f)), sample.dense], axis=1)
    x[sample.row, sample.at] = 1
    truth = np.eye(3)[sample.label]
    w, b = np.zeros((x.shape[1], 3)), np.log((truth.sum(axis=0) + 0.5) / (n + 1.5))
    for _ in range(20_000):
        e = np.exp(x @ w + b)
        p = e / e.sum(axis=1, keepdims=True)
        w, b = w - 0.1 * (x.T @ (p - truth) / n + 0.05 * w), b - 0.1 * (p - truth).mean(axis=0)
    got = textmodel.softmax(x @ model.weights + model.bias)
    assert np.abs(got - p).max() < 0.01


def test_calibration_and_clashing_names(spark):
    rows = [(i, "calm words of the day " + ("vile rotten" if i % 4 == 0 else "fair bright")) for i in range(120)]
    docs = spark.createDataFrame([*rows, rows[0], (None, None), (500, "")], "doc_id long, text string")
    for name in ("key", "p", "own0", "label", "TEXT2"):
        docs = docs.withColumn(name, F.lit(7))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [*(i for i in range(120) if i % 4), 500]
    assert kept.where("doc_id IS NULL").count() == 1
    scored = toxicity.score_toxicity(docs, labels).where("doc_id = 0").collect()
    assert len(scored) == 2 and scored[0] == scored[1] and scored[0].rejected
    bins = toxicity.calibration(docs, labels).collect()
    assert sum(b.n for b in bins) < 121 and all(b.toxic_share == (b.p_toxic > 0.5) for b in bins)
    assert toxicity.calibration(docs.limit(0), labels).count() == 0
