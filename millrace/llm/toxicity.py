"""Toxicity: cumulative-link ordinal regression over sparse text features.

Severity grades are 0 (not toxic), 1 and 2. Labels say only whether a text is toxic; of the toxic ones those with more
telling features than the median are grade 2. Telling are the features that lean to toxic texts by more than TELLING
standard errors in the other half of the sample, so no text takes part in choosing the features that grade it.
One weight vector serves all thresholds: P(grade > k) = 1 / (1 + exp(threshold_k - score)), the thresholds ascending, and
the expected severity is the sum of these. A text is rejected if P(grade > 0) is at least 1/2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import id_back, id_key, mix, slices, tagged, utf8
from millrace.llm.textmodel import SAMPLE, Sample, TextModel, choose_features, descend, labelled

GRADES = 3
TELLING = 4.0
BINS = 10


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def leaning(sample: Sample, rows: np.ndarray) -> np.ndarray:
    """Of each feature how many standard errors its share in the toxic texts among rows (a mask) is above that in others."""
    toxic, features = sample.label == 1, len(sample.lean)
    own, rest = (rows & toxic).sum(), (rows & ~toxic).sum()
    if not own or not rest:
        return np.zeros(features)
    here = rows[sample.row]
    n = np.bincount(sample.at[here], minlength=features)
    n1 = np.bincount(sample.at[here & toxic[sample.row]], minlength=features)
    share = n / (own + rest)
    return (n1 / own - (n - n1) / rest) / (np.sqrt(share * (1 - share) * (1 / own + 1 / rest)) + 1e-9)


def grades(sample: Sample) -> np.ndarray:
    """The severity grade of each sample row, from its label and the features that tell in the half it is not in.

    Rows are halved by a hash of their ids. A half without toxic texts, or without others, tells nothing of the other,
    whose toxic texts are then grade 1; so are those with as many telling features as the median.
    """
    toxic = sample.label == 1
    out = toxic.astype(np.int64)
    half = (mix(sample.keys.view(np.uint64)) & np.uint64(1)).astype(bool)
    for own in (half, ~half):
        telling = leaning(sample, ~own) > TELLING
        count = np.bincount(sample.row[telling[sample.at]], minlength=len(toxic))
        if (own & toxic).any():
            out[own & toxic & (count > np.median(count[own & toxic]))] = 2
    return out


def fit_ordinal(model: TextModel, sample: Sample, grade: np.ndarray, ridge: float = 1e-5, steps: int = 500) -> TextModel:
    """Weights and ascending thresholds by gradient descent on the cumulative-link likelihood.

    model.bias becomes minus the thresholds and model.weights one column per threshold, all alike.
    """
    f, n, k = len(model.hashes), max(len(grade), 1), GRADES - 1
    above = np.array([(grade > j).mean() if len(grade) else 0.0 for j in range(k)])
    start = np.log((1 - above + 1e-3) / (above + 1e-3))

    def thresholds(p: np.ndarray) -> np.ndarray:
        return p[f] + np.concatenate([[0], np.cumsum(np.exp(p[f + 1 :]))])

    def gradient(p: np.ndarray) -> np.ndarray:
        score = np.bincount(sample.row, weights=p[:f][sample.at], minlength=len(grade))
        t = thresholds(p)
        # P(grade <= j) at the grade's upper and lower threshold
        cum = sigmoid(np.concatenate([[-1e9], t, [1e9]])[None, :] - score[:, None])
        rows = np.arange(len(grade))
        high, low = cum[rows, grade + 1], cum[rows, grade]
        mass = np.maximum(high - low, 1e-12)
        up, down = high * (1 - high) / mass, low * (1 - low) / mass
        by_score = up - down  # of minus the log-likelihood
        by_t = np.stack([np.where(grade == j, -up, 0) + np.where(grade == j + 1, down, 0) for j in range(k)], axis=1).sum(axis=0)
        steps_ = np.exp(p[f + 1 :]) * np.array([by_t[j + 1 :].sum() for j in range(k - 1)])
        return np.concatenate([np.bincount(sample.at, weights=by_score[sample.row], minlength=f) / n + ridge * p[:f], [by_t.sum() / n], steps_ / n])

    p = np.concatenate([np.zeros(f), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])
    if len(grade):
        p = descend(p, gradient, steps)
    model.weights, model.bias, model.use_dense = np.repeat(p[:f, None], k, axis=1), -thresholds(p), False
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> TextModel:
    """A severity model from at most `most` labelled documents (labels.toxic)."""
    model, sample = choose_features(labelled(docs, labels, "CAST(toxic > 0 AS int)", most), 2)
    return fit_ordinal(model, sample, grades(sample))


def severity(df: DataFrame, model: TextModel) -> DataFrame:
    """(key, p1, p2, severity): P(grade > 0), P(grade > 1) and their sum for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                p = sigmoid(model.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p.sum(axis=1))], names=["key", "p1", "p2", "severity"])

    return df.mapInArrow(run, "key long, p1 double, p2 double, severity double")


def score_toxicity(df: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, severity, p_toxic, p_severe, grade, rejected) for each whole text.

    A null or empty text has no features and the sample's base rate; a null doc_id stays null; repeated rows are scored
    each; an empty table gives no rows. Without labels, or with labels of one kind, the model is its base rate and
    rejects nothing unless all labels are toxic. Other columns are not read.
    """
    docs = df.select(id_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = severity(docs, train(df, labels, most))
    grade = F.when(F.col("p2") >= 0.5, 2).when(F.col("p1") >= 0.5, 1).otherwise(0)
    return scored.select(id_back(F.col("key")).alias("doc_id"), "severity", F.col("p1").alias("p_toxic"), F.col("p2").alias("p_severe"), grade.alias("grade"), (F.col("p1") >= 0.5).alias("rejected"))


def drop_toxic(df: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The rows of df whose text is not rejected, with all their columns. The score is a column beside the row's own,
    so nothing is joined or shuffled.

    Null and empty texts are scored as texts without features, repeated rows each and alike, a null doc_id like any
    other; an empty table gives no rows.
    """
    model = train(df, labels, most)

    @F.pandas_udf("double")
    def p_toxic(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        data, offsets = utf8(pa.array(texts, pa.large_string()))
        out = [sigmoid(model.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))[:, 0] for i, j in slices(offsets)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    marked, back = tagged(df)
    return marked.withColumn("p", p_toxic(F.coalesce("text", F.lit("")))).where("p < 0.5").select(*back)


def calibration(df: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(bin, n, p_toxic, toxic_share, severity) of labelled texts that the model has not seen.

    Half of the sample, by a hash of the ids, fits the model; the other half is put into BINS bins of p_toxic. A bin
    has its number of texts, their mean p_toxic, the share that is labelled toxic and their mean severity. Bins without
    texts are left out, so an empty table gives no rows; several texts of one id count each.
    """
    sample = labelled(df, labels, "CAST(toxic > 0 AS int)", most)
    held = F.pmod(F.xxhash64("key", F.lit("held")), F.lit(2)) == 1
    model, seen = choose_features(sample.where(~held), 2)
    model = fit_ordinal(model, seen, grades(seen))
    truth = sample.where(held).groupBy("key").agg(F.max("label").alias("label"))
    scored = severity(sample.where(held).select("key", "text"), model).join(truth, "key")
    place = F.least(F.floor(F.col("p1") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    return scored.groupBy(place).agg(F.count("*").alias("n"), F.avg("p1").alias("p_toxic"), F.avg("label").alias("toxic_share"), F.avg("severity").alias("severity"))
