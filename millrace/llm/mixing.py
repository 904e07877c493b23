"""Mixing sources to target weights by soft membership.

A softmax classifier fitted on the labelled table gives each document a posterior over domains. Each document i has a
rate r_i >= 0, its expected number of copies in the mixture; with n_i its tokens and p_i its posterior, the mixture's
expected tokens are A r = sum of r_i n_i p_i, one total per domain. The rates minimise

    f(r) = (A r - T)' M^-1 (A r - T) / 2,      M = sum of n_i p_i p_i'

by projected gradient from r = 1: r_i <- max(0, r_i - p_i' h) with h = M^-1 (A r - T), the gradient in the metric of
token counts. M whitens the domains, so the step 1 is right whatever their sizes. A step needs the domain totals alone:
one aggregation over all documents, whose rates are folded from the few h so far, so no state is kept per document.
Nesterov's momentum takes the gradient at a point ahead of the last two.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import SPACE, id_back, id_key, materialise, slices, tagged, utf8, word_spans
from millrace.llm.textmodel import SAMPLE, TextModel, choose_features, fit_softmax, labelled, softmax

#: The domains of a labels row, in the order of the classifier's classes.
DOMAINS = ("high", "low", "toxic")
DOMAIN_SQL = "CASE WHEN toxic > 0 THEN 2 WHEN quality > 0 THEN 0 WHEN quality IS NOT NULL THEN 1 END"
#: Target shares of the mixture's tokens.
TARGETS = {"high": 0.9, "low": 0.08, "toxic": 0.02}
STEPS, TOLERANCE = 100, 1e-6


def domain_model(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> TextModel:
    """The domain classifier, from at most `most` labelled documents."""
    model, sample = choose_features(labelled(docs, labels, DOMAIN_SQL, most), len(DOMAINS))
    return fit_softmax(model, sample, len(DOMAINS))


def posteriors(df: DataFrame, model: TextModel) -> DataFrame:
    """(key, tokens, p0 ...): words of each whole text and its domain posterior."""
    names = [f"p{k}" for k in range(len(DOMAINS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                some, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                p = softmax(model.scores(some, at))
                tokens = np.diff(word_spans(some, at, SPACE)[2])
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), pa.array(tokens), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=["key", "tokens", *names])

    return df.mapInArrow(run, "key long, tokens long, " + ", ".join(f"{n} double" for n in names))


def rate(history: list[tuple[float, list[float]]]) -> Column:
    """The rate of a row with posterior p0, p1 ... after the steps (momentum, h) of history."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*(F.array(F.lit(float(m)), *(F.lit(float(x)) for x in h)) for m, h in history))
    dot = lambda s: sum((F.element_at(s, k + 2) * F.col(f"p{k}") for k in range(len(history[0][1]))), F.lit(0.0))

    def step(acc: Column, s: Column) -> Column:
        ahead = acc["now"] + F.element_at(s, 1) * (acc["now"] - acc["before"])
        return F.struct(F.greatest(F.lit(0.0), ahead - dot(s)).alias("now"), acc["now"].alias("before"))

    return F.aggregate(steps, F.struct(F.lit(1.0).alias("now"), F.lit(1.0).alias("before")), step)["now"]


def fit_rates(rows: DataFrame, totals: np.ndarray | None = None, shares: np.ndarray | None = None, budget: float | None = None, steps: int = STEPS) -> tuple[list[tuple[float, list[float]]], np.ndarray, np.ndarray]:
    """(history of steps, reached totals, target totals) for rows of (tokens, p0 ...).

    Give the targets as totals, or as shares of a budget of tokens (all tokens of the rows by default).
    """
    k = sum(c.startswith("p") and c[1:].isdigit() for c in rows.columns)
    p = [F.col(f"p{i}") for i in range(k)]
    gram = [F.sum(F.col("tokens") * p[i] * p[j]) for i in range(k) for j in range(i, k)]
    first = [x or 0.0 for x in rows.agg(*(F.sum(F.col("tokens") * x) for x in p), *gram).first()]
    now, m = np.array(first[:k]), np.zeros((k, k))
    m[np.triu_indices(k)] = first[k:]
    m = m + np.triu(m, 1).T
    if totals is None:
        shares = np.asarray(shares, dtype=float)
        totals = shares / shares.sum() * (now.sum() if budget is None else budget)
    whole = max(totals.sum(), 1.0)
    inverse = np.linalg.pinv(m + np.eye(k) * 1e-9 * max(np.trace(m), 1e-9))
    history: list[tuple[float, list[float]]] = []
    before, t = now, 1.0
    while len(history) < steps and np.abs(now - totals).max() > TOLERANCE * whole:
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = (t - 1) / after
        t = after
        # totals are linear in the rates, so those of the point ahead need no pass of their own
        history.append((momentum, (inverse @ (now + momentum * (now - before) - totals)).tolist()))
        r = rate(history)
        before, now = now, np.array([x or 0.0 for x in rows.select((F.col("tokens") * r).alias("t"), *p).agg(*(F.sum(F.col("t") * x) for x in p)).first()])
    return history, now, totals


def mixture_rates(df: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, budget: float | None = None, most: int = SAMPLE) -> DataFrame:
    """(doc_id, tokens, p_high, p_low, p_toxic, rate) for each whole text.

    tokens: words of the text; a null or empty one has none and takes the rate of its posterior. A null doc_id stays
    null; repeated rows count and are rated each, alike; an empty table gives no rows; without labels the posterior is
    even and all rates are alike. Other columns are not read.
    """
    docs = df.select(id_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = materialise(posteriors(docs, domain_model(df, labels, most)), "posteriors")
    history, _, _ = fit_rates(rows, shares=np.array([targets.get(d, 0.0) for d in DOMAINS]), budget=budget)
    return rows.select(id_back(F.col("key")).alias("doc_id"), "tokens", *(F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)), rate(history).alias("rate"))


def mix_down(df: DataFrame, labels: DataFrame, low_share: float = 0.05, headroom: float = 1.1, most: int = SAMPLE) -> DataFrame:
    """The rows of df that the mixture draws, each at most once, with all their columns.

    The target keeps all expected tokens of the domain `high`, raised by headroom so that the rate of a clean text is
    over 1, and lets `low` and `toxic` together have low_share of the mixture at most; no domain is drawn beyond what
    there is. A row stays if its rate exceeds a number in [0, 1) that its doc_id and text determine, so a rerun draws
    the same rows. Rates are computed beside each row; nothing is joined.
    """
    docs = df.select(id_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = domain_model(df, labels, most)
    rows = materialise(posteriors(docs, model), "posteriors")
    have = np.array([x or 0.0 for x in rows.agg(*(F.sum(F.col("tokens") * F.col(f"p{k}")) for k in range(len(DOMAINS)))).first()])
    rest = min(1.0, have[0] * low_share / (1 - low_share) / max(have[1:].sum(), 1e-9))
    history, _, _ = fit_rates(rows, totals=have * np.array([headroom, rest, rest]))

    @F.pandas_udf("array<double>")
    def posterior(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        data, offsets = utf8(pa.array(texts, pa.large_string()))
        parts = [softmax(model.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in slices(offsets)]
        return pd.Series(list(np.concatenate(parts)) if parts else [])

    marked, back = tagged(df)
    marked = marked.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("p", posterior("text")).withColumns({f"p{i}": F.element_at("p", i + 1) for i in range(len(DOMAINS))})
    drawn = F.shiftrightunsigned(F.xxhash64("key", "text", F.lit("mix")), 11) / F.lit(float(2**53))
    return marked.where(drawn < rate(history)).select(*back)
