"""A quality classifier from positive and unlabelled texts.

Trusted positives are labelled documents, unlabelled texts are web documents as they come.
A logistic model minimises the non-negative unbiased risk: with class prior p, the risk on
positives p * E+[loss(g)] plus the risk on negatives E_u[loss(-g)] - p * E+[loss(-g)], which
is held at 0 from below; when a step finds it negative, the step undoes it instead.
The prior is estimated from the labelled rows.

The fit uses a bounded sample, ``SAMPLE`` positives and as many unlabelled documents with
the smallest hashes of their ids; scoring reads every text whole.

Defined cases: a missing text is empty and has a score like any other; without positives or
unlabelled texts every score is the prior (0.5 without labels); a document with
contradicting labels is no trusted positive; equal texts have equal scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import remainder, whole_texts

#: Most positives, and most unlabelled documents, that a fit reads.
SAMPLE = 4000
# Classes of bytes: lower, upper, digit, blank, line end, sentence marks, quotes and
# brackets, other marks, beyond ASCII, control.
CLASS = np.array([
    0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in (32, 9)
    else 4 if c in (10, 13) else 5 if chr(c) in ".,;:!?" else 6 if chr(c) in "'\"()[]{}<>"
    else 8 if c >= 128 else 9 if c < 32 or c == 127 else 7 for c in range(256)], dtype=np.uint8)
KINDS = 10
#: Class trigrams and byte frequencies, then figures of words and lines.
WIDTH = KINDS ** 3 + 256 + 8


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros(WIDTH, dtype=np.float32)
    kinds = CLASS[raw].astype(np.int32)
    if len(kinds) > 2:
        codes = kinds[:-2] * (KINDS * KINDS) + kinds[1:-1] * KINDS + kinds[2:]
        out[:KINDS ** 3] = np.sqrt(np.bincount(codes, minlength=KINDS ** 3) / len(codes))
    if len(raw):
        out[KINDS ** 3:KINDS ** 3 + 256] = np.sqrt(np.bincount(raw, minlength=256) / len(raw))
    words, lines = data.split(), data.split(b"\n")
    n = max(len(words), 1)
    out[-8:] = (
        np.log1p(len(words)), len(raw) / n / 10, len(set(words)) / n,
        len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(len(raw) / len(lines)),
        max(map(len, words), default=0) ** 0.5 / 10, 0.0 if words else 1.0)
    return out


def losses(score: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
    """Mean logistic loss for a label, and its slope at each score."""
    z = sign * score
    return float(np.logaddexp(0, -z).mean()), -sign / (1 + np.exp(z)) / len(score)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400,
        step: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept with the least non-negative risk, by Adam on the whole sample."""
    n = len(positive) + len(unlabelled)
    mean = sum(x.sum(axis=0, dtype=np.float64) for x in (positive, unlabelled)) / n
    square = sum(np.einsum("nd,nd->d", x, x, dtype=np.float64) for x in (positive, unlabelled)) / n
    spread = np.sqrt(np.maximum(square - mean ** 2, 0)) + 1e-3
    xp, xu = ((x - mean.astype(np.float32)) / spread.astype(np.float32) for x in (positive, unlabelled))
    w = np.zeros(positive.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        v = w[:-1].astype(np.float32)
        gp, gu = ((x @ v).astype(np.float64) + w[-1] for x in (xp, xu))
        _, as_positive = losses(gp, 1.0)
        p_negative, p_slope = losses(gp, -1.0)
        u_negative, u_slope = losses(gu, -1.0)
        if u_negative - prior * p_negative >= 0:
            dp, du = prior * (as_positive - p_slope), u_slope
        else:
            dp, du = prior * p_slope, -u_slope
        pull = xp.T @ dp.astype(np.float32) + xu.T @ du.astype(np.float32)
        slope = np.append(pull + decay * w[:-1], dp.sum() + du.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope ** 2
        w -= step * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    weights = w[:-1] / spread
    return weights, float(w[-1] - mean @ weights)


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of packed numbers as a matrix, read where Arrow holds them."""
    parts = [np.zeros((0, WIDTH), dtype=np.float32)]
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
        if len(chunk):
            parts.append(np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(np.float32).reshape(-1, WIDTH))
    return np.concatenate(parts)


def sampled(rows: DataFrame, seed: str, most: int) -> DataFrame:
    """The ``most`` ids with the smallest hashes. A share of the ids that holds about twice
    as many is picked first, so the tasks have no more than that to merge.
    """
    ids = rows.select("doc_id").where("doc_id IS NOT NULL").withColumn(
        "place", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    share = min(1.0, 2.0 * most / max(rows.count(), 1))
    return (ids.where(F.col("place") <= int(share * 2 ** 64) - 2 ** 63 - 1)
            .orderBy("place", "doc_id").limit(most).select("doc_id"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """docs: (doc_id, text) to learn from; labels: (doc_id, quality) of such documents."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("low"), F.max("quality").alias("high"))
    row = known.agg(F.avg(F.col("low").cast("double")).alias("prior")).first()
    prior = 0.5 if row.prior is None else min(max(row.prior, 0.01), 0.99)
    positive = sampled(known.where("low = 1 AND high = 1"), "quality", sample)
    unlabelled = sampled(docs, "web", sample)
    picked = (positive.select("doc_id", F.lit(True).alias("trusted"))
              .unionAll(unlabelled.select("doc_id", F.lit(False).alias("trusted"))))
    vector = F.pandas_udf(lambda t: pd.Series([features(x).tobytes() for x in t]), "binary")
    rows = (docs.join(picked, "doc_id").dropDuplicates(["doc_id", "trusted"])
            .select("trusted", vector("text").alias("x")).toArrow())
    x, trusted = vectors(rows.column("x")), rows.column("trusted").to_numpy()
    xp, xu = x[trusted], x[~trusted]
    del rows, x
    if not len(xp) or not len(xu):
        return np.zeros(WIDTH), float(np.log(prior / (1 - prior)))
    return fit(xp, xu, prior)


def scorer(model: tuple[np.ndarray, float]):
    """A column function: the score of a text, from 0 to 1."""
    weights, intercept = model

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        g = np.array([features(t) @ weights for t in texts]) + intercept
        return pd.Series(1 / (1 + np.exp(-np.clip(g, -60, 60))))

    return score


def held_out() -> Column:
    return remainder("doc_id", 4) == 2


def learned(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """A model that has seen no text and no label of the held-out quarter."""
    return train(whole_texts(docs).where(~held_out()),
                 labels.select("doc_id", "quality").where(~held_out()))


def quality_table(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    score = scorer(learned(docs, labels))
    return (whole_texts(docs).select("doc_id", held_out().alias("held_out"),
                                     score("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= least).cast("int")))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The documents predicted good, all columns kept."""
    score = scorer(learned(docs, labels))
    return docs.where(score(F.coalesce("text", F.lit(""))) >= least)
