"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of words, word pairs and pairs around one word.
Training takes a bounded, documented sample of labelled rows, dealt into shards;
every shard runs FTRL-proximal with per-coordinate rates over its rows, and the
shards' weights are averaged by feature.  L1 leaves few weights other than zero,
so what is broadcast for scoring is bounded by ``2 ** BITS`` and small in fact.

Defined cases: a null or empty text has no feature and gets the score of the
intercept; without labels of both kinds every score is the share of toxic labels
(one half without labels); conflicting labels of a document count as toxic if at
least half say so; null ids are scored, never learned from; repeated rows are
scored one by one; other columns are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import in_fold, table

BITS = 22
#: Remembered word hashes per worker.
REMEMBERED = 300_000

_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Training:
    """``sample_rows`` is the expected number of labelled rows that are learned from."""

    sample_rows: int = 24_000
    shard_rows: int = 6_000
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    most_balance: float = 6.0


class _Words(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.strip(".,;:!?\"'()*&%$#").encode())
        if len(self) < REMEMBERED:
            self[word] = h
        return h


_WORDS = _Words()


def hashed(text: str) -> np.ndarray:
    """Hashed words, pairs and skip pairs, with repeats, as indices below ``2 ** BITS``."""
    w = np.fromiter(map(_WORDS.__getitem__, text.lower().split()), np.uint64)
    pairs, skips = w[:-1] * _PAIR + w[1:], w[:-2] * _SKIP + w[2:]
    mixed = np.concatenate([w, pairs, skips])
    mixed ^= mixed >> np.uint64(31)
    return ((mixed * _PAIR) >> np.uint64(64 - BITS)).astype(np.int64)


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train_shard(texts: list[str], labels: np.ndarray, balance: float, t: Training) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, intercept) after ``epochs`` passes of FTRL-proximal.

    Toxic rows weigh ``balance``: with few of them the log-loss alone would
    learn mostly the share.
    """
    rows = [np.unique(hashed(x)).astype(np.int32) for x in texts]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z0 = n0 = 0.0
    for _ in range(t.epochs):
        for idx, y in zip(rows, labels):
            zi, ni = z[idx], n[idx]
            rate = (t.beta + np.sqrt(ni)) / t.alpha
            w = np.where(np.abs(zi) <= t.l1, 0.0, -(zi - np.sign(zi) * t.l1) / (rate + t.l2))
            w0 = -z0 / ((t.beta + np.sqrt(n0)) / t.alpha)
            g = (sigmoid(w.sum() + w0) - y) * (balance if y else 1.0)
            grown = np.sqrt(ni + g * g)
            z[idx] += g - (grown - np.sqrt(ni)) / t.alpha * w
            n[idx] += g * g
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / t.alpha * w0
            n0 += g * g
    w = np.where(np.abs(z) <= t.l1, 0.0, -(z - np.sign(z) * t.l1) / ((t.beta + np.sqrt(n)) / t.alpha + t.l2))
    used = np.flatnonzero(w)
    return used, w[used], -z0 / ((t.beta + np.sqrt(n0)) / t.alpha)


def train(documents: DataFrame, labels: DataFrame, t: Training, id_col: str, text_col: str) -> tuple[np.ndarray, float]:
    """Dense weights and intercept from labelled rows outside the held-out fold."""
    kept = (
        labels.filter("doc_id is not null and toxic is not null").filter(~in_fold("doc_id", 5, 0))
        .groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    )
    n, toxic = kept.agg(F.count("*"), F.sum("toxic")).first()
    toxic = toxic or 0
    if not toxic or toxic == n:
        share = min(max(toxic / n, 1e-3), 1 - 1e-3) if n else 0.5
        return np.zeros(1 << BITS), float(np.log(share / (1 - share)))
    spread = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    sample = kept.filter(spread < int((1 << 30) * min(1.0, t.sample_rows / n)))
    # an expected sample_rows rows of two numbers
    joined = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    balance = min(t.most_balance, (n - toxic) / toxic)
    shards = int(min(n, t.sample_rows) // t.shard_rows) or 1
    rows = joined.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).alias("shard"), F.xxhash64("doc_id", "text").alias("turn"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        used, w, w0 = train_shard(list(pdf["text"]), pdf["toxic"].to_numpy(), balance, t)
        return pd.DataFrame({"i": np.append(used, -1), "w": np.append(w, w0)})

    parts = rows.groupBy("shard").applyInPandas(fit, "i long, w double")
    got = parts.groupBy("i").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    trained = max((r["n"] for r in got if r["i"] < 0), default=1)
    weights, intercept = np.zeros(1 << BITS), 0.0
    for r in got:
        if r["i"] < 0:
            intercept = r["w"] / trained
        else:
            weights[r["i"]] = r["w"] / trained
    return weights, intercept


def score(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Training = Training()) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_features) per document."""
    weights, intercept = train(documents, labels, training, id_col, text_col)
    used = np.flatnonzero(weights)
    sent = documents.sparkSession.sparkContext.broadcast((used.astype(np.int32), weights[used].astype(np.float32), intercept))

    @F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n", T.IntegerType())]))
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index, values, w0 = sent.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[index] = values
        for texts in batches:
            out = []
            for t in texts:
                idx = hashed(t)
                idx = np.unique(idx[dense[idx] != 0])
                out.append((float(sigmoid(float(dense[idx].sum(dtype=np.float64)) + w0)), len(idx)))
            yield pd.DataFrame(out, columns=["score", "n"])

    found = documents.select(
        F.col(id_col).alias("doc_id"), in_fold(id_col, 5, 0).alias("held_out"), scored(F.coalesce(F.col(text_col), F.lit(""))).alias("s")
    )
    return found.select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.n").alias("n_features"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
