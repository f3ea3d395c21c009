"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, of its pairs of neighbouring words and of
its pairs with one word between (skip-grams). Each coordinate has its own learning rate, and L1
keeps most weights at exactly 0, so that the model is a short list of (feature, weight) that is
broadcast. Labels are learnt from a bounded sample of labelled rows (at most `max_rows`, taken by
hash of the id, whole texts of at most `max_bytes` of features in all) in one task, so that the driver
gets the weights only; every text is scored whole. The learner's parameters were chosen by folds
within the rows that may be learnt from (`by_folds()`); held-out rows had no part in it.

Defined results: null and empty texts get the bias's score; without usable labels the bias is the
prior `log(0.1 / 0.9)` and there are no weights; rows with a null label or null id aren't learnt
from; of several labels for an id the largest counts; equal texts get equal scores; an existing
column named like an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, give_back, held_out, table, texts_udf

BITS = 21
_U = np.uint64


@dataclass(frozen=True)
class FTRL:
    """Parameters of the learner. positive weighs rows of label 1; max_rows and max_bytes (4 for each feature of a text) bound the labelled sample."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 25.0
    l2: float = 1.0
    epochs: int = 6
    positive: float = 8.0
    max_rows: int = 10000
    max_bytes: int = 100_000_000
    seed: int = 7


@dataclass(frozen=True)
class Model:
    bias: float
    features: np.ndarray  # int64, ascending
    weights: np.ndarray  # float32


def features(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each word, pair and skip-gram of a block, repeats included."""
    w = Words(raw, starts)
    shift = _U(64 - BITS)
    n = len(w.hash)
    docs, ids = [w.doc], [(w.hash >> shift).astype(np.int64)]
    for gap, salt in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        if n > gap:
            at = np.flatnonzero(w.doc[:-gap] == w.doc[gap:])
            with np.errstate(over="ignore"):
                h = (w.hash[at] ^ _U(salt)) * _U(0x9FB21C651E98DF25) + w.hash[at + gap]
                h ^= h >> _U(31)
                h *= _U(salt | 1)
            docs.append(w.doc[at])
            ids.append((h >> shift).astype(np.int64))
    return np.concatenate(docs), np.concatenate(ids)


def distinct(docs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((docs.astype(np.int64) << BITS) | ids)
    return both >> BITS, both & ((1 << BITS) - 1)


def _feature_lists(raw: np.ndarray, starts: np.ndarray) -> dict:
    docs, ids = distinct(*features(raw, starts))
    cuts = np.searchsorted(docs, np.arange(len(starts)))
    ids = ids.astype(np.int32)
    return {"ids": [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]}


def fit(rows: list[tuple[np.ndarray, int]], p: FTRL = FTRL()) -> Model:
    """Learns from (distinct features, label) in the order given, shuffled by the seed in each epoch."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    order = np.random.default_rng(p.seed)
    if not rows:
        return Model(float(np.log(0.1 / 0.9)), np.zeros(0, np.int64), np.zeros(0, np.float32))
    share = min(max(sum(y for _, y in rows) / len(rows), 0.01), 0.99)
    prior = np.log(share / (1 - share))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            ids, y = rows[k]
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            b = prior - zb / ((p.beta + np.sqrt(nb)) / p.alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            g *= p.positive if y else 1.0
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha
            z[ids] = zi + g - sigma * w
            n[ids] = ni + g * g
            sb = (np.sqrt(nb + g * g) - np.sqrt(nb)) / p.alpha
            zb += g - sb * (b - prior)
            nb += g * g
    at = np.flatnonzero(np.abs(z) > p.l1)
    w = weights(z[at], n[at]).astype(np.float32)
    return Model(float(prior - zb / ((p.beta + np.sqrt(nb)) / p.alpha)), at[w != 0], w[w != 0])


def sample(documents: DataFrame, labels: DataFrame, label: str, p: FTRL) -> DataFrame:
    """(_at, doc_id, _y, ids) of at most p.max_rows labelled documents outside the held-out fifth: ids are the distinct features as int32."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).alias("_y"))
        .withColumn("_at", F.xxhash64("doc_id"))
        .orderBy("_at", "doc_id").limit(p.max_rows)
    )
    lists = texts_udf(_feature_lists, "ids binary")
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows rows at most
    return found.select("_at", "doc_id", F.col("_y").cast("int").alias("_y"), lists("text").ids.alias("ids"))


def bounded(rows: Iterable[tuple[bytes, int]], most: int) -> list[tuple[np.ndarray, int]]:
    """Features and labels of the rows in order, once each, while their features have at most so many bytes in all."""
    seen, kept = set(), []
    for ids, y in rows:
        if (ids, y) not in seen:  # copies of a text would outweigh the rest
            most -= len(ids)
            if most < 0:
                break
            seen.add((ids, y))
            kept.append((np.frombuffer(ids, np.int32), int(y > 0)))
    return kept


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", p: FTRL = FTRL()) -> Model:
    """Fits on the bounded sample, in one task; the driver gets the weights that aren't 0."""

    def learnt(batches):
        rows = ((ids, y) for b in batches for ids, y in zip(b.column("ids").to_pylist(), b.column("_y").to_pylist(), strict=True))
        model = fit(bounded(rows, p.max_bytes), p)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([-1, *model.features], pa.int64()), pa.array([model.bias, *model.weights], pa.float64())], ["feature", "weight"])

    ordered = sample(documents, labels, label, p).repartition(1).sortWithinPartitions("_at", "doc_id", "ids")
    got = sorted((r.feature, r.weight) for r in ordered.select("ids", "_y").mapInArrow(learnt, "feature long, weight double").collect())
    bias, weights = (got[0][1], got[1:]) if got else (fit([], p).bias, [])
    return Model(bias, np.array([f for f, _ in weights], np.int64), np.array([w for _, w in weights], np.float32))


def margin(model: Model, ids: np.ndarray) -> float:
    """The score, before the logistic function, of a text with these distinct features."""
    at = np.searchsorted(model.features, ids)
    hit = at < len(model.features)
    hit[hit] = model.features[at[hit]] == ids[hit]
    return float(model.weights[at[hit]].sum() + model.bias)


def by_folds(rows: list[tuple[np.ndarray, int]], choices: list[FTRL], folds: int = 3) -> list[tuple[float, float, FTRL]]:
    """(recall, false-positive rate, parameters) of each choice over folds of rows that may be learnt from."""
    out = []
    for p in choices:
        hits = [0, 0]
        for k in range(folds):
            model = fit([r for i, r in enumerate(rows) if i % folds != k], p)
            for ids, y in rows[k::folds]:
                hits[y] += margin(model, ids) >= 0
        positive = sum(y for _, y in rows)
        out.append((hits[1] / max(positive, 1), hits[0] / max(len(rows) - positive, 1), p))
    return out


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds `score` (0 to 1) to every row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(raw: np.ndarray, starts: np.ndarray) -> dict:
        m = sent.value
        if run.table is None:
            run.table = np.zeros(1 << BITS, np.float32)
            run.table[m.features] = m.weights
        docs, ids = features(raw, starts)
        hit = np.flatnonzero(run.table[ids])
        docs, ids = distinct(docs[hit], ids[hit])
        total = np.bincount(docs, run.table[ids], len(starts) - 1) + m.bias
        return {"score": 1 / (1 + np.exp(-np.clip(total, -35, 35)))}

    run.table = None
    return documents.withColumn("score", texts_udf(run, "score double")(F.col(text)).score)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
