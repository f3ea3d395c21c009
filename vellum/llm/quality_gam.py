"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is binned at quantiles of the training rows. Cyclic boosting goes round the features;
each step fits a tree of depth two to the feature's gradient histogram and adds it, shrunk, to the
feature's lookup table. Pairs are ranked by what a cut in each of two features gains on the
residuals, and the best ones get tables of two dimensions in the same way. A score is the sum of
the intercept and one looked-up bin for each feature and pair, taken through the logistic function.

Labels are learnt from a bounded sample of labelled rows (`max_rows`, taken by hash of the id);
every text is scored whole.

Defined results: null and empty texts have all features 0 and a score like any other; without usable
labels the score is the prior 0.5; rows with a null label or id aren't learnt from; of several labels
for an id the largest counts; equal texts get equal scores; extra columns stay and an existing
`score` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from .common import Words, held_out, table, texts_udf

FEATURES = (
    "words", "word_length", "long_words", "symbols", "digits", "capitals", "beyond_ascii", "full_stops", "pipes",
    "lines_per_word", "repeated_lines", "echoes", "distinct", "repeated_triples",
)
_U = np.uint64


@dataclass(frozen=True)
class Boosting:
    """Parameters of the learner. max_rows bounds the labelled sample."""

    bins: int = 32
    rounds: int = 150
    pair_rounds: int = 60
    pairs: int = 6
    coarse: int = 8
    rate: float = 0.15
    l2: float = 5.0
    max_rows: int = 12000


@dataclass(frozen=True)
class Model:
    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # features, coarse bin of each bin, table


def features(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a block."""
    n = len(starts) - 1
    w = Words(raw, starts)
    words = w.count.astype(float)
    per_word = np.maximum(words, 1)

    def marked(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[starts]).astype(float)

    def summed(doc: np.ndarray, value=None) -> np.ndarray:
        return np.bincount(doc, value, n).astype(float) if len(doc) else np.zeros(n)

    size = w.end - w.begin
    chars = np.maximum(summed(w.doc, size), 1)
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&<>^~@{}[]\\")] = True

    def repeats(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        """How many of each text's hashes equal an earlier one."""
        if not len(h):
            return np.zeros(n)
        order = np.lexsort((h, doc))
        d, x = doc[order], h[order]
        return summed(d[1:][(d[1:] == d[:-1]) & (x[1:] == x[:-1])])

    # a line's hash: its words' hashes, combined in order
    new_line = marked(raw == 10)
    line = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 10, out=line[1:])
    key = line[w.begin] + w.doc  # differs between lines and between texts
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    place = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
    with np.errstate(over="ignore"):
        lines = np.add.reduceat(w.hash * (_U(2) * place.astype(_U) + _U(1)) * _U(0x9FB21C651E98DF25), at) if len(at) else np.zeros(0, _U)
    line_doc = w.doc[at] if len(at) else np.zeros(0, np.int64)
    triples, first = w.grams(3)
    echo = w.doc[1:][(w.doc[1:] == w.doc[:-1]) & (w.hash[1:] == w.hash[:-1])] if len(w.hash) > 1 else np.zeros(0, np.int64)
    return np.column_stack([
        np.log1p(words), chars / per_word, summed(w.doc[size >= 13]) / per_word, marked(symbol[raw]) / per_word,
        marked((raw >= 48) & (raw <= 57)) / chars, marked((raw >= 65) & (raw <= 90)) / chars, marked(raw >= 128) / chars,
        marked(raw == 46) / per_word, marked(raw == 124) / per_word, (new_line + 1) / per_word,
        repeats(line_doc, lines) / np.maximum(summed(line_doc), 1), summed(echo) / per_word,
        1 - repeats(w.doc, w.hash) / per_word, repeats(w.doc[first], triples) / per_word,
    ])


def _tree(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Values by bin of a tree of depth two on a histogram of gradients and hessians."""
    gs, hs = np.cumsum(g), np.cumsum(h)

    def cut(a: int, b: int) -> int | None:
        """The best first bin of the right part of bins a..b-1."""
        if b - a < 2:
            return None
        g0, h0 = (gs[a - 1], hs[a - 1]) if a else (0.0, 0.0)
        gl, hl = gs[a : b - 1] - g0, hs[a : b - 1] - h0
        gr, hr = gs[b - 1] - g0 - gl, hs[b - 1] - h0 - hl
        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2)
        k = int(np.argmax(gain))
        whole = gs[b - 1] - g0
        return a + k + 1 if gain[k] > whole**2 / (hs[b - 1] - h0 + l2) + 1e-9 else None

    edges = [0, len(g)]
    for _ in range(2):
        edges = sorted({*edges, *(c for a, b in zip(edges[:-1], edges[1:], strict=True) if (c := cut(a, b)))})
    out = np.empty(len(g))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Gain and values by cell of the best one cut in each of two features."""
    gc, hc = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)

    def four(c):
        ll, lr = c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1]
        rl = c[-1:, :-1] - c[:-1, :-1]
        return ll, lr, rl, c[-1, -1] - ll - lr - rl

    parts = list(zip(four(gc), four(hc), strict=True))
    gain = sum(a**2 / (b + l2) for a, b in parts)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(g.shape)
    for (rows, cols), (a, b) in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), parts, strict=True):
        out[rows, cols] = -a[i, j] / (b[i, j] + l2)
    return float(gain[i, j] - gc[-1, -1] ** 2 / (hc[-1, -1] + l2)), out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, p: Boosting = Boosting()) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, p.bins + 1)[1:-1])) for c in x.T]
    bins = [np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    intercept = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), intercept)
    for _ in range(p.rounds):
        for b, t in zip(bins, tables, strict=True):
            q = _sigmoid(total)
            step = p.rate * _tree(np.bincount(b, q - y, len(t)), np.bincount(b, q * (1 - q), len(t)), p.l2)
            t += step
            total += step[b]
    coarse = [np.arange(len(t)) * min(p.coarse, len(t)) // len(t) for t in tables]
    cells = [c[b] for c, b in zip(coarse, bins, strict=True)]
    sizes = [int(c[-1]) + 1 for c in coarse]
    q = _sigmoid(total)

    def histogram(i: int, j: int, value: np.ndarray) -> np.ndarray:
        return np.bincount(cells[i] * sizes[j] + cells[j], value, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    ranked = sorted(
        ((_quadrants(histogram(i, j, q - y), histogram(i, j, q * (1 - q)), p.l2)[0], i, j) for i in range(len(sizes)) for j in range(i) if sizes[i] > 1 and sizes[j] > 1),
        key=lambda r: (-r[0], r[1:]),
    )
    pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in ranked[: p.pairs]]
    for _ in range(p.pair_rounds):
        for i, j, t in pairs:
            q = _sigmoid(total)
            step = p.rate * _quadrants(histogram(i, j, q - y), histogram(i, j, q * (1 - q)), p.l2)[1]
            t += step
            total += step[cells[i], cells[j]]
    return Model(intercept, cuts, tables, [(i, j, coarse[i], coarse[j], t) for i, j, t in pairs])


def predict(model: Model, x: np.ndarray) -> np.ndarray:
    """Scores by adding up bins."""
    total = np.full(len(x), model.intercept)
    if model.cuts:
        bins = [np.searchsorted(c, v, "right") for c, v in zip(model.cuts, x.T, strict=True)]
        for b, t in zip(bins, model.tables, strict=True):
            total += t[b]
        for i, j, a, b, t in model.pairs:
            total += t[a[bins[i]], b[bins[j]]]
    return _sigmoid(total)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", p: Boosting = Boosting()) -> Model:
    """Fits on at most p.max_rows labelled documents outside the held-out fifth."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows)
    )
    got = texts_udf(lambda raw, starts: {"x": list(features(raw, starts))}, "x array<double>")
    rows = documents.select("doc_id", "text").join(broadcast(chosen), "doc_id").select("doc_id", "_y", got("text").x.alias("x")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    return fit(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([float(r._y > 0) for r in rows]), p)


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds `score` (0 to 1) to every row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    run = texts_udf(lambda raw, starts: {"score": predict(sent.value, features(raw, starts))}, "score double")
    return documents.withColumn("score", run(F.col(text)).score)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.3) of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
