"""The three learners: held-out accuracy, and defined results."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import quality_gam as G
from vellum.llm import quality_rules as R
from vellum.llm import toxicity as T
from vellum.llm.common import Words, held_out, text_bytes


def test_words_hash_by_their_bytes():
    texts = ["One two\x0bTWO", "", None, "two one", "é É", "end"]
    w = Words(*text_bytes(pa.array(texts)))
    assert w.count.tolist() == [3, 0, 0, 2, 2, 1]
    assert w.hash[1] == w.hash[2] == w.hash[3] and w.hash[0] == w.hash[4] and w.hash[5] != w.hash[6]
    assert len(w.grams(2)[0]) == 2 + 1 + 1


def test_grams_do_not_cross_texts():
    a, b = Words(*text_bytes(pa.array(["a b", "c d"]))), Words(*text_bytes(pa.array(["a b", "c d"]).slice(1)))
    assert a.grams(2)[0][1] == b.grams(2)[0][0]


def test_held_out_is_crc32_of_the_decimal_id(spark):
    got = {r.doc_id: r.h for r in spark.range(60).select(held_out("id").alias("h"), "id").withColumnRenamed("id", "doc_id").collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(60)}


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.1"
    try:
        return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    except Exception:
        pytest.skip("no test tables here")


def held(scored, labels, label):
    rows = scored.join(labels, "doc_id").where(held_out()).select("score", label).collect()
    return np.array([r.score for r in rows]), np.array([r[label] for r in rows])


def test_toxicity_on_held_out_rows(tables):
    documents, labels = tables
    model = T.train(documents, labels)
    s, y = held(T.score(documents, model), labels, "toxic")
    assert (s[y == 1][:, None] > s[y == 0][None]).mean() > 0.97
    assert (s[y == 1] >= 0.5).mean() > 0.7 and (s[y == 0] >= 0.5).mean() < 0.01
    assert len(model.features) < 20_000


def test_quality_on_held_out_rows(tables):
    documents, labels = tables
    s, y = held(G.score(documents, G.train(documents, labels)), labels, "quality")
    assert ((s >= 0.3) == y).mean() > 0.97


def test_rules_on_held_out_rows(tables):
    documents, labels = tables
    rules = R.learn(documents, labels)
    assert rules
    rows = R.judge(documents, rules).where(held_out() & ~R.F.col("base_failed")).join(labels, "doc_id").select("kept", "quality").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.97


def brute_measures(t):
    import re
    from collections import Counter

    w = re.findall("[^\x20\x09-\x0d]+", t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(t.count(k) for k in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = ["a b c a b c a b c", "a a a a a", "x\n\nx\n \nx", "\x0b#|é é", "a b c d", "", " ", None, "a b a b a b c a b"]
    df = df.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], df.schema))
    for r in R.measures(df).collect():
        want = brute_measures(r.text or "")
        assert want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = G.fit(x, y, G.Boosting(pairs=1))
    assert m.pairs[0][:2] in ((1, 0), (0, 1))
    assert ((G.predict(m, x) > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("module", [T, G])
def test_scorers_on_awkward_rows(module, awkward, nothing, labels, no_labels):
    for ls in (labels, no_labels):
        model = module.train(awkward, ls)
        got = [r for r in module.score(awkward, model).collect()]
        assert len(got) == 22 and all(0 <= r.score <= 1 for r in got)
        scores = {r.doc_id: r.score for r in got if r.doc_id is not None}
        assert scores[3] == scores[4]
        assert got[0].kept == "clash"
    assert module.score(nothing, module.train(nothing, labels)).count() == 0


def test_rules_on_awkward_rows(awkward, nothing, labels, no_labels):
    for ls in (labels, no_labels):
        got = R.judge(awkward, R.learn(awkward, ls)).collect()
        assert len(got) == 22 and all(r.base_failed and not r.kept for r in got if not (r.text or "").strip())
    assert R.judge(nothing, R.learn(nothing, labels)).count() == 0


def test_rules_stay_native(awkward, labels):
    plan = R.judge(awkward.select("doc_id", "text"), R.learn(awkward, labels))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_sample_is_written_before_it_is_measured(awkward, labels, monkeypatch):
    """Training measures the sampled rows only."""
    seen = []
    whole = R.measures
    monkeypatch.setattr(R, "measures", lambda df, text="text": seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df, text))
    R.learn(awkward, labels)
    assert len(seen) == 1 and "Join" not in seen[0]


def test_measures_named_like_input_columns(awkward, labels):
    got = R.judge(awkward.withColumn("m_words", R.F.lit("mine")), R.learn(awkward, labels)).collect()
    assert {r.m_words for r in got} == {"mine"}


TEXTS = ["", "One two TWO one two", "a b a b a b c. | #x 12é\n\na b\nc d\na b\n", "extraordinarily long incomprehensibilities é中 {x}", " \n\t", "x", "same same same same"]


def brute_features(text):
    """quality_gam.FEATURES in plain Python."""
    import math
    import re
    from collections import Counter

    raw = text.encode()
    fold = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    words = [fold(w) for w in re.findall(rb"[^\x20\x09-\x0d]+", raw)]
    lines = [tuple(fold(w) for w in re.findall(rb"[^\x20\x09-\x0d]+", x)) for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    n, chars = max(len(words), 1), max(sum(map(len, words)), 1)
    again = lambda xs: len(xs) - len(set(xs))
    count = lambda test: sum(map(test, raw))
    return [
        math.log1p(len(words)), chars / n, sum(len(w) >= 13 for w in words) / n, count(lambda c: c in b"#*$%&<>^~@{}[]\\") / n,
        count(lambda c: 48 <= c <= 57) / chars, count(lambda c: 65 <= c <= 90) / chars, count(lambda c: c >= 128) / chars, raw.count(b".") / n, raw.count(b"|") / n,
        (raw.count(b"\n") + 1) / n, again(lines) / max(len(lines), 1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - again(words) / n, again(list(zip(words, words[1:], words[2:], strict=False))) / n,
    ]


def test_quality_features_equal_brute_force(spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    got = G.features(*text_bytes(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, brute_features(t), atol=1e-12), t[:50]


def test_additive_scores_are_sums_of_looked_up_bins():
    rng = np.random.default_rng(4)
    x = rng.random((500, 4))
    m = G.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), G.Boosting(rounds=20, pair_rounds=10))
    for row, p in zip(x[:50], G.predict(m, x[:50]), strict=True):
        bins = [sum(c <= v for c in cuts) for cuts, v in zip(m.cuts, row, strict=True)]
        total = m.intercept + sum(t[b] for t, b in zip(m.tables, bins, strict=True)) + sum(t[a[bins[i]]][b[bins[j]]] for i, j, a, b, t in m.pairs)
        assert abs(1 / (1 + np.exp(-total)) - p) < 1e-12


def test_toxicity_features_are_words_pairs_and_skip_grams():
    """Texts share as many features as they share distinct words, neighbours and pairs with one word between."""
    def grams(t):
        w = t.lower().split()
        return {("w", x) for x in w} | {(1, *p) for p in zip(w, w[1:], strict=False)} | {(2, *p) for p in zip(w, w[2:], strict=False)}

    texts = ["a b c d e", "A B x d e", "b a", "", "e d c b a a", "d e"]
    lists = [set(np.frombuffer(x, np.int32).tolist()) for x in T._feature_lists(*text_bytes(pa.array(texts)))["ids"]]
    for i, s in enumerate(texts):
        for j, t in enumerate(texts):
            assert len(lists[i] & lists[j]) == len(grams(s) & grams(t)), (i, j)


def test_ftrl_equals_plain_steps():
    """fit() against one coordinate at a time, in plain Python."""
    import math

    rng = np.random.default_rng(8)
    rows = [(np.array(sorted(rng.choice(30, 6, replace=False)), np.int32), int(rng.random() < 0.4)) for _ in range(40)]
    p = T.FTRL(l1=0.5, epochs=3)
    z, n, zb, nb = [0.0] * 30, [0.0] * 30, 0.0, 0.0
    prior = math.log(sum(y for _, y in rows) / sum(1 - y for _, y in rows))
    weight = lambda i: 0.0 if abs(z[i]) <= p.l1 else -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)
    bias = lambda: prior - zb / ((p.beta + math.sqrt(nb)) / p.alpha)
    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            ids, y = rows[k]
            w = {i: weight(i) for i in ids}
            g = (1 / (1 + math.exp(-(sum(w.values()) + bias()))) - y) * (p.positive if y else 1)
            for i in ids:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i] += g - s * w[i]
                n[i] += g * g
            s = (math.sqrt(nb + g * g) - math.sqrt(nb)) / p.alpha
            zb += g - s * (bias() - prior)
            nb += g * g
    m = T.fit(rows, p)
    assert abs(m.bias - bias()) < 1e-9
    want = {i: weight(i) for i in range(30) if weight(i)}
    assert m.features.tolist() == sorted(want) and np.allclose(m.weights, [want[i] for i in sorted(want)], atol=1e-5)


def test_sample_is_bounded_in_bytes(awkward, labels):
    rows = [(bytes(4 * k), k % 2) for k in (5, 5, 10, 20, 40)]
    assert [len(x) for x, _ in T.bounded(rows, 150)] == [5, 10, 20]
    T.train(awkward, labels, p=T.FTRL(max_bytes=10))


def test_covering_finds_the_planted_rules(spark):
    """Rows that two planted conjunctions reject, and no others, are rejected."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        words = int(rng.integers(60, 200))
        symbols = int(rng.integers(0, words))
        rows.append((i, " ".join([f"w{rng.integers(1e9)}"] * 0 + [f"w{k}x{i}" for k in range(words - symbols)] + ["#"] * 0 + [f"#{k}y{i}" for k in range(symbols)]), symbols / words))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    bad = lambda share: share > 0.6 or share < 0.1
    labels = spark.createDataFrame([(i, int(not bad(s)), 0) for i, _, s in rows], "doc_id long, quality int, toxic int")
    rules = R.learn(docs, labels)
    assert len(rules) >= 2
    kept = {r.doc_id: r.kept for r in R.judge(docs, rules).collect()}
    assert np.mean([kept[i] == (not bad(s)) for i, _, s in rows]) > 0.93
