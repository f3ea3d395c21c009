import random
import re
from collections import Counter, defaultdict
from math import comb

from vellum.llm import near_dedup as N

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(rows):
    """(n, component) by doc_id, from all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    posts = defaultdict(list)
    for i in sorted(sets):
        for j, k in Counter(j for s in sets[i] for j in posts[s]).items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            posts[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(df, rows):
    want = brute(rows)
    for r in N.near_duplicates(df).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_miss_chance_is_negligible():
    assert sum(comb(N.K, k) * 0.8**k * 0.2 ** (N.K - k) for k in range(N.T)) < 1e-7


def test_whole_table_equals_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    check(df, [(r.doc_id, r.text) for r in df.collect()])


def test_edit_families_and_shared_passages(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for f in range(12):
        base = [word() for _ in range(rng.choice([5, 12, 60, 150]))]
        for _ in range(rng.choice([1, 4, 90])):
            edited = [word() if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append((len(rows), " ".join(edited) + (" " + passage if f % 3 == 0 else "")))
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_long_lists_go_through_the_bounds(spark, monkeypatch):
    monkeypatch.setattr(N, "SHORT", 6)
    monkeypatch.setattr(N, "SPLIT", 5)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(f"e{rng.random()}" if rng.random() < rng.choice([0, 0.02, 0.05, 0.08]) else w for w in base)) for i in range(120)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_components_of_a_chain(spark):
    splits = lambda i: 1 + i % 3
    pairs = [(i, i + 1) for i in range(40)] + [(101, 100), (7, 7), (7, 8)]
    edges = spark.createDataFrame([(a, b, splits(a), splits(b)) for a, b in pairs], "p long, q long, p_splits int, q_splits int")
    got = {r.node: r.label for r in N.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_pages_of_one_template_rarely_meet(spark, monkeypatch):
    """Fields from common values between a template's words: all pages share lists and every shingle is frequent, yet few pairs are compared."""
    monkeypatch.setattr(N, "SPLIT", 40)
    rng = random.Random(21)
    template = [f"t{i}" for i in range(230)]
    rows = []
    for i in range(600):
        words = list(template)
        for at in range(10, 220, 21):  # ten fields, 40 of some 230 shingles, each value held by about ten pages
            words[at] = f"v{at}x{rng.randrange(60)}"
        rows.append((i, " ".join(words)))
    compared = []
    links = N.links

    def counted(pairs, sets):
        compared.append(pairs.count())
        return links(pairs, sets)

    monkeypatch.setattr(N, "links", counted)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert sum(compared) < 600 * 599 / 2 / 5, compared


def test_ids_of_candidates_stay_off_the_driver(spark, monkeypatch):
    """What is broadcast has a row for 32,768 bits of the digest, not one for each candidate; a digest that is full loses nothing."""
    sent = []
    monkeypatch.setattr(N, "broadcast", lambda df, f=N.broadcast: sent.append(df.count()) or f(df))
    monkeypatch.setattr(N, "MOST_BITS", 1 << 16, raising=False)
    rng = random.Random(5)
    rows = [(i, f"a{i % 700} b{i % 700} " + " ".join(f"w{(i % 700) * 31 + k}" for k in range(40)) + (f" e{rng.random()}" if i % 3 else "")) for i in range(1400)]
    rows += [(5000 + i, " ".join(f"l{i}x{k}" for k in range(9))) for i in range(300)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert all(n <= 2 for n in sent), sent


def test_awkward_rows(awkward, nothing):
    got = [r for r in N.near_duplicates(awkward).collect()]
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == 22
    assert by[1].component_id == 0 and not by[1].kept and by[7].component_id == 6
    assert by[3].n_shingles == 0 and by[4].n_shingles == 0 and by[5].kept and by[9].component_id == 8
    assert [r.kept for r in got if r.doc_id == 12] == [True, True]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert N.near_duplicates(nothing).count() == 0
