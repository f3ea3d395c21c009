from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from vellum.llm import mixing as X
from vellum.llm import url_filters as U


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 100, ("b", "z", "4"): 1000}
    got = X.budgets(leaves, X.Mix(share=200 / 1210, max_epochs=1))
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("a", "y", "3"): 50, ("b", "z", "4"): 100}


def test_full_subtree_overflows_to_its_siblings():
    got = X.budgets({("a", "x", "1"): 10, ("b", "y", "2"): 1000}, X.Mix(share=400 / 1010, max_epochs=2))
    assert got == {("a", "x", "1"): 20, ("b", "y", "2"): 380}


def test_no_weight_takes_nothing():
    assert X.poured(10.0, [("a", 0.0, 5.0), ("b", 1.0, 4.0)]) == {"a": 0.0, "b": 4.0}


@pytest.mark.parametrize("leaf_range", [1, 3, 1000])
def test_select_equals_brute_force(spark, sf, monkeypatch, leaf_range):
    monkeypatch.setattr(X, "RANGE", leaf_range)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(tuple(r) for r in X.op8_mixing(spark, sf).collect()) == sorted(con.execute(X.ORACLE_SQL).fetchall())


@pytest.mark.parametrize("mix", [X.Mix(), X.Mix(share=1.1, weights={"a": 3.0, "x": 0.0, ("b", "z"): 5.0, ("b", "z", "7"): 0.5}), X.Mix(share=0.3, max_epochs=1, weights={"3": 9.0})])
def test_budgets_by_window_sums_equal_the_drivers(spark, mix):
    leaves = {(d, m, str(s)): (37 * s * (len(m) + ord(d)) ** 2) % 991 * (s != 4) for d in "ab" for m in ("x", "y", "z", 'q"') for s in range(12)}
    df = spark.createDataFrame([(*p, n) for p, n in leaves.items()], "d string, l string, s string, tokens long")
    got = {(r.d, r.l, r.s): r.budget for r in X.budgeted(df, mix, ["d", "l", "s"]).collect()}
    want = X.budgets(leaves, mix)
    assert got == want and any(want.values())


def test_more_leaves_than_are_broadcast(spark, sf, awkward, monkeypatch):
    want = sorted(tuple(r) for r in X.op8_mixing(spark, sf).collect())
    monkeypatch.setattr(X, "MOST_LEAVES", 3)
    assert sorted(tuple(r) for r in X.op8_mixing(spark, sf).collect()) == want
    assert X.select(awkward, X.Mix(share=1.0, max_epochs=1)).count() == 22


def test_mixing_awkward_rows(awkward, nothing):
    got = X.select(awkward, X.Mix(share=1.0, max_epochs=1)).collect()
    assert len(got) == 22 and got[0].score == 9.0 and {r.epoch for r in got} == {0}
    twice = X.select(awkward, X.Mix(share=2.0, max_epochs=2)).collect()
    assert len(twice) >= 40
    assert X.select(nothing, X.TARGET).count() == 0


RULE_CASES = [
    ("http://com/", "com/", "allow"), ("http://x.com", None, "allow"), ("https://a.example.com/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/1", "www.example.com/en/", "allow"), ("https://v.www.example.com/en/", "www.example.com/en/", "allow"),
    ("http://EXAMPLE.com/en/", "example.com/en/", "block"), ("http://notexample.com/en/", "com/", "allow"), ("ftp://a.net/es/?q", "net/es/", "block"),
    ("http://a.net/fr", None, "allow"), ("http://a.net?x=/es/", None, "allow"), ("no url", None, "allow"), (None, None, "allow"), ("x://h#/p", None, "allow"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(RULE_CASES)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.host, r.path) for r in U.judge(df, []).collect()}
    assert {i: v[:2] for i, v in got.items()} == {i: (r, v) for i, (_, r, v) in enumerate(RULE_CASES)}
    assert got[10][2:] == ("", "") and got[9][2:] == ("a.net", "") and got[7][2:] == ("a.net", "/es/")


def test_mined_rules_block(spark):
    rows = [(i, f"http://{'m.' if i % 3 else ''}{'big-win' if i % 2 else 'good-site'}.example.org/{'en' if i % 5 else 'de'}/{i}", i % 2 == 1) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean").withColumn("host", U.host_of()).withColumn("path", U.path_of()).withColumn("tokens", U.tokens_of())
    mined = U.mine(df)
    assert ["host:big-win"] in mined and not any("host:good-site" in r for r in mined)
    assert {(r.page_id % 2, r.verdict) for r in U.judge(df.select("page_id", "url"), mined).collect()} == {(0, "allow"), (1, "block")}


def test_pairs_of_tokens_are_matched(spark):
    rows = [(i, f"http://{'a' if i % 2 else 'b'}.example.org/{'x' if i // 2 % 2 else 'y'}/", i % 2 == 1 and i // 2 % 2 == 1) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean").withColumn("host", U.host_of()).withColumn("path", U.path_of()).withColumn("tokens", U.tokens_of())
    assert {frozenset(r) for r in U.mine(df)} == {frozenset({"host:a", "path:x"})}
    got = U.judge(df.select("page_id", "url"), U.mine(df)).collect()
    assert all((r.verdict == "block") == (r.page_id % 4 == 3) for r in got)


def test_urls_equal_sql(spark, sf):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert sorted(map(str, (tuple(r) for r in U.op9_url_filters(spark, sf).collect()))) == sorted(map(str, con.execute(U.ORACLE_SQL).fetchall()))


def test_urls_of_awkward_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, rule int")
    labels = spark.createDataFrame([(1, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    assert U.mine(U.labelled_urls(empty, labels)) == [] and U.judge(empty, []).count() == 0
    odd = spark.createDataFrame([(1, "http://a/1", 3), (1, "http://a/1", 3), (None, None, None), (2, "http://" + "x" * 100_000, 0), (3, "http://a/99999999999999999999", 1)], empty.schema)
    assert [r.verdict for r in U.judge(odd, U.mine(U.labelled_urls(odd, labels))).collect()].count("allow") >= 3


def test_urls_stay_native(spark):
    plan = U.judge(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), [["host:a"]])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def rule_families(spark, path):
    """Tables of 40 families of six shared tokens, nine of ten bad in every fourth, with labels: more than 1,000 passing combinations."""
    rows, labels = [], []
    for f in range(40):
        for i in range(20):
            n = 100 * f + i
            rows.append((n, f"http://h{f}a.h{f}b.h{f}c.org/{'x' * (f + 1)}/{'y' * (f + 1)}/{'z' * (f + 1)}/{n}"))
            labels.append((n, int(f % 4 == 0 and i % 10 == 0), 0))
    for n in range(4000, 4800):
        rows.append((n, f"http://fine.org/{n}"))
        labels.append((n, 1, 0))
    rows += [(9000, "http://h0a.org/9000"), (9001, "http://h39a.net/es/1"), (9002, None), (9003, "http://h39a.org/x"), (9003, "http://h39a.org/x")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_many_rules_equal_sql(spark, tmp_path):
    d = rule_families(spark, tmp_path)
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    want = sorted(map(str, con.execute(U.ORACLE_SQL).fetchall()))
    assert sorted(map(str, (tuple(r) for r in U.op9_url_filters(spark, d).collect()))) == want
    pages = spark.read.parquet(f"{d}/pages.parquet")
    learnt = U.labelled_urls(pages, spark.read.parquet(f"{d}/labels.parquet"))
    listed, joined = U.mine(learnt), U.mine(learnt, U.Mining(most_rules=5))
    assert len(listed) == 240 and sorted(r.tokens for r in joined.collect()) == listed
    got = U.judge(pages, joined).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == want


def test_tokens_that_come_together_are_one_item(spark):
    together = [f"t{k:02d}" for k in range(25)]  # 33 million itemsets, if each were an item
    rows = [([*together, f"n{i}"], True) for i in range(30)] + [(["fine", f"m{i}"], False) for i in range(30)]
    mined = U.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    assert mined == [[t] for t in together]


def test_rules_of_alike_tokens_are_expanded(spark):
    rows = [(["a1", "a2", *(["x1", "x2"] if i % 2 else ["y"])], bool(i % 2)) for i in range(60)] + [(["x1", "x2"], False) for _ in range(60)]
    mined = U.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    assert {frozenset(r) for r in mined} == {frozenset({a, x}) for a in ("a1", "a2") for x in ("x1", "x2")}


def test_mined_rules_fire_as_in_sql(spark, sf):
    sf = str(Path(sf).parent / "sf0.01")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    got = sorted(map(str, (tuple(r) for r in U.mined_url_rules(spark, sf).collect())))
    assert got == sorted(map(str, con.execute(U.TELLING_SQL).fetchall()))
    assert sum("block" in r and "None" in r for r in got) > 0


def test_columns_with_clashing_names_stay(spark):
    docs = spark.createDataFrame([(i, "one two three", "en", f"src{i % 3}", i, -i, "k", 7) for i in range(40)], "doc_id long, text string, lang string, source string, last long, ranges long, _key string, epoch int")
    got = X.select(docs, X.Mix(share=0.5)).collect()
    assert got and all((r["last"], r.ranges, r["_key"]) == (r.doc_id, -r.doc_id, "k") and r.epoch == 0 for r in got)
    assert X.select(docs, X.Mix(share=0.5), F.lit(10)).agg(F.sum("n_tokens")).first()[0] <= 200
