import re

import corpus_pipeline as P
from vellum.llm import mixing, near_dedup, secrets_scan, sentencepiece_table, toxicity


def test_stages_follow_each_other(spark, sf):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("score < 0.5").collect()}
    docs = docs.where(docs.doc_id.isin(*kept))
    stay = {r.doc_id for r in near_dedup.near_duplicates(docs).where("kept").collect()}
    docs = secrets_scan.redact(docs.where(docs.doc_id.isin(*stay)))
    taken = mixing.select(docs, mixing.TARGET).collect()
    model = sentencepiece_table.chunk_table(sentencepiece_table.default_model()).model
    want = sorted((r.doc_id, len(model.encode(r.text, add_eos=True))) for r in taken)
    got = P.run(spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want
    assert all(r.n_chars == len(r.text) and not re.search("[0-9a-f]{24}", r.text) for r in got)


def test_stages_keep_the_columns(spark, awkward, sf):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns
        got.collect()
    assert {"n_tokens", "ids_sha256"} <= set(P.STAGES[-1][1](spark, docs, sf).columns)


def test_pairs_are_written_before_links_are_confirmed(spark, monkeypatch):
    """links() reads its pairs twice; both passes hand it a table, so no plan on the driver holds the steps before."""
    handed = []
    links = near_dedup.links
    monkeypatch.setattr(near_dedup, "links", lambda pairs, sets: handed.append(hasattr(pairs, "_written_at")) or links(pairs, sets))
    words = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, words + f" e{i}" * (i % 3), "en", "src0", 1) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in P._near_dedup(spark, docs, "").collect()] == [0]
    assert handed == [True, True]


def test_exploded_rows_are_not_broadcast(spark):
    """A small file can hold many rows: Spark would broadcast them by the file's size."""
    few = spark.range(50).selectExpr("id as doc_id", "1 as splits", "id as label", "id % 5 as pair")
    plan = near_dedup._pairs(few, few, "x.pair = y.pair")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
