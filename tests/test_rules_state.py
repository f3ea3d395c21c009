import datetime as dt

import pytest
from pyspark.sql import functions as F

from vellum.operators import checks, corpus, glossary, jobs, ledger, overview, prompts, rules, state, structure
from vellum.sources import files
from vellum.streaming import state_stream

PAIR = "doc_id long, src string, tgt string"


def kinds(spark, src, tgt, terms=(), names=None):
    df = spark.createDataFrame([(1, src, tgt)], PAIR)
    if names is not None:
        df = df.withColumn("names", F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"))
    return {r.kind for r in rules.findings(df, terms).collect()}


@pytest.mark.parametrize(
    ("src", "tgt", "want"),
    [
        ("It rained 81 days since 1908.", "81 दिवस पाऊस पडला.", {"number_lost"}),
        ("Rivers rise in the north.", "Rivers rise in the north.", {"untranslated", "no_devanagari"}),
        ("The ferry reached Lumina in 1908.", "नाव 1908 मध्ये Lumina ला पोचली.", set()),
        ("It rained 81 days.", "८१ दिवस पाऊस.", {"devanagari_digits"}),
        ("some text", " \n", {"missing_translation"}),
        ("some text", "<i></i>", {"missing_translation"}),
        ("some text", None, {"missing_translation"}),
        (None, "म", set()),
        ("some text", "<i>म", {"unbalanced_tag"}),
        ("5 and 5 went", "म 5", set()),
        ("x went with Aaaa and Bbbb", "म", set()),
        ("x went with Aaaa and Bbbb and Cccc", "म", {"latin_proper_noun_lost"}),
        ("a" * 121, "म" * 54, {"suspiciously_short"}),
        ("a" * 120, "म" * 3, set()),
        ("a" * 121, "म" * 267, {"suspiciously_long"}),
        ("a" * 121, "म" * 266, set()),
    ],
)
def test_findings(spark, src, tgt, want):
    assert kinds(spark, src, tgt) - ({"no_devanagari"} if "म" in (tgt or "") else set()) == want


def test_glossary_and_lexicon(spark):
    term = [("flood plain", "पूर मैदान")]
    assert kinds(spark, "Here the flood plain begins.", "येथे मैदान सुरू होते.", term) == {"glossary_miss"}
    assert kinds(spark, "x went with Aaaa and Bbbb and Cccc", "म", names=["Aaaa"]) == set()
    df = spark.createDataFrame([(1, "a Flood Plain.", "म"), (2, "flood plains", "म")], PAIR)
    g = spark.createDataFrame([(*term[0],), ("", "x"), (None, "y")], "english string, target string")
    assert [(r.doc_id, r.english) for r in rules.glossary_misses(df, g).collect()] == [(1, "flood plain")]
    signs = spark.createDataFrame([("—", "–"), ("the plain", "म"), ("no such", "म")], "english string, target string")
    odd = spark.createDataFrame([(1, "rain — and sun", "म"), (2, "rain — and sun", "म – न"), (3, "of the plain", "न"), (4, "the the the", "न")], PAIR)
    assert {(r.doc_id, r.english) for r in rules.glossary_misses(odd, signs).collect()} == {(1, "—"), (3, "the plain")}


def test_long_glossaries_are_joined(spark, monkeypatch):
    terms = [("flood plain", "पूर मैदान"), ("rain", "पाऊस"), ("—", "–")]
    df = spark.createDataFrame([(1, "a flood plain", "म"), (2, "rain here", "पाऊस"), (3, "x — y", "म"), (4, "Rain", "म")], PAIR)
    inline = sorted(map(tuple, rules.findings(df, terms).collect()))
    monkeypatch.setattr(rules, "INLINE_TERMS", 2)
    assert sorted(map(tuple, rules.findings(df, terms).collect())) == inline
    assert {k for k, _, kind in inline if kind == "glossary_miss"} == {1, 3, 4}


def test_substring_flags(spark):
    term = [("flood plain", "पूर मैदान")]
    df = spark.createDataFrame([(1, "a Flood Plain.", "म"), (2, "flood plains", "म")], PAIR)
    assert {r.doc_id for r in rules.substring_misses(df, term).collect()} == {1, 2}


def test_rollup_has_clean_pages(spark):
    found = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "doc_id long, rule_no int, kind string")
    got = {r.doc_id: (r.n_findings, r.passed, r.kinds) for r in rules.rollup(found, spark.createDataFrame([(1,), (2,)], "doc_id long")).collect()}
    assert got == {1: (2, False, "a,b"), 2: (0, True, "")}


BLOCK = "page_no long, block_index int, id string, text string, draft string, final string, status string, review_notes string"


def test_upsert_keeps_or_resets(spark):
    old = spark.createDataFrame([(1, 0, "a", "t", "d", "f", "final", "n"), (1, 1, "b", "t", "d", None, "drafted", "n"), (2, 0, "z", "t", "d", "f", "final", None)], BLOCK)
    new = spark.createDataFrame([(1, 0, "a", "t2"), (1, 1, "B", "t3"), (3, 0, "c", "t4")], "page_no long, block_index int, id string, text string")
    got = {(r.page_no, r.block_index): tuple(r)[2:] for r in state.upsert_blocks(old, new).collect()}
    assert got == {
        (1, 0): ("a", "t2", "d", "f", "final", "n"), (1, 1): ("B", "t3", None, None, "pending", None),
        (2, 0): ("z", "t", "d", "f", "final", None), (3, 0): ("c", "t4", None, None, "pending", None),
    }


def test_queues(spark):
    b = spark.createDataFrame([(1, 0, "a", "t", "d", None, "drafted", None), (1, 1, "b", "t", "d", "f", "final", None), (2, 0, "c", "t", "", None, "drafted", None), (3, 0, "e", "t", "d", "f", "final", None)], BLOCK)
    assert {r.page_no for r in state.pages_needing(b, "final").collect()} == {1, 2}
    assert {r.page_no for r in state.review_ready(b).collect()} == {1}
    assert {r.page_no for r in state.review_ready(b, force=True).collect()} == {1, 3}
    done = state.set_text(b, spark.createDataFrame([("c", "neu")], "id string, text string"), "final")
    assert {(r.id, r.final, r.status) for r in done.collect()} >= {("c", "neu", "final"), ("a", None, "drafted")}
    assert state.counts(b).first().blocks == 4 and state.target(F.lit(""), F.lit("d")) is not None


def test_latest_attempt_decides(spark):
    qa = spark.createDataFrame([(1, "auto", 1, 0), (1, "auto", 2, 1), (1, "vision", 1, 0), (2, "auto", 1, 1), (2, "auto", 2, 0)], "page_no long, kind string, attempt int, passed int")
    assert {(r.page_no, r.kind, r.attempt) for r in state.latest_failures(qa).collect()} == {(1, "vision", 1), (2, "auto", 2)}


def test_outline_edges(spark):
    marks = spark.createDataFrame([(1, "A", 3), (2, "B", 3), (3, "C", 6), (4, "X", 0)], "idx int, title string, page int")
    pages = spark.createDataFrame([(p,) for p in (1, 3, 5, 6, 9)], "page_no int")
    got = {r.page_no: r.chapter for r in structure.page_chapters(pages, structure.outline_ranges(marks)).collect()}
    assert got == {1: None, 3: "B", 5: "B", 6: "C", 9: "C"}


def test_outlines_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(structure, "PAGES", 7)
    starts = [4, 5, 20, 21, 22, 70]
    marks = spark.createDataFrame([(i, f"T{p}", p) for i, p in enumerate(starts)], "idx int, title string, page int")
    pages = spark.createDataFrame([(p, f"x{p}") for p in [*range(1, 90, 2), 500, 500]], "page_no int, extra string")
    got = [(r.page_no, r.extra, r.chapter) for r in structure.page_chapters(pages, structure.outline_ranges(marks)).collect()]
    title = lambda p: f"T{max(s for s in starts if s <= p)}" if p >= 4 else None
    assert set(got) == {(p, f"x{p}", title(p)) for p in [*range(1, 90, 2), 500]} and len(got) == 47


@pytest.mark.parametrize("away", [1, 2])
def test_lookaround_edges(spark, away):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "page_no int, text string")
    got = {r.page_no: (r.prev, r.next) for r in structure.lookaround(df, away).collect()}
    none = "(no text on this page)"
    assert got[1] == ("(start of book)", "b" if away == 1 else none)
    assert got[4] == (none if away == 1 else "b", "(end of book)")


def test_selectors_chunks_and_samples(spark):
    assert {r.page_no for r in structure.select_pages(spark, "1,5, 9-12,10").collect()} == {1, 5, 9, 10, 11, 12}
    assert structure.select_pages(spark, "").count() == 0
    t = spark.createDataFrame([("a", "x" * 25), ("b", "y" * 10), ("c", "")], "chapter string, text string")
    lines = t.select("chapter", F.lit(1).alias("page_no"), F.lit(0).alias("block_index"), "text")
    assert sorted((r.chapter, len(r.text)) for r in structure.chunks(lines, F.col("chapter"), 10).collect()) == [("a (1)", 10), ("a (2)", 10), ("a (3)", 5), ("b", 10)]
    rows = [("c", p, i, f"{p}-{i} " + "w" * (p * 7 % 13) * i) for p in (3, 1, 1500, 2, 999, 1000) for i in range(4)]
    many = spark.createDataFrame(rows, "chapter string, page_no long, block_index int, text string")
    whole = structure.chapter_text(many, F.col("chapter")).first().text
    assert [r.text for r in structure.chunks(many, F.col("chapter"), 17).orderBy("chunk").collect()] == [whole[k : k + 17] for k in range(0, len(whole), 17)]
    for n, k in ((3, 7), (7, 7), (23, 7), (14, 7)):
        rows = list(range(n))
        want = rows[:: max(1, n // k)][:k]
        got = structure.every_kth(spark.createDataFrame([(1, i) for i in rows], "g int, i int"), "i", k, "g")
        assert sorted(r.i for r in got.collect()) == want


def test_page_offsets_count_earlier_pages(spark):
    df = spark.createDataFrame([(1, p, e) for p, e in ((1, 0), (2, 1), (3, 3), (4, 0))], "book int, page_no int, n_extra int")
    assert {r.page_no: r.out_idx for r in structure.page_offsets(df, "book").collect()} == {1: 0, 2: 1, 3: 3, 4: 7}


def test_calls_are_made_once_and_good_pages_kept(spark, tmp_path):
    class Counting(jobs.Echo):
        """Counts its calls in a file; some pages fail, or fail the first time."""

        def __init__(self, path, later=False):
            super().__init__()
            self.path, self.later = str(path), later

        def call(self, request):
            with open(self.path, "a") as f:
                f.write("x")
            if "boom" in request and not self.later:
                raise ValueError("boom")
            if "cut" in request and not self.later:
                return jobs.Answer("{", complete=False)
            return super().call(request)

    blocks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "boom"), (3, 0, "cut")], "page_no long, block_index int, text string")
    work = jobs.page_jobs(blocks, spark.createDataFrame([(1, "ch")], "page_no long, chapter string"))
    assert {r.page_no: r.chapter for r in work.collect()} == {1: "ch", 2: jobs.FRONT, 3: jobs.FRONT}
    calls, path = tmp_path / "calls", f"{tmp_path}/answers"
    got = jobs.call_all(work, Counting(calls), path)
    for _ in range(2):
        assert {(r.page_no, r.ok) for r in jobs.validated(jobs.parsed(got)).collect()} == {(1, True)}
    with pytest.raises(jobs.ProviderError, match="p2: ValueError: boom; p3: ProviderError: the answer was cut off"):
        jobs.raise_failures(got)
    assert calls.read_text() == "x" * 3
    again = jobs.call_all(work, Counting(calls, later=True), path)
    jobs.raise_failures(again)
    assert {(r.page_no, r.ok) for r in jobs.validated(jobs.parsed(again)).collect()} == {(1, True), (2, True), (3, True)}
    assert calls.read_text() == "x" * 5  # only the two that failed


def test_answers_must_be_whole():
    assert jobs.content("x") == jobs.content(jobs.Answer("x")) == "x"
    for bad in (jobs.Answer("x", complete=False), jobs.Answer(None), " \n", None):
        with pytest.raises(jobs.ProviderError):
            jobs.content(bad)


def test_policy_of_repeated_calls():
    def after(*errors):
        left = list(errors)

        def once():
            if left:
                raise left.pop(0)
            return "ok"

        return once

    pauses = []
    assert jobs.Policy().call(after(jobs.Transient(), jobs.TimedOut(), jobs.Transient()), pauses.append) == "ok"
    assert pauses == [3.0, 6.0, 12.0]
    for errors, kind in (([jobs.TimedOut()] * 2, jobs.ProviderError), ([jobs.Transient()] * 4, jobs.ProviderError), ([KeyError()], KeyError)):
        with pytest.raises(kind):
            jobs.Policy().call(after(*errors), lambda _: None)


def test_first_new_row_of_a_key_is_added(spark):
    old = spark.createDataFrame([(1, "a", 0)], "id int, name string, at int")
    new = spark.createDataFrame([(1, "b", 1), (2, "late", 5), (2, "first", 2), (3, None, 1), (3, None, 1)], old.schema)
    assert {tuple(r) for r in state.insert_missing(old, new, ["id"], "at").collect()} == {(1, "a", 0), (2, "first", 2), (3, None, 1)}
    assert state.insert_missing(old, new, ["id"]).count() == 3


def test_page_fields(spark):
    pages = spark.createDataFrame([(1, "new", None), (2, "new", "s")], "page_no long, status string, summary string")
    assert {tuple(r) for r in state.set_page(pages, spark.createDataFrame([(1, "done")], "page_no long, value string"), "status").collect()} == {(1, "done", None), (2, "new", "s")}
    b = spark.createDataFrame([(1, "f"), (1, None), (2, "f")], "page_no long, final string")
    assert [r.page_no for r in state.all_final(b).collect()] == [2]
    assert checks.any_row(b) and not checks.any_row(b.where("page_no = 9"))
    f = spark.createDataFrame([(7, "x"), (3, "y")], "page_no long, detail string")
    assert tuple(checks.first_failure(f).first()) == (3, "y")


def test_validation(spark):
    rows = [(1, [0, 1, 2], [(0, "a"), (2, " "), (1, " "), (1, "b"), (9, "z")]), (2, [0], []), (3, [0], [(0, "x")])]
    got = {r.page_no: (r.missing, r.empty, r.ok) for r in jobs.validated(spark.createDataFrame(rows, "page_no long, ids array<int>, answers array<struct<id:int,text:string>>")).collect()}
    assert got == {1: ([], [2], False), 2: ([0], [], False), 3: ([], [], True)}


def test_glossary_merging(spark):
    terms = spark.createDataFrame([(" Frame", "a", "k", 1), ("frame", "b", "k", 0), (" ", "c", "k", 2), ("Pin", "d", "k", 3)], "english string, target string, kind string, pos int")
    locked = spark.createDataFrame([("pin", "L", "x"), ("Extra", "E", "x")], "english string, target string, kind string")
    got = {(r.english, r.target, r.locked) for r in glossary.merged(terms, locked).collect()}
    assert got == {("frame", "b", False), ("pin", "L", True), ("Extra", "E", True)}
    assert glossary.prompt_lines(glossary.merged(terms, locked), 2).first().lines == "- frame  ->  b\n- pin  ->  L"
    assert glossary.prompt_lines(terms.limit(0)).first().lines == glossary.NO_TERMS
    assert "3. Keep the setting" in prompts.system_prompt("literary", "keep_latin", "keep_english", "- a  ->  b")


def test_cost_floors_after_summing(spark):
    calls = spark.createDataFrame([("t", 10, 50, 1), ("t", 100, 20, 1)], "tier string, input long, cached long, output long")
    assert ledger.cost(ledger.usage(calls, "tier"), F.lit(5.0), F.lit(30.0)).first().cost_usd == pytest.approx((40 * 5 + 70 * 0.5 + 2 * 30) / 1e6)
    over = calls.where("cached = 50")
    assert ledger.cost(ledger.usage(over, "tier"), F.lit(5.0), F.lit(30.0)).first().cost_usd == pytest.approx((50 * 0.5 + 30) / 1e6)


def test_revision_rate_and_report(spark):
    b = spark.createDataFrame([("g", "a", " a\n"), ("g", "a", "b")], "g string, draft string, final string")
    assert tuple(ledger.revision_rate(b, "g").first()) == ("g", 2, 1, 50.0, False)
    out = spark.createDataFrame([(1, 0, "large", "x")], "page_no int, block_index int, tier string, text string")
    pivot = ledger.tier_pivot(out, ["large", "small"], "page_no", "block_index").withColumn("source", F.lit("s"))
    assert ledger.markdown(pivot, ["large", "small"]).first().value == "**Source [0]**\n\n> s\n\n*large*\n\n> x\n\n*small*\n\n> (missing)"


def test_corpus_operators(spark):
    lines = spark.createDataFrame([("Administration   प्रशासन",), ("X  y",), ("no columns",), ("Two words (x)  a  b",)], "text string")
    assert [(r.english, r.target) for r in corpus.dictionary_lines(lines).collect()] == [("Administration", "प्रशासन"), ("Two words (x)", "a  b")]
    e = "k int, method string, type string, text string"
    rows = [(1, m, "text", "x" * 100) for m in "abc"] + [(2, m, "text", "x" * n) for m, n in zip("abc", (100, 40, 100), strict=True)] + [(3, m, "text", "x" * n) for m, n in zip("abc", (100, 75, 100), strict=True)]
    rows += [(4, m, "text", "(cid:1)" + "x" * 90) for m in "abc"] + [(5, "a", "image_ref", "x" * 99), (5, "b", "text", "x")]
    assert {r.k: r.verdict for r in corpus.cross_checked(spark.createDataFrame(rows, e), ("a", "b", "c"), "k").collect()} == {1: "match", 2: "major", 3: "variance", 4: "garbage", 5: "blank"}
    p = spark.createDataFrame([("a {x}", "text"), ("plain", "table"), ("plain", "text")], "text string, type string")
    assert {(r.text, r.type) for r in corpus.bypassed(p).collect()} == {("a {x}", "code_block"), ("plain", "table")}
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)] + [(9, None)], "vec_id long, embedding array<float>")
    got = corpus.nearest(v.where("vec_id = 2"), v, 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 3, 0]
    assert corpus.nearest(v.limit(0), v).count() == 0


def test_queries_in_several_passes(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i * i % 37), float(i % 5)]) for i in range(50)], "vec_id long, embedding array<float>")
    once = {tuple(r) for r in corpus.nearest(v, v, 4, block=7).collect()}
    monkeypatch.setattr(corpus, "QUERY_BYTES", 400)
    assert {tuple(r) for r in corpus.nearest(v, v, 4).collect()} == once and len(once) == 200


def test_checks(spark):
    h = spark.createDataFrame([("a",), ("a",), ("b",)], "sha256 string")
    assert [r.sha256 for r in checks.images_missing(h, h.where("sha256 = 'a'")).collect()] == ["b"]
    assert not checks.text_layer(spark.createDataFrame([("म",), ("a�",)], "text string")).first().passed
    o = spark.createDataFrame([("म", 1), ("x", 9)], "title string, page int")
    assert tuple(checks.outline_errors(o, F.lit(5)).first()) == (2, 1, 1, False)
    assert checks.outline_errors(o.limit(0), F.lit(5)).first().passed
    rows = checks.all_passed([checks.check(1, "a", h, F.col("sha256") == "z"), checks.check(2, "b", h, F.col("sha256") == "b")]).collect()
    assert [(r.check_no, r.passed) for r in sorted(rows)] == [(0, False), (1, True), (2, False)]
    g = spark.createDataFrame([(1, 10, 8), (2, 10, 7)], "page_no int, expected int, got int")
    assert [(r.page_no, r.deficit) for r in checks.glyph_deficits(g).collect()] == [(2, 3)]


def test_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text("# head\npaths:\n  work: out/x  # note\n  abs: /a\nmodels:\n  order: [a, b]\n  list:\n    - one\n    - 2\nqa:\n  dpi: 150\n  on: true\n  deep:\n    k: 'v: w'\n")
    c = files.Config.load(str(tmp_path / "c.yaml"))
    assert (c.get("qa.dpi"), c.get("qa.on"), c.get("models.order"), c.get("models.list"), c.get("qa.deep.k")) == (150, True, ["a", "b"], ["one", 2], "v: w")
    assert c.path("paths.work") == f"{tmp_path}/out/x" and c.path("paths.abs") == "/a" and c.get("no.key", 3) == 3
    with pytest.raises(KeyError):
        c.get("qa.none")


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    files.json_lines(df, f"{tmp_path}/j")
    files.json_lines(df, f"{tmp_path}/j", append=True)
    assert files.read_json(spark, f"{tmp_path}/j", "k long, v string").count() == 2
    (tmp_path / "bad.json").write_text("{not json\n")
    with pytest.raises(Exception, match=r"(?i)malformed"):
        files.read_json(spark, f"{tmp_path}/bad.json", "k long").collect()
    got = files.read_in_batches(spark, f"{tmp_path}/j", "k long, v string", 2, lambda rows: rows.assign(n=len(rows))[["k", "n"]], "k long, n long").collect()
    assert sorted(r.n for r in got) in ([1, 1], [2, 2])
    files.csv(df, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first().v == "a"
    files.append_log(state.log_entries(spark, [("extract", "m", "info")]), f"{tmp_path}/log")
    files.append_log(state.log_entries(spark, [("verify", "n", "warn")]), f"{tmp_path}/log")
    assert {r.stage for r in spark.read.json(f"{tmp_path}/log").collect()} == {"extract", "verify"}
    (tmp_path / "x.bin").write_bytes(b"abc")
    got = files.parsed_files(spark, f"{tmp_path}/x.bin", lambda p, b: iter([{"n": len(b)}]), "n long").collect()
    assert got[0].n == 3
    im = spark.createDataFrame([(2, 7, "png", bytearray(b"later")), (1, 7, "png", bytearray(b"first")), (3, 8, "jpg", bytearray(b"first"))], "page_no long, xref long, ext string, content binary")
    streams = files.image_streams(im)
    assert {(r.xref, r.page_no, r.n_bytes, r.filepath) for r in streams.collect()} == {(7, 1, 5, "p0001_x7.png"), (8, 3, 5, "p0003_x8.jpg")}
    assert files.distinct_streams(streams).count() == 1


def test_swaps_survive_a_crash_at_each_step(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert files.current(spark, path) is None
    for n in (1, 2):
        files.swap_in(spark.range(n), path)
        assert files.current(spark, path).count() == n
    # a crash while the version is written, after it, and between the pointer and the removal of the old version
    (tmp_path / "t" / "v0000000003").mkdir()
    assert files.current(spark, path).count() == 2
    (tmp_path / "t" / "_v0000000003.new").touch()
    assert files.current(spark, path).count() == 2
    files.swap_in(spark.range(3), path)
    assert files.current(spark, path).count() == 3
    spark.range(4).write.parquet(f"{path}/v0000000004")
    (tmp_path / "t" / "_v0000000004.current").touch()
    assert files.current(spark, path).count() == 4
    files.swap_in(spark.range(5), path)
    assert files.current(spark, path).count() == 5
    assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 1


def test_stream_upserts(spark, tmp_path):
    schema = "page_no long, block_index int, id string, text string, seq long"
    src, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "mark"))
    empty = lambda: spark.createDataFrame([], BLOCK)
    for batch in ([(1, 0, "a", "x", 1), (1, 0, "b", "y", 2)], [(1, 0, "b", "y", 3), (2, 0, "c", "z", 4)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        state_stream.upsert_stream(spark.readStream.schema(schema).parquet(src), out, mark, empty).awaitTermination(60)
    assert {(r.page_no, r.id, r.status) for r in files.current(spark, out).collect()} == {(1, "b", "pending"), (2, "c", "pending")}
    assert state_stream.latest_attempts(spark.createDataFrame([(dt.datetime(2024, 1, 1), 1, "k", 2, 0), (dt.datetime(2024, 1, 1), 1, "k", 1, 1)], "ts timestamp, page_no long, kind string, attempt int, passed int")).first().attempt == 2


def test_model_choice_probes_once():
    asked, cache = [], {}

    def probe(name):
        asked.append(name)
        return {"vision": True} if name == "b" else None

    assert overview.choose_model(["a", "b"], probe, cache) == overview.choose_model(["a", "b"], probe, cache) == ("b", {"vision": True})
    assert asked == ["a", "b", "a"]
    with pytest.raises(LookupError):
        overview.choose_model(["a"], probe, cache)


def test_rules_search_and_do_not_split(spark):
    """The cheap patterns give what the splitting ones gave, for odd characters too."""
    import random
    import re

    from vellum.functions import text as T

    rnd = random.Random(3)
    bits = ["Anna", "(Bob's", "\"Carl.\"", "d'Eve", "the", "con", "CON", "Con.", "of the", "of  the", "xcon", "conx", "éclair", "naïve", "\U0001d400con", "con\U0001d400", "\U0001f600con", "Fritz!", "USA", "French", "is.", "ab", "abc", "A", "Anna-", "it’s", "’con", "<b>", "</b>", "<b", "\u0939con", "Zoe\u2028", "No.1"]
    texts = ["", " ", "Anna", "Anna Bob"] + ["".join(rnd.choice(bits) + rnd.choice((" ", " ", " ", "\n", "  ", ". ", "?\t", "")) for _ in range(rnd.randrange(1, 25))) for _ in range(400)]
    blank, edge = r"[\x20\x09-\x0D]+", "\"'()[],;:.!?"
    word = lambda c: re.match(r"\w", c) is not None or "\u0300" <= c <= "\u036f"  # noqa: E731  of the characters above

    def nouns(t):
        inner = [w for s in re.split(rf"(?<=[.!?]){blank}", t) for w in [w for w in re.split(blank, s) if w][1:]]
        bare = [w.strip(edge) for w in inner]
        return sorted({w for w in bare if re.match(r"[A-Z][A-Za-z'&.-]+[A-Za-z]\u2028?$", w) and w != w.upper() and w.lower() not in (*T.SENTENCE_STARTERS, *T.DEMONYMS)})

    def has(t, term):
        low = t.lower()
        return any(low.startswith(term, i) and not (i and word(t[i - 1])) and not (t[i + len(term) :] and word(t[i + len(term)])) for i in range(len(t)))

    def words(t):
        return ["".join(g) for g in re.findall(r"\w+", t)]

    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    t = F.col("t")
    cols = [T.proper_nouns(t), T.has_term(t, "con"), T.has_term(t, "of the"), T.has_translatable(t), T.count_of(t, "<b>")]
    got = df.select("k", *(c.alias(f"c{i}") for i, c in enumerate(cols)))
    for r in got.collect():
        s = texts[r.k]
        assert (r.c0, r.c1, r.c2, r.c3, r.c4) == (nouns(s), has(s, "con"), has(s, "of the"), any(re.fullmatch("[a-z]{3,}", w) for w in words(s)), s.count("<b>")), s
    assert "split(" not in got._jdf.queryExecution().toString()  # no list of every word of a text
