import pytest
from pyspark.sql import functions as F

from vellum.operators import assemble as A
from vellum.operators import layout as L

FONT = "Serif"


def page(spark, *blocks):
    rows = [(1, [(b.get("type", 0), (0.0, 0.0, 100.004, 100.0), [([(t, 10.0, f, n) for t, f, n in line],) for line in b["lines"]]) for b in blocks])]
    return A.page_blocks(spark.createDataFrame(rows, f"page_no long, blocks array<{A.BLOCK}>")).collect()


def spans(*texts):
    return [(t, 0, FONT) if isinstance(t, str) else t for t in texts]


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ([["moun", "tain", " River"]], "mountain River"),
        ([["rain came"], ["and went"]], "rain came and went"),
        ([["water-"], ["fall"]], "waterfall"),
        ([["a--"], ["b"]], "a-- b"),
        ([["ends-"]], "ends-"),
        ([["a"], [], ["  b\t c "]], "a b c"),
        ([["e"], ["́x"]], "e ́x"),
    ],
)
def test_spans_and_lines_join(spark, lines, want):
    assert page(spark, {"lines": [spans(*x) for x in lines]})[0].source_text == want


def test_italic_runs_are_kept(spark):
    r = page(spark, {"lines": [spans("a ", ("slow", 2, FONT), " river")]})[0]
    assert r.source_text == "a slow river"
    assert [(x.start, x.end, x.i, x.b) for x in r.style.runs] == [(2, 6, True, False)]


def test_runs_follow_healed_and_collapsed_text(spark):
    r = page(spark, {"lines": [spans("  a ", ("bo-", 0, "X-Bold")), spans(("ld", 16, FONT), "  z"), spans(("it", 0, "Y-Oblique"))]})[0]
    assert r.source_text == "a bold z it"
    assert [(r.source_text[x.start : x.end], x.i, x.b) for x in r.style.runs] == [("bold", False, True), ("it", True, False)]


def test_runs_follow_composition(spark):
    r = page(spark, {"lines": [spans("cafe", "\u0301 au ", ("lait", 2, FONT), " n\u0303", ("o", 16, FONT))]})[0]
    assert r.source_text == "caf\u00e9 au lait \u00f1o"
    assert [r.source_text[x.start : x.end] for x in r.style.runs] == ["lait", "o"]


def test_bold_by_font_and_sizes(spark):
    r = page(spark, {"lines": [spans(("RIVERS", 0, "Serif-Bold"))]})[0]
    assert r.style.runs[0].b and (r.style.size, r.style.size_max) == (10.0, 10.0) and r.x1 == 100.0


def test_other_blocks_and_blank_ones_go_before_numbering(spark):
    got = page(spark, {"type": 1, "lines": []}, {"lines": [spans("  ")]}, {"lines": [spans("one")]}, {"lines": []}, {"lines": [spans("two")]})
    assert [(r.block_index, r.source_text) for r in got] == [(0, "one"), (1, "two")]


BOX = "page_no long, block_index int, x0 double, y0 double, x1 double, y1 double"


def test_overlaps_are_trimmed_within_a_column(spark):
    def trimmed(*rows):
        return {r.block_index: r for r in L.deoverlapped(spark.createDataFrame([(1, i, *map(float, b)) for i, b in enumerate(rows)], BOX)).collect()}

    stacked = trimmed((60, 20, 480, 95), (60, 90, 480, 180))
    assert (stacked[0].y1, stacked[1].y0, stacked[1].y1) == (89.5, 90.0, 180.0)
    assert trimmed((50, 30, 200, 330), (220, 45, 400, 310))[0].y1 == 330.0
    assert trimmed((0, 100, 50, 101), (0, 100.2, 50, 200))[0].y1 == 101.0


def groups(spark, *rows, right=540.0, width=612.0):
    data = [(1, i, *map(float, box), 14.4, src, text) for i, box, src, text in rows]
    df = spark.createDataFrame(data, f"{BOX}, size double, src string, text string")
    return L.merged_paragraphs(df, width, F.lit(right)).orderBy("group_no").collect()


def test_wrapped_line_merges(spark):
    got = groups(spark, (4, (60, 300, 538, 324), "Rain had fallen on the valley for", "P"), (5, (66, 318, 150, 342), "three days.", "Q"))
    assert [(g.text, g.x1, g.indices) for g in got] == [("P Q", 538.0, [4, 5])]


@pytest.mark.parametrize(
    ("first", "second", "src"),
    [
        ((60, 300, 538, 380), (60, 310, 538, 390), "too far into it"),
        ((270, 50, 340, 74), (60, 75, 538, 99), "Of Rivers"),
        ((60, 300, 250, 324), (60, 318, 538, 342), "ends early"),
        ((60, 300, 538, 324), (60, 318, 538, 342), "The river rose."),
        ((60, 300, 538, 324), (60, 318, 538, 342), "They left!”"),
        ((60, 300, 538, 324), (60, 318, 538, 342), ""),
    ],
)
def test_others_stay_apart(spark, first, second, src):
    got = groups(spark, (0, first, src, "P"), (1, second, "q", "Q"))
    assert len(got) == 2
    if src == "Of Rivers":
        assert [g.align for g in got] == ["center", "justify"]


def test_many_paragraphs_of_a_page(spark):
    rows = [(i, (60, 20 * i, 538, 20 * i + 15), "Ends here.", f"t{i}") for i in range(700)]
    assert [g.text for g in groups(spark, *rows)] == [f"t{i}" for i in range(700)]


def test_chain_merges_by_the_groups_own_edge(spark):
    got = groups(spark, (0, (60, 40, 537, 64), "so", "P"), (1, (60, 58, 280, 82), "it", "Q"), (2, (60, 76, 537, 100), "went", "R"))
    assert [g.text for g in got] == ["P Q R"]


def test_percentiles_take_the_lower_index(spark):
    for n in (1, 2, 53):
        df = spark.createDataFrame([(1, i, float(i + 1), float(i + 1), float(i + 1), float(i + 1)) for i in range(n)], BOX)
        v = sorted(range(1, n + 1))
        f = L.document_frame(df).first()
        assert (f.x0, f.x1) == (v[int(0.02 * (n - 1))], v[int(0.98 * (n - 1))])


def test_page_frame_is_at_least_100_high(spark):
    b = spark.createDataFrame([(1, 0, 80.0, 90.0, 200.0, 100.0)], BOX)
    f = spark.createDataFrame([(72.0, 95.0, 150.0, 120.0)], "x0 double, y0 double, x1 double, y1 double")
    assert tuple(L.page_frames(b, f).select("x0", "y0", "x1", "y1").first()) == (72.0, 90.0, 200.0, 190.0)


def test_frames_of_thin_rules_only(spark):
    def rules(x, y, t=1.0):
        return [(x, y, x + 150, y + t), (x + 149, y, x + 150, y + 40), (x, y + 39, x + 150, y + 40), (x, y, x + t, y + 40)]

    rows = rules(0.0, 0.0) + rules(300.0, 0.0, 9.0) + [(500.0, 0.0, 700.0, 1.0), (5.0, 5.0, 5.0, 9.0)]
    got = L.rule_frames(spark.createDataFrame([(1, *r) for r in rows], "page_no long, x0 double, y0 double, x1 double, y1 double")).collect()
    assert [tuple(g) for g in got] == [(1, 0.0, 0.0, 150.0, 40.0)]


def test_blocks_of_odd_pages_at_any_batch(spark):
    line = lambda *spans: ([(t, s, f, n) for t, s, f, n in spans],)
    box = (0.0, 0.125, 9.0, 9.0)
    twice = [line((" \t“ﬁre”", 10.005, None, None), ("x\u00a0 ", 12.0, 2, "A")), line(("", 99.0, 0, "B"), ("re-", 12.0, 0, "SerifBLACK")), line(("do cafe\u0301 go", None, 16, "C"))]
    blank = (0, box, [line((" \t\x0b", 8.0, 0, "A"))])
    text = (0, box, twice)
    plain = (0, None, [line(("plain", float("nan"), 0, "A"), (" one", float("nan"), 0, "A"), ("!", 3.0, 0, "Oblique"))])
    odd = (0, box, [None, ([None, ("a", 1.0, 2, "A")],), (None,)])
    rows = [(1, [blank, text, (1, box, twice), None, plain]), (2, None), (3, []), (4, [(0, box, None), (None, box, twice), odd]), (1, [plain])] + [(i, [text] * (i % 5)) for i in range(10, 40)]
    fire = ('"fire"x redo café go', 12.0, 12.0, [(6, 8, True, False), (8, 20, False, True)])
    one = ("plain one!", "nan", "nan", [(9, 10, True, False)])
    want = [(1, 0, 0.13, *fire), (1, 1, None, *one), (1, 0, None, *one), (4, 0, 0.13, "a", 1.0, 1.0, [(0, 1, True, False)])] + [(i, k, 0.13, *fire) for i in range(10, 40) for k in range(i % 5)]
    df = spark.createDataFrame(rows, f"page_no int, blocks array<{A.BLOCK}>")
    for most in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            got = A.page_blocks(df)
            found = got.collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(((r.page_no, r.block_index, r.y0, r.source_text, *(s if s == s else "nan" for s in r.style[:2]), [tuple(x) for x in r.style.runs]) for r in found), key=str) == sorted(want, key=str)
    assert "aggregate(" not in got._jdf.queryExecution().toString()  # no fold of expressions over spans, which the engine interprets


def brute_frames(rows):
    """Frames of one page, each pair held against each other."""
    boxes = [r for r in rows if None not in r and r[2] > r[0] and r[3] > r[1]]
    near = lambda a, b: a[0] - 3 < b[2] and b[0] < a[2] + 3 and a[1] - 3 < b[3] and b[1] < a[3] + 3
    out, left = [], boxes
    while left:
        cluster, left = left[:1], left[1:]
        for a in cluster:
            cluster += [b for b in left if near(a, b)]
            left = [b for b in left if not near(a, b)]
        u = [f(c) for f, c in zip((min, min, max, max), zip(*cluster, strict=True), strict=True)]
        if all(min(c[2] - c[0], c[3] - c[1]) <= 5 for c in cluster) and u[2] - u[0] > 60 and u[3] - u[1] > 25:
            out.append(tuple(u))
    return out


def test_frames_of_many_pages_at_a_time(spark):
    import random

    rnd = random.Random(4)

    def rect():
        x, y, long = float(rnd.randrange(900)), float(rnd.randrange(900)), rnd.choice((0.0, 40.0, 90.0, 200.0))
        thick = rnd.choice((1.0, 1.0, 1.0, 4.0, 9.0)) if rnd.random() < 0.3 else 2.0
        return (x, y, x + long, y + thick) if rnd.random() < 0.5 else (x, y, x + thick, y + long)

    pages = {None: 20, 2**60: 30, 2**60 + 1: 30, 5: 0} | {i: i * 7 % 60 for i in range(10, 60)} | {7: 400}
    pages = {i: [rect() for _ in range(m)] for i, m in pages.items()}
    pages[None] += [(2000.0, 0.0, 2100.0, 1.0), (2000.0, 0.0, 2001.0, 50.0)]
    pages[8] = [(0.0, 0.0, 0.0, 5.0), (None, 0.0, 9.0, 9.0)]
    pages[9] = [(float(4 * k), 0.0, float(4 * k + 2), 2.0) for k in range(300)][::-1] + [(float(4 * k), 30.0 + k % 2, float(4 * k + 2), 32.0) for k in range(300)] + [(596.0, 0.0, 598.0, 40.0)]  # a chain
    want = sorted(((i, *f) for i, rows in pages.items() for f in brute_frames(rows)), key=str)
    assert len(want) > 40 and {None, 2**60, 2**60 + 1, 7, 9} <= {w[0] for w in want}
    df = spark.createDataFrame([(i, *r) for i, rows in pages.items() for r in rows], "page_no long, x0 double, y0 double, x1 double, y1 double")
    for most in ("1", "37", "10000"):  # pages over several batches, and several pages in one
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            got = L.rule_frames(df)
            assert sorted((tuple(r) for r in got.collect()), key=str) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()  # no call for each page


def paragraphs(*rows, size=10.0):
    return [L.Paragraph(i, L.Box(*map(float, box)), size, text, centred) for i, (box, text, centred) in enumerate(rows)]


FRAME = L.Box(72.0, 72.0, 540.0, 300.0)


def test_flow_gives_up_fidelity_step_by_step():
    rows = paragraphs(*(((72, 80 + 60 * i, 540, 100 + 60 * i), "word " * 150, False) for i in range(3)))
    flow = L.Flow(L.Page(FRAME), L.monospaced, 1.0, True, 1.30)
    for p in rows:
        flow.put(p, 0.0)
    assert flow.spill and flow.placed and all(a[1].y1 <= b[1].y0 for a, b in zip(flow.placed, flow.placed[1:], strict=False))
    _, below = L.set_page(rows[:1], L.Page(L.Box(72.0, 72.0, 540.0, 700.0), figures=(L.Box(72.0, 70.0, 540.0, 150.0),)))
    assert below.placed[0][1].y0 == 152.0


def test_figures_are_passed_one_after_the_other():
    page = L.Page(L.Box(0.0, 0.0, 400.0, 900.0), figures=(L.Box(0.0, 200.0, 400.0, 300.0), L.Box(0.0, 90.0, 400.0, 195.0), L.Box(500.0, 0.0, 600.0, 900.0)))
    _, flow = L.set_page(paragraphs(((0, 100, 400, 120), "some words", False)), page)
    assert flow.placed[0][1].y0 == 302.0  # 197 would run into the next one


def test_short_lines_widen_and_containers_hold():
    long = "word " * 20
    rung, flow = L.set_page(paragraphs(((72, 80, 150, 92), long, False)), L.Page(FRAME))
    assert (rung, flow.placed[0][1].x1) == (0, 540.0)  # a stub that its text has outgrown
    _, held = L.set_page(paragraphs(((72, 80, 150, 192), long, False)), L.Page(FRAME))
    assert held.placed[0][1].x1 == 150.0  # a column
    _, boxed = L.set_page(paragraphs(((72, 80, 150, 192), long, False)), L.Page(FRAME, containers=(L.Box(70.0, 70.0, 306.0, 250.0),)))
    assert boxed.placed[0][1].x1 == 300.0
    _, centred = L.set_page(paragraphs(((250, 80, 350, 92), "a heading", True)), L.Page(FRAME))
    assert (centred.placed[0][1].x0, centred.placed[0][1].x1) == (72.0, 540.0)


def test_figures_and_containers_of_a_table(spark):
    data = [(1, 0, 79.0, 100.0, 300.0, 160.0, 12.0, "x.", "text here " * 10), (2, 0, 79.0, 100.0, 300.0, 160.0, 12.0, "x.", "text here " * 10)]
    df = spark.createDataFrame(data, f"{BOX}, size double, src string, text string")
    boxes = "page_no long, x0 double, y0 double, x1 double, y1 double"
    frame = spark.createDataFrame([(i, 72.0, 72.0, 540.0, 700.0) for i in (1, 2)], boxes)
    got = {r.page_no: r for r in L.laid_out(L.merged_paragraphs(df), frame, spark.createDataFrame([(1, 0.0, 90.0, 400.0, 180.0)], boxes), spark.createDataFrame([(2, 70.0, 70.0, 406.0, 500.0)], boxes)).collect()}
    assert got[1].y0 == 182.0 and got[1].x1 == 300.0
    assert got[2].y0 == 100.0 and got[2].x1 == 400.0


def test_longest_prefix_that_fits():
    text = "one two <i>three four</i> five"
    head, tail = L.split_to_fit(text, 60.0, 26.0, 10.0, 1.3, L.monospaced)
    assert f"{head} {tail}" == text and L.monospaced(head, 60.0, 10.0, 1.3) <= 26.0
    assert L.monospaced(" ".join(text.split(" ")[: len(head.split(" ")) + 1]), 60.0, 10.0, 1.3) > 26.0
    assert L.retagged("so <b>very", "far</b> away") == ("so <b>very</b>", "<b>far</b> away")
    assert L.split_to_fit("unsplittable" * 9, 60.0, 26.0, 10.0, 1.3, L.monospaced)[0] == ""


def test_pages_are_laid_out(spark):
    data = [(1, i, 79.0, 100.0 + 40 * i, 539.0, 120.0 + 40 * i, 12.0, "x.", "text here " * 10) for i in range(5)]
    df = spark.createDataFrame(data, f"{BOX}, size double, src string, text string")
    frame = spark.createDataFrame([(1, 72.0, 72.0, 540.0, 700.0)], "page_no long, x0 double, y0 double, x1 double, y1 double")
    got = L.laid_out(L.merged_paragraphs(df), frame).collect()
    assert len(got) == 5 and not any(r.spilled for r in got) and {r.rung for r in got} == {0}
