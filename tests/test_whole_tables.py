"""Queries cover whole tables and whole texts."""

import hashlib

from vellum.plans import table_queries, text_queries


def documents(spark, path, texts):
    spark.createDataFrame([(i, t, "en", "src1") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_frames_of_every_page_and_line(spark, tmp_path):
    lines = {1: 3, 2: 45, 3: 90, 4: 41, 5: 5, 8: 61}
    d = documents(spark, tmp_path, {i: "\n".join(f"line {k}" for k in range(m)) for i, m in lines.items()})
    want = []
    for i, m in lines.items():
        for box in range((m + 3) // 4):
            x, y = 72.0 + box % 2 * 200, 72.0 + box // 2 * 60
            if (i + box) % 5 and m - box * 4 >= 2:  # a rule across and one down
                want.append((i, x, y, x + 150, y + 40))
    assert sorted(tuple(r) for r in table_queries.Q["rule_frames"](spark, d).collect()) == sorted(want)


def test_output_pages_of_every_page(spark, tmp_path):
    lengths = {i: i * 1237 % 9001 for i in [*range(280, 330), 1000, 10_000]}
    d = documents(spark, tmp_path, {i: "x" * m for i, m in lengths.items()})
    want = []
    for book in range(10):
        starts, before = [], 0
        for i in sorted(i for i in lengths if i % 10 == book):
            starts.append((i, i - 1 + before))
            before += lengths[i] // 3000
        for k, (i, start) in enumerate(starts):
            stop = starts[k + 1][1] if k + 1 < len(starts) else start + lengths[i] // 3000 + 1
            want += [(book, i, o) for o in range(start, max(stop, start + 1))]
    assert sorted(tuple(r) for r in table_queries.Q["vision_targets"](spark, d).select("book", "page_no", "out_page").collect()) == sorted(want)


def test_whole_pages_are_sanitised(spark, tmp_path):
    html = "a" * 250 + "\x01b\x85\n" + "c" * 300 + "\x1f"
    spark.createDataFrame([(1, html), (2, "")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.text_md5, r.n) for r in text_queries.Q["sanitise"](spark, str(tmp_path)).collect()}
    assert got == {i: (hashlib.md5(t.encode()).hexdigest(), len(t)) for i, t in ((1, "a" * 250 + "b\n" + "c" * 300 + "x"), (2, "x"))}


def wrapped(words, width, size):
    """Lines of whole words, each shorter than a line, of characters half as wide as high."""
    lines, used = 0, None
    for w in words:
        if used is None or used + 1 + len(w) > int(width / (size * 0.5)):
            lines, used = lines + 1, len(w)
        else:
            used += 1 + len(w)
    return lines


def brute_flow(texts, size):
    """(rung, placements, spill) of long lines that end their sentences: each is a paragraph of full width."""
    blocks = [(72.0 + 18 * (i % 5 == 0), 72.0 + 14 * i, 72.0 + 14 * i + 13 + len(t) % 5, t) for i, t in enumerate(texts)]
    for rung, (scale, pin, line) in enumerate(((1.0, True, 1.30), (0.65, True, 1.30), (1.0, False, 1.30), (0.6, False, 1.30), (0.3, False, 1.30), (0.3, False, 1.22), (0.25, False, 1.16))):
        cursor, placed, spill = 72.0, [], []
        for k, (x, y0, y1, t) in enumerate(blocks):
            top, words = max(y0, cursor) if pin else cursor, t.split(" ")
            fit = 0
            if 720 - top >= size * 1.4:
                while fit < len(words) and wrapped(words[: fit + 1], 540 - x, size) * size * line <= 720 - top:
                    fit += 1
            if fit:
                placed.append((k, " ".join(words[:fit]), round(top, 6)))
            if fit < len(words):
                spill = [" ".join(words[fit:]), *(b[3] for b in blocks[k + 1 :])]
                break
            gap = max(blocks[k + 1][1] - y1, 0.0) if k + 1 < len(blocks) else 0.0
            cursor = top + wrapped(words, 540 - x, size) * size * line + min(gap, size * 1.6) * scale
        if not spill:
            break
    return rung, placed, spill


def test_flow_of_whole_texts_equals_brute_force(spark, tmp_path):
    def line(n, m):
        return " ".join("w" * (1 + (n * 7 + k * k) % 11) for k in range(m)) + "."

    pages = {3: [line(1, 120)], 4: [line(k, 90) for k in range(6)], 7: [line(2, 2500)], 8: [line(k, 150 + 40 * k) for k in range(9)], 11: [line(k, 60) for k in range(40)]}  # without figures and boxes
    d = documents(spark, tmp_path, {i: "\n".join(t) for i, t in pages.items()})
    rows = table_queries.Q["page_flow"](spark, d).collect()
    rungs = set()
    for i, texts in pages.items():
        mine = [r for r in rows if r.page_no == i]
        rung, placed, spill = brute_flow(texts, 10.0 + i % 3)
        assert {r.rung for r in mine} == {rung}
        assert sorted((r.group_no, r.text, round(r.y0, 6)) for r in mine if not r.spilled) == placed
        assert sorted(r.text for r in mine if r.spilled) == sorted(spill)
        rungs.add((rung, bool(spill)))
    assert (0, False) in rungs and (6, True) in rungs
def test_tags_are_snapped_to_the_end(spark, tmp_path):
    text = "क" * 30 + "<i>\u093f</i>" + "ख" * 30
    d = documents(spark, tmp_path, {6: text})
    want = "<b>स्त्री</b><i></i> म ".replace("ी</b><i>", "</b>ी<i>") + "क" * 30 + "\u093f<i></i>" + "ख" * 30
    got = text_queries.Q["snap_clusters"](spark, d).first()
    assert (got.moved, got.start, got.snapped_md5) == (True, want[:30], hashlib.md5(want.encode()).hexdigest())
