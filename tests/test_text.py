import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vellum.functions import markup as M
from vellum.functions import text as T


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("scaﬀold", "scaffold"), ("‚low‛ and „high”", "'low' and \"high\""), ("x  \t y ", "x y"), ("ﬆﬅ", "stst"), ("o\u0308l", "öl"), ("one\u2028two\u2029three", "one two three"), ("", ""), (None, None), ("\na\n", "a")])
def test_normalise(spark, raw, want):
    assert one(spark, raw, T.normalise) == want


def test_numbers(spark):
    assert one(spark, "rain of 4,812.75 mm since 1908", T.numbers_in) == ["4,812.75", "1908"]
    assert one(spark, "98,7654 or 3\u00a0200 by 1866, so", T.numbers_in) == ["98,765", "4", "3", "200", "1866"]
    assert one(spark, "२५०", T.numbers_in) == ["250"] and one(spark, "२५०", T.raw_numbers_in) == ["२५०"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Rivers near Tarnow flooded. Below them, Orla waited.", ["Orla", "Tarnow"]),
        ("Long ago Orla Brennick LOUDLY sang", ["Brennick", "Orla"]),
        ("A ferry, the Dutch one, reached Lumina.", ["Lumina"]),
        ("with Irisha, Dutcher and Italo.", ["Dutcher", "Irisha", "Italo"]),
        ("", []),
        ("near D'Arcy-Wells & R&D it.", ["D'Arcy-Wells"]),
    ],
)
def test_proper_nouns(spark, text, want):
    assert one(spark, text, T.proper_nouns) == want


def test_titles_and_prose(spark):
    for text, title, prose in (("Rivers That Run Uphill", True, False), ("heavy rain.", False, True), ("Two", False, False), ("v. 2. no. 7", False, False), ("Born of Salt", True, False)):
        assert one(spark, text, T.looks_like_title) == title
        assert one(spark, text, T.is_prose) == prose


@pytest.mark.parametrize("text", ["well-Known it's abcD é-f éa a-é don’t' x_y aé b c-", "Jean-é A-1 B' C-d", "__a a__ a1 1a"])
def test_word_patterns_equal_boundaries(spark, text):
    text = unicodedata.normalize("NFC", text)
    assert one(spark, text, T.lexicon_words) == re.findall(r"\b[a-z][a-z'’-]{1,}\b", text)
    assert one(spark, text, T.title_words) == re.findall(r"\b[A-Za-z][A-Za-z'’-]*\b", text)
    assert one(spark, text, T.translatable_words) == re.findall(r"\b[a-z]{3,}\b", text)


def test_terms_keep_word_bounds(spark):
    assert one(spark, "The Flood Plain grew", lambda c: T.has_term(c, "flood plain"))
    assert not one(spark, "flood plains", lambda c: T.has_term(c, "flood plain"))
    assert one(spark, "C++ (a.b)", lambda c: T.has_term(c, "a.b")) and not one(spark, "axb", lambda c: T.has_term(c, "a.b"))


def test_escape(spark):
    assert one(spark, "x > 1 & <b>y</b> <u> &lt;i&gt;", T.to_html) == "<p>x &gt; 1 &amp; <b>y</b> &lt;u&gt; &amp;lt;i&amp;gt;</p>"


def test_short_form_json_and_code(spark):
    assert one(spark, "x" * 41, T.shortened) == "x" * 40 + "…" and one(spark, None, T.shortened) == ""
    assert one(spark, 'ok {"a": {"b": 1}} end', T.first_json) == '{"a": {"b": 1}}' and one(spark, "none", T.first_json) is None
    for t, want in (("call getName now", True), ("{x}", True), (" <br> ", True), ("```", True), ("a < b > c", False), ("GetName", False)):
        assert one(spark, t, T.is_code) == want


def test_lexicon_key_strips_a_set_of_characters(spark):
    for w in ("Boss's", "sis", "It's", "Class’"):
        assert one(spark, w, T.lexicon_key) == w.lower().strip("'’s")


def test_markup_round_trip(spark):
    def marked(text, runs):
        return spark.createDataFrame([(text, runs)], f"t string, r {M.RUNS}").select(M.apply_markup(F.col("t"), F.col("r")).alias("x")).first().x

    assert marked("a slow river", [(2, 6, True, False)]) == "a <i>slow</i> river"
    assert marked("rain fell", [(5, 9, True, True)]) == "rain <i><b>fell</b></i>"
    assert marked("abcdef", [(4, 99, False, True), (-3, 2, True, False), (1, 3, True, True), (3, 3, True, False)]) == "<i>ab</i>cd<b>ef</b>"
    assert marked("abc", []) == "abc" and marked("abc", None) == "abc"
    assert one(spark, "a <i>slow</i> <b>r</b>", T.strip_markup) == "a slow r"


@pytest.mark.parametrize(
    ("text", "want"),
    [("<b>प</b>ूर आला", "<b>पू</b>र आला"), ("<i>स</i>्त्री", "<i>स्त्री</i>"), ("<b>स</b>्<i>त", "<b>स्</b><i>त"), ("<i>नदी</i> खोल", "<i>नदी</i> खोल"), ("untagged", "untagged"), ("a <b>deep</b> c", "a <b>deep</b> c")],
)
def test_tags_move_behind_clusters(spark, text, want):
    assert one(spark, text, M.snap_to_clusters) == want


def test_cut_emphasis_is_closed_and_reopened(spark):
    df = spark.createDataFrame([("so <b>very", "far</b> away")], "h string, t string")
    assert tuple(df.select(M.close_open_tags(F.col("h"), F.col("t")).alias("c")).first().c) == ("so <b>very</b>", "<b>far</b> away")


def test_block_ids_follow_content(spark):
    import hashlib

    def bid(p, i, t):
        return spark.createDataFrame([(p, i, t)], "p int, i int, t string").select(T.block_id(F.col("p"), F.col("i"), F.col("t")).alias("x")).first().x

    assert bid(7, 3, "rain") == hashlib.sha256(b"7|3|rain").hexdigest()[:32]
    assert len({bid(7, 3, "rain"), bid(7, 3, "rains"), bid(7, 4, "rain"), bid(8, 3, "rain")}) == 4


def test_runs_of_one_style_merge(spark):
    df = spark.createDataFrame([([(5, 8, True, False), (0, 3, True, False), (3, 5, True, False), (8, 9, False, True)],)], f"r {M.RUNS}")
    assert [tuple(r) for r in df.select(M.merge_runs(F.col("r")).alias("x")).first().x] == [(0, 8, True, False), (8, 9, False, True)]
