"""Text and rule queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as T
from ..operators import assemble, rules
from . import sql as S

#: Glossary of the queries: terms that occur in the texts, and one that doesn't (fixed values).
TERMS = (("this is", "हे आहे"), ("of the", "चा"), ("für", "साठी"), ("con", "सह"), ("narrow frame", "संकुचित दृष्टिकोन"))

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def spread(table: DataFrame) -> DataFrame:
    """Dealt over the cores where a scan has fewer tasks than half of them: a file of one row group can't be split by size, and the patterns that follow cost far more than the shuffle of its texts. A table of many files or row groups is left as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() * 2 <= cores else table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Source and derived target: the class of doc_id modulo 7 decides what was done to the text."""
    t, k = F.col("text"), F.col("doc_id") % 7
    target = (
        F.when(k == 0, "").when(k == 1, t).when(k == 2, F.regexp_replace(t, "[0-9]", "")).when(k == 3, F.translate(t, "0123456789", T.DEVANAGARI_DIGITS))
        .when(k == 4, F.concat(F.lit("<b>"), F.expr("left(text, length(text) div 3)"))).when(k == 5, F.concat(F.lit("म "), t, F.lit(" "), t, F.lit(" "), t)).otherwise(F.concat(F.lit("म "), t))
    )
    return spread(docs(spark, d).select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", t.alias("src"), target.alias("tgt"))


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


def n(c: Column) -> Column:
    return c.cast("long")


@query(f"with {S.LINES} select page_no, lang, source, block_index, text from lines")
def block_lines(spark, d):
    """Non-blank lines as numbered blocks."""
    return assemble.line_blocks(docs(spark, d)).withColumn("block_index", n(F.col("block_index")))


@query(f"with {S.LINES} select page_no, block_index, left(sha256(page_no || '|' || block_index || '|' || text), 32) as id from lines")
def block_ids(spark, d):
    """Content addresses of blocks."""
    b = block_lines(spark, d)
    return b.select("page_no", "block_index", T.block_id(F.col("page_no"), F.col("block_index"), F.col("text")).alias("id"))


@query(f"select doc_id, {S.collapsed('text')} as text from documents")
def collapse_ws(spark, d):
    """White space collapsed."""
    return docs(spark, d).select("doc_id", T.collapse(F.col("text")).alias("text"))


@query(f"select doc_id, {S.strip('regexp_replace(nfc_normalize(' + S.typographic('text') + "), '[ \\t]+', ' ', 'g')")} as text from documents")
def normalise_text(spark, d):
    """Ligatures, quotes, composition and blanks."""
    return docs(spark, d).select("doc_id", T.normalise(F.col("text")).alias("text"))


@query("select page_id, md5(regexp_replace(html, '</?[ib]>', '', 'g')) as stripped_md5, length(regexp_replace(html, '</?[ib]>', '', 'g')) as n from pages")
def strip_tags(spark, d):
    """Emphasis tags removed."""
    s = T.strip_markup(F.col("html"))
    return pages(spark, d).select("page_id", F.md5(s.cast("binary")).alias("stripped_md5"), n(F.length(s)).alias("n"))


@query(f"select page_id, {S.count_of('html', '<i>')} as i_open, {S.count_of('html', '</i>')} as i_close, {S.count_of('html', '<b>')} as b_open, {S.count_of('html', '</b>')} as b_close, {S.unbalanced('html', 'i')} or {S.unbalanced('html', 'b')} as unbalanced from pages")
def tag_balance(spark, d):
    """Emphasis tags counted and held against each other."""
    h = F.col("html")
    counts = [n(T.count_of(h, f"<{s}{t}>")).alias(f"{t}_{'close' if s else 'open'}") for t in ("i", "b") for s in ("", "/")]
    return pages(spark, d).select("page_id", *counts, (T.unbalanced(h, "i") | T.unbalanced(h, "b")).alias("unbalanced"))


def _html_sql() -> str:
    t = "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    for tag in ("i", "/i", "b", "/b"):
        t = f"replace({t}, '&lt;{tag}&gt;', '<{tag}>')"
    return f"select page_id, md5('<p>' || {t} || '</p>') as html_md5, length('<p>' || {t} || '</p>') as n from pages"


@query(_html_sql())
def html_escape(spark, d):
    """Escaped markup with emphasis kept."""
    h = T.to_html(F.col("html"))
    return pages(spark, d).select("page_id", F.md5(h.cast("binary")).alias("html_md5"), n(F.length(h)).alias("n"))


@query(f"select doc_id, {S.joined(S.numbers('text'))} as numbers from documents")
def numbers_in(spark, d):
    """Numbers of each text."""
    return docs(spark, d).select("doc_id", joined(T.numbers_in(F.col("text"))).alias("numbers"))


@query(f"with {S.PAIRS} select doc_id, {S.latinised('tgt')} as text, regexp_matches(tgt, '[०-९]') as had_digits, regexp_matches(tgt, '[ऀ-ॿ]') as devanagari from pairs")
def latinise_digits(spark, d):
    """Devanagari digits made Latin."""
    t = F.col("tgt")
    return pairs(spark, d).select("doc_id", T.latinise_digits(t).alias("text"), T.has_devanagari_digits(t).alias("had_digits"), T.has_devanagari(t).alias("devanagari"))


@query(f"select doc_id, len({S.translatable('text')}) as n, {S.joined(S.translatable('text'))} as words from documents")
def translatable_words(spark, d):
    """Lower-case words of three and more letters."""
    w = T.translatable_words(F.col("text"))
    return docs(spark, d).select("doc_id", n(F.size(w)).alias("n"), joined(w).alias("words"))


@query(f"with {S.LINES} select page_no, block_index, len({S.title_words('text')}) as n_words, {S.is_title('text')} as title, {S.is_prose('text')} as prose from lines")
def looks_like_title(spark, d):
    """Title and prose predicates of each block."""
    t = F.col("text")
    return block_lines(spark, d).select("page_no", "block_index", n(F.size(T.title_words(t))).alias("n_words"), T.looks_like_title(t).alias("title"), T.is_prose(t).alias("prose"))


@query(f"select doc_id, {S.joined(S.nouns('text'))} as nouns from documents")
def proper_nouns(spark, d):
    """Likely names of each text."""
    return spread(docs(spark, d).select("doc_id", "text")).select("doc_id", joined(T.proper_nouns(F.col("text"))).alias("nouns"))


@query(f"select distinct unnest({S.lexicon_words('text')}) as word from documents")
def lexicon(spark, d):
    """Every lower-case word of the corpus."""
    return rules.lexicon(spread(docs(spark, d).select("doc_id", "text")))


@query(f"""with lex as (select distinct unnest({S.lexicon_words('text')}) as word from documents), nn as (select doc_id, unnest({S.nouns('text')}) as noun from documents)
select doc_id, noun from nn where lower(noun) not in (select word from lex) and regexp_replace(lower(noun), '^[''’s]+|[''’s]+$', '', 'g') not in (select word from lex)""")
def unknown_tokens(spark, d):
    """Names that the lexicon doesn't have."""
    t = spread(docs(spark, d).select("doc_id", "text"))
    return rules.unknown_nouns(t, rules.lexicon(t))


@query("""with t as (select *, lead(role) over w as next_role, lead(text) over w as tgt from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, text as src, tgt from t where role = 'user' and next_role = 'assistant'""")
def qa_pairs(spark, d):
    """A user's turn and the assistant's answer right after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = spark.read.parquet(f"{d}/conversations.parquet").withColumns({"next_role": F.lead("role").over(w), "tgt": F.lead("text").over(w)})
    return t.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("src"), "tgt")


def _findings_sql() -> str:
    terms = " or ".join(f"({S.has_term('src', en)} and not contains(tgt, '{mr}'))" for en, mr in TERMS)
    lost = f"len(list_filter({S.raw_numbers('src')}, lambda x: not list_contains({S.numbers('tgt')}, x))) > 0"
    lacking = "regexp_replace(lower(x), '^[''’s]+|[''’s]+$', '', 'g')"
    dropped = "(not title and len(list_filter(names, lambda x: not contains(tgt, x))) > 2)"
    tests = [
        "bare = ''", f"prose and not regexp_matches(tgt, '[ऀ-ॿ]')", f"prose and bare = {S.strip('src')}", lost, "regexp_matches(tgt, '[०-९]')",
        f"{S.unbalanced('raw', 'i')} or {S.unbalanced('raw', 'b')}", dropped, terms,
        "length(src) > 120 and length(tgt) * 100 < length(src) * 45", "length(src) > 120 and length(tgt) * 10 > length(src) * 22",
    ]
    rows = " union all ".join(f"select doc_id, {k} as rule_no, '{rules.KINDS[k - 1]}' as kind from base where ({t})" + (" and bare <> ''" if k > 1 else "") for k, t in enumerate(tests, 1))
    return f"""with {S.PAIRS}, lex as (select distinct unnest({S.lexicon_words('src')}) as word from pairs),
nouns as (select doc_id, unnest({S.nouns("coalesce(src, '')")}) as x from pairs),
named as (select doc_id, list(x) as names from nouns where not exists (select 1 from lex where word = lower(x)) and not exists (select 1 from lex where word = {lacking}) group by doc_id),
stripped as (select doc_id, lang, source, coalesce(src, '') as src, coalesce(tgt, '') as raw, regexp_replace(coalesce(tgt, ''), '</?[ib]>', '', 'g') as tgt from pairs),
base as (select s.*, coalesce(names, []) as names, {S.strip('tgt')} as bare, {S.is_prose('src')} as prose, {S.is_title('src')} as title from stripped s left join named using (doc_id)), found as ({rows})"""


def _found(spark, d) -> DataFrame:
    """Findings, proper nouns held against the corpus's own lexicon."""
    p = pairs(spark, d)
    words = rules.lexicon(p, "src")
    named = rules.unknown_nouns(p.select("doc_id", F.coalesce("src", F.lit("")).alias("text")), words).groupBy("doc_id").agg(F.collect_list("noun").alias("names"))  # of one text
    return rules.findings(p.join(named, "doc_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>"))), TERMS)


@query(_findings_sql() + " select doc_id, rule_no, kind from found")
def integrity_findings(spark, d):
    """All rules over all pairs: a row for each finding."""
    return _found(spark, d)


@query(_findings_sql() + """ select p.doc_id, count(kind) as n_findings, count(kind) = 0 as passed, coalesce(string_agg(kind, ',' order by kind), '') as kinds
from (select doc_id from pairs) p left join found using (doc_id) group by p.doc_id""")
def qa_rollup(spark, d):
    """Verdict on each document; clean ones too."""
    return rules.rollup(_found(spark, d), docs(spark, d).select("doc_id"))


@query(f"""with {S.PAIRS} select doc_id, {S.joined(f"list_filter({S.raw_numbers('src')}, lambda x: not list_contains({S.numbers('tgt')}, x))")} as lost from pairs
where len(list_filter({S.raw_numbers('src')}, lambda x: not list_contains({S.numbers('tgt')}, x))) > 0""")
def number_lost(spark, d):
    """Numbers that the target has nowhere, repeats kept."""
    return pairs(spark, d).select("doc_id", rules.lost_numbers(F.col("src"), F.col("tgt")).alias("l")).where(F.size("l") > 0).select("doc_id", joined(F.col("l")).alias("lost"))


@query(f"with {S.PAIRS} select doc_id from pairs where {S.is_prose('src')} and {S.strip('tgt')} = {S.strip('src')}")
def untranslated(spark, d):
    """Prose whose target equals it."""
    return pairs(spark, d).where(T.is_prose(F.col("src")) & (T.strip(F.col("tgt")) == T.strip(F.col("src")))).select("doc_id")


@query(f"with {S.PAIRS} select doc_id, case when length(tgt) * 100 < length(src) * 45 then 'short' when length(tgt) * 10 > length(src) * 22 then 'long' else 'fine' end as verdict from pairs where length(src) > 120")
def length_ratio(spark, d):
    """Length of the target against the source's."""
    s, t = F.length("src"), F.length("tgt")
    return pairs(spark, d).where(s > 120).select("doc_id", F.when(t * 100 < s * 45, "short").when(t * 10 > s * 22, "long").otherwise("fine").alias("verdict"))


@query(f"with {S.PAIRS} " + " union all ".join(f"select doc_id, '{en}' as english from pairs where {S.has_term('src', en)} and not contains(tgt, '{mr}')" for en, mr in TERMS))
def glossary_miss(spark, d):
    """Terms whose rendering is missing, by a join on the term's first word."""
    terms = spark.createDataFrame(list(TERMS), "english string, target string")
    return rules.glossary_misses(pairs(spark, d), terms)


@query(f"with {S.PAIRS} " + " union all ".join(f"select doc_id, '{en}' as term, '{mr}' as expected from pairs where coalesce(tgt, '') <> '' and contains(lower(src), '{en}') and not contains(tgt, '{mr}')" for en, mr in TERMS))
def substring_flags(spark, d):
    """The older, looser glossary check: terms anywhere in the text."""
    return rules.substring_misses(pairs(spark, d), list(TERMS))


_CLEAN = "regexp_replace(html || chr(7) || chr(127) || 'x', '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]', '', 'g')"


@query(f"select page_id, md5({_CLEAN}) as text_md5, length({_CLEAN}) as n from pages")
def sanitise(spark, d):
    """Control characters removed from whole pages."""
    t = T.without_controls(F.concat("html", F.lit("\x07\x7fx")))
    return pages(spark, d).select("page_id", F.md5(t.cast("binary")).alias("text_md5"), n(F.length(t)).alias("n"))


@query(f"""with {S.LINES} select page_no, block_index, contains(text, '```') or regexp_matches(text, '[{{}}]') or len(list_filter({S.words('text')}, lambda w: regexp_full_match(w, '[a-z]+[A-Z][a-z]+'))) > 0
or regexp_matches(text, '^{S.BLANK}*<[^>]+>{S.BLANK}*$') as code from lines""")
def code_bypass(spark, d):
    """Blocks that look like code."""
    return block_lines(spark, d).select("page_no", "block_index", T.is_code(F.col("text")).alias("code"))


@query("""select conv_id, turn, coalesce(nullif(regexp_extract('Sure: {"answer": "' || conv_id || '-' || turn || '"} done', '(?s)\\{.*\\}'), '')::json ->> '$.answer', text) as answer from conversations where turn % 2 = 0
union all select conv_id, turn, text from conversations where turn % 2 <> 0""")
def json_salvage(spark, d):
    """A field of the JSON object within a chatty answer, else the draft."""
    from ..operators.jobs import salvage

    chatty = F.concat(F.lit('Sure: {"answer": "'), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit('"} done'))
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return c.select("conv_id", "turn", salvage(F.when(F.col("turn") % 2 == 0, chatty), F.col("text"), "answer").alias("answer"))


@query(f"""with {S.LINES} select page_no, block_index, case when length(flat) <= 40 then flat else left(flat, 40) || '…' end as short
from (select *, trim(regexp_replace(text, '{S.BLANK}+', ' ', 'g'), ' ') as flat from lines)""")
def short_form(spark, d):
    """Blocks cut to forty characters for reports."""
    return block_lines(spark, d).select("page_no", "block_index", T.shortened(F.col("text")).alias("short"))


@query(f"""with {S.LINES}, v as (select *, length(text) as n from lines)
select page_no, block_index, case when n >= 12 then substr(text, 1, 2) || '<i>' || substr(text, 3, 3) || '</i>' || substr(text, 6, 2) || '<i><b>' || substr(text, 8, 4) || '</b></i>' || substr(text, 12) else text end as marked from v""")
def apply_markup(spark, d):
    """Styled runs as tags; an overlapping and an empty run are left out."""
    b = block_lines(spark, d)
    run = lambda s, e, i, bold: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(i).alias("i"), F.lit(bold).alias("b"))
    runs = F.when(F.length("text") >= 12, F.array(run(7, 11, True, True), run(2, 5, True, False), run(3, 6, False, True), run(8, 8, True, False))).otherwise(F.array().cast(M.RUNS))
    return b.select("page_no", "block_index", M.apply_markup(F.col("text"), runs).alias("marked"))


@query(f"""with {S.PAIRS}, cut as (select doc_id, left(tgt, 60) as h, substr(tgt, 61) as t, {S.count_of('left(tgt, 60)', '<b>')} > {S.count_of('left(tgt, 60)', '</b>')} as open from pairs)
select doc_id, case when open then h || '</b>' else h end as head, md5(case when open then '<b>' || t else t end) as tail_md5 from cut""")
def close_tags(spark, d):
    """Emphasis closed before a cut and opened after it."""
    got = pairs(spark, d).select("doc_id", M.close_open_tags(F.left("tgt", F.lit(60)), F.expr("substring(tgt, 61)")).alias("c"))
    return got.select("doc_id", "c.head", F.md5(F.col("c.tail").cast("binary")).alias("tail_md5"))


#: Starts of words whose tags stand within a cluster, but for the last.
_SPLIT = ("<b>त</b>ुळस ", "<i>क</i>्षेत्र ", "<b>स</b>्त्र<i>ी</i> ", "<b>घर</b> ")
#: Marks, and what a virama joins, in a dialect without lookbehind.
_TAIL = "((?:\\x{094D}+[^\\x{094D}<]|[\\p{Mn}\\p{Mc}])+)"


def _split_sql() -> str:
    case = " ".join(f"when {k} then '{w}'" for k, w in enumerate(_SPLIT))
    return f"""with {S.PAIRS}, t as (select doc_id, case doc_id % {len(_SPLIT)} {case} end || tgt as t from pairs),
s as (select doc_id, t, regexp_replace(t, '(?s)(</?[ib]>){_TAIL}', '\\2\\1', 'g') as s from t)
select doc_id, left(s, 30) as start, md5(s) as snapped_md5, s <> t as moved from s"""


@query(_split_sql())
def snap_clusters(spark, d):
    """Tags set inside a cluster move behind it; clean tags stay."""
    starts = F.array(*map(F.lit, _SPLIT))
    t = F.concat(F.element_at(starts, (F.col("doc_id") % len(_SPLIT) + 1).cast("int")), "tgt")
    s = M.snap_to_clusters(t)
    return pairs(spark, d).select("doc_id", F.left(s, F.lit(30)).alias("start"), F.md5(s.cast("binary")).alias("snapped_md5"), (s != t).alias("moved"))
