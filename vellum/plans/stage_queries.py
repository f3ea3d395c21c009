"""Queries of the extract stage over nested pages, and of the stages around a model, run against local providers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as T
from ..operators import assemble, checks, corpus, jobs, layout, overview, stages, state, structure
from ..sources import tables
from . import sql as S
from .table_queries import _BLOCKS, _BOXES, blocks, boxes, events, with_status
from .text_queries import docs, n

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _scratch(spark, name: str) -> str:
    return tables.scratch(spark, name)


# --- nested pages: each line of a document, blank ones too, is a raw block of two lines and four spans ---

#: The end of a block's first line, by the block's number modulo 4.
_ENDS = ("", "-", "--", " \t")

_RAW = f"""spans as (select doc_id as page_no, pos, line, case when pos % 7 = 5 then 1 else 0 end as kind, left(line, length(line) // 3) as a,
    substr(line, length(line) // 3 + 1, length(line) // 3) || case pos % 4 {" ".join(f"when {k} then '{e}'" for k, e in enumerate(_ENDS))} end as b, substr(line, 2 * (length(line) // 3) + 1) as c
    from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)),
plain as (select page_no, pos, kind, {S.typographic('a')} as a, {S.typographic('b')} as b, {S.typographic('left(c, length(c) // 2)')} as c1, {S.typographic('substr(c, length(c) // 2 + 1)')} as c2 from spans),
joins as (select *, a || b as l1, c1 || c2 as l2 from plain),
raw as (select *, case when l1 = '' then l2 when ends_with(l1, '-') and not ends_with(l1, '--') then left(l1, length(l1) - 1) || l2 else l1 || ' ' || l2 end as raw,
    case when l1 = '' then 0 when ends_with(l1, '-') and not ends_with(l1, '--') then length(l1) - 1 else length(l1) + 1 end as at2,
    case when ends_with(l1, '-') and not ends_with(l1, '--') then length(l1) - 1 else length(l1) end as end1 from joins),
flat as (select *, {S.collapsed('raw')} as text, case when regexp_matches(raw, '^[ \\t\\r\\n]') then 1 else 0 end as lead from raw),
kept as (select *, row_number() over (partition by page_no order by pos) - 1 as block_index, length(text) as n from flat where kind = 0 and regexp_matches(text, '[^\\x20\\x09-\\x0D]'))"""


def _place(at: str) -> str:
    return f"greatest(0, least(length(regexp_replace(left(raw, {at}::int), '[ \\t\\r\\n]+', ' ', 'g')) - lead, n))"


_RUNS = f"""{_RAW}, runs as (select *, {_place('length(a)')} as i0, {_place('end1')} as i1, {_place('at2')} as b0, {_place('length(raw)')} as b1 from kept),
sized as (select page_no, pos, unnest([case when a <> '' then 10.0 end, case when b <> '' then 12.0 end, case when c1 <> '' then case when page_no % 2 = 0 then 12.0 else 9.5 end end, case when c2 <> '' then 9.5 end]) as s from kept),
size as (select page_no, pos, max(s) as size_max, min_by(s, (-k, s)) as size from (select page_no, pos, s, count(*) as k from sized where s is not null group by all) group by all)"""


def raw_pages(spark, d: str) -> DataFrame:
    """page_no and nested raw blocks, as a document reader gives them."""
    third = F.expr("length(line) div 3")
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("pos") % 4 + 1).cast("int"))
    lines = docs(spark, d).select(F.col("doc_id").alias("page_no"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumns({"a": F.left("line", third), "b": F.concat(F.substring("line", third + 1, third), end), "c": F.substring("line", third * 2 + 1, F.length("line"))})
    half = F.expr("length(c) div 2")

    def span(text, size, flags=0, font="Serif"):
        return F.struct(text.alias("text"), F.lit(size).cast("double").alias("size") if isinstance(size, float) else size.cast("double").alias("size"), F.lit(flags).alias("flags"), F.lit(font).alias("font"))

    first = F.struct(F.array(span(F.col("a"), 10.0), span(F.col("b"), 12.004, 2)).alias("spans"))
    second = F.struct(F.array(span(F.left("c", half), F.when(F.col("page_no") % 2 == 0, 12.0).otherwise(9.5), 16), span(F.substring("c", half + 1, F.length("c")), 9.5, 0, "Serif-Bold")).alias("spans"))
    box = F.struct(*(c.cast("double").alias(k) for k, c in (("x0", 72 + F.col("pos") % 4 * 0.25 + 0.001), ("y0", 72 + F.col("pos") * 14), ("x1", F.lit(540)), ("y1", 85 + F.col("pos") * 14))))
    block = F.struct((F.col("pos") % 7 == 5).cast("int").alias("type"), box.alias("bbox"), F.array(first, second).alias("lines"))
    return lines.groupBy("page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))), lambda x: x.block).alias("blocks"))  # of one document


@query(f"""with {_RUNS} select page_no, block_index, round(72 + pos % 4 * 0.25, 2)::double as x0, md5(nfc_normalize(text)) as text_md5, n, size::double as size, size_max::double as size_max,
concat_ws(',', case when i1 > i0 then i0 || '-' || i1 || '-i' end, case when b1 > b0 then b0 || '-' || b1 || '-b' end) as runs from runs join size using (page_no, pos)""")
def page_blocks(spark, d):
    """Blocks of nested pages: images and blank ones out, spans and lines joined, the dominant size, styled runs merged."""
    b = assemble.page_blocks(raw_pages(spark, d))
    style = lambda r: F.concat(F.when(r.i, F.lit("i")).otherwise(F.lit("")), F.when(r.b, F.lit("b")).otherwise(F.lit("")))
    runs = F.array_join(F.transform("style.runs", lambda r: F.concat_ws("-", r.start.cast("string"), r.end.cast("string"), style(r))), ",")
    return b.select("page_no", n(F.col("block_index")).alias("block_index"), "x0", F.md5(F.col("source_text").cast("binary")).alias("text_md5"), n(F.length("source_text")).alias("n"), "style.size", "style.size_max", runs.alias("runs"))


@query(f"""with {_RUNS}, m as (select page_no, block_index, left(text, i0) || case when i1 > i0 then '<i>' || substr(text, i0 + 1, i1 - i0) || '</i>' else '' end
    || substr(text, greatest(i0, i1) + 1, b0 - greatest(i0, i1)) || case when b1 > b0 then '<b>' || substr(text, b0 + 1, b1 - b0) || '</b>' else '' end || substr(text, greatest(b0, b1, i1) + 1) as t from runs)
select page_no, block_index, md5(t) as marked_md5, length(t) as n from m""")
def styled_blocks(spark, d):
    """Blocks of nested pages with their runs as tags."""
    b = assemble.page_blocks(raw_pages(spark, d))
    t = M.apply_markup(F.col("source_text"), F.col("style.runs"))
    return b.select("page_no", n(F.col("block_index")).alias("block_index"), F.md5(t.cast("binary")).alias("marked_md5"), n(F.length(t)).alias("n"))


@query("""with w as (select doc_id, text, length(text) // 4 as q from documents)
select doc_id, case when q > 0 then '0-' || 2 * q || '-i,' || 3 * q || '-' || length(text) || '-b' else '0-' || length(text) || '-b' end as runs from w where length(text) > 0""")
def merged_runs(spark, d):
    """Runs of one style that touch, given out of order, become one."""
    q, m = F.expr("length(text) div 4"), F.length("text")
    run = lambda s, e, i, b: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(i).alias("i"), F.lit(b).alias("b"))
    runs = F.filter(F.array(run(q, q * 2, True, False), run(q * 3, m, False, True), run(F.lit(0), q, True, False)), lambda r: r.end > r.start)
    text = F.array_join(F.transform(M.merge_runs(runs), lambda r: F.concat_ws("-", r.start.cast("string"), r.end.cast("string"), F.when(r.i, F.lit("i")).otherwise(F.lit("b")))), ",")
    return docs(spark, d).where(m > 0).select("doc_id", text.alias("runs"))


@query("""select doc_id, 'p { font-size: ' || (8 + doc_id % 5) || 'px; line-height: 1.30; text-align: ' || case when doc_id % 3 = 0 then 'center' else 'justify' end || '; }' as css from documents""")
def style_sheets(spark, d):
    """The style of each page's text."""
    k = F.col("doc_id")
    return docs(spark, d).select("doc_id", M.css(8 + k % 5, F.when(k % 3 == 0, F.lit("center")).otherwise(F.lit("justify"))).alias("css"))


# --- stages around a model ---


@query(f"""with {_BLOCKS}, ready as (select page_no from blocks group by page_no having bool_and(coalesce(draft, '') <> '') and bool_or(final is null))
select page_no, block_index, md5(coalesce(case when page_no in (select page_no from ready) then 'म ' || draft else final end, '')) as final_md5,
case when page_no in (select page_no from ready) or final is not null then 'final' when draft is not null then 'drafted' else 'pending' end as status from blocks""")
def review_pages(spark, d):
    """Pages that are ready are reviewed, validated and made final; the rest stay."""
    b = with_status(blocks(spark, d))
    got = stages.review(b, docs(spark, d).select(F.col("doc_id").alias("page_no"), F.col("lang").alias("chapter")), jobs.Echo(), _scratch(spark, "reviews"))
    return got.select("page_no", "block_index", F.md5(F.coalesce("final", F.lit("")).cast("binary")).alias("final_md5"), "status")


@query(f"""with {_BLOCKS} select page_no, count(*) as n_blocks, bool_and(draft is not null or page_no in (select page_no from blocks where draft is null)) as drafted,
md5(string_agg(case when page_no in (select page_no from blocks where draft is null) then 'म ' || text else draft end, chr(10) order by block_index)) as drafts_md5 from blocks group by page_no""")
def draft_pages(spark, d):
    """Pages with an undrafted block are translated whole; others keep their drafts."""
    got = stages.translate(with_status(blocks(spark, d)), docs(spark, d).select(F.col("doc_id").alias("page_no"), F.col("lang").alias("chapter")), jobs.Echo(), _scratch(spark, "drafts"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_index", "draft"))), lambda x: x.draft), "\n")  # of one page
    return got.groupBy("page_no").agg(F.count("*").alias("n_blocks"), F.bool_and(F.col("draft").isNotNull()).alias("drafted"), F.md5(texts.cast("binary")).alias("drafts_md5"))


_LOCKED = "locked as (select distinct r_name as english, 'म' as target, 'region' as kind from region)"


@query(f"""with found as (select doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{{6,}}')) as w, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{{6,}}'), 1) as k from documents), {_LOCKED},
first as (select lower(w) as key, min_by(w, (doc_id, k)) as english from found group by 1)
select coalesce(l.english, f.english) as english, coalesce(l.target, 'म ' || f.english) as target, coalesce(l.kind, 'word') as kind, l.english is not null as locked from first f full join locked l on lower(l.english) = f.key""")
def extracted_glossary(spark, d):
    """Terms of every document by a provider, the first spelling of each, locked ones over them."""
    locked = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("english"), F.lit("म").alias("target"), F.lit("region").alias("kind"))
    return stages.extract_terms(docs(spark, d).select(F.col("doc_id").alias("section"), "text"), locked, stages.Capitals(), _scratch(spark, "terms")).select("english", "target", "kind", "locked")


@query("""select doc_id as no, case when length(text) < 400 then '' else left(text, 60) end as summary from documents where text is not null and trim(left(text, 60), ' ' || chr(9) || chr(10)) <> ''""")
def chapter_summaries(spark, d):
    """Summaries of chapters that are long enough."""
    t = docs(spark, d).where(T.strip(F.left("text", F.lit(60))) != "").select(F.col("doc_id").alias("no"), F.col("doc_id").cast("string").alias("chapter"), "text")
    return stages.summaries(t, stages.Opening(), _scratch(spark, "summaries")).select("no", "summary")


@query("select p_partkey as idx, 'म ' || p_name as title from part")
def outline_titles(spark, d):
    """Outline entries with translated titles."""
    entries = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("title"))
    return stages.outline(entries, jobs.Echo(), _scratch(spark, "titles"))


@query(f"""with {S.PAIRS} select doc_id as page_no, 'empty' as kind, 'high' as severity, lang as detail from pairs where tgt = ''
union all select doc_id, 'crowded', 'high', length(text)::varchar from documents where length(text) > 4000""")
def vision_findings(spark, d):
    """Automated findings, and a reviewer's remarks worth acting on."""
    from .text_queries import pairs

    auto = pairs(spark, d).where("tgt = ''").select(F.col("doc_id").alias("page_no"), F.lit("empty").alias("kind"), F.lit("high").alias("severity"), F.col("lang").alias("detail"))
    return stages.vision_findings(docs(spark, d).select(F.col("doc_id").alias("page_no"), "text"), stages.Lengths(), _scratch(spark, "remarks"), auto)


# --- checks and scans without a query so far ---


@query(f"""with recursive {_BOXES}, edge as (select page_no, max(x1) as edge from box group by page_no),
o as (select b.*, edge, row_number() over (partition by page_no order by round(y0, 1), x0) as r, abs((x0 + x1) / 2 - 306) < 6 and x1 - x0 < (edge - x0) * 0.92 and y1 - y0 < size * 3 as centred, trim(text, ' ') as src from box b join edge using (page_no)),
g as (select page_no, r, 0 as group_no, x0, x1, y1, size, src, centred from o where r = 1
  union all select page_no, r, case when joins then group_no else group_no + 1 end, case when joins then least(px0, x0) else x0 end, case when joins then greatest(px1, x1) else x1 end, y1, case when joins then psize else size end, src, case when joins then pcentred else centred end
  from (select o.*, g.group_no, g.x0 as px0, g.x1 as px1, g.size as psize, g.centred as pcentred,
      least(g.x1, o.x1) - greatest(g.x0, o.x0) > 1 and abs(g.size - o.size) < 0.15 and o.y0 - g.y1 >= g.size * -0.7 and o.y0 - g.y1 <= g.size * 0.9 and g.src <> ''
      and not regexp_matches(g.src, '(?:[.!?:;”’…]|[.!?]"|\\.'')$') and g.x1 >= o.edge - greatest(g.size * 1.2, 12) and not g.centred and not o.centred as joins from g join o on o.page_no = g.page_no and o.r = g.r + 1)),
u as (select g.page_no, g.group_no, string_agg(trim(o.text, ' '), ' ' order by g.r) as src from g join o using (page_no, r) group by all),
t as (select *, case page_no % 3 when 0 then src when 1 then 'xx' else 'म ' || src end as tgt from u where {S.is_prose('src')})
select page_no, group_no, 'no_devanagari' as kind from t where not regexp_matches(tgt, '[ऀ-ॿ]') union all select page_no, group_no, 'passthrough' from t where {S.strip('tgt')} = {S.strip('src')}""")
def untranslated_paragraphs(spark, d):
    """Merged paragraphs of prose that were left as they were."""
    b = boxes(spark, d).select("page_no", F.col("block_index").cast("int").alias("block_index"), "x0", "y0", "x1", "y1", "size", F.col("text").alias("src"), "text")
    g = layout.merged_paragraphs(b).select("page_no", "group_no", F.col("text").alias("source"))
    k = F.col("page_no") % 3
    return stages.untranslated_paragraphs(g.withColumn("text", F.when(k == 0, F.col("source")).when(k == 1, "xx").otherwise(F.concat(F.lit("म "), "source")))).withColumn("group_no", F.col("group_no").cast("int"))


@query(f"""with {S.PAIRS}, s as (select distinct lang, doc_id, unnest({S.raw_numbers('src')}) as x from pairs), t as (select distinct doc_id, unnest({S.numbers("replace(tgt, '7', '')")}) as x from pairs)
select lang, min(doc_id) as page_no, min_by(x, (doc_id, x)) as detail from s anti join t using (doc_id, x) group by lang""")
def first_lost_number(spark, d):
    """The earliest page of each language that lost a number, and the first such number."""
    from .text_queries import pairs

    p = pairs(spark, d)
    src = p.select("lang", F.col("doc_id").alias("page_no"), F.explode(T.raw_numbers_in(F.col("src"))).alias("detail")).distinct()
    tgt = p.select(F.col("doc_id").alias("page_no"), F.explode(T.numbers_in(F.replace("tgt", F.lit("7"), F.lit("")))).alias("detail")).distinct()
    return checks.first_failure(src.join(tgt, ["page_no", "detail"], "left_anti"), "lang")


@query(f"with {_BLOCKS} select page_no, case when bool_and(final is not null) then 'final' else 'open' end as status from blocks group by page_no")
def page_status(spark, d):
    """Status set on pages whose blocks are all final."""
    b = blocks(spark, d)
    pages = b.select("page_no").distinct().withColumn("status", F.lit("open"))
    return state.set_page(pages, state.all_final(b).withColumn("value", F.lit("final")), "status")


@query("select doc_id, lang, n_chars from documents where doc_id >= 3 order by doc_id limit 15")
def first_pages(spark, d):
    """The first fifteen rows in order (a limit that is the feature)."""
    return overview.first_rows(docs(spark, d).where("doc_id >= 3").select("doc_id", "lang", "n_chars"), "doc_id")


@query(f"select doc_id from documents where regexp_matches(text, '[^\\x20\\x09-\\x0D]')")
def text_pages(spark, d):
    """Pages with text."""
    return overview.text_pages(docs(spark, d)).select("doc_id")


@query("""with r as (select n_nationkey as page_no, n_name as font, row_number() over (order by n_nationkey) - 1 as r, count(*) over () as n from nation), s as (select * from r where r % greatest(1, n // 7) = 0 and r // greatest(1, n // 7) < 7)
select bool_or(contains(font, 'A')) as passed, string_agg(distinct font, ',' order by font) as fonts from s""")
def sampled_fonts(spark, d):
    """Fonts on a sample of seven pages (a limit that is the feature)."""
    p = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("page_no"), F.col("n_name").alias("font"), F.lit(0).alias("g"))
    return checks.font_faces(structure.every_kth(p, "page_no", 7, "g"), "A")


@query("select event_id, coalesce(nullif(props, ''), event_type) as text from events where coalesce(nullif(props, ''), nullif(event_type, '')) is not null")
def fallback_texts(spark, d):
    """A text, else what stands in for it; rows with neither are left out."""
    return overview.fallback(events(spark, d).select("event_id", "props", "event_type"), "props", "event_type").select("event_id", "text")


@query("""select user_id, count(*) filter (event_type = 'error') as failures, sum(event_id % 4) filter (event_type <> 'error') as continuations from events group by 1""")
def page_counters(spark, d):
    """Failures and continuation pages of each book."""
    e = events(spark, d).select("user_id", (F.col("event_type") == "error").alias("failed"), F.when(F.col("event_type") != "error", F.col("event_id") % 4).alias("n_extra"))
    return overview.counters(e, "user_id")


@query("""select c_custkey as id, c_name as name from customer where c_custkey % 2 = 0 union all select c_custkey, min_by(case when k = 0 then upper(c_name) else lower(c_name) end, (c_custkey + k) % 2) from customer, (values (0), (1)) v(k) where c_custkey % 3 = 0 and c_custkey % 2 <> 0 group by 1""")
def insert_first(spark, d):
    """Of new rows that repeat a key the first is added."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = c.where("id % 3 = 0")
    both = new.select("id", F.upper("name").alias("name"), (F.col("id") % 2).alias("at")).unionByName(new.select("id", F.lower("name").alias("name"), ((F.col("id") + 1) % 2).alias("at")))
    return state.insert_missing(c.where("id % 2 = 0").withColumn("at", F.lit(0).cast("long")), both, ["id"], "at").select("id", "name")


_KIND = "case block_index % 6 when 1 then 'image_ref' when 2 then 'table' when 3 then 'equation' when 4 then null else 'text' end"
_CODE = f"""(contains(t, '```') or regexp_matches(t, '[{{}}]') or len(list_filter({S.words('t')}, lambda w: regexp_full_match(w, '[a-z]+[A-Z][a-z]+'))) > 0 or regexp_matches(t, '^{S.BLANK}*<[^>]+>{S.BLANK}*$'))"""


@query(f"""with {S.LINES}, p as (select page_no, block_index, {_KIND} as kind, case when page_no % 5 = 0 then text || ' {{x}}' else text end as t from lines), c as (select *, {_CODE} as code from p)
select page_no, block_index, case when code and coalesce(kind not in ('table', 'equation'), false) then 'code_block' else kind end as type from c where coalesce(kind in ('image_ref', 'table', 'equation'), false) or code""")
def bypassed_paragraphs(spark, d):
    """Paragraphs that aren't translated; code gets a type of its own."""
    b = assemble.line_blocks(docs(spark, d)).withColumn("block_index", n(F.col("block_index")))
    k = F.col("block_index") % 6
    kind = F.when(k == 1, "image_ref").when(k == 2, "table").when(k == 3, "equation").when(k == 4, F.lit(None)).otherwise("text")
    text = F.when(F.col("page_no") % 5 == 0, F.concat("text", F.lit(" {x}"))).otherwise(F.col("text"))
    return corpus.bypassed(b.select("page_no", "block_index", kind.alias("type"), text.alias("text"))).select("page_no", "block_index", "type")
