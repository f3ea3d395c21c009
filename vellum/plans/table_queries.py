"""State, structure, layout, job and ledger queries over the driver's tables in the roles of the pipeline's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assemble, checks, corpus, glossary, jobs, layout, ledger, overview, rules, state, structure
from ..sources import files, tables
from . import sql as S
from .text_queries import TERMS, docs, n, pages, pairs

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


# --- blocks with state: drafts and finals by place ---

_BLOCKS = f"""{S.LINES}, blocks as (select page_no, lang, source, block_index, text, left(sha256(page_no || '|' || block_index || '|' || text), 32) as id,
    case when (page_no + block_index) % 5 <> 0 then 'म ' || text end as draft, case when (page_no + block_index) % 5 > 1 then case when block_index % 3 = 0 then ' म ' || text else 'म! ' || text end end as final from lines)"""


def blocks(spark, d: str) -> DataFrame:
    """Lines as blocks; a fifth has no draft, two fifths no final text."""
    b = assemble.line_blocks(docs(spark, d)).withColumn("block_index", n(F.col("block_index")))
    k, t = (F.col("page_no") + F.col("block_index")) % 5, F.col("text")
    final = F.when(F.col("block_index") % 3 == 0, F.concat(F.lit(" म "), t)).otherwise(F.concat(F.lit("म! "), t))
    return b.withColumns({"id": T.block_id(F.col("page_no"), F.col("block_index"), t), "draft": F.when(k != 0, F.concat(F.lit("म "), t)), "final": F.when(k > 1, final)})


def with_status(b: DataFrame) -> DataFrame:
    return b.withColumn("status", F.when(F.col("final").isNotNull(), "final").when(F.col("draft").isNotNull(), "drafted").otherwise("pending"))


@query(f"""with {_BLOCKS}, new as (select page_no, block_index, case when page_no % 3 = 0 then text || '!' else text end as text from blocks where page_no % 2 = 0
    union all select page_no + 1000000, block_index, text from blocks where page_no % 50 = 0),
ids as (select *, left(sha256(page_no || '|' || block_index || '|' || text), 32) as id from new),
old as (select *, case when final is not null then 'final' when draft is not null then 'drafted' else 'pending' end as status from blocks)
select coalesce(o.page_no, i.page_no) as page_no, coalesce(o.block_index, i.block_index) as block_index, coalesce(i.id, o.id) as id,
    case when i.id is null or i.id = o.id then o.draft end as draft, case when i.id is null or i.id = o.id then o.final end as final,
    case when i.id is null or i.id = o.id then o.status else 'pending' end as status from old o full join ids i on o.page_no = i.page_no and o.block_index = i.block_index""")
def upsert_invalidate(spark, d):
    """Blocks of every second page arrive anew, some changed, some on new pages."""
    old = with_status(blocks(spark, d)).select("page_no", "block_index", "id", "text", "draft", "final", "status")
    b = blocks(spark, d).select("page_no", "block_index", "text")
    changed = b.where("page_no % 2 = 0").withColumn("text", F.when(F.col("page_no") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    new = changed.unionByName(b.where("page_no % 50 = 0").withColumn("page_no", F.col("page_no") + 1_000_000))
    new = new.withColumn("id", T.block_id(F.col("page_no"), F.col("block_index"), F.col("text")))
    return state.upsert_blocks(old, new).select("page_no", "block_index", "id", "draft", "final", "status")


@query(f"with {_BLOCKS} select distinct page_no from blocks where draft is null")
def pending_pages(spark, d):
    """Pages with an undrafted block."""
    return state.pages_needing(blocks(spark, d), "draft")


@query(f"with {_BLOCKS} select page_no from blocks group by page_no having bool_and(coalesce(draft, '') <> '') and bool_or(final is null)")
def review_ready(spark, d):
    """Fully drafted pages that aren't final."""
    return state.review_ready(blocks(spark, d))


@query(f"""with {_BLOCKS} select count(*) as blocks, count(draft) as drafted, count(final) as finalised, count(*) filter (draft is null and final is null) as untranslated,
count(*) filter (final is null) as unreviewed, count(distinct page_no) as pages, round(100 * count(draft) / count(*), 1) as drafted_pct from blocks""")
def status_counts(spark, d):
    """One row of totals."""
    return state.counts(blocks(spark, d))


@query("""select user_id as page_no, event_type as kind, event_id as attempt from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as r from events) where r = 1 and value < 20""")
def latest_failures(spark, d):
    """Checks (user, kind) whose last attempt failed."""
    qa = events(spark, d).select(F.col("user_id").alias("page_no"), F.col("event_type").alias("kind"), F.col("event_id").alias("attempt"), (F.col("value") >= 20).cast("int").alias("passed"))
    return state.latest_failures(qa).select("page_no", "kind", "attempt")


@query("""select user_id as page_no, event_type as kind, max(event_id) as attempt, max_by(value, event_id) as value from events group by all""")
def replace_by_key(spark, d):
    """The row written last for each key."""
    e = events(spark, d).select(F.col("user_id").alias("page_no"), F.col("event_type").alias("kind"), F.col("event_id").alias("attempt"), "value")
    return state.last_written(e, ["page_no", "kind"], "attempt")


@query("""select c_custkey as id, c_name as name from customer where c_custkey % 2 = 0 union all select c_custkey, upper(c_name) from customer where c_custkey % 3 = 0 and c_custkey % 2 <> 0""")
def insert_missing(spark, d):
    """Rows whose key isn't there yet are added, others left."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return state.insert_missing(c.where("id % 2 = 0"), c.where("id % 3 = 0").withColumn("name", F.upper("name")), ["id"])


@query("""with old as (select n_nationkey as page_no, n_name as chapter, n_regionkey as status from nation), new as (select n_nationkey + 10 as page_no, lower(n_name) as chapter from nation)
select page_no, coalesce(new.chapter, old.chapter) as chapter, old.status from old full join new using (page_no)""")
def page_upsert(spark, d):
    """Pages overlaid by new ones; their status stays."""
    nation = spark.read.parquet(f"{d}/nation.parquet")
    old = nation.select(F.col("n_nationkey").alias("page_no"), F.col("n_name").alias("chapter"), F.col("n_regionkey").alias("status"))
    return state.overlay(old, nation.select((F.col("n_nationkey") + 10).alias("page_no"), F.lower("n_name").alias("chapter")), ["page_no"])


# --- structure ---


@query("""with m as (select user_id, ts, event_id as mark_id, 'ch' || event_id as title from events where event_type = 'signup'), e as (select user_id, ts, event_id from events where event_type <> 'signup')
select user_id, event_id, title as chapter from (select e.user_id, e.event_id, m.title, row_number() over (partition by e.event_id order by m.ts desc, m.mark_id desc) as r from e left join m on m.user_id = e.user_id and m.ts <= e.ts) where r = 1""")
def chapter_asof(spark, d):
    """Each event under the last signup of its user."""
    e = events(spark, d)
    marks = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("mark_id"), F.concat(F.lit("ch"), F.col("event_id").cast("string")).alias("title"))
    return structure.chapter_of(e.where("event_type <> 'signup'").select("user_id", "ts", "event_id"), marks, "event_id", "ts", "user_id").select("user_id", "event_id", "chapter")


@query("""with m as (select p_brand || '-' || min(p_partkey) as title, min(p_partkey) as page from part group by p_brand having min(p_partkey) > 0), r as (select title, page as start, lead(page) over (order by page) - 1 as stop from m)
select p_partkey as page_no, title as chapter from part left join r on p_partkey >= start and (stop is null or p_partkey <= stop)""")
def page_chapters(spark, d):
    """Pages under outline ranges."""
    part = spark.read.parquet(f"{d}/part.parquet")
    marks = part.groupBy("p_brand").agg(F.min("p_partkey").alias("page")).select(F.concat_ws("-", "p_brand", F.col("page").cast("string")).alias("title"), "page", F.col("page").alias("idx"))
    return structure.page_chapters(part.select(F.col("p_partkey").alias("page_no")), structure.outline_ranges(marks))


@query("""with p as (select doc_id + 1 + doc_id // 96 as page_no, text from documents), l as (select max(page_no) as m from p)
select p.page_no, case when p.page_no - 2 < 1 then '(start of book)' else coalesce(right(a.text, 700), '(no text on this page)') end as prev,
case when p.page_no + 2 > l.m then '(end of book)' else coalesce(left(b.text, 700), '(no text on this page)') end as next
from p cross join l left join p a on a.page_no = p.page_no - 2 left join p b on b.page_no = p.page_no + 2""")
def lookaround(spark, d):
    """Text two pages away on both sides; every 97th page has none."""
    p = docs(spark, d).select(F.expr("doc_id + 1 + doc_id div 96").alias("page_no"), "text")
    return structure.lookaround(p, 2, 700)


#: A chapter is a part of a language's source of a thousand pages at most.
_CHAPTER = "coalesce(lang, '(front matter)') || '/' || source || '/' || page_no // 1000"
_CHAPTERS = f"{S.LINES}, ch as (select {_CHAPTER} as chapter, string_agg(text, chr(10) || chr(10) order by page_no, block_index) as text from lines group by 1)"


def _chapter(part: bool):
    parts = [F.coalesce("lang", F.lit(jobs.FRONT)), "source", *([F.expr("page_no div 1000").cast("string")] if part else [])]
    return F.array_join(F.array(*parts), "/", "null")


@query(f"with {_CHAPTERS} select chapter, md5(text) as text_md5, length(text) as n from ch")
def chapter_text(spark, d):
    """Texts of each chapter in order."""
    got = structure.chapter_text(assemble.line_blocks(docs(spark, d)), _chapter(True))
    return got.select("chapter", F.md5(F.col("text").cast("binary")).alias("text_md5"), n(F.length("text")).alias("n"))


@query(f"""with {S.LINES}, ch as (select coalesce(lang, '(front matter)') || '/' || source as chapter, string_agg(text, chr(10) || chr(10) order by page_no, block_index) as text from lines group by 1),
p as (select *, unnest(range(0, length(text), 5000)) as pos from ch)
select case when length(text) <= 5000 then chapter else chapter || ' (' || (pos // 5000 + 1) || ')' end as chapter, pos // 5000 as chunk, substr(text, pos + 1, 5000) as text from p""")
def chunks(spark, d):
    """Chapters, here all of a language's source, cut to what a call takes."""
    return structure.chunks(assemble.line_blocks(docs(spark, d)), _chapter(False), 5000).withColumn("chunk", n(F.col("chunk")))


@query("select doc_id % 10 as book, doc_id as page_no, doc_id - 1 + coalesce(sum(length(text) // 3000) over (partition by doc_id % 10 order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as out_idx from documents")
def page_offsets(spark, d):
    """Output index after all earlier continuation pages."""
    return structure.page_offsets(_extra(spark, d), "book")


def _extra(spark, d) -> DataFrame:
    return docs(spark, d).select((F.col("doc_id") % 10).alias("book"), F.col("doc_id").alias("page_no"), F.expr("length(text) div 3000").alias("n_extra"))


@query("""with o as (select doc_id % 10 as book, doc_id as page_no, doc_id - 1 + coalesce(sum(length(text) // 3000) over (partition by doc_id % 10 order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as out_idx, length(text) // 3000 as x from documents),
w as (select *, coalesce(lead(out_idx) over (partition by book order by page_no), out_idx + x + 1) as stop from o)
select book, page_no, unnest(range(out_idx, greatest(stop, out_idx + 1))) as out_page from w""")
def vision_targets(spark, d):
    """Output pages of each source page."""
    extra = _extra(spark, d)
    mapped = structure.page_offsets(extra, "book").join(extra, ["book", "page_no"])
    return structure.vision_targets(mapped, F.col("out_idx") + F.col("n_extra") + 1, "book")


@query("""with o as (select n_nationkey as idx, n_name as title, n_nationkey * 7 as page from nation), m as (select doc_id as page_no, doc_id + length(text) // 1000 as out_idx from documents where doc_id % 3 <> 0),
t as (select n_nationkey as idx, lower(n_name) as title from nation where n_regionkey < 3)
select o.idx, coalesce(t.title, o.title) as title, coalesce(m.out_idx + 1, o.page) as page from o left join m on m.page_no = o.page left join t using (idx)""")
def outline_remap(spark, d):
    """Outline entries with translated titles and mapped pages."""
    nation = spark.read.parquet(f"{d}/nation.parquet")
    outline = nation.select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("title"), (F.col("n_nationkey") * 7).alias("page"))
    page_map = docs(spark, d).where("doc_id % 3 <> 0").select(F.col("doc_id").alias("page_no"), F.expr("doc_id + length(text) div 1000").alias("out_idx"))
    return structure.remap_outline(outline, page_map, nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("idx"), F.lower("n_name").alias("title")))


@query("select doc_id, length(text) as n from documents where doc_id in (1, 5) or doc_id between 9 and 12 or doc_id between 11 and 40")
def page_selector(spark, d):
    """Pages named by a selector."""
    chosen = structure.select_pages(spark, "1,5, 9-12,11-40,")
    return docs(spark, d).join(chosen.withColumnRenamed("page_no", "doc_id"), "doc_id", "left_semi").select("doc_id", n(F.length("text")).alias("n"))


@query("""with r as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as r, count(*) over (partition by source) as n from documents)
select source, doc_id from r where r % greatest(1, n // 7) = 0 and r // greatest(1, n // 7) < 7""")
def sample_step(spark, d):
    """At most seven pages of each source, evenly."""
    return structure.every_kth(docs(spark, d).select("source", "doc_id"), "doc_id", 7, "source")


# --- layout: boxes by integer arithmetic ---

_BOXES = f"""{S.LINES}, box as (select page_no, lang, block_index, text, (72 + case when block_index % 5 = 0 then 18 else 0 end)::double as x0, (72 + block_index * 14)::double as y0,
    least(540, 72 + case when block_index % 5 = 0 then 18 else 0 end + length(text) * 2)::double as x1, (72 + block_index * 14 + 13 + length(text) % 5)::double as y1, (10 + page_no % 3)::double as size from lines)"""


def boxes(spark, d: str) -> DataFrame:
    b = assemble.line_blocks(docs(spark, d)).withColumn("block_index", n(F.col("block_index")))
    i, m = F.col("block_index"), F.length("text")
    x0, y0 = 72 + F.when(i % 5 == 0, 18).otherwise(0), 72 + i * 14
    sizes = {"x0": x0, "y0": y0, "x1": F.least(F.lit(540), x0 + m * 2), "y1": y0 + 13 + m % 5, "size": 10 + F.col("page_no") % 3}
    return b.select("page_no", "lang", "block_index", "text", *(v.cast("double").alias(k) for k, v in sizes.items()))


_FRAME = ", ".join(f"list_sort(list({c}))[(floor({q} * (count(*) - 1)) + 1)::bigint] as {c}" for c, q in (("x0", 0.02), ("y0", 0.02), ("x1", 0.98), ("y1", 0.98)))


@query(f"with {_BOXES} select lang, {_FRAME} from box group by lang")
def doc_frame(spark, d):
    """Text boxes of each language by percentiles at the lower index."""
    return layout.document_frame(boxes(spark, d), "lang")


@query(f"""with {_BOXES}, f as (select lang, {_FRAME} from box group by lang), p as (select lang, page_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from box group by all)
select lang, page_no, least(p.x0, f.x0) as x0, least(p.y0, f.y0) as y0, greatest(p.x1, f.x1) as x1, greatest(p.y1, f.y1, least(p.y0, f.y0) + 100) as y1 from p join f using (lang)""")
def page_frame(spark, d):
    """Boxes of pages, widened by the document's."""
    b = boxes(spark, d)
    return layout.page_frames(b, layout.document_frame(b, "lang"), "lang")


@query(f"""with {_BOXES}, nxt as (select a.page_no, a.block_index, first(b.y0 order by b.y0, b.x0) as ny from box a join box b on a.page_no = b.page_no and b.y0 > a.y0 and least(a.x1, b.x1) - greatest(a.x0, b.x0) > 1 group by all)
select page_no, block_index, x0, y0, x1, greatest(case when ny < y1 then ny - 0.5 else y1 end, y0 + 1) as y1 from box left join nxt using (page_no, block_index)""")
def deoverlap(spark, d):
    """Boxes trimmed above the next one of their column."""
    return layout.deoverlapped(boxes(spark, d))


@query(f"""with recursive {_BOXES}, edge as (select page_no, max(x1) as edge from box group by page_no),
o as (select b.*, edge, row_number() over (partition by page_no order by round(y0, 1), x0) as r, abs((x0 + x1) / 2 - 306) < 6 and x1 - x0 < (edge - x0) * 0.92 and y1 - y0 < size * 3 as centred, trim(text, ' ') as src from box b join edge using (page_no)),
g as (select page_no, r, 0 as group_no, x0, y0, x1, y1, size, src, centred, block_index::varchar as indices from o where r = 1
  union all select page_no, r, case when joins then group_no else group_no + 1 end, case when joins then least(px0, x0) else x0 end, case when joins then py0 else y0 end, case when joins then greatest(px1, x1) else x1 end,
    y1, case when joins then psize else size end, src, case when joins then pcentred else centred end, case when joins then pindices || ',' || block_index else block_index::varchar end
  from (select o.*, g.group_no, g.x0 as px0, g.y0 as py0, g.x1 as px1, g.size as psize, g.centred as pcentred, g.indices as pindices,
      least(g.x1, o.x1) - greatest(g.x0, o.x0) > 1 and abs(g.size - o.size) < 0.15 and o.y0 - g.y1 >= g.size * -0.7 and o.y0 - g.y1 <= g.size * 0.9 and g.src <> ''
      and not regexp_matches(g.src, '(?:[.!?:;”’…]|[.!?]"|\\.'')$') and g.x1 >= o.edge - greatest(g.size * 1.2, 12) and not g.centred and not o.centred as joins
    from g join o on o.page_no = g.page_no and o.r = g.r + 1))
select page_no, group_no, x0, y0, x1, y1, case when centred then 'center' else 'justify' end as align, indices from (select *, row_number() over (partition by page_no, group_no order by r desc) as last from g) where last = 1""")
def merge_paragraphs(spark, d):
    """Blocks joined to paragraphs by a fold down each page."""
    b = boxes(spark, d).select("page_no", F.col("block_index").cast("int").alias("block_index"), "x0", "y0", "x1", "y1", "size", F.col("text").alias("src"), "text")
    got = layout.merged_paragraphs(b)
    return got.select("page_no", "group_no", "x0", "y0", "x1", "y1", "align", F.array_join("indices", ",").alias("indices"))


def rects(spark, d: str) -> DataFrame:
    """Four thin rules for each group of four lines, some of them a solid block."""
    b = assemble.line_blocks(docs(spark, d)).select("page_no", F.col("block_index").alias("i"))
    box, side = F.expr("i div 4"), F.col("i") % 4
    x, y = 72 + (box % 2) * 200, 72 + F.expr("i div 8") * 60
    solid = (F.col("page_no") + box) % 5 == 0
    t = F.when(solid, 9).otherwise(1)
    x0 = F.when(side == 1, x + 149).otherwise(x)
    y0 = F.when(side == 2, y + 39).otherwise(y)
    x1 = F.when(side == 3, x + t).when(side == 1, x + 150).otherwise(x + 150)
    y1 = F.when(side == 0, y + t).when(side == 2, y + 40).otherwise(y + 40)
    return b.select("page_no", "i", *(c.cast("double").alias(k) for k, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))))


#: Numbers by a count of the rows before: with row_number() - 1 the recursive form below loses the subtraction.
_COUNTED = S.LINES.replace("row_number() over (partition by doc_id order by pos) - 1", "count(*) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding)")
_RECTS = f"""{_COUNTED}, raw as (select page_no, block_index as i, block_index // 4 as box, block_index % 4 as side, 72 + (block_index // 4) % 2 * 200 as x, 72 + block_index // 8 * 60 as y, case when (page_no + block_index // 4) % 5 = 0 then 9 else 1 end as t from lines),
rects as (select page_no, i, (case when side = 1 then x + 149 else x end)::double as x0, (case when side = 2 then y + 39 else y end)::double as y0, (case when side = 3 then x + t else x + 150 end)::double as x1, (case when side = 0 then y + t else y + 40 end)::double as y1 from raw)"""


@query(f"""with recursive {_RECTS}, e as (select a.page_no, a.i, b.i as j from rects a join rects b on a.page_no = b.page_no and a.x0 - 3 < b.x1 and b.x0 < a.x1 + 3 and a.y0 - 3 < b.y1 and b.y0 < a.y1 + 3),
reach as (select page_no, i, i as j from rects union select r.page_no, r.i, e.j from reach r join e on e.page_no = r.page_no and e.i = r.j),
root as (select page_no, i, min(j) as c from reach group by all)
select page_no, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from rects join root using (page_no, i) group by page_no, c having bool_and(least(x1 - x0, y1 - y0) <= 5) and max(x1) - min(x0) > 60 and max(y1) - min(y0) > 25""")
def rule_frames(spark, d):
    """Frames made of thin rules."""
    return layout.rule_frames(rects(spark, d))


@query(f"with {_BOXES}, img as (select doc_id as page_no, doc_id % 3 as image_no, 100.0 as x0, (100 + doc_id % 200)::double as y0, 300.0 as x1, (160 + doc_id % 200)::double as y1 from documents where doc_id % 2 = 0) select b.page_no, b.block_index, i.image_no from box b join img i on b.page_no = i.page_no and least(b.x1, i.x1) - greatest(b.x0, i.x0) > 1 and i.y1 > b.y0 and i.y0 < b.y0 + b.size * 1.4")
def text_over_images(spark, d):
    """Blocks that an image would cover."""
    k = F.col("doc_id") % 200
    images = docs(spark, d).where("doc_id % 2 = 0").select(F.col("doc_id").alias("page_no"), (F.col("doc_id") % 3).alias("image_no"), F.lit(100.0).alias("x0"), (100.0 + k).alias("y0"), F.lit(300.0).alias("x1"), (160.0 + k).alias("y1"))
    return layout.text_over_images(boxes(spark, d), images)


@query(f"with {_BOXES}, fr as (select doc_id as page_no, 70::double as x0, (60 + doc_id % 90)::double as y0, 400::double as x1, (200 + doc_id % 90)::double as y1 from documents) select b.page_no, b.block_index, min(f.y1) - 2 as bottom, max(f.x1) - 6 as right from box b join fr f on b.page_no = f.page_no and f.x0 <= b.x0 + 1 and b.x0 + 1 < f.x1 and f.y0 <= b.y0 + 1 and b.y0 + 1 < f.y1 group by all")
def inside_frames(spark, d):
    """Blocks that begin within a frame."""
    k = F.col("doc_id") % 90
    frames = docs(spark, d).select(F.col("doc_id").alias("page_no"), F.lit(70.0).alias("x0"), (60.0 + k).alias("y0"), F.lit(400.0).alias("x1"), (200.0 + k).alias("y1"))
    return layout.inside_frames(boxes(spark, d), frames)


@query(None)
def page_flow(spark, d):
    """Paragraphs flowed down their pages, past figures and within drawn boxes, by the first rung that fits; a fold with a measurer, which SQL has none of."""
    b = boxes(spark, d).select("page_no", F.col("block_index").cast("int").alias("block_index"), "x0", "y0", "x1", "y1", "size", F.col("text").alias("src"), "text")
    p, k = docs(spark, d).select(F.col("doc_id").alias("page_no")), F.col("page_no")
    at = lambda x0, y0, x1, y1: [F.lit(c).cast("double").alias(a) if isinstance(c, float) else c.cast("double").alias(a) for a, c in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)]
    frames = p.select("page_no", *at(72.0, 72.0, 540.0, 720.0))
    figures = p.where("page_no % 4 = 1").select("page_no", *at(100.0, 80.0 + k % 50, 300.0, 120.0 + k % 50))
    held = p.where("page_no % 4 = 2").select("page_no", *at(70.0, 70.0, 400.0 + k % 60, 500.0 + k % 100))
    return layout.laid_out(layout.merged_paragraphs(b), frames, figures, held)


# --- sources, jobs, checks, ledgers, corpora ---


@query("""select xref, page_no, sha256, n_bytes, 'p' || lpad(page_no::varchar, greatest(4, length(page_no::varchar))::int, '0') || '_x' || xref || '.html' as filepath from
(select page_id // 3 as xref, min(page_id) as page_no, min_by(sha256(html), page_id) as sha256, min_by(strlen(html), page_id) as n_bytes from pages group by 1)""")
def image_streams(spark, d):
    """Streams once for each reference, with the hash of their bytes."""
    p = pages(spark, d).select(F.col("page_id").alias("page_no"), F.expr("page_id div 3").alias("xref"), F.lit("html").alias("ext"), F.col("html").cast("binary").alias("content"))
    return files.image_streams(p).select("xref", "page_no", "sha256", n(F.col("n_bytes")).alias("n_bytes"), "filepath")


@query("select distinct sha256(text) as sha256 from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 4 <> 0)")
def images_missing(spark, d):
    """Expected hashes that the output lacks."""
    t = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("sha256"))
    return checks.images_missing(t, t.where("doc_id % 4 <> 0"))


_ANSWERS = """sent as (select l_orderkey as page_no, list(l_linenumber order by l_linenumber) as ids from lineitem group by 1),
ans as (select l_orderkey as page_no, l_linenumber as id, max(case when l_quantity < 4 then ' ' else l_returnflag end) as text from lineitem where l_suppkey % 10 <> 0 group by 1, 2)"""


@query(f"""with {_ANSWERS}, a as (select page_no, list(id) as got, list(id order by id) filter (trim(text) = '') as empty from ans group by 1)
select page_no, coalesce(array_to_string(list_filter(ids, lambda i: not list_contains(coalesce(got, []), i)), ','), '') as missing, coalesce(array_to_string(empty, ','), '') as empty,
len(list_filter(ids, lambda i: not list_contains(coalesce(got, []), i))) = 0 and len(coalesce(empty, [])) = 0 as ok from sent left join a using (page_no)""")
def validate_response(spark, d):
    """Answers held against the ids that were sent."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    sent = li.groupBy(F.col("l_orderkey").alias("page_no")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids"))
    text = F.when(F.col("l_quantity") < 4, F.lit(" ")).otherwise(F.col("l_returnflag"))
    answers = li.where("l_suppkey % 10 <> 0").groupBy(F.col("l_orderkey").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), text.alias("text")))).alias("answers"))
    both = sent.join(answers, "page_no", "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<struct<id:int,text:string>>")))
    return jobs.validated(both).select("page_no", F.array_join("missing", ",").alias("missing"), F.array_join("empty", ",").alias("empty"), "ok")


@query(f"with {S.LINES} select page_no, lang as chapter, count(*) as n_blocks, md5(string_agg('म ' || text, chr(10) order by block_index)) as drafts_md5 from lines group by all")
def translate_pages(spark, d):
    """Page jobs run against the local provider, validated and joined again."""
    b = assemble.line_blocks(docs(spark, d))
    work = jobs.page_jobs(b.select("page_no", "block_index", "text"), docs(spark, d).select(F.col("doc_id").alias("page_no"), F.col("lang").alias("chapter")))
    got = jobs.parsed(jobs.call_all(work, jobs.Echo(), tables.scratch(spark, "answers")))
    text = F.array_join(F.transform(F.array_sort("answers"), lambda a: a.text), "\n")
    return got.join(work.select("page_no", "chapter"), "page_no").select("page_no", "chapter", n(F.size("answers")).alias("n_blocks"), F.md5(text.cast("binary")).alias("drafts_md5"))


def _glossary(spark, d) -> tuple[DataFrame, DataFrame]:
    part = spark.read.parquet(f"{d}/part.parquet")
    terms = part.select(F.when(F.col("p_partkey") % 9 == 0, " ").when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.concat(F.lit(" "), "p_brand")).alias("english"), F.col("p_name").alias("target"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("pos"))
    locked = part.where("p_partkey <= 40").groupBy(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("New "), "p_brand")).otherwise(F.col("p_brand")).alias("english")).agg(F.min("p_type").alias("target")).withColumn("kind", F.lit("locked"))
    return terms, locked


_GLOSSARY = """terms as (select case when p_partkey % 9 = 0 then ' ' when p_partkey % 2 = 0 then upper(p_brand) else ' ' || p_brand end as english, p_name as target, p_type as kind, p_partkey as pos from part),
locked as (select case when p_partkey % 4 = 0 then 'New ' || p_brand else p_brand end as english, min(p_type) as target, 'locked' as kind from part where p_partkey <= 40 group by 1),
first as (select lower(trim(english)) as key, min_by(english, pos) as english, min_by(target, pos) as target, min_by(kind, pos) as kind, min(pos) as pos from terms where trim(english) <> '' group by 1),
merged as (select coalesce(l.english, f.english) as english, coalesce(l.target, f.target) as target, coalesce(l.kind, f.kind) as kind, l.english is not null as locked, f.pos from first f full join locked l on lower(l.english) = f.key)"""


@query(f"with {_GLOSSARY} select english, target, kind, locked, pos from merged")
def glossary_merge(spark, d):
    """First of each term, locked entries over them."""
    return glossary.merged(*_glossary(spark, d))


@query(f"with {_GLOSSARY} select string_agg('- ' || english || '  ->  ' || target, chr(10) order by pos nulls last, english) as lines from (select * from merged order by pos nulls last, english limit 30)")
def glossary_prompt(spark, d):
    """The first thirty terms as prompt lines (a limit that is the feature)."""
    return glossary.prompt_lines(glossary.merged(*_glossary(spark, d)), 30)


@query("""with u as (select event_type as tier, count(*) as calls, sum(floor(value * 10)::bigint)::bigint as input, sum(floor(case when user_id % 3 = 0 then value * 9 else value * 11 end)::bigint)::bigint as cached, sum(event_id % 100)::bigint as output from events group by 1)
select *, round((greatest(input - cached, 0) * 5.0::double + cached * 5.0::double * 0.1::double + output * 30.0::double) / 1e6::double, 6) as cost_usd from u""")
def cost_report(spark, d):
    """Usage and cost of each tier."""
    v = F.col("value")
    calls = events(spark, d).select(F.col("event_type").alias("tier"), F.floor(v * 10).cast("long").alias("input"), F.floor(F.when(F.col("user_id") % 3 == 0, v * 9).otherwise(v * 11)).cast("long").alias("cached"), (F.col("event_id") % 100).alias("output"))
    return ledger.cost(ledger.usage(calls, "tier"), F.lit(5.0), F.lit(30.0))


@query(f"""with {_BLOCKS}, r as (select lang, count(*) as blocks, count(*) filter ({S.strip("coalesce(final, '')")} <> {S.strip("coalesce(draft, '')")}) as changed from blocks where final is not null group by lang)
select lang, blocks, changed, round(100 * changed / blocks, 1) as rate, round(100 * changed / blocks, 1) < 1 as inert from r""")
def revision_rate(spark, d):
    """Share of blocks that the review changed."""
    return ledger.revision_rate(blocks(spark, d).where("final is not null"), "lang")


@query("select user_id, coalesce(max(props) filter (event_type = 'click'), '(missing)') as click, coalesce(max(props) filter (event_type = 'error'), '(missing)') as error, coalesce(max(props) filter (event_type = 'view'), '(missing)') as view from events where event_type in ('click', 'error', 'view') group by 1")
def tier_pivot(spark, d):
    """Outputs of each tier side by side."""
    e = events(spark, d).where("event_type in ('click', 'error', 'view')").select("user_id", F.col("event_type").alias("tier"), F.col("props").alias("text"))
    return ledger.tier_pivot(e, ["click", "error", "view"], "user_id")


@query("""select text as english, 'म ' || text as target, 'parallel' as source, 'parallel_sentence' as type from benchmark union all
select src, tgt, 'dialogue', 'parallel_sentence' from (select text as src, lead(text) over (partition by conv_id order by turn) as tgt from conversations) where tgt is not null union all
select string_agg(p_name, '|' order by p_partkey), p_brand, 'lexicon', 'dictionary_synset' from part group by p_brand, p_partkey // 100""")
def corpus_union(spark, d):
    """Three corpora under one schema, lists of terms beside sentences."""
    from pyspark.sql import Window

    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    talk = spark.read.parquet(f"{d}/conversations.parquet").withColumn("tgt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("tgt is not null")
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x.p_name)
    lex = spark.read.parquet(f"{d}/part.parquet").groupBy("p_brand", F.expr("p_partkey div 100")).agg(names.alias("names"))  # a hundred at most
    one = lambda c: F.array(F.col(c))
    got = corpus.unified([(bench, one("text"), F.array(F.concat(F.lit("म "), "text")), "parallel", "parallel_sentence"), (talk, one("text"), one("tgt"), "dialogue", "parallel_sentence"), (lex, F.col("names"), one("p_brand"), "lexicon", "dictionary_synset")])
    return got.select(F.array_join("english", "|").alias("english"), F.array_join("target", "|").alias("target"), "source", "type")


@query("""with q as (select vec_id, embedding::double[] as e from embeddings where vec_id % 100 = 0), p as (select q.vec_id as query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.e, v.embedding::double[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9) as dist from q join embeddings v on v.vec_id <> q.vec_id)
select query_id, vec_id, r as rank from (select *, row_number() over (partition by query_id order by dist, vec_id) as r from p) where r <= 3""")
def knn_terms(spark, d):
    """The three nearest of all vectors for every hundredth one."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    return corpus.nearest(v.where("vec_id % 100 = 0"), v).withColumn("rank", n(F.col("rank")))


@query("""with e as (select doc_id, 'a' as method, text from documents union all select doc_id, 'b', case when doc_id % 5 = 0 then left(text, length(text) // 3) when doc_id % 5 = 1 then left(text, length(text) * 8 // 10) else text end from documents union all select doc_id, 'c', case when doc_id % 7 = 0 then text || '(cid:3)' else text end from documents
union all select doc_id, 'a', '(cid:9)' from documents where doc_id % 11 = 0),
c as (select doc_id, sum(case when method = 'a' then length(text) else 0 end)::bigint as n0, sum(case when method = 'b' then length(text) else 0 end)::bigint as n1, sum(case when method = 'c' then length(text) else 0 end)::bigint as n2, bool_or(method = 'a' and contains(text, '(cid:')) as cid from e group by doc_id)
select doc_id, n0, n1, n2, case when greatest(n0, n1, n2) < 20 then 'blank' when least(n0, n1, n2) * 2 < greatest(n0, n1, n2) then 'major'
when greatest(abs(3 * n0 - n0 - n1 - n2), abs(3 * n1 - n0 - n1 - n2), abs(3 * n2 - n0 - n1 - n2)) * 10 > n0 + n1 + n2 + 3 then 'variance' when cid then 'garbage' else 'match' end as verdict from c""")
def extractor_crosscheck(spark, d):
    """Three extractions of each page held against each other."""
    t = docs(spark, d)
    part = F.expr("case when doc_id % 5 = 0 then left(text, length(text) div 3) when doc_id % 5 = 1 then left(text, length(text) * 8 div 10) else text end")
    rows = [(t, "a", F.col("text")), (t, "b", part), (t, "c", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("(cid:3)"))).otherwise(F.col("text"))), (t.where("doc_id % 11 = 0"), "a", F.lit("(cid:9)"))]
    out = None
    for rows_of, method, text in rows:
        got = rows_of.select("doc_id", F.lit(method).alias("method"), F.lit("text").alias("type"), text.alias("text"))
        out = got if out is None else out.unionByName(got)
    return corpus.cross_checked(out, ("a", "b", "c"), "doc_id")


@query(f"""with l as (select p_partkey, case when p_partkey % 6 = 0 then 'X  ' || p_type when p_partkey % 5 = 0 then p_name || ' ' || p_type else p_name || '   प्र ' || p_type end as text from part)
select p_partkey, {S.strip(f"regexp_extract(text, '^([A-Za-z0-9{S.BLANK[1:-1]}()\\-.,]+?){S.BLANK}{{2,}}(.+)$', 1)")} as english, {S.strip(f"regexp_extract(text, '^([A-Za-z0-9{S.BLANK[1:-1]}()\\-.,]+?){S.BLANK}{{2,}}(.+)$', 2)")} as target from l
where length({S.strip(f"regexp_extract(text, '^([A-Za-z0-9{S.BLANK[1:-1]}()\\-.,]+?){S.BLANK}{{2,}}(.+)$', 1)")}) > 1""")
def dictionary_lines(spark, d):
    """Entries of two-column dictionary lines."""
    part = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    text = F.when(k % 6 == 0, F.concat(F.lit("X  "), "p_type")).when(k % 5 == 0, F.concat("p_name", F.lit(" "), "p_type")).otherwise(F.concat("p_name", F.lit("   प्र "), "p_type"))
    return corpus.dictionary_lines(part.select("p_partkey", text.alias("text"))).select("p_partkey", "english", "target")


@query(f"""with {S.PAIRS}, s as (select distinct doc_id as page_no, unnest({S.raw_numbers('src')}) as number from pairs where doc_id not in (select doc_id from labels where toxic = 1)), t as (select distinct doc_id as page_no, unnest({S.numbers('tgt')}) as number from pairs)
select page_no, string_agg(number, ',' order by number) as lost from s anti join t using (page_no, number) group by page_no""")
def page_numbers(spark, d):
    """Numbers that a page lost; reviewed pages are excused."""
    p = pairs(spark, d).select(F.col("doc_id").alias("page_no"), F.lit(0).alias("block_index"), "src", "tgt")
    excused = spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("page_no"), F.lit(0).alias("block_index"))
    return checks.page_number_losses(p, excused)


@query("""select doc_id as page_no from documents where doc_id % 13 <> 0 and round((500 + doc_id % 100) * 1.0) <> round(500 + doc_id % 100 + case when doc_id % 6 = 0 then 0.6 else 0.2 end)""")
def resized_pages(spark, d):
    """Pages whose size changed on the way."""
    w = F.lit(500.0) + F.col("doc_id") % 100
    source = docs(spark, d).select(F.col("doc_id").alias("page_no"), w.alias("width"), F.lit(700.0).alias("height"))
    page_map = docs(spark, d).select(F.col("doc_id").alias("page_no"), (F.col("doc_id") + 5).alias("out_idx"))
    output = docs(spark, d).where("doc_id % 13 <> 0").select((F.col("doc_id") + 5).alias("out_idx"), (w + F.when(F.col("doc_id") % 6 == 0, 0.6).otherwise(0.2)).alias("width"), F.lit(700.2).alias("height"))
    return checks.resized_pages(source, page_map, output)


@query(f"""with {S.LINES}, u as (select page_no, block_index, text as src, case when page_no % 4 = 0 then ' ' || text when page_no % 4 = 1 then 'xx' else 'म ' || text end as tgt from lines where page_no not in (select doc_id from labels where quality = 0))
select page_no, block_index, 'no_devanagari' as kind from u where {S.is_prose('src')} and not regexp_matches(tgt, '[ऀ-ॿ]') union all select page_no, block_index, 'passthrough' from u where {S.is_prose('src')} and {S.strip('tgt')} = {S.strip('src')}""")
def untranslated_units(spark, d):
    """Units of prose left as they were; reviewed ones are excused."""
    t, k = F.col("text"), F.col("page_no") % 4
    units = blocks(spark, d).select("page_no", "block_index", t.alias("src"), F.when(k == 0, F.concat(F.lit(" "), t)).when(k == 1, "xx").otherwise(F.concat(F.lit("म "), t)).alias("tgt"))
    reviewed = spark.read.parquet(f"{d}/labels.parquet").where("quality = 0").select(F.col("doc_id").alias("page_no"))
    excused = units.join(reviewed.distinct(), "page_no", "left_semi").select("page_no", "block_index")
    return checks.untranslated_units(units, excused)


_GLYPHS = "length(regexp_replace({}, '[\\x20\\x09-\\x0D]', '', 'g'))"
_PAINTED = "case when doc_id % 17 = 0 then regexp_replace(text, '[aeiou]', '', 'g') when doc_id % 19 = 0 then right(text, length(text) - 3) else replace(text, chr(10), '  ') end"


@query(f"select doc_id as page_no, e - g as deficit from (select doc_id, {_GLYPHS.format('text')} as e, {_GLYPHS.format(_PAINTED)} as g from documents) where g < e - 2")
def glyph_deficits(spark, d):
    """Pages that painted too few glyphs."""
    return checks.glyph_deficits(_glyphs(spark, d)).withColumn("deficit", n(F.col("deficit")))


def _glyphs(spark, d) -> DataFrame:
    """Glyphs of each page's text, and of what is left of it."""
    count, k, t = lambda c: n(F.length(F.regexp_replace(c, r"[\x20\x09-\x0D]", ""))), F.col("doc_id"), F.col("text")
    painted = F.when(k % 17 == 0, F.regexp_replace(t, "[aeiou]", "")).when(k % 19 == 0, F.expr("right(text, length(text) - 3)")).otherwise(F.replace(t, F.lit("\n"), F.lit("  ")))
    return docs(spark, d).select(k.alias("page_no"), count(t).alias("expected"), count(painted).alias("got"))


@query(f"""with g as (select doc_id as page_no, {_GLYPHS.format('text')} as e, {_GLYPHS.format(_PAINTED)} as g from documents),
r as (select page_no, e, g, row_number() over (order by page_no) - 1 as r, count(*) over () as n from g), s as (select * from r where r % greatest(1, n // 40) = 0 and r // greatest(1, n // 40) < 40)
select sum(e)::bigint as expected, sum(g)::bigint as got, count(*) filter (g < e - 2) as n_short, coalesce((select string_agg(page_no || ':' || d, ',' order by d desc, page_no) from (select page_no, e - g as d from s where g < e - 2 order by d desc, page_no limit 3)), '') as worst, count(*) as pages from s""")
def glyph_audit(spark, d):
    """Totals of a sample of forty pages and its three worst (limits that are the feature)."""
    return checks.glyph_audit(_glyphs(spark, d), 40).select(*(n(F.col(c)).alias(c) for c in ("expected", "got", "n_short")), "worst", n(F.col("pages")).alias("pages"))


_KEPT = "case when doc_id % 50 = 7 then text || '!' else text end"


@query(f"""with {_BLOCKS}, want as (select distinct sha256(text) as h from documents), found as (select distinct sha256({_KEPT}) as h from documents),
lost as (select len(list_filter({S.raw_numbers('text')}, lambda x: not list_contains({S.numbers("coalesce(final, draft)")}, x))) as lost from (select text, draft, case when block_index % 9 = 4 then regexp_replace(final, '[0-9]', '', 'g') else final end as final from blocks) where draft is not null),
c as (select 1 as check_no, 'images' as name, count(*) filter (h not in (select h from found)) as n, count(*) as t from want
union all select 2, 'translated', count(*) filter (draft is null and final is null), count(*) from blocks
union all select 3, 'numbers', count(*) filter (lost > 0), count(*) from lost
union all select 4, 'outline', count(*) filter (page not between 1 and 20 or not regexp_matches(title, '[ऀ-ॿ]')), count(*) from (select n_nationkey as page, case when n_regionkey > 1 then 'म ' || n_name else n_name end as title from nation)
union all select 5, 'regions', count(*) filter (r_name = ''), count(*) from region)
select check_no, name, n = 0 as passed, n || '/' || t as detail from c union all select 0, 'all', bool_and(n = 0), count(*) filter (n = 0) || '/' || count(*) from c""")
def acceptance(spark, d):
    """Several checks, all run, then all needed."""
    b = blocks(spark, d)
    k = F.when(F.col("doc_id") % 50 == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    hashes = docs(spark, d).select(F.sha2("text", 256).alias("sha256"))
    missing = checks.images_missing(hashes, docs(spark, d).select(F.sha2(k, 256).alias("sha256"))).withColumn("lost", F.lit(True))
    images = hashes.distinct().join(missing, "sha256", "left")
    final = F.when(F.col("block_index") % 9 == 4, F.regexp_replace("final", "[0-9]", "")).otherwise(F.col("final"))
    lost = b.where("draft is not null").select(F.size(rules.lost_numbers(F.col("text"), F.coalesce(final, "draft"))).alias("lost"))
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("page"), F.when(F.col("n_regionkey") > 1, F.concat(F.lit("म "), "n_name")).otherwise(F.col("n_name")).alias("title"))
    return checks.all_passed([
        checks.check(1, "images", images, F.coalesce("lost", F.lit(False))), checks.check(2, "translated", b, F.col("draft").isNull() & F.col("final").isNull()),
        checks.check(3, "numbers", lost, F.col("lost") > 0), checks.check(4, "outline", nation, ~F.col("page").between(1, 20) | ~T.has_devanagari(F.col("title"))),
        checks.check(5, "regions", spark.read.parquet(f"{d}/region.parquet"), F.col("r_name") == ""),
    ])


@query("""with o as (select n_regionkey as book, n_nationkey * 6 as page, case when n_regionkey > 1 and n_nationkey % 2 = 0 then 'म ' || n_name else n_name end as title from nation)
select book, count(*) as entries, count(*) filter (page not between 1 and 130) as outside, count(*) filter (regexp_matches(title, '[ऀ-ॿ]')) as translated,
count(*) = 0 or (count(*) filter (page not between 1 and 130) = 0 and count(*) filter (regexp_matches(title, '[ऀ-ॿ]')) > 0) as passed from o group by book""")
def outline_check(spark, d):
    """Outline entries that point outside their book, and translated ones."""
    title = F.when((F.col("n_regionkey") > 1) & (F.col("n_nationkey") % 2 == 0), F.concat(F.lit("म "), "n_name")).otherwise(F.col("n_name"))
    o = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").alias("book"), (F.col("n_nationkey") * 6).alias("page"), title.alias("title"))
    return checks.outline_errors(o, F.lit(130), "book")


@query("select bool_or(contains(p_name || case when p_partkey = 7 then ' Devanagari' else '' end, 'Devanagari')) as passed, string_agg(distinct p_brand || case when p_partkey = 7 then ' Devanagari' else '' end, ',' order by p_brand || case when p_partkey = 7 then ' Devanagari' else '' end) as fonts from part")
def font_faces(spark, d):
    """Font faces on sampled pages."""
    part = spark.read.parquet(f"{d}/part.parquet")
    return checks.font_faces(part.select(F.col("p_partkey").alias("page_no"), F.concat("p_brand", F.when(F.col("p_partkey") == 7, " Devanagari").otherwise("")).alias("font")))


_LAYER = "case when doc_id % 100 = 13 then tgt || chr(65533) else tgt end"


@query(f"""with {S.PAIRS}, t as (select lang || '/' || doc_id % 5 as sample, {_LAYER} as text from pairs), r as (select sample, bool_or(regexp_matches(text, '[ऀ-ॿ]')) as devanagari, bool_or(contains(text, chr(65533)) or contains(text, chr(9633))) as tofu, sum(length(text))::bigint as chars from t group by sample)
select *, devanagari and not tofu as passed from r""")
def text_layer(spark, d):
    """Text of the output, by sample: readable and free of replacement characters."""
    text = F.when(F.col("doc_id") % 100 == 13, F.concat("tgt", F.lit("\ufffd"))).otherwise(F.col("tgt"))
    t = pairs(spark, d).select(F.concat("lang", F.lit("/"), (F.col("doc_id") % 5).cast("string")).alias("sample"), text.alias("text"))
    return checks.text_layer(t, "sample").select("sample", "devanagari", "tofu", "chars", "passed")


_BARE = "case doc_id % 5 when 0 then repeat(' ', 30) || coalesce(lang, '') || chr(9) when 1 then source else text end"


@query(f"select doc_id, n_chars from documents where length(regexp_replace({_BARE}, '^{S.BLANK}+|{S.BLANK}+$', '', 'g')) < 20")
def image_only_pages(spark, d):
    """Pages with hardly any text; two fifths bear a label only."""
    t = docs(spark, d).withColumn("text", F.expr("case doc_id % 5 when 0 then repeat(' ', 30) || coalesce(lang, '') || '\t' when 1 then source else text end"))
    return overview.image_only_pages(t).select("doc_id", "n_chars")


@query("""with p as (select lang, source, count(*) as pages, sum(length(text))::bigint as chars from documents group by all), i as (select lang, source, count(distinct doc_id // 3) as images from documents where doc_id % 4 = 0 group by all)
select lang, source, pages, chars, coalesce(images, 0) as images, chars >= 1000 as usable from p left join i using (lang, source)""")
def document_stats(spark, d):
    """Pages, characters and distinct images of each chapter."""
    t = docs(spark, d)
    return overview.document_stats(t, t.where("doc_id % 4 = 0").withColumn("xref", F.expr("doc_id div 3")), "lang", "source")


@query("select event_id, event_type, case user_id % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as severity from events where user_id % 3 <> 0")
def severe_findings(spark, d):
    """Findings worth acting on."""
    k = F.col("user_id") % 3
    e = events(spark, d).withColumn("severity", F.when(k == 0, "low").when(k == 1, "medium").otherwise("high"))
    return overview.severe(e).select("event_id", "event_type", "severity")


@query("select event_id, value from events order by value desc, event_id limit 3")
def worst_three(spark, d):
    """The three largest deficits (a limit that is the feature)."""
    return overview.worst(events(spark, d).select("event_id", "value"), "value", "event_id")


@query("select doc_id, length(regexp_replace(text, '[\\x20\\x09-\\x0D\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]', '', 'g')) as glyphs from documents")
def glyph_counts(spark, d):
    """Characters that leave ink."""
    return overview.glyph_counts(docs(spark, d)).select("doc_id", n(F.col("glyphs")).alias("glyphs"))


@query(f"""with {S.PAIRS}, miss as ({" union all ".join(f"select doc_id, 'Glossary mismatch: {en} -> {mr}' as r from pairs where coalesce(tgt, '') <> '' and contains(lower(src), '{en}') and not contains(tgt, '{mr}')" for en, mr in TERMS)}),
w as (select doc_id, max(r) as reason from miss group by doc_id)
select p.doc_id, case when doc_id % 2 = 0 and reason is not null then 'flagged' when doc_id % 2 = 0 then 'final' else 'drafted' end as status, case when doc_id % 2 = 0 then reason end as reason from pairs p left join w using (doc_id)""")
def flagged_blocks(spark, d):
    """Final blocks flagged for a missed term."""
    p = pairs(spark, d)
    status = p.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "final").otherwise("drafted").alias("status"))
    return overview.flagged(status, rules.substring_misses(p, list(TERMS)), "doc_id")
