"""Outline ranges, page offsets, lookaround, samples and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast


def select_pages(spark: SparkSession, text: str) -> DataFrame:
    """Distinct pages of a selector such as `1,5,9-12`; an empty one selects none by number, and callers take all."""
    parts = spark.range(1).select(F.explode(F.split(F.lit(text), ",")).alias("p")).select(F.trim("p").alias("p")).where("p <> ''")
    ends = F.split("p", "-")
    return parts.select(F.explode(F.sequence(ends[0].cast("int"), F.coalesce(F.try_element_at(ends, F.lit(2)), ends[0]).cast("int"))).alias("page_no")).distinct()


def outline_ranges(marks: DataFrame) -> DataFrame:
    """(title, start, stop) of outline entries (idx, title, page): each up to the page before the next one; of one page the last listed counts."""
    one = marks.where("page > 0").groupBy("page").agg(F.max_by("title", "idx").alias("title"))
    return one.select("title", F.col("page").alias("start"), (F.lead("page").over(Window.orderBy("page")) - 1).alias("stop"))


def chapter_of(events: DataFrame, marks: DataFrame, key: str, at: str, group: str) -> DataFrame:
    """As-of join: for each row the title of the last mark of its group at or before it, ties by mark id; null before the first.

    Marks and rows are merged into one ordered pass per group, so the cost is one shuffle and sort.
    """
    m = marks.select(group, F.col(at), F.lit(0).alias("_side"), F.col("mark_id").alias("_id"), F.col("title"), F.lit(None).cast("long").alias(key))
    e = events.select(group, F.col(at), F.lit(1).alias("_side"), F.col(key).alias("_id"), F.lit(None).cast("string").alias("title"), F.col(key).cast("long").alias(key))
    w = Window.partitionBy(group).orderBy(at, "_side", "_id").rowsBetween(Window.unboundedPreceding, 0)
    return m.unionByName(e).withColumn("chapter", F.last("title", ignorenulls=True).over(w)).where("_side = 1").select(group, key, "chapter")


#: Pages that are put in order in one task, about.
PAGES = 10_000


def page_chapters(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Chapter of each page: the title of the last range (start, title) that begins at or before it.

    Pages are dealt by number; each share begins with the title in force at its start, and is then
    one ordered pass, so neither side is broadcast or bounded.
    """
    share = lambda c: F.floor(F.col(c) / PAGES).alias("_share")
    marks = ranges.select(share("start"), F.col("start").cast("long").alias("_at"), F.lit(0).alias("_side"), F.struct("title").alias("_mark"))
    ends = marks.groupBy("_share").agg(F.max_by("_mark", "_at").alias("_mark")).unionByName(pages.select(share("page_no")).distinct().withColumn("_mark", F.lit(None).cast("struct<title:string>")))
    before = Window.orderBy("_share").rangeBetween(Window.unboundedPreceding, -1)  # a row for each share
    starts = ends.select("_share", F.last("_mark", ignorenulls=True).over(before).alias("_mark")).groupBy("_share").agg(F.first("_mark", ignorenulls=True).alias("_mark"))
    starts = starts.select("_share", F.lit(None).cast("long").alias("_at"), F.lit(0).alias("_side"), "_mark")
    rows = pages.select("*", share("page_no"), F.col("page_no").cast("long").alias("_at"), F.lit(1).alias("_side"))
    all_rows = rows.unionByName(marks.unionByName(starts), allowMissingColumns=True)
    order = Window.partitionBy("_share").orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    got = all_rows.withColumn("_mark", F.last("_mark", ignorenulls=True).over(order)).where("_side = 1")
    return got.select(*pages.columns, F.col("_mark.title").alias("chapter"))


def lookaround(pages: DataFrame, away: int = 1, size: int = 700) -> DataFrame:
    """prev: the end of the page `away` before; next: the start of the page `away` after; labels at the edges. pages: page_no, text."""
    ends = pages.agg(F.max("page_no").alias("last_page"))
    label = F.lit("(no text on this page)")
    before = pages.select((F.col("page_no") + away).alias("page_no"), F.right("text", F.lit(size)).alias("prev"))
    after = pages.select((F.col("page_no") - away).alias("page_no"), F.left("text", F.lit(size)).alias("next"))
    got = pages.select("page_no").join(before, "page_no", "left").join(after, "page_no", "left").join(broadcast(ends))
    prev = F.when(F.col("page_no") - away < 1, F.lit("(start of book)")).otherwise(F.coalesce("prev", label))
    following = F.when(F.col("page_no") + away > F.col("last_page"), F.lit("(end of book)")).otherwise(F.coalesce("next", label))
    return got.select("page_no", prev.alias("prev"), following.alias("next"))


def page_offsets(extra: DataFrame, group: str) -> DataFrame:
    """Output index of each page (group, page_no, n_extra): its number less one, and all earlier pages' continuation pages."""
    w = Window.partitionBy(group).orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return extra.select(group, "page_no", (F.col("page_no") - 1 + F.coalesce(F.sum("n_extra").over(w), F.lit(0))).alias("out_idx"))


def remap_outline(outline: DataFrame, page_map: DataFrame, titles: DataFrame) -> DataFrame:
    """(idx, title, page): translated title or the old one; mapped page or the old one, counted from 1."""
    got = outline.join(page_map.select(F.col("page_no").alias("page"), "out_idx"), "page", "left").join(titles.select("idx", F.col("title").alias("new_title")), "idx", "left")
    return got.select("idx", F.coalesce("new_title", "title").alias("title"), F.coalesce(F.col("out_idx") + 1, F.col("page")).alias("page"))


def every_kth(rows: DataFrame, order: str, k: int, group: str) -> DataFrame:
    """At most k rows of each group, evenly: every max(1, n div k)-th in order."""
    w = Window.partitionBy(group).orderBy(order)
    numbered = rows.withColumn("_r", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    step = F.greatest(F.lit(1), F.expr(f"_n div {k}"))
    return numbered.where((F.col("_r") % step == 0) & (F.expr(f"_r div greatest(1, _n div {k})") < k)).drop("_r", "_n")


def chapter_text(blocks: DataFrame, chapter: Column) -> DataFrame:
    """Texts of a chapter in page and block order, joined by an empty line. One row holds a chapter, so it must be of one prompt's size; chunks() takes any."""
    parts = F.array_sort(F.collect_list(F.struct("page_no", "block_index", "text")))
    return blocks.groupBy(chapter.alias("chapter")).agg(F.array_join(F.transform(parts, lambda p: p.text), "\n\n").alias("text"))


def chunks(blocks: DataFrame, chapter: Column, size: int = 40_000) -> DataFrame:
    """(chapter, chunk, text): what chapter_text() gives, in pieces of `size` characters; labels are numbered only where there are several.

    A block's place in its chapter is the length of the pages before, by sums of ranges of pages,
    and of the blocks before on its page; each piece is then put together from the parts of blocks
    that fall in it, so no task holds a chapter.
    """
    b = blocks.select(chapter.alias("chapter"), "page_no", "block_index", "text", (F.length("text") + 2).cast("long").alias("n"), F.floor(F.col("page_no") / 1000).alias("share"))
    page = b.groupBy("chapter", "share", "page_no").agg(F.sum("n").alias("n"))
    share = page.groupBy("chapter", "share").agg(F.sum("n").alias("n"))
    sum_before = lambda *keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = share.select("chapter", "share", sum_before("chapter", order=["share"]).alias("share_at"), (F.sum("n").over(Window.partitionBy("chapter")) - 2).alias("whole"))
    pages = page.select("chapter", "share", "page_no", sum_before("chapter", "share", order=["page_no"]).alias("page_at"))
    at = F.col("share_at") + F.col("page_at") + F.col("block_at")
    placed = (
        b.withColumn("block_at", sum_before("chapter", "page_no", order=["block_index"])).join(pages, ["chapter", "share", "page_no"]).join(shares, ["chapter", "share"])
        .select("chapter", "whole", at.alias("at"), F.concat("text", F.lit("\n\n")).alias("text"), "n").where("whole > 0 and at < whole")
        .withColumn("n", F.least("n", F.col("whole") - F.col("at")))
    )
    first, last = F.expr(f"at div {size}"), F.expr(f"(at + n - 1) div {size}")
    parts = placed.select("chapter", "whole", "at", "text", "n", F.explode(F.sequence(first, last)).alias("chunk"))
    begin = F.greatest(F.col("chunk") * size - F.col("at"), F.lit(0))
    end = F.least((F.col("chunk") + 1) * size - F.col("at"), F.col("n"))
    cut = parts.select("chapter", "whole", "chunk", "at", F.substring("text", (begin + 1).cast("int"), (end - begin).cast("int")).alias("text"))
    joined = cut.groupBy("chapter", "whole", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p.text), "").alias("text"))  # `size` characters
    name = F.when(F.col("whole") <= size, F.col("chapter")).otherwise(F.concat("chapter", F.lit(" ("), (F.col("chunk") + 1).cast("string"), F.lit(")")))
    return joined.select(name.alias("chapter"), "chunk", "text")


def vision_targets(page_map: DataFrame, n_out: Column, group: str) -> DataFrame:
    """Output pages of each source page: from its own to before the next page's; the last page's run to the end."""
    following = F.coalesce(F.lead("out_idx").over(Window.partitionBy(group).orderBy("page_no")), n_out)
    return page_map.withColumn("_stop", following).select(group, "page_no", F.explode(F.sequence(F.col("out_idx"), F.greatest(F.col("_stop") - 1, F.col("out_idx")))).alias("out_page"))
