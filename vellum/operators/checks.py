"""Acceptance checks: each gives one row (check_no, name, passed, detail); all run, then all must pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import rules, structure

TOLERANCE = 2


def check(no: int, name: str, rows: DataFrame, bad: Column) -> DataFrame:
    """Fails if any row is bad; detail counts them."""
    got = rows.agg(F.count_if(bad).alias("n"), F.count("*").alias("of"))
    return got.select(F.lit(no).alias("check_no"), F.lit(name).alias("name"), (F.col("n") == 0).alias("passed"), F.concat(F.col("n").cast("string"), F.lit("/"), F.col("of").cast("string")).alias("detail"))


def images_missing(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected hashes that the output has nowhere; equal hashes count once."""
    return expected.select("sha256").distinct().join(found.select("sha256").distinct(), "sha256", "left_anti")


def untranslated_units(units: DataFrame, excused: DataFrame) -> DataFrame:
    """Prose units without Devanagari or equal to their source: page_no, block_index, kind. units: page_no, block_index, src, tgt."""
    t = T.strip_markup(F.coalesce("tgt", F.lit("")))
    kept = rules.without_excused(units.where(T.is_prose(F.col("src"))), excused, ["page_no", "block_index"])
    kinds = F.array_compact(F.array(F.when(~T.has_devanagari(t), F.lit("no_devanagari")), F.when(T.strip(t) == T.strip(F.col("src")), F.lit("passthrough"))))
    return kept.select("page_no", "block_index", F.explode(kinds).alias("kind"))


def glyph_deficits(glyphs: DataFrame) -> DataFrame:
    """Sampled pages (page_no, expected, got) that painted over TOLERANCE fewer glyphs than expected."""
    return glyphs.where(F.col("got") < F.col("expected") - TOLERANCE).select("page_no", (F.col("expected") - F.col("got")).alias("deficit"))


def page_number_losses(blocks: DataFrame, excused: DataFrame) -> DataFrame:
    """(page_no, lost): numbers of a page's sources, reviewed blocks left out, that none of its targets has. blocks: page_no, block_index, src, tgt.

    Numbers are pre-aggregated as distinct (page, number) before they meet.
    """
    src = rules.without_excused(blocks, excused, ["page_no", "block_index"]).select("page_no", F.explode(T.raw_numbers_in(F.coalesce("src", F.lit("")))).alias("number")).distinct()
    tgt = blocks.select("page_no", F.explode(T.numbers_in(F.coalesce("tgt", F.lit("")))).alias("number")).distinct()
    lost = src.join(tgt, ["page_no", "number"], "left_anti")
    return lost.groupBy("page_no").agg(F.array_join(F.array_sort(F.collect_set("number")), ",").alias("lost"))


def font_faces(fonts: DataFrame, wanted: str = "Devanagari") -> DataFrame:
    """Whether any sampled page has a face so named, and which there are. fonts: page_no, font."""
    return fonts.agg(F.coalesce(F.bool_or(F.contains("font", F.lit(wanted))), F.lit(False)).alias("passed"), F.array_join(F.array_sort(F.collect_set("font")), ",").alias("fonts"))


def glyph_audit(glyphs: DataFrame, k: int = 40, worst: int = 3) -> DataFrame:
    """One row over every n-th of the pages (page_no, expected, got), k at most: totals, how many are short, the worst of them as page:deficit, and the pages looked at."""
    sample = structure.every_kth(glyphs.withColumn("_all", F.lit(0)), "page_no", k, "_all").drop("_all")
    short = F.col("got") < F.col("expected") - TOLERANCE
    deficits = F.array_sort(F.collect_list(F.when(short, F.struct((F.col("got") - F.col("expected")).alias("d"), "page_no"))))  # k at most
    top = F.transform(F.slice(deficits, 1, worst), lambda x: F.concat(x.page_no.cast("string"), F.lit(":"), (-x.d).cast("string")))
    return sample.agg(F.sum("expected").alias("expected"), F.sum("got").alias("got"), F.count_if(short).alias("n_short"), F.array_join(top, ",").alias("worst"), F.count("*").alias("pages"))


def first_failure(failures: DataFrame, *group: str) -> DataFrame:
    """The earliest failing page (page_no, detail)."""
    return failures.groupBy(*group).agg(F.min(F.struct("page_no", "detail")).alias("f")).select(*group, "f.*")


def any_row(rows: DataFrame) -> bool:
    """Whether there is a row at all; stops at the first."""
    return not rows.isEmpty()


def text_layer(samples: DataFrame, *group: str) -> DataFrame:
    """Devanagari somewhere and no replacement characters anywhere. samples: text."""
    return samples.groupBy(*group).agg(
        F.coalesce(F.bool_or(T.has_devanagari(F.col("text"))), F.lit(False)).alias("devanagari"),
        F.coalesce(F.bool_or(F.col("text").rlike("[�□]")), F.lit(False)).alias("tofu"), F.sum(F.length("text")).alias("chars"),
    ).withColumn("passed", F.col("devanagari") & ~F.col("tofu"))


def outline_errors(outline: DataFrame, pages: Column, *group: str) -> DataFrame:
    """Entries outside the document, entries in Devanagari, and the verdict."""
    got = outline.groupBy(*group).agg(F.count("*").alias("entries"), F.count_if(~F.col("page").between(F.lit(1), pages)).alias("outside"), F.count_if(T.has_devanagari(F.col("title"))).alias("translated"))
    return got.withColumn("passed", (F.col("entries") == 0) | ((F.col("outside") == 0) & (F.col("translated") > 0)))


def resized_pages(source: DataFrame, page_map: DataFrame, output: DataFrame) -> DataFrame:
    """Source pages whose rounded size differs on their output page; pages without one are skipped."""
    mapped = source.join(page_map, "page_no", "left").withColumn("out_idx", F.coalesce("out_idx", F.col("page_no") - 1))
    both = mapped.join(output.select("out_idx", F.col("width").alias("w"), F.col("height").alias("h")), "out_idx")
    return both.where((F.round("width") != F.round("w")) | (F.round("height") != F.round("h"))).select("page_no")


def all_passed(checks: list[DataFrame]) -> DataFrame:
    """Every check's row, and a last one that needs them all."""
    rows = reduce(lambda a, b: a.unionByName(b), checks)
    total = rows.agg(F.lit(0).alias("check_no"), F.lit("all").alias("name"), F.bool_and("passed").alias("passed"), F.concat(F.count_if("passed").cast("string"), F.lit("/"), F.count("*").cast("string")).alias("detail"))
    return rows.unionByName(total)
