"""Scans and summaries around the pipeline: page content, severity, worst pages, model choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_PAGE_CHARS, MIN_DOCUMENT_CHARS = 20, 1000


def image_only_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with fewer than MIN_PAGE_CHARS characters besides white space at the ends."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return pages.where(F.length(bare) < MIN_PAGE_CHARS)


def text_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with anything but white space."""
    return pages.where(F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))


def first_rows(rows: DataFrame, order: str, k: int = 15) -> DataFrame:
    """The first k rows in order."""
    return rows.orderBy(order).limit(k)


def fallback(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Adds `text`: the first text that isn't empty; rows without one go."""
    return rows.withColumn("text", F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))).where("text is not null")


def counters(pages: DataFrame, *group: str) -> DataFrame:
    """Failures and continuation pages. pages: failed, n_extra."""
    return pages.groupBy(*group).agg(F.count_if("failed").alias("failures"), F.sum("n_extra").alias("continuations"))


def document_stats(pages: DataFrame, images: DataFrame, *group: str) -> DataFrame:
    """Pages, characters, distinct images and whether there is text enough to work on. Both hold the group's columns; pages has text, images xref."""
    p = pages.groupBy(*group).agg(F.count("*").alias("pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    i = images.groupBy(*group).agg(F.count_distinct("xref").alias("images"))
    got = p.join(i, list(group), "left").withColumn("images", F.coalesce("images", F.lit(0)))
    return got.withColumn("usable", F.col("chars") >= MIN_DOCUMENT_CHARS)


def severe(findings: DataFrame) -> DataFrame:
    """Findings of medium and high severity."""
    return findings.where(F.col("severity").isin("medium", "high"))


def worst(rows: DataFrame, by: str, tie: str, k: int = 3) -> DataFrame:
    """The k rows with the largest value."""
    return rows.orderBy(F.desc(by), tie).limit(k)


def glyph_counts(pages: DataFrame, text: str = "text") -> DataFrame:
    """Characters of each page that leave ink."""
    return pages.withColumn("glyphs", F.length(F.regexp_replace(text, r"[\s\u00A0\u2000-\u200A\u202F\u3000]", "")))


def flagged(blocks: DataFrame, misses: DataFrame, key: str) -> DataFrame:
    """Final blocks with a missed term become flagged, with the last term named as the reason."""
    why = misses.groupBy(key).agg(F.max(F.concat(F.lit("Glossary mismatch: "), "term", F.lit(" -> "), "expected")).alias("reason"))
    got = blocks.join(why, key, "left")
    hit = F.col("reason").isNotNull() & (F.col("status") == "final")
    return got.withColumns({"status": F.when(hit, F.lit("flagged")).otherwise(F.col("status")), "reason": F.when(hit, F.col("reason"))})


def choose_model(wanted: list[str], probe: Callable[[str], dict | None], cache: dict[str, dict]) -> tuple[str, dict]:
    """The first model of a preference list that answers a probe, and what it can do; answers are kept in the cache."""
    for name in wanted:
        if name not in cache:
            caps = probe(name)
            if caps is None:
                continue
            cache[name] = caps
        return name, cache[name]
    raise LookupError(f"none of {', '.join(wanted)} answers")
