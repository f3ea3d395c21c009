"""Content-addressed state: keyed overlays, queues and latest attempts. Each takes tables and returns the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """New geometry, text and id for (page_no, block_index); draft, final and status stay where the id does, else the block is pending."""
    keys = ["page_no", "block_index"]
    work = ["draft", "final", "status"]
    o = old.select(*keys, F.col("id").alias("old_id"), *(F.col(c).alias(f"old_{c}") for c in old.columns if c not in (*keys, "id")))
    joined = o.join(new.withColumn("_new", F.lit(True)), keys, "full_outer")
    same = F.col("_new").isNull() | F.col("id").eqNullSafe(F.col("old_id"))
    out = [*keys, F.coalesce("id", "old_id").alias("id")]
    for c in old.columns:
        if c in (*keys, "id"):
            continue
        if c in work:
            fresh = F.lit("pending") if c == "status" else F.lit(None).cast("string")
            out.append(F.when(same, F.col(f"old_{c}")).otherwise(fresh).alias(c))
        elif c in new.columns:
            out.append(F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c))
        else:
            out.append(F.when(same, F.col(f"old_{c}")).alias(c))
    return joined.select(*out)


def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace rows of old with their key; columns that new lacks keep old's values (page upsert)."""
    extra = [c for c in old.columns if c not in new.columns]
    kept = old.join(new.select(*keys), keys, "left_anti")
    fresh = new.join(old.select(*keys, *extra), keys, "left") if extra else new
    return kept.unionByName(fresh.select(*old.columns))


def last_written(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of a key, the one written last (image and check replacement)."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of new whose key old lacks are added, one for each key: the first by `order`, or by all columns where none is given."""
    rank = F.struct(*([order] if order else []), *(F.col(c).cast("string") for c in old.columns))
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*old.columns), rank).alias("r")).select("r.*")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def set_page(pages: DataFrame, results: DataFrame, column: str) -> DataFrame:
    """status or summary of the pages named in results (page_no, value)."""
    got = pages.join(results.select("page_no", F.col("value").alias("_value")), "page_no", "left")
    return got.withColumn(column, F.coalesce("_value", column)).select(*pages.columns)


def all_final(blocks: DataFrame) -> DataFrame:
    """Pages all of whose blocks are final."""
    return blocks.groupBy("page_no").agg(F.bool_and(F.col("final").isNotNull()).alias("all")).where("all").select("page_no")


def set_text(blocks: DataFrame, results: DataFrame, column: str) -> DataFrame:
    """draft or final of the blocks named by id in results (id, text), with the status that goes with it."""
    status = {"draft": "drafted", "final": "final"}[column]
    got = blocks.join(results.select("id", F.col("text").alias("_text")), "id", "left")
    return got.withColumn(column, F.coalesce("_text", column)).withColumn("status", F.when(F.col("_text").isNotNull(), F.lit(status)).otherwise(F.col("status"))).select(*blocks.columns)


def pages_needing(blocks: DataFrame, column: str) -> DataFrame:
    """Pages with a block that lacks draft or final."""
    return blocks.where(F.col(column).isNull()).select("page_no").distinct()


def review_ready(blocks: DataFrame, force: bool = False) -> DataFrame:
    """Pages whose blocks are all drafted and, unless forced, not all final."""
    ready = F.bool_and(F.coalesce(F.col("draft"), F.lit("")) != "") & (F.lit(force) | F.bool_or(F.col("final").isNull()))
    return blocks.groupBy("page_no").agg(ready.alias("ready")).where("ready").select("page_no")


def latest_failures(qa: DataFrame) -> DataFrame:
    """(page_no, kind) whose last attempt failed."""
    last = qa.groupBy("page_no", "kind").agg(F.max(F.struct("attempt", "passed", *[c for c in qa.columns if c not in ("page_no", "kind", "attempt", "passed")])).alias("r"))
    return last.select("page_no", "kind", "r.*").where("passed = 0")


def counts(blocks: DataFrame) -> DataFrame:
    """Totals of the table: blocks, drafted, final, neither, unreviewed, pages and the share drafted."""
    none = F.col("draft").isNull() & F.col("final").isNull()
    drafted = F.count("draft")
    return blocks.agg(
        F.count("*").alias("blocks"), drafted.alias("drafted"), F.count("final").alias("finalised"),
        F.count_if(none).alias("untranslated"), F.count_if(F.col("final").isNull()).alias("unreviewed"),
        F.count_distinct("page_no").alias("pages"), F.round(100 * drafted / F.count("*"), 1).alias("drafted_pct"),
    )


def target(final: Column, draft: Column) -> Column:
    """The text that rules look at: empty texts count as missing."""
    return F.coalesce(F.nullif(final, F.lit("")), F.nullif(draft, F.lit("")), F.lit(""))


def log_entries(spark, entries: list[tuple[str, str, str]]) -> DataFrame:
    """(stage, message, level) with a timestamp, to be appended to a run log."""
    return spark.createDataFrame(entries, "stage string, message string, level string").withColumn("at", F.current_timestamp())
