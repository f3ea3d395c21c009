"""Glossary building: candidates, first wins, locked entries, prompt lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

NO_TERMS = "(no glossary terms yet)"


def candidates(sections: list[DataFrame]) -> DataFrame:
    """All sections' terms, repeats kept."""
    return reduce(lambda a, b: a.unionByName(b), sections)


def merged(terms: DataFrame, locked: DataFrame) -> DataFrame:
    """First of each term (by `pos`) without regard to case and outer white space, blanks dropped; a locked entry wins over it; locked ones it lacks are added after."""
    keyed = terms.withColumn("key", F.lower(T.strip(F.col("english")))).where("key <> ''")
    first = keyed.groupBy("key").agg(F.min_by(F.struct("english", "target", "kind"), "pos").alias("t"), F.min("pos").alias("pos"))
    held = locked.select(F.lower("english").alias("key"), F.struct("english", "target", "kind").alias("l"))
    got = first.join(held, "key", "full_outer")
    chosen = F.coalesce("l", "t")
    return got.select(chosen.english.alias("english"), chosen.target.alias("target"), chosen.kind.alias("kind"), F.col("l").isNotNull().alias("locked"), "pos")


def prompt_lines(terms: DataFrame, limit: int = 400) -> DataFrame:
    """One row `lines`: the first `limit` terms by pos, nulls last."""
    top = terms.orderBy(F.col("pos").asc_nulls_last(), "english").limit(limit)
    line = F.struct(F.col("pos").isNull().alias("late"), "pos", "english", F.concat(F.lit("- "), "english", F.lit("  ->  "), "target").alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.line), "\n")
    return top.agg(F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_TERMS)).alias("lines"))
