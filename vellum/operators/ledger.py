"""Call ledgers, cost, revision rates and tier comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CACHED_PRICE = 0.1


def usage(calls: DataFrame, *group: str) -> DataFrame:
    """Sums of a call ledger (input, cached, output)."""
    return calls.groupBy(*group).agg(F.count("*").alias("calls"), *(F.sum(c).cast("long").alias(c) for c in ("input", "cached", "output")))


def cost(summed: DataFrame, price_in: Column, price_out: Column) -> DataFrame:
    """Adds cost_usd: input not from the cache, floored at 0 after summing; cached input at a tenth; output. Prices are per million."""
    billed = F.greatest(F.col("input") - F.col("cached"), F.lit(0))
    return summed.withColumn("cost_usd", F.round((billed * price_in + F.col("cached") * price_in * CACHED_PRICE + F.col("output") * price_out) / 1e6, 6))


def revision_rate(blocks: DataFrame, *group: str) -> DataFrame:
    """Share of reviewed blocks whose final text differs from the draft, white space at the ends aside; `inert` below one per cent."""
    changed = F.count_if(T.strip(F.coalesce("final", F.lit(""))) != T.strip(F.coalesce("draft", F.lit(""))))
    got = blocks.groupBy(*group).agg(F.count("*").alias("blocks"), changed.alias("changed"))
    rate = F.round(100 * F.col("changed") / F.col("blocks"), 1)
    return got.withColumn("rate", rate).withColumn("inert", F.col("rate") < 1.0)


def tier_pivot(outputs: DataFrame, tiers: list[str], *keys: str) -> DataFrame:
    """A column for each tier with its text for each key, `(missing)` where it has none."""
    got = outputs.groupBy(*keys).pivot("tier", tiers).agg(F.max("text"))
    return got.select(*keys, *(F.coalesce(F.col(f"`{t}`"), F.lit("(missing)")).alias(t) for t in tiers))


def markdown(pivoted: DataFrame, tiers: list[str], source: str = "source") -> DataFrame:
    """Lines of a side-by-side report, in order of page and block."""
    parts = [F.concat(F.lit("**Source ["), F.col("block_index").cast("string"), F.lit("]**\n\n> "), F.col(source))]
    parts += [F.concat(F.lit(f"*{t}*\n\n> "), F.col(t)) for t in tiers]
    return pivoted.orderBy("page_no", "block_index").select(F.concat_ws("\n\n", *parts).alias("value"))
