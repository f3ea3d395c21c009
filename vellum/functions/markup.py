"""Styled runs, tags and cluster-safe tag places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = "array<struct<start:int,end:int,i:boolean,b:boolean>>"


def apply_markup(text: Column, runs: Column) -> Column:
    """The text with <i> and <b> around its runs, in order; runs that are empty or overlap an earlier one are left out."""
    n = F.length(text)
    clamped = F.transform(F.array_sort(runs), lambda r: F.struct(F.greatest(r.start, F.lit(0)).alias("s"), F.least(r.end, n).alias("e"), r.i.alias("i"), r.b.alias("b")))

    def tagged(inner: Column, on: Column, tag: str) -> Column:
        return F.when(F.coalesce(on, F.lit(False)), F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))).otherwise(inner)

    def step(acc: Column, r: Column) -> Column:
        inner = F.substring(text, r.s + 1, r.e - r.s)
        marked = tagged(tagged(inner, r.b, "b"), r.i, "i")
        out = F.concat(acc.out, F.substring(text, acc.pos + 1, r.s - acc.pos), marked)
        use = (r.s < r.e) & (r.s >= acc.pos)
        return F.struct(F.when(use, out).otherwise(acc.out).alias("out"), F.when(use, r.e).otherwise(acc.pos).alias("pos"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    done = F.aggregate(clamped, start, step, lambda a: F.concat(a.out, F.substring(text, a.pos + 1, F.length(text))))
    return F.when(runs.isNull() | (F.size(runs) == 0), text).otherwise(done)


def merge_runs(runs: Column) -> Column:
    """Adjacent runs of one style joined."""

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (r.start <= last.end) & (r.i == last.i) & (r.b == last.b)
        joined = F.struct(last.start.alias("start"), F.greatest(last.end, r.end).alias("end"), last.i.alias("i"), last.b.alias("b"))
        front = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(front, F.array(joined))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(runs), F.array().cast(RUNS), step)


def snap_to_clusters(text: Column) -> Column:
    """Tags moved behind the marks and conjuncts that belong to the letter before them; a tag that follows a virama stays whole."""
    tail = "((?:[\\p{Mn}\\p{Mc}]|(?<=्)[^<])+)"
    return F.regexp_replace(text, f"(?s)(</?[ib]>)(?:{tail})", "$2$1")


def close_open_tags(head: Column, tail: Column) -> Column:
    """struct<head, tail> where emphasis that the cut left open is closed before it and opened after it."""
    from .text import count_of

    for tag in ("b", "i"):
        is_open = count_of(head, f"<{tag}>") > count_of(head, f"</{tag}>")
        head, tail = F.when(is_open, F.concat(head, F.lit(f"</{tag}>"))).otherwise(head), F.when(is_open, F.concat(F.lit(f"<{tag}>"), tail)).otherwise(tail)
    return F.struct(head.alias("head"), tail.alias("tail"))


def css(size: Column, align: Column, line_height: float = 1.30) -> Column:
    return F.format_string(f"p {{ font-size: %spx; line-height: {line_height:.2f}; text-align: %s; }}", size.cast("string"), align)
