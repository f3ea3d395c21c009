"""Parallel-corpus operators: unions, dictionary lines, nearest neighbours, extractor cross-checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def unified(parts: list[tuple[DataFrame, Column, Column, str, str]]) -> DataFrame:
    """english and target as arrays, with constant source and type, of several tables: (table, english, target, source, type)."""
    out = None
    for table, english, target, source, kind in parts:
        got = table.select(english.alias("english"), target.alias("target"), F.lit(source).alias("source"), F.lit(kind).alias("type"))
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out


def dictionary_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """(english, target) of lines with two columns: Latin words, two or more blanks, the rest. One-letter entries go."""
    latin, gap = r"[A-Za-z0-9(),.\x20\x09-\x0D-]", r"[\x20\x09-\x0D]"
    columns = rf"\A({latin}+?){gap}{{2,}}([^\n\r]+)\z"
    got = lines.withColumn("english", T.strip(F.regexp_extract(text, columns, 1))).withColumn("target", T.strip(F.regexp_extract(text, columns, 2)))
    return got.where("target <> '' and length(english) > 1")


def bypassed(paragraphs: DataFrame, text: str = "text", kind: str = "type") -> DataFrame:
    """Paragraphs that aren't translated: images, tables, equations and code; code gets its own type."""
    fixed = F.col(kind).isin("image_ref", "table", "equation")
    code = T.is_code(F.col(text))
    relabelled = F.when(code & ~F.col(kind).isin("table", "equation"), F.lit("code_block")).otherwise(F.col(kind))
    return paragraphs.where(F.coalesce(fixed, F.lit(False)) | code).withColumn(kind, relabelled)


#: Bytes of query vectors that are broadcast in one pass over the vectors.
QUERY_BYTES = 64 << 20


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 3, block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id) of the k nearest vectors by squared distance, ties by id. Both: vec_id, embedding.

    Exact. Queries are dealt by hash to as many passes as keep each below QUERY_BYTES; in a pass every
    task keeps the k best of its own vectors for each query, and those few meet by query.
    """
    import numpy as np

    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    passes = max(1, -(-size["n"] * (8 * (size["d"] or 0) + 8) // (QUERY_BYTES // 2)))
    spark = vectors.sparkSession
    out = "query_id long, distance double, vec_id long"
    near = spark.createDataFrame([], out)
    for p in range(passes if size["n"] else 0):
        rows = queries.where(F.col("embedding").isNotNull() & (F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p)).select("vec_id", "embedding").collect()  # some QUERY_BYTES / 2
        if not rows:
            continue
        sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)))

        def best(batches, sent=sent):
            ids, q = sent.value
            held_d, held_i = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)
            for pdf in batches:
                pdf = pdf[pdf.embedding.notna()]
                for a in range(0, len(pdf), block):
                    v, names = np.stack(pdf.embedding.iloc[a : a + block].to_numpy()).astype(float), pdf.vec_id.to_numpy()[a : a + block]
                    for b in range(0, len(ids), block):
                        rows_ = slice(b, b + block)
                        d = np.zeros((len(ids[rows_]), len(v)))
                        for c in range(v.shape[1]):  # by coordinate: sums of squares in a fixed order
                            d += np.subtract.outer(q[rows_, c], v[:, c]) ** 2
                        d = np.round(d, 9)
                        d[ids[rows_, None] == names[None]] = np.inf
                        if b == 0:
                            new_d, new_i = [], []
                        both_d, both_i = np.hstack([held_d[rows_], d]), np.hstack([held_i[rows_], np.broadcast_to(names, d.shape)])
                        order = np.lexsort((both_i, both_d), axis=1)[:, :k]
                        new_d.append(np.take_along_axis(both_d, order, 1))
                        new_i.append(np.take_along_axis(both_i, order, 1))
                    held_d, held_i = np.vstack(new_d), np.vstack(new_i)
            keep = np.isfinite(held_d)
            yield pd.DataFrame({"query_id": np.repeat(ids, keep.sum(1)), "distance": held_d[keep], "vec_id": held_i[keep]})

        near = near.unionByName(vectors.select("vec_id", "embedding").mapInPandas(best, out))
    return near.selectExpr("query_id", "vec_id", "row_number() over (partition by query_id order by distance, vec_id) as rank").where(F.col("rank") <= k)


def cross_checked(elements: DataFrame, methods: tuple[str, str, str], *keys: str) -> DataFrame:
    """Verdict on each key from the characters that three extractors found: blank, major, variance, garbage or match, in this order. elements: keys, method, type, text."""
    n = F.when(F.coalesce(F.col("type"), F.lit("")) != "image_ref", F.length(F.coalesce("text", F.lit("")))).otherwise(0)
    counted = elements.groupBy(*keys).agg(*(F.sum(F.when(F.col("method") == m, n).otherwise(0)).alias(f"n{i}") for i, m in enumerate(methods)), F.bool_or((F.col("method") == methods[0]) & F.col("text").contains("(cid:")).alias("cid"))
    c = [F.col(f"n{i}") for i in range(3)]
    total = c[0] + c[1] + c[2]
    # |c - total/3| / (total/3 + 1) > 0.1, in whole numbers
    far = [F.abs(3 * x - total) * 10 > total + 3 for x in c]
    verdict = (
        F.when(F.greatest(*c) < 20, "blank").when(F.least(*c) * 2 < F.greatest(*c), "major")
        .when(far[0] | far[1] | far[2], "variance").when(F.coalesce("cid", F.lit(False)), "garbage").otherwise("match")
    )
    return counted.select(*keys, "n0", "n1", "n2", verdict.alias("verdict"))
