"""MinHash near-deduplication by a join of inverted signature coordinates.

Each distinct shingle set has a signature of K coordinates. Sets are posted under each
coordinate-value pair; two sets of similarity 0.8 agree in at least T of K coordinates but for a
chance of about 2e-8. Postings are counted, pairs of count 1 can't collide, and the rest are merged
by the prefix rule: with a set's shared pairs ordered from rare to frequent, two sets that agree in
T coordinates share one of the first (shared - T + 1), so only those are joined and the long lists
at the end are skipped. Candidates must agree in T coordinates and are then confirmed on full sets.

Copies never meet each other as pairs: equal sets form one class, and a list is joined in two
passes: all members with one pivot (its most central member), then only members that the links so
far leave in another component than the pivot, with the members of other components. A link needs
9 * |A & B| >= 4 * (|A| + |B|), and |A & B| is at most the number of a set's shingles that any other
candidate has: sets and pairs that can't reach it are left out before. Long lists of the second pass
are merged by prefixes of the sets themselves (_unmet()).

Hot keys are split: posts, pairs and holders are counted before they are joined, so both sides of a
join know in how many parts a key is dealt; the side with few rows of it is copied to each part.
Exploded sides of joins are merged, never broadcast: their size is guessed from the files of the
table before, which are far smaller than its rows. Candidates' texts are picked in the scan by a digest of bounded size, then joined exactly.

Defined results: texts without words, and null texts, have no shingles and no links; fewer than
four words make one shingle of the whole sequence; repeated rows are each returned, rows that share
a doc_id count as one document with several texts; a null doc_id is never a representative, and a
component of such rows only has a null id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from .common import Words, materialise, mix, release, table, texts_udf

K = 64
T = 32
WORDS = 4
#: Bits a candidate of the digest that picks texts in the scan, at least, and bits in all, at most (4 MB); a full digest lets more texts through to the exact join.
DIGEST_BITS, MOST_BITS = 16, 1 << 25
#: Bits of a page of the digest: those of Spark's bitmaps.
PAGE_BITS = 32_768
#: Members of a list that is joined as it is, at most.
SHORT = 64
#: Members of a list, pairs of a document, or holders of a shingle that one task gets of a hot one, about; a part of its own for each more.
SPLIT = 256
#: Parts of every key where counts aren't known beforehand.
JUMPS = 8

_U = np.uint64
_random = np.random.default_rng(20240607)
_A = (_random.integers(0, 2**64, K, dtype=_U) | _U(1))[:, None]
_B = _random.integers(0, 2**64, K, dtype=_U)[:, None]
_SALT = _random.integers(0, 2**64, K, dtype=_U)


def shingle_sets(raw: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text of a block."""
    w = Words(raw, starts)
    hashes, at = w.grams(WORDS)
    cuts = np.searchsorted(w.doc[at], np.arange(len(starts)))
    out = []
    for k in range(len(starts) - 1):
        n = w.count[k]
        if n >= WORDS:
            out.append(np.unique(hashes[cuts[k] : cuts[k + 1]]))
        elif n:
            h = np.zeros(1, _U) + _U(n)
            with np.errstate(over="ignore"):
                for x in w.hash[w.doc_at[k] : w.doc_at[k] + n]:
                    h = mix((h ^ x) * _U(0x9FB21C651E98DF25))
            out.append(h)
        else:
            out.append(np.zeros(0, _U))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """K coordinate-value pairs as 64-bit numbers."""
    low = np.full(K, 2**64 - 1, _U)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            np.minimum(low, (_A * shingles[None, i : i + 4096] + _B).min(axis=1), out=low)
        return mix(low ^ _SALT)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, _U)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sign(raw: np.ndarray, starts: np.ndarray) -> dict:
    sets = shingle_sets(raw, starts)
    none = np.zeros(0, _U)
    return {
        "n": [len(s) for s in sets],
        "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
        "pairs": _lists([signature(s) if len(s) else none for s in sets]),
    }


def _sets(raw: np.ndarray, starts: np.ndarray) -> dict:
    sets = shingle_sets(raw, starts)
    return {"shingles": _lists(sets), "pairs": _lists([signature(s) for s in sets])}


def _linked(batches):
    """Pairs that agree in T coordinates and whose full sets are similar enough."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        views = []
        for name in ("p_pairs", "q_pairs", "p_shingles", "q_shingles"):
            col = batch.column(name)
            views.append((col.offsets.to_numpy(), col.values.to_numpy()))
        (pa_o, pa_v), (pb_o, pb_v), (sa_o, sa_v), (sb_o, sb_v) = views
        for i in range(batch.num_rows):
            if np.count_nonzero(pa_v[pa_o[i] : pa_o[i + 1]] == pb_v[pb_o[i] : pb_o[i + 1]]) >= T:
                x, y = sa_v[sa_o[i] : sa_o[i + 1]], sb_v[sb_o[i] : sb_o[i + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= 80 * (len(x) + len(y) - common)
        yield batch.select(["p", "q", "p_splits", "q_splits"]).take(pa.array(np.flatnonzero(keep)))


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (p, q) that are links, with `splits` of both. p may be in any number of pairs: its set is sent to `splits` (a function of p) tasks."""
    heads = pairs.groupBy("p").agg(F.max("splits").alias("n_splits")).join(sets.withColumnRenamed("doc_id", "p"), "p")
    heads = heads.select("p", F.explode(F.sequence(F.lit(0), F.col("n_splits") - 1)).alias("split"), F.col("splits").alias("p_splits"), F.col("pairs").alias("p_pairs"), F.col("shingles").alias("p_shingles"))
    tails = sets.select(F.col("doc_id").alias("q"), F.col("splits").alias("q_splits"), F.col("pairs").alias("q_pairs"), F.col("shingles").alias("q_shingles"))
    dealt = pairs.select("p", "q", _split("q", "splits").alias("split")).join(tails, "q").join(heads, ["p", "split"])
    return dealt.drop("split").mapInArrow(_linked, "p long, q long, p_splits int, q_splits int")


def _split(key: str, splits: str) -> Column:
    """Which of so many parts a key's row goes to."""
    return F.pmod(F.xxhash64(key), F.col(splits)).cast("int")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label): the smallest node that each node with an edge reaches. edges: p, q, and in how many parts each of them is dealt where it is a hub. rounds: stop early; equal labels then still mean connected.

    Labels take the smallest one around them, then jump to their own label's label; each round is a written table.
    """
    there = edges.where("p <> q").select(F.col("p").alias("node"), F.col("q").alias("other"), F.col("p_splits").alias("own"), F.col("q_splits").alias("splits"))
    back = there.select(F.col("other").alias("node"), F.col("node").alias("other"), F.col("splits").alias("own"), F.col("own").alias("splits"))
    both = materialise(there.union(back).distinct().withColumn("split", _split("node", "splits")).drop("splits"), "edges")
    labels = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label"), F.max("own").alias("own")), "labels")
    written, done = labels, 1
    while rounds is None or done < rounds:
        near = labels.select(F.col("node").alias("other"), F.col("label").alias("near"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("split"))
        around = both.join(near, ["other", "split"]).groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(around, "node").select("node", "label", "own", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far")).where("far <> next").join(lower.select("next").distinct(), "next", "left_semi")
        jump = jump.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(JUMPS - 1))))
        dealt = lower.withColumn("split", F.pmod(F.xxhash64("node"), F.lit(JUMPS)).cast("int")).join(jump, ["next", "split"], "left")
        new = materialise(dealt.select("node", F.least("next", "far").alias("label"), "own", (F.least("next", "far") < F.col("label")).alias("changed")), "labels")
        release(written)
        labels, written, done = new.select("node", "label", "own"), new, done + 1
        if rounds is None and new.where("changed").isEmpty():
            break
    release(both)
    return labels.select("node", "label")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of documents (doc_id, text)."""
    signed = materialise(
        documents.select("doc_id", texts_udf(_sign, "n long, set_key binary, pairs array<long>")(F.col("text")).alias("s")).select("doc_id", "s.*"),
        "signed",
    )
    classes = materialise(
        signed.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("pairs").alias("pairs")),
        "classes",
    )
    merged = _merge(documents, classes)
    of = (
        classes.select("set_key", F.col("doc_id").alias("node"))
        .join(merged, "node", "left")
        .select("set_key", F.coalesce("label", "node").alias("component_id"))
    )
    got = signed.select("doc_id", "n", "set_key").join(of, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return got.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _merge(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, label) of the classes' representatives that have links."""
    posted = classes.select("doc_id", F.explode("pairs").alias("pair"))
    counts = posted.groupBy("pair").agg(F.count("*").alias("posts")).where("posts > 1")
    candidates = materialise(
        posted.hint("merge").join(counts, "pair")
        .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("posts", "pair"))).alias("shared"))  # K at most
        .where(F.size("shared") >= T)
        .select("doc_id", F.expr(f"slice(shared, 1, size(shared) - {T - 1})").alias("prefix"), F.expr("aggregate(shared, 0L, (t, s) -> t + s.posts)").alias("central"))
        .withColumn("splits", F.expr(f"cast(1 + array_max(transform(prefix, s -> s.posts)) div {SPLIT} as int)")),
        "candidates",
    )
    ids = candidates.select("doc_id", "splits")
    chosen = _picked(documents.select("doc_id", "text"), ids).join(ids, "doc_id")
    sets = materialise(
        chosen.select("doc_id", "splits", texts_udf(_sets, "shingles array<long>, pairs array<long>")(F.col("text")).alias("s")).select("doc_id", "splits", "s.*").where(F.size("shingles") > 0),
        "sets",
    )
    alone = (
        sets.select("doc_id", F.explode("shingles").alias("shingle"))
        .groupBy("shingle").agg(F.count("*").alias("k"), F.min("doc_id").alias("doc_id")).where("k = 1")
        .groupBy("doc_id").agg(F.count("*").alias("alone"))
    )
    sizes = sets.groupBy("doc_id").agg(F.max(F.size("shingles")).cast("long").alias("n"))  # several texts of an id: the longest bounds them
    lists = materialise(
        candidates.join(sizes, "doc_id").join(alone, "doc_id", "left")
        .select("doc_id", "central", "splits", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("m"), "prefix")
        .where("5 * m >= 4 * n")
        .select("doc_id", "central", "splits", "n", "m", F.explode("prefix").alias("s"))
        .select("doc_id", "central", "splits", "n", "m", "s.pair", F.expr(f"s.posts div {SPLIT}").alias("last_part"))
        .withColumn("part", F.expr("pmod(xxhash64(doc_id), last_part + 1)")),
        "lists",
    )
    may = "9 * least({0}.m, {1}.m) >= 4 * ({0}.n + {1}.n)"
    pivots = (
        lists.groupBy("pair").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("d"), "n", "m", "splits")).alias("p"), F.count("*").alias("k"), F.max("last_part").alias("last_part"))
        .where("k > 1").select("pair", (-F.col("p.d")).alias("pivot"), "p.n", "p.m", "p.splits", "k", "last_part")
    )
    to_parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_part"))).alias("part")  # a long list meets copies of its pivot in several tasks
    first = (
        lists.alias("x").join(pivots.select("pair", "pivot", "n", "m", "splits", to_parts).alias("y").hint("merge"), (F.col("x.pair") == F.col("y.pair")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.doc_id") != F.col("y.pivot")) & F.expr(may.format("x", "y")))
        .select(F.col("pivot").alias("p"), F.col("doc_id").alias("q"), F.col("y.splits").alias("splits")).distinct()
    )
    first = materialise(first, "first")
    found = materialise(links(first, sets), "links")
    labels = components(found, 3)
    heads = pivots.join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("main")), "pivot", "left").select("pair", "k", F.coalesce("main", "pivot").alias("main"), to_parts)
    named = materialise(
        lists.join(labels.toDF("doc_id", "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")).join(heads.hint("merge"), ["pair", "part"])
        .select("pair", "k", "doc_id", "n", "m", "splits", "label", "main"),
        "named",
    )
    met = first.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    second = _unmet(named, sets, may).join(met, (F.least("p", "q") == F.col("a")) & (F.greatest("p", "q") == F.col("b")), "left_anti")
    second = materialise(second, "second")  # links() reads the pairs twice: one plan of both would be the driver's largest
    more = materialise(links(second, sets), "links")
    release(candidates, lists, first, second, named, sets)
    merged = components(found.union(more))
    release(found, more)
    return merged


def _picked(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of documents whose doc_id is in ids, and a few others. Executors mark a bit for the hash of each id; only these pages of bits are broadcast, so the driver never holds the ids."""
    bits = min(MOST_BITS, max(PAGE_BITS, 1 << (DIGEST_BITS * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    marked = ids.select(bit.alias("bit")).selectExpr(f"bit div {PAGE_BITS} as page", f"bit % {PAGE_BITS} as at")
    digest = marked.groupBy("page").agg(F.expr("bitmap_construct_agg(at)").alias("marks"))
    byte = f"cast(conv(hex(substring(marks, cast(bit % {PAGE_BITS} div 8 as int) + 1, 1)), 16, 10) as int)"
    on = F.expr(f"bit div {PAGE_BITS} = page and shiftright({byte}, cast(bit % 8 as int)) & 1 = 1")
    return documents.withColumn("bit", bit).join(broadcast(digest), on, "left_semi").drop("bit")


def _pairs(x: DataFrame, y: DataFrame, on: str) -> DataFrame:
    """Distinct pairs of rows of two tables; the one that may be in more pairs becomes p."""
    both = x.alias("x").join(y.alias("y").hint("merge"), F.expr(on))
    turned = both.selectExpr("x.splits > y.splits or (x.splits = y.splits and x.doc_id < y.doc_id) as straight", "x.doc_id as x", "y.doc_id as y", "greatest(x.splits, y.splits) as splits")
    return turned.select(F.when(F.col("straight"), F.col("x")).otherwise(F.col("y")).alias("p"), F.when(F.col("straight"), F.col("y")).otherwise(F.col("x")).alias("q"), "splits").distinct()


def _unmet(named: DataFrame, sets: DataFrame, may: str) -> DataFrame:
    """Pairs (p, q) that share a list, lie in different components and may be linked.

    Short lists are joined as they are. Members of long lists meet by their sets: with a set's
    shingles ordered from rare to frequent, a link's smaller set has one of its first n / 9 + 1
    among the first n / 5 + 1 of the larger, as they share 4 / 9 of both sizes. What a template
    gives to all members comes last in that order, so members that only share a template don't meet:
    at the first shingle that two sets share, the rest of both must still hold what a link needs.
    """
    rest = named.where("label <> main")
    apart = "x.label <> y.label and (y.label = y.main or x.doc_id < y.doc_id) and "
    found = _pairs(rest.where(f"k <= {SHORT}"), named.where(f"k <= {SHORT}"), "x.pair = y.pair and " + apart + may.format("x", "y"))
    open_lists = rest.where(f"k > {SHORT}").select("pair").distinct()
    members = named.where(f"k > {SHORT}").join(open_lists, "pair", "left_semi").groupBy("doc_id").agg(F.first("label").alias("label"), F.max("n").alias("n"), F.max("m").alias("m"))
    members = materialise(members, "members")
    if members.isEmpty():
        return found
    part = F.pmod(F.xxhash64("doc_id"), F.lit(JUMPS)).cast("int").alias("part")  # a template's shingles are in all sets
    held = sets.join(members, "doc_id").select("doc_id", "splits", "label", "n", "m", F.xxhash64("shingles").alias("set"), F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"), part)
    held = materialise(held, "held")
    often = held.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(JUMPS - 1))))
    ranked = held.join(often.hint("merge"), ["shingle", "part"], "left").groupBy("doc_id", "splits", "label", "n", "m", "set", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("holders", F.lit(0)).alias("holders"), "shingle"))).alias("s"))
    placed = ranked.select("doc_id", "splits", "label", "n", "m", "size", F.posexplode(F.expr("slice(s, 1, size div 5 + 1)")).alias("at", "s"))
    placed = materialise(placed.where("s.holders > 1").select("doc_id", "splits", "label", "n", "m", "size", "at", "s.shingle", F.expr(f"s.holders div {SPLIT}").alias("last_part")), "placed")
    smaller = placed.where("at < size div 9 + 1").withColumn("part", F.expr("pmod(xxhash64(doc_id), last_part + 1)"))
    larger = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_part"))))
    by_set = _pairs(smaller, larger, "x.shingle = y.shingle and x.part = y.part and x.label <> y.label and x.size <= y.size and 9 * least(x.size - x.at, y.size - y.at) >= 4 * (x.size + y.size) and " + may.format("x", "y"))
    return found.union(by_set).distinct()


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) end as shingles from w),
e as (select doc_id, unnest(shingles) as h from s),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join s x on x.doc_id = a join s y on y.doc_id = b where 100 * c >= 80 * (len(x.shingles) + len(y.shingles) - c)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as other from s union select r.doc_id, edges.b from reach r join edges on edges.a = r.other)
select doc_id, any_value(len(shingles)) as n_shingles, min(other) as component_id, doc_id = min(other) as kept from s join reach using (doc_id) group by doc_id
"""
