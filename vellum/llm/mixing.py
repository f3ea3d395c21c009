"""Mixing sources to target weights: hierarchical budgeting over a domain-language-source tree.

A token budget is propagated from the root: each node shares its amount among its children by
weight, a child takes at most what its leaves hold in `max_epochs` epochs, and what one child can't
take goes to its siblings by weight; only what a whole subtree can't take reaches the siblings of
its root. A leaf's stream is one seeded shuffle of its documents after another (epochs), cut at the
leaf's budget: whole epochs, then the longest prefix of the next shuffle that fits.

No leaf is ordered in one task. The shuffles' keys are cut into ranges of about `RANGE` documents;
range sums find the range where a leaf's budget ends, only that range is ordered, and the last key
that fits then decides every row by comparison.

Defined results: null and empty texts have no tokens and come along with the keys around them; null
language or source is a branch of its own, named `(none)`; repeated rows have the same key and are
taken or left together; no rows or no tokens give an empty result; extra columns stay in `select()`,
whatever their names, but for ones named like added columns, which are replaced.

Tokens are words unless another count is given; where a later stage cuts words into pieces, shares
of pieces differ from the weights by the languages' pieces per word.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from .common import materialise, table

RANGE = 1000
#: Leaves that are budgeted on the driver and broadcast, at most; a larger tree is budgeted by window sums and joined.
MOST_LEAVES = 200_000


@dataclass(frozen=True)
class Mix:
    """share: of all tokens, the budget. weights: of a node below its parent, by path (a tuple), else by its own name at any place, else 1."""

    share: float = 0.6
    max_epochs: int = 2
    seed: int = 17
    weights: dict = field(default_factory=dict)

    def weight(self, path: tuple[str, ...]) -> float:
        return float(self.weights.get(path, self.weights.get(path[-1], 1.0)))


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: str = "source") -> Column:
    """The domain of a source where tables name none: its number modulo 4."""
    number = F.expr(f"try_cast(regexp_extract({source}, '([0-9]+)$', 1) AS int)")
    return F.concat(F.lit("domain"), F.coalesce(number % 4, F.lit(0)).cast("string"))


def poured(amount: float, children: list[tuple[str, float, float]]) -> dict[str, float]:
    """Shares `amount` among (name, weight, capacity) by weight; what overflows one goes to the others."""
    rest, weight, out = amount, sum(w for _, w, _ in children), {}
    for name, w, most in sorted(children, key=lambda c: (c[2] / c[1] if c[1] else float("inf"), c[0])):
        out[name] = min(rest * w / weight, most) if w else 0.0
        rest -= out[name]
        weight -= w
    return out


def budgets(leaves: dict[tuple[str, ...], int], mix: Mix) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf (a path of equal length) that holds so many tokens."""
    held: dict[tuple[str, ...], float] = {}
    below: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    for path, n in leaves.items():
        for k in range(len(path) + 1):
            held[path[:k]] = held.get(path[:k], 0) + n * mix.max_epochs
            if k:
                below.setdefault(path[: k - 1], set()).add(path[:k])
    given = {(): min(mix.share * sum(leaves.values()), held.get((), 0))}
    for k in range(max(map(len, leaves), default=0)):
        for node in sorted(p for p in given if len(p) == k):
            shares = poured(given[node], [(c[-1], mix.weight(c), held[c]) for c in sorted(below[node])])
            given |= {(*node, name): amount for name, amount in shares.items()}
    return {p: int(given[p] + 1e-6) for p in leaves}


def _weight(mix: Mix, path: list[str]) -> Column:
    """Mix.weight() of the node whose path is in these columns."""
    by_path = {json.dumps(k, ensure_ascii=False, separators=(",", ":")): float(w) for k, w in mix.weights.items() if not isinstance(k, str) and len(k) == len(path)}
    by_name = {k: float(w) for k, w in mix.weights.items() if isinstance(k, str)}
    look = lambda d, key: F.try_element_at(F.from_json(F.lit(json.dumps(d)), "map<string,double>"), key)
    return F.coalesce(look(by_path, F.to_json(F.array(*path))), look(by_name, F.col(path[-1])), F.lit(1.0))


def budgeted(leaves: DataFrame, mix: Mix, path: list[str]) -> DataFrame:
    """leaves (columns of path, tokens) with `budget`: what budgets() gives, level by level by window sums over siblings."""
    held = F.sum("tokens").cast("double")
    given = leaves.agg(F.least(mix.share * held, mix.max_epochs * held).alias("given"))
    for k in range(1, len(path) + 1):
        parent, name = path[: k - 1], path[k - 1]
        nodes = leaves.groupBy(*path[:k]).agg((held * mix.max_epochs).alias("most")).withColumn("w", _weight(mix, path[:k]))
        nodes = nodes.join(given, parent) if parent else nodes.crossJoin(broadcast(given))
        siblings = Window.partitionBy(*parent)
        ratio = F.when(F.col("w") > 0, F.try_divide("most", "w"))
        first = siblings.orderBy(ratio.asc_nulls_last(), F.asc(name)).rowsBetween(Window.unboundedPreceding, -1)
        last = siblings.orderBy(ratio.desc_nulls_first(), F.desc(name)).rowsBetween(Window.unboundedPreceding, 0)
        nodes = nodes.withColumns({"before": F.coalesce(F.sum("most").over(first), F.lit(0.0)), "weight": F.sum("w").over(last)})
        nodes = nodes.withColumn("full", (F.col("w") > 0) & (F.col("most") * F.col("weight") <= F.col("w") * (F.col("given") - F.col("before"))))
        taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(siblings), F.lit(0.0))
        weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(siblings)
        share = F.when(F.col("w") == 0, 0.0).when(F.col("full"), F.col("most")).otherwise(F.try_divide(F.col("w") * (F.col("given") - taken), weight))
        given = nodes.select(*path[:k], share.alias("given"))
    return leaves.join(given, path).withColumn("budget", F.floor(F.col("given") + 1e-6).cast("long")).drop("given")


_LEAF = ("domain", "lang", "source")


def _branches(documents: DataFrame, tokens: Column | None) -> DataFrame:
    """doc_id, _domain, _lang, _source, _tokens, and the whole row as _row."""
    branch = [F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(f"_{c}") for c in ("lang", "source")]
    n = words() if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    return documents.select("doc_id", domain_of("source").alias("_domain"), *branch, n.alias("_tokens"), F.struct("*").alias("_row"))


def _key(mix: Mix, epoch: Column) -> Column:
    """Place in a leaf's shuffle of one epoch: 60 bits."""
    digest = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def plan(documents: DataFrame, mix: Mix, tokens: Column | None = None) -> DataFrame:
    """For each leaf with a budget: whole epochs, and the last (key, doc_id) of the next one that fits (null: none); to be broadcast up to MOST_LEAVES leaves."""
    spark = documents.sparkSession
    leaf = [f"_{c}" for c in _LEAF]
    slim = materialise(_branches(documents, tokens).select("doc_id", *leaf, "_tokens"), "slim")
    leaves = slim.groupBy(*leaf).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("rows"))
    stats = leaves.limit(MOST_LEAVES + 1).collect()
    few = len(stats) <= MOST_LEAVES
    if few:
        held = {tuple(r[c] for c in leaf): r for r in stats}
        given = budgets({p: r.tokens for p, r in held.items()}, mix)
        rows = []
        for p, b in given.items():
            n = held[p].tokens
            whole, rest = divmod(b, n) if n else (0, 0)
            rows.append((*p, whole, rest, max(1, held[p].rows // RANGE)))
        cuts = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in leaf) + ", whole int, rest long, ranges long")
    else:
        del stats
        parts = {"whole": "cast(budget div tokens as int)", "rest": "budget % tokens"}
        parts = {c: F.when(F.col("tokens") > 0, F.expr(e)).otherwise(0).alias(c) for c, e in parts.items()}
        got = budgeted(materialise(leaves, "leaves"), mix, leaf)
        cuts = materialise(got.select(*leaf, *parts.values(), F.greatest(F.lit(1), F.expr(f"rows div {RANGE}")).cast("long").alias("ranges")), "budgets")
    keyed = slim.join(broadcast(cuts) if few else cuts, leaf).withColumn("key", _key(mix, F.col("whole"))).withColumn("range", F.expr("key div (1152921504606846976L div ranges + 1)"))
    ranges = keyed.groupBy(*leaf, "rest", "range").agg(F.sum("_tokens").alias("tokens"))
    ends = ranges.selectExpr(*leaf, "rest", "range", f"sum(tokens) over (partition by {', '.join(leaf)} order by range) as upto", "tokens")
    edge = ends.where("upto > rest and upto - tokens <= rest").selectExpr(*leaf, "range", "upto - tokens as before")
    whole_ranges = ends.where("upto <= rest").groupBy(*leaf).agg(F.max("range").alias("full"))
    last = (
        keyed.join(edge, [*leaf, "range"])
        .selectExpr(*leaf, "key", "doc_id", "rest", f"before + sum(_tokens) over (partition by {', '.join(leaf)} order by key, doc_id) as upto")
        .where("upto <= rest").groupBy(*leaf).agg(F.max(F.struct("key", "doc_id")).alias("last"))
    )
    out = cuts.join(whole_ranges, leaf, "left").join(last, leaf, "left")
    out = materialise(out.select(*leaf, "whole", "ranges", "full", "last"), "cuts")
    return broadcast(out) if few else out


def select(documents: DataFrame, mix: Mix, tokens: Column | None = None) -> DataFrame:
    """A row for each document and epoch it is taken in, with `domain`, `n_tokens` and `epoch` added. tokens: counts of another tokenizer than words()."""
    leaf = [f"_{c}" for c in _LEAF]
    named = _branches(documents, tokens).join(plan(documents, mix, tokens), leaf).withColumn("_key", _key(mix, F.col("whole")))
    in_full = F.expr("_key div (1152921504606846976L div ranges + 1) <= full")
    fits = F.coalesce(in_full, F.lit(False)) | F.coalesce(F.struct(F.col("_key").alias("key"), F.col("doc_id")) <= F.col("last"), F.lit(False))
    taken = F.col("whole") + fits.cast("int")
    got = named.withColumn("_taken", taken).where("_taken > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_taken") - 1)))
    added = {"domain": "_domain", "n_tokens": "_tokens", "epoch": "_epoch"}
    return got.select(*(F.col("_row")[c].alias(c) for c in documents.columns if c not in added), *(F.col(v).alias(k) for k, v in added.items()))


#: Target weights of the query and of the pipeline.
TARGET = Mix(weights={"en": 5.0, "fr": 2.0, "de": 2.0, "es": 1.0, "domain0": 3.0, "domain1": 2.0, "domain2": 2.0, "domain3": 1.0, "src0": 0.5})


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch of every taken document and epoch."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return select(documents, TARGET).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _level(name: str, over: str, parent: str, keys: str) -> str:
    """SQL of one level of the tree: nodes with `given` tokens, from the parent's."""
    part = f"partition by {parent}" if parent else ""
    amount = "p.given" if parent else f"least({TARGET.share!r}::double * (select sum(tokens) from leaves), (select sum(tokens) from leaves) * {TARGET.max_epochs}::double)"
    source = f"from {over} n join {parent.split(',')[-1].strip()}_given p using ({parent})" if parent else f"from {over} n"
    return f"""
{name}_cap as (select {keys}, sum(tokens) * {TARGET.max_epochs}::double as cap from leaves group by {keys}),
{name}_node as (select c.*, coalesce(w.w, 1.0)::double as w from {name}_cap c left join weights w on w.name = c.{name}),
{name}_flag as (select n.*, {amount} as amount,
    n.cap * coalesce(sum(n.w) over (partition by {parent or '1'} order by n.cap / n.w, n.{name} rows between current row and unbounded following), 0)
      <= n.w * ({amount} - coalesce(sum(n.cap) over (partition by {parent or '1'} order by n.cap / n.w, n.{name} rows between unbounded preceding and 1 preceding), 0)) as capped
    {source}),
{name}_given as (select {keys}, case when capped then cap else w * (amount - sum(case when capped then cap else 0 end) over (partition by {parent or '1'}))
      / nullif(sum(case when capped then 0 else w end) over (partition by {parent or '1'}), 0) end as given from {name}_flag)"""


ORACLE_SQL = f"""
with d as (select doc_id, lang, source, 'domain' || coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 4, 0) as domain,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::bigint as n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens)::double as tokens from d group by all),
weights(name, w) as (values {", ".join(f"('{k}', {v!r})" for k, v in TARGET.weights.items())}),
{_level("domain", "domain_node", "", "domain")},
{_level("lang", "lang_node", "domain", "domain, lang")},
{_level("source", "source_node", "domain, lang", "domain, lang, source")},
cut as (select l.domain, l.lang, l.source, tokens::bigint as n, floor(given + 1e-6)::bigint as b from leaves l join source_given using (domain, lang, source)),
keyed as (select d.*, case when n = 0 then 0 else b // n end as whole, case when n = 0 then 0 else b % n end as rest,
    ('0x' || substr(md5('{TARGET.seed}:' || case when n = 0 then 0 else b // n end || ':' || doc_id), 1, 15))::bigint as key from d join cut using (domain, lang, source)),
summed as (select *, sum(n_tokens) over (partition by domain, lang, source order by key, doc_id) as upto from keyed),
taken as (select *, whole + (upto <= rest)::int as times from summed)
select doc_id, domain, lang, source, n_tokens, unnest(range(times))::int as epoch from taken where times > 0
"""
