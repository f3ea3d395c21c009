"""URL filters: host and path rules, and association rules mined from labelled URLs. Native: no Python on the executors.

FP-growth mines token combinations of labelled URLs together with the item of a bad label. A rule
(tokens => bad) stays while its support, its confidence and the lower bound of its confidence
(Wilson, 95 %) are high enough and no rule with fewer of its tokens is as confident. Rules are
matched by an inverted index from each rule's rarest token; a URL is looked up by its own tokens.
Few rules are an index within the plan, many are a table that the URLs' tokens are joined with.
Tokens that always come together are mined as one and stand for each other in the rules.

On the test tables nothing is mined: a page's label is that of the document its path names, and it
doesn't depend on the URL (hosts such as casino-win, spam-farm and cheap-pills were looked at: 13 of
their 47 labelled pages at sf0.1 are bad, 25 % of the others). `mined_url_rules` runs the same code
over labels that do depend on it.

Defined results: null URLs and URLs without `://` have an empty host and path, no rule and the
verdict `allow`; of rules that fit, the longest wins, then the alphabetically first; without usable
labels nothing is mined; repeated rows are judged alike; every rule is kept, however many there are; extra columns stay and existing columns
named like added ones are replaced.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: (verdict, host, path) of the query's fixed rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BAD = "label:bad"


@dataclass(frozen=True)
class Mining:
    """support: share of labelled URLs that are bad and have the tokens. Up to most_rules rules are an index within the plan, more are joined."""

    support: float = 0.002
    confidence: float = 0.8
    lower: float = 0.5
    tokens: int = 3
    most_rules: int = 1000


def host_of(url: str = "url") -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), letters, letters.lower())


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(host: str = "host", path: str = "path", url: str = "url") -> Column:
    """Distinct tokens: last label, other labels, their hyphenated parts, path segments without digits, names in the query."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    front = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))
    parts = F.flatten(F.transform(F.filter(front, lambda x: x.contains("-")), lambda x: F.filter(F.split(x, "-"), lambda y: y != "")))
    segments = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("[0-9]"))
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)://[^?#]*\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")

    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.concat(F.lit(f"{kind}:"), x))

    return F.array_distinct(F.concat(named("end", _last(labels)), named("host", front), named("part", parts), named("path", segments), named("query", names)))


def _last(values: Column) -> Column:
    return F.slice(values, F.greatest(F.size(values), F.lit(1)), F.lit(1))


def by_rule(host: str = "host", path: str = "path", rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, m: Mining = Mining()) -> list[list[str]] | DataFrame:
    """Token combinations that tell of a bad label, from (tokens, bad); each list's rarest token first. More than most_rules come as a table of `tokens`."""
    rows = labelled.where(F.col("bad").isNotNull() & (F.size("tokens") > 0)).select(F.monotonically_increasing_id().alias("id"), "tokens", "bad")
    rows = materialise(rows, "labelled_urls")
    least = math.ceil(m.support * rows.count())
    alike = materialise(_alike(rows, least), "alike_tokens")
    each = rows.select("id", "bad", F.explode("tokens").alias("token")).join(alike.select("token"), "token", "left_semi")
    items = each.groupBy("id", "bad").agg(F.collect_list("token").alias("tokens"))  # of one URL
    items = materialise(items.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")), "items")
    if items.isEmpty():
        return []
    total = items.count()
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=m.confidence).fit(items)
    bad = F.array_contains("consequent", BAD)
    found = model.associationRules.where(bad & (F.size("antecedent") <= m.tokens)).withColumn("n", F.col("support") / F.col("confidence") * total)
    c, n = F.col("confidence"), F.col("n")
    lower = (c + 1.9208 / n - 1.96 * F.sqrt((c * (1 - c) + 0.9604 / n) / n)) / (1 + 3.8416 / n)
    kept = materialise(found.where(lower >= m.lower).select(F.array_sort("antecedent").alias("tokens"), "confidence"), "passing_rules")
    if kept.isEmpty():
        return []
    token = minimal(kept).select("tokens", F.explode("tokens").alias("token")).join(alike, "token")
    by_rarity = F.array_sort(F.collect_list(F.struct("n", "token", "members")))
    one_of_each = F.aggregate(
        F.transform("r", lambda x: x.members), F.array(F.array().cast("array<string>")),
        lambda acc, members: F.flatten(F.transform(acc, lambda a: F.transform(members, lambda x: F.array_append(a, x)))),
    )
    rules = token.groupBy("tokens").agg(by_rarity.alias("r")).select(F.explode(one_of_each).alias("tokens"))
    rules = materialise(rules, "rules")
    few = rules.limit(m.most_rules + 1).collect()
    return rules if len(few) > m.most_rules else sorted(r["tokens"] for r in few)


def _alike(rows: DataFrame, least: int) -> DataFrame:
    """(token, n, members): of tokens in the same n rows, `least` bad ones among them, the first one and all of them.

    Sets of tokens that always come together would each be frequent; mined as one token, k of them
    give one itemset instead of 2 ** k. Equal rows are told by two 64-bit sums of row hashes.
    """
    each = rows.select("bad", F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"), F.explode("tokens").alias("token"))
    marks = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    groups = marks.where(F.col("bad") >= max(least, 1)).groupBy("n", "a", "b").agg(F.min("token").alias("token"), F.array_sort(F.collect_list("token")).alias("members"))  # within one URL
    return groups.select("token", "n", "members")


def minimal(rules: DataFrame) -> DataFrame:
    """(tokens, confidence), tokens sorted, without rules of which a proper part is a rule at least as confident."""
    none = F.array(F.array().cast("array<string>"))
    parts = F.aggregate("tokens", none, lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, t))))
    proper = F.filter(parts, lambda s: (F.size(s) > 0) & (F.size(s) < F.size("tokens")))
    part = rules.select("tokens", "confidence", F.explode(proper).alias("part"))
    smaller = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"))
    return rules.join(part.join(smaller, "part").where("part_confidence >= confidence").select("tokens"), "tokens", "left_anti")


def hits(rules: list[list[str]], tokens: str = "tokens") -> Column:
    """True where a URL has all the tokens of a rule, by an index from each rule's first token."""
    if not rules:
        return F.lit(False)
    index: dict[str, list[list[str]]] = {}
    for r in rules:
        index.setdefault(r[0], []).append(r[1:])
    look = F.from_json(F.lit(json.dumps(index)), "map<string,array<array<string>>>")
    rest = lambda t: F.coalesce(F.try_element_at(look, t), F.array().cast("array<array<string>>"))
    return F.exists(tokens, lambda t: F.exists(rest(t), lambda r: F.forall(r, lambda x: F.array_contains(F.col(tokens), x))))


def hit_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """_hit_url: the distinct urls, of (url, _tokens), that have all the tokens of a rule, by a join on each rule's first token."""
    each = urls.where("url is not null").select("url", "_tokens", F.explode("_tokens").alias("_token"))
    index = rules.select(F.col("tokens")[0].alias("_first"), F.col("tokens").alias("_rule"))
    fits = (F.col("_token") == F.col("_first")) & F.forall("_rule", lambda t: F.array_contains(F.col("_tokens"), t))
    return each.join(index, fits, "left_semi").select(F.col("url").alias("_hit_url")).distinct()


def judge(pages: DataFrame, mined: list[list[str]] | DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and verdict to rows with a `url`."""
    parsed = pages.withColumn("host", host_of()).withColumn("path", path_of())
    rule, said = by_rule(rules=rules)
    got = parsed.withColumn("_tokens", tokens_of()).withColumn("rule", rule).withColumn("_said", said)
    if isinstance(mined, DataFrame):
        got = got.join(hit_urls(got.select("url", "_tokens"), mined), F.col("url") == F.col("_hit_url"), "left")
        hit = F.col("_hit_url").isNotNull()
    else:
        hit = hits(mined, "_tokens")
    verdict = F.coalesce(F.col("_said"), F.when(hit, F.lit("block")).otherwise(F.lit("allow")))
    return got.withColumn("verdict", verdict).drop("_tokens", "_said", "_hit_url")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of the pages whose path's first number is a labelled document: bad if it is of low quality or toxic."""
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    named = pages.withColumn("host", host_of()).withColumn("path", path_of())
    number = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') as bigint)")
    return named.select(number.alias("doc_id"), tokens_of().alias("tokens")).where("doc_id is not null").join(bad, "doc_id").select("tokens", "bad")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    mined = mine(labelled_urls(pages, table(spark, sf_dir, "labels")))
    return judge(pages, mined).select("page_id", "host", "path", "rule", "verdict")


def telling_labels(pages: DataFrame) -> DataFrame:
    """(tokens, bad) of all pages: bad are those whose host names an offer, and blogs below org."""
    named = pages.withColumn("host", host_of()).withColumn("path", path_of())
    offer = F.coalesce(F.col("host").rlike(r"(casino|cheap|spam)-[a-z]+\."), F.lit(False))
    return named.select(tokens_of().alias("tokens"), (offer | (F.col("host").startswith("blog.") & F.col("host").endswith(".org"))).alias("bad"))


def mined_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, by rules mined from labels that the URLs tell of."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, mine(telling_labels(pages))).select("page_id", "host", "path", "rule", "verdict")


_LEARNT = """bad as (select doc_id, max((quality = 0 or toxic = 1)::int) as bad from labels where doc_id is not null group by doc_id),
learnt as (select t.id, tokens, bad from tokened t join bad b on b.doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') as bigint) where len(tokens) > 0 and bad is not null)"""
_TELLING = """learnt as (select id, tokens, (regexp_matches(host, '(casino|cheap|spam)-[a-z]+\\.') or (starts_with(host, 'blog.') and ends_with(host, '.org')))::int as bad from tokened where len(tokens) > 0)"""


def _oracle(learnt: str = _LEARNT, m: Mining = Mining()) -> str:
    fits = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    ranked = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = " ".join(f"when {fits.format(h=h, p=p)} then '{h}{p}'" for _, h, p in ranked)
    said = " ".join(f"when {fits.format(h=h, p=p)} then '{v}'" for v, h, p in ranked)
    wilson = "(c + 1.9208 / n - 1.96 * sqrt((c * (1 - c) + 0.9604 / n) / n)) / (1 + 3.8416 / n)"
    return f"""
with parsed as (select page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
labels_of as (select *, list_filter(string_split(host, '.'), lambda x: x <> '') as labels, row_number() over () as id from parsed),
listed as (select *, list_slice(labels, 1, greatest(len(labels) - 1, 0)) as front from labels_of),
tokened as (select id, page_id, url, host, path, list_distinct(
    list_transform(list_slice(labels, greatest(len(labels), 1), greatest(len(labels), 1)), lambda x: 'end:' || x)
    || list_transform(front, lambda x: 'host:' || x)
    || list_transform(list_filter(flatten(list_transform(list_filter(front, lambda x: contains(x, '-')), lambda x: string_split(x, '-'))), lambda x: x <> ''), lambda x: 'part:' || x)
    || list_transform(list_filter(string_split(path, '/'), lambda x: x <> '' and not regexp_matches(x, '[0-9]')), lambda x: 'path:' || x)
    || list_transform(list_filter(list_transform(string_split(regexp_extract(coalesce(url, ''), '(?s)://[^?#]*\\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'query:' || x)) as tokens from listed),
{learnt},
item as (select id, bad, unnest(tokens) as t from learnt),
sets as (select [t] as s, count(*)::double as n, sum(bad)::double as k from item group by t
    union all select [a.t, b.t], count(*), sum(a.bad) from item a join item b on a.id = b.id and a.t < b.t group by a.t, b.t
    union all select [a.t, b.t, c.t], count(*), sum(a.bad) from item a join item b on a.id = b.id and a.t < b.t join item c on a.id = c.id and b.t < c.t group by a.t, b.t, c.t),
rules as (select s, k / n as c, n from sets where k >= ceil({m.support} * (select count(*) from learnt)) and k / n >= {m.confidence}),
strong as (select s from rules where {wilson} >= {m.lower}),
blocked as (select distinct id from tokened t join strong r on list_has_all(t.tokens, r.s))
select page_id, host, path, case {rule} end as rule,
    coalesce(case {said} end, case when id in (select id from blocked) then 'block' else 'allow' end) as verdict from tokened
"""


ORACLE_SQL = _oracle()
TELLING_SQL = _oracle(_TELLING)
