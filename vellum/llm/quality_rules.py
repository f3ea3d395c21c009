"""Quality rules: measures of every text, and a learned decision list over them. Native: no Python on the executors.

Sequential covering learns from labelled measures: a rule grows by the threshold with the best gain
on the growing rows, is pruned to the prefix of its conjunction that does best on other rows, and
is kept while it is precise there; the rows it covers then go, and the next rule is learnt from the
rest. All counts come from Spark aggregations over binned measures. The list is an ordered
conditional expression: the first rule that fits rejects a text, and none keeps it.

Labels are learnt from a bounded sample of labelled rows (`max_rows`, by hash of the id, outside
the held-out fifth); every text is measured whole.

Defined results: null and empty texts have zero words and fail the base rule; without usable labels
the list is empty and only the base rule rejects; rows with a null label or id aren't learnt from;
of several labels for an id the largest counts; equal texts get equal verdicts; extra columns stay
and existing columns named like added ones are replaced (an input column `__words` goes).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from .common import held_out, materialise, release, table

_SPACE = "[\\x20\\x09-\\x0D]"
_SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Covering:
    """Parameters of the learner. max_rows bounds the labelled sample."""

    cuts: int = 24
    max_rules: int = 8
    max_conditions: int = 3
    precision: float = 0.9
    support: int = 8
    max_rows: int = 12000


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool  # measure > cut, else measure <= cut
    cut: float

    def fits(self, value: Column) -> Column:
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:g}"


Rules = list[tuple[Condition, ...]]

#: What rules are made of: measures by word, but for the number of words.
MEASURES = {"m_words": "n_words", "m_word_length": "word_chars", "m_symbols": "n_symbols", "m_dup_lines": "n_dup_lines", "m_repeats": "n_repeat_words"}


def _value(measure: str) -> Column:
    """A measure from the counts of measures()."""
    count = F.col(MEASURES[measure]).cast("double")
    return count if measure == "m_words" else count / F.greatest(F.col("n_words"), F.lit(1))


def _bound(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once and uses it as `name` in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words() -> str:
    """SQL of the number of words in three-word windows found twice or more, from the array `__words`.

    Windows are hashed; a text whose hashes are distinct is done. Else (hash, place) pairs are sorted,
    places beside an equal hash are sorted again, and each adds the words that the one before didn't cover.
    """
    again = "filter(s, (x, k) -> x.h <=> get(s, k + 1).h or (k > 0 and x.h <=> get(s, k - 1).h))"
    covered = f"aggregate(sort_array(transform({again}, x -> x.i)), named_struct('n', 0L, 'last', -3), (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i), a -> a.n)"
    heavy = _bound("sort_array(transform(w, (h, i) -> named_struct('h', h, 'i', i)))", "s", covered)
    windows = "transform(sequence(0, size(hs) - 3), i -> xxhash64(hs[i], hs[i + 1], hs[i + 2]))"
    some = _bound(windows, "w", f"if(size(array_distinct(w)) = size(w), 0L, {heavy})")
    return f"if(size(__words) < 4, 0L, {_bound('transform(__words, x -> xxhash64(x))', 'hs', some)})"


def measures(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.trim(whole, F.lit(_SPACES))
    split = documents.withColumn("__words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{_SPACE}+")))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    got = split.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long"),
        "n_repeat_words": F.expr(_repeat_words()),
    }).drop("__words")
    return got.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def learn(documents: DataFrame, labels: DataFrame, label: str = "quality", p: Covering = Covering()) -> Rules:
    """An ordered list of conjunctions that reject."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(label).alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_rows)
    )
    names = list(MEASURES)
    # the sample is written before it is measured: a filter on measures would else be taken below the join, to all documents
    sample = materialise(documents.select("doc_id", "text").join(broadcast(chosen), "doc_id"), "sample")  # max_rows rows at most
    kept = measures(sample).where("not base_failed")
    rows = materialise(kept.select(F.expr("_y <= 0").alias("bad"), F.expr("pmod(xxhash64(doc_id, 3), 3) > 0").alias("grows"), *(_value(n).alias(n) for n in names)), "labelled")
    release(sample)
    shares = [k / p.cuts for k in range(1, p.cuts)]
    found = rows.where("grows").agg(*(F.percentile_approx(n, shares, 10000).alias(n) for n in names)).first()
    bad = rows.where("grows").agg(F.max("bad").alias("any")).first()
    if not bad["any"]:
        return []
    rare = rows.where("grows and bad").agg(*(F.percentile_approx(n, shares, 10000).alias(n) for n in names)).first()
    cuts = {n: sorted({*(found[n] or []), *(rare[n] or [])}) for n in names}
    binned = materialise(
        rows.select("bad", "grows", *names, F.array(*(_bin(n, cuts[n]) for n in names)).alias("bins")),
        "binned",
    )
    rules: Rules = []
    while len(rules) < p.max_rules:
        left = binned
        for r in rules:
            left = left.where(~_all(r))
        rule = _grow(left.where("grows"), names, cuts, p)
        rule = _prune(left, rule, p) if rule else ()
        if not rule:
            break
        rules.append(_centred(left, rule))
    return rules


def _bin(name: str, cuts: list[float]) -> Column:
    """How many cuts lie below the measure."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(name) > c))


def _all(rule: tuple[Condition, ...], of=F.col) -> Column:
    """All conditions; of: gives the column of a measure."""
    out = F.lit(True)
    for c in rule:
        out = out & c.fits(of(c.measure))
    return out


def _grow(rows: DataFrame, names: list[str], cuts: dict[str, list[float]], p: Covering) -> tuple[Condition, ...]:
    """Adds the condition with the best gain until no good row is covered or none gains."""
    rule: tuple[Condition, ...] = ()
    while len(rule) < p.max_conditions:
        counts = rows.where(_all(rule)).select("bad", F.posexplode("bins").alias("m", "bin")).groupBy("m", "bin").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n")).collect()
        of: dict[int, dict[int, tuple[int, int]]] = {}
        for r in counts:
            of.setdefault(r.m, {})[r.bin] = (r.bad, r.n)
        if not of:
            break
        bad, n = (sum(v[k] for v in of[0].values()) for k in (0, 1))
        if bad == n or not bad:
            break
        best = (1e-9, None)
        for m, name in enumerate(names):
            low_bad = low_n = 0
            for k, cut in enumerate(cuts[name]):
                b, c = of[m].get(k, (0, 0))
                low_bad, low_n = low_bad + b, low_n + c
                for above, q, t in ((False, low_bad, low_n), (True, bad - low_bad, n - low_n)):
                    if q >= p.support:
                        gain = q * (math.log2(q / t) - math.log2(bad / n))
                        if gain > best[0]:
                            best = (gain, Condition(name, above, float(cut)))
        if best[1] is None:
            break
        rule = (*rule, best[1])
    return rule


def _prune(rows: DataFrame, rule: tuple[Condition, ...], p: Covering) -> tuple[Condition, ...]:
    """The prefix that does best on the other rows, if it is precise there."""
    parts = []
    for k in range(1, len(rule) + 1):
        fits = _all(rule[:k])
        parts += [F.count_if(fits & F.col("bad") & ~F.col("grows")).alias(f"bad{k}"), F.count_if(fits & ~F.col("grows")).alias(f"n{k}")]
    got = rows.agg(*parts).first()
    scored = [((2 * got[f"bad{k}"] - got[f"n{k}"]) / max(got[f"n{k}"], 1), -k) for k in range(1, len(rule) + 1)]
    k = -max(scored)[1]
    good = got[f"n{k}"] >= max(1, p.support // 2) and got[f"bad{k}"] >= p.precision * got[f"n{k}"]
    return rule[:k] if good else ()


def _centred(rows: DataFrame, rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """Each cut moved halfway between the measures on its two sides, so that near misses of the good rows stay good."""
    sides = []
    for k, c in enumerate(rule):
        rest = _all(rule[:k] + rule[k + 1 :])
        sides += [F.max(F.when(rest & (F.col(c.measure) <= c.cut), F.col(c.measure))).alias(f"low{k}"), F.min(F.when(rest & (F.col(c.measure) > c.cut), F.col(c.measure))).alias(f"high{k}")]
    got = rows.agg(*sides).first()
    out = []
    for k, c in enumerate(rule):
        low, high = got[f"low{k}"], got[f"high{k}"]
        out.append(Condition(c.measure, c.above, (low + high) / 2) if low is not None and high is not None else c)
    return tuple(out)


def judge(documents: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """Adds the measures, base_failed, `rule` (the one that rejects, else null) and `kept`."""
    measured = measures(documents, text)
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in rules:
        verdict = verdict.when(_all(rule, _value), F.lit(" and ".join(map(str, rule))))
    return measured.withColumn("rule", verdict).withColumn("kept", F.col("rule").isNull())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn(documents, table(spark, sf_dir, "labels"))
    return judge(documents, rules).drop("text")
