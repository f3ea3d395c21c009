"""Text-integrity rules over source and target pairs: one projection, findings as an array, exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

KINDS = (
    "missing_translation", "no_devanagari", "untranslated", "number_lost", "devanagari_digits", "unbalanced_tag",
    "latin_proper_noun_lost", "glossary_miss", "suspiciously_short", "suspiciously_long",
)
#: Terms that one conditional expression holds; a longer glossary is joined by its first word.
INLINE_TERMS = 200


def lost_numbers(source: Column, target: Column) -> Column:
    """Numbers of the source that the target has nowhere, repeats kept."""
    lost = F.transform(F.array(T.numbers_in(target)), lambda have: F.filter(T.raw_numbers_in(source), lambda n: ~F.array_contains(have, n)))[0]
    return F.when(source.rlike(r"\p{Nd}"), lost).otherwise(F.array().cast("array<string>"))


def dropped_nouns(source: Column, target: Column, names: Column | None = None, title: Column | None = None) -> Column:
    """Proper nouns of the source (or `names`, those no lexicon has) that are nowhere in the target; none of titles."""
    found = T.proper_nouns(source) if names is None else names
    missing = F.filter(found, lambda n: ~F.contains(target, n))
    return F.when(T.looks_like_title(source) if title is None else title, F.array().cast("array<string>")).otherwise(missing)


def missed_terms(source: Column, target: Column, terms: list[tuple[str, str]]) -> Column:
    """Glossary terms in the source whose rendering isn't in the target: a condition for each term, so for short glossaries; glossary_misses() takes any."""
    pairs = [(en, mr) for en, mr in terms if en and mr]
    if not pairs:
        return F.array().cast("array<string>")

    def folded(t: Column) -> Column:
        return F.lower(F.upper(t))

    # plain searches decide most texts; the pattern looks at the rest
    def hits(low: Column) -> Column:
        return F.array(*(F.when(F.contains(low, folded(F.lit(en))) & ~F.contains(target, F.lit(mr)) & (F.contains(source, F.lit(f" {en} ")) | T.has_term(source, en)), F.lit(en)) for en, mr in pairs))

    return F.array_compact(F.transform(F.array(folded(source)), hits)[0])


def findings(pairs: DataFrame, terms: list[tuple[str, str]] = (), key: str = "doc_id") -> DataFrame:
    """(key, rule_no, kind) of every finding in pairs (key, src, tgt); a `names` column holds nouns already held against a lexicon.

    More than INLINE_TERMS terms are joined, not tested one by one; `key` must then name a row.
    """
    src, raw = F.coalesce(F.col("src"), F.lit("")), F.coalesce(F.col("tgt"), F.lit(""))
    named = F.col("names") if "names" in pairs.columns else None
    base = pairs.select(key, src.alias("src"), raw.alias("raw"), T.strip_markup(raw).alias("tgt"), *(["names"] if named is not None else []))
    if long_glossary := len(terms) > INLINE_TERMS:
        glossary = pairs.sparkSession.createDataFrame(list(terms), "english string, target string")
        missed = glossary_misses(base.select(key, "src", "tgt"), glossary, key).select(key).distinct().withColumn("missed", F.lit(True))
        base = base.join(missed, key, "left")
    base = base.withColumn("bare", T.strip(F.col("tgt"))).withColumn("title", T.looks_like_title(F.col("src")))
    base = base.withColumn("prose", T.has_translatable(F.col("src")) & ~F.col("title"))
    s, t, n = F.col("src"), F.col("tgt"), F.length("src")
    long = n > 120
    hits = [
        F.col("prose") & ~T.has_devanagari(t),
        F.col("prose") & (F.col("bare") == T.strip(s)),
        F.size(lost_numbers(s, t)) > 0,
        T.has_devanagari_digits(t),
        T.unbalanced(F.col("raw"), "i") | T.unbalanced(F.col("raw"), "b"),
        F.size(dropped_nouns(s, t, named, F.col("title"))) > 2,
        F.coalesce("missed", F.lit(False)) if long_glossary else F.size(missed_terms(s, t, list(terms))) > 0,
        long & (F.length(t) * 100 < n * 45),
        long & (F.length(t) * 10 > n * 22),
    ]
    rules = F.array(*(F.when(h, F.struct(F.lit(i + 2).alias("rule_no"), F.lit(KINDS[i + 1]).alias("kind"))) for i, h in enumerate(hits)))
    missing = F.array(F.struct(F.lit(1).alias("rule_no"), F.lit(KINDS[0]).alias("kind")))
    found = F.when(F.col("bare") == "", missing).otherwise(F.array_compact(rules))
    return base.select(key, F.explode(found).alias("f")).select(key, "f.rule_no", "f.kind")


def lexicon(texts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct lower-case words of the corpus."""
    return texts.select(F.explode(T.lexicon_words(F.col(text))).alias("word")).distinct()


def unknown_nouns(texts: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, noun) of proper nouns that the lexicon has neither as they are nor without s and apostrophes at their ends."""
    nouns = texts.select(key, F.explode(T.proper_nouns(F.col(text))).alias("noun"))
    out = nouns.join(words.withColumnRenamed("word", "_w"), F.lower("noun") == F.col("_w"), "left_anti")
    return out.join(words.withColumnRenamed("word", "_w"), T.lexicon_key(F.col("noun")) == F.col("_w"), "left_anti")


def rollup(found: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each key: passed, number of findings and their kinds; clean keys too."""
    per = found.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"))  # ten kinds at most
    got = keys.select(key).distinct().join(per, key, "left")
    return got.select(key, F.coalesce("n", F.lit(0)).alias("n_findings"), F.col("n").isNull().alias("passed"), F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("kinds"))


def glossary_misses(pairs: DataFrame, glossary: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, english) as missed_terms finds them, for glossaries of any size.

    Texts and terms meet by the word of the term that the fewest texts have, so a term such as `the
    frame` isn't sought in every text with `the`. A term without words is sought in all texts.
    """
    terms = glossary.where("coalesce(english, '') <> '' and coalesce(target, '') <> ''").select("english", "target").distinct()
    words_of = terms.select("english", "target", F.explode_outer(F.array_distinct(T.words(F.lower("english")))).alias("word"))
    heads = pairs.select(key, F.explode(F.array_distinct(T.words(F.lower("src")))).alias("word")).join(words_of.select("word").distinct(), "word", "left_semi")
    holders = heads.groupBy("word").agg(F.count("*").alias("n"))
    rarest = words_of.where("word is not null").join(holders, "word", "left").groupBy("english", "target").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    quoted = F.regexp_replace("english", r"([^\p{L}\p{N}\s])", r"\\$1")
    pattern = F.concat(F.lit(r"(?iu)(^|[^\p{L}\p{M}\p{N}_])"), quoted, F.lit(r"([^\p{L}\p{M}\p{N}_]|$)")).alias("pattern")
    near = heads.join(rarest, "word").select(key, "english", "target", pattern).join(pairs.select(key, "src", "tgt"), key)
    signs = words_of.where("word is null").select("english", "target", pattern)  # few
    everywhere = pairs.select(key, "src", "tgt").join(signs, F.contains("src", F.col("english")))
    found = near.select(key, "english", "target", "pattern", "src", "tgt").unionByName(everywhere.select(key, "english", "target", "pattern", "src", "tgt"))
    return found.where(F.regexp_like("src", F.col("pattern")) & ~F.contains("tgt", F.col("target"))).select(key, "english").distinct()


def substring_misses(rows: DataFrame, terms: list[tuple[str, str]], key: str = "doc_id") -> DataFrame:
    """(key, term, expected): a term anywhere in the source, in either case, whose rendering isn't in the target; empty sides are skipped."""
    hits = F.array_compact(F.array(*(F.when(F.contains(F.lower("src"), F.lit(en.lower())) & ~F.contains("tgt", F.lit(mr)), F.struct(F.lit(en).alias("term"), F.lit(mr).alias("expected"))) for en, mr in terms)))
    return rows.where("coalesce(src, '') <> '' and coalesce(tgt, '') <> ''").select(key, F.explode(hits).alias("h")).select(key, "h.*")


def without_excused(rows: DataFrame, excused: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no reviewed exception names."""
    return rows.join(excused.select(*keys), keys, "left_anti")
