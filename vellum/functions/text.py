"""Text functions as columns.

Patterns avoid word boundaries and Unicode shorthand classes, whose meaning differs between
engines: words are runs of letters, marks, digits and underscores, and digits are latinised first.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What typographic characters become.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
NO_BREAK = "\u00a0"
LINE_ENDS = "\u2028\u2029"
QUOTES = ("‘’‚‛“”„" + NO_BREAK + LINE_ENDS, "''''\"\"\"   ")
DEVANAGARI_DIGITS = "०१२३४५६७८९"

# Capitalised words that aren't names.
SENTENCE_STARTERS = (
    "the a an and but or if when he she they it this that these those in on at to for we you i his her "
    "their its there then so as by of one two after before because what why how who"
).split()
DEMONYMS = (
    "american british canadian indian chinese japanese european african australian russian german french "
    "spanish italian mexican korean english irish scottish dutch swedish swiss brazilian israeli egyptian"
).split()

_NOT_WORD = r"[^\p{L}\p{M}\p{N}_]+"


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode composition, which no built-in function does."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def strip(text: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def typographic(text: Column) -> Column:
    """Ligatures expanded, typographic quotes, no-break spaces and Unicode line ends made plain."""
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.translate(text, *QUOTES)


def normalise(text: Column) -> Column:
    return strip(F.regexp_replace(nfc(typographic(text)), r"[ \t]+", " "))


def collapse(text: Column) -> Column:
    """Runs of space, tab, CR and LF become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def strip_markup(text: Column) -> Column:
    return F.regexp_replace(text, r"</?[ib]>", "")


def latinise_digits(text: Column) -> Column:
    return F.translate(text, DEVANAGARI_DIGITS, "0123456789")


def numbers_in(text: Column) -> Column:
    """Numbers in order: digits, groups of three after commas, a fraction."""
    return F.regexp_extract_all(F.translate(latinise_digits(text), NO_BREAK, " "), F.lit(r"[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"), 0)


def raw_numbers_in(text: Column) -> Column:
    """As numbers_in, but Devanagari digits count as themselves."""
    return F.regexp_extract_all(F.translate(text, NO_BREAK, " "), F.lit(r"\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?"), 0)


def words(text: Column) -> Column:
    return F.filter(F.split(text, _NOT_WORD), lambda w: w != "")


def translatable_words(text: Column) -> Column:
    """Words of three and more letters, all a-z."""
    return F.filter(words(text), lambda w: w.rlike("^[a-z]{3,}$"))


def title_words(text: Column) -> Column:
    """Words of letters, apostrophes and hyphens that begin with a letter."""
    w = r"[\p{L}\p{M}\p{N}_]"
    return F.regexp_extract_all(text, F.lit(rf"[A-Za-z](?<!{w}[A-Za-z])(?:[A-Za-z'’-]*(?:[A-Za-z](?!{w})|['’-](?={w}))|(?!{w}))"), 0)


def looks_like_title(text: Column) -> Column:
    """At least two words, of which three fifths begin with a capital, which sorts before all small letters."""
    return F.transform(
        F.array(title_words(text)),
        lambda w: (F.size(w) >= 2) & (F.size(F.filter(w, lambda x: x < F.lit("a"))) * 10 >= F.size(w) * 6),
    )[0]


def has_translatable(text: Column) -> Column:
    """Has one of translatable_words(); the search ends at the first."""
    return text.rlike(r"(^|[^\p{L}\p{M}\p{N}_])[a-z]{3,}+([^\p{L}\p{M}\p{N}_]|$)")


def is_prose(text: Column) -> Column:
    return has_translatable(text) & ~looks_like_title(text)


def has_devanagari(text: Column) -> Column:
    return text.rlike("[ऀ-ॿ]")


def has_devanagari_digits(text: Column) -> Column:
    return text.rlike("[०-९]")


def proper_nouns(text: Column) -> Column:
    """Distinct capitalised words inside sentences that are neither openers, all capitals nor demonyms, sorted."""
    common = F.array(*map(F.lit, [*SENTENCE_STARTERS, *DEMONYMS]))
    # few words have a capital after the punctuation they begin with; a word inside a sentence follows one that doesn't end it
    inner = F.regexp_extract_all(text, F.lit(r"(?<=[^.!?\x20\x09-\x0D])[\x20\x09-\x0D]++([\"'()\[\],;:.!?]*+[A-Z][^\x20\x09-\x0D]*+)"), F.lit(1))
    bare = F.transform(inner, lambda w: F.regexp_replace(w, r"^[\"'()\[\],;:.!?]+|[\"'()\[\],;:.!?]+$", ""))
    named = F.filter(bare, lambda w: w.rlike(r"^[A-Z][A-Za-z'&.-]+[A-Za-z]$") & (w != F.upper(w)) & ~F.array_contains(common, F.lower(w)))
    return F.array_sort(F.array_distinct(named))


def lexicon_words(text: Column) -> Column:
    """Words that begin with a lower-case letter outside a word, of two and more characters."""
    return F.regexp_extract_all(text, F.lit(r"[a-z](?<![\p{L}\p{M}\p{N}_][a-z])[a-z'’-]*(?:[a-z](?![\p{L}\p{M}\p{N}_])|['’-](?=[\p{L}\p{M}\p{N}_]))"), 0)


def lexicon_key(word: Column) -> Column:
    """Lower case, without apostrophes and s at both ends."""
    return F.regexp_replace(F.lower(word), r"^['’s]+|['’s]+$", "")


def count_of(text: Column, part: str) -> Column:
    """How often a fixed text occurs."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())).cast("int")


def unbalanced(text: Column, tag: str) -> Column:
    return count_of(text, f"<{tag}>") != count_of(text, f"</{tag}>")


def to_html(text: Column) -> Column:
    """Escaped but for <i>, </i>, <b>, </b>, in a paragraph."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    for tag in ("i", "/i", "b", "/b"):
        text = F.replace(text, F.lit(f"&lt;{tag}&gt;"), F.lit(f"<{tag}>"))
    return F.concat(F.lit("<p>"), text, F.lit("</p>"))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


def shortened(text: Column, most: int = 40) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.left(flat, F.lit(most)), F.lit("…")))


def first_json(text: Column) -> Column:
    """From the first { to the last }, null if there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def is_code(text: Column) -> Column:
    """Fences, braces, a camelCase word, or nothing but one tag."""
    camel = F.exists(words(text), lambda w: w.rlike("^[a-z]+[A-Z][a-z]+$"))
    return text.contains("```") | text.rlike("[{}]") | camel | text.rlike(r"^[\x20\x09-\x0D]*<[^>]+>[\x20\x09-\x0D]*$")


def has_term(text: Column, term: str) -> Column:
    """A term between non-word characters, in either case."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in term)
    anywhere = text.rlike(rf"(?iu)(^|[^\p{{L}}\p{{M}}\p{{N}}_]){quoted}([^\p{{L}}\p{{M}}\p{{N}}_]|$)")
    if not term or max(term) > "\uffff":
        return anywhere
    # the term first, which few places pass; what lies before it is seen a UTF-16 unit at a time, so not in texts with pairs of them
    near = text.rlike(rf"(?iu){quoted}(?<![\p{{L}}\p{{M}}\p{{N}}_]{quoted})(?![\p{{L}}\p{{M}}\p{{N}}_])")
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), anywhere).otherwise(near)


def block_id(page: Column, index: Column, text: Column) -> Column:
    """Content address of a block: 32 hexadecimal digits."""
    return F.left(F.sha2(F.concat_ws("|", page.cast("string"), index.cast("string"), text), 256), F.lit(32))
