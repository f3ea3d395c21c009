"""Pieces of SQL that the queries' SQL forms share."""

from __future__ import annotations

from ..functions.text import DEMONYMS, DEVANAGARI_DIGITS, NO_BREAK, QUOTES, LIGATURES, SENTENCE_STARTERS

BLANK = "[\\x20\\x09-\\x0D]"

LINES = f"""lines as (select doc_id as page_no, lang, source, row_number() over (partition by doc_id order by pos) - 1 as block_index, line as text
    from (select doc_id, lang, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)
    where regexp_matches(line, '[^\\x20\\x09-\\x0D]'))"""

PAIRS = f"""pairs as (select doc_id, lang, source, text as src, case doc_id % 7 when 0 then '' when 1 then text when 2 then regexp_replace(text, '[0-9]', '', 'g')
    when 3 then translate(text, '0123456789', '{DEVANAGARI_DIGITS}') when 4 then '<b>' || left(text, length(text) // 3)
    when 5 then 'म ' || text || ' ' || text || ' ' || text else 'म ' || text end as tgt from documents)"""


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: w <> '')"


def translatable(t: str) -> str:
    return f"list_filter({words(t)}, lambda w: regexp_full_match(w, '[a-z]{{3,}}'))"


def masked(t: str) -> str:
    """Letters, marks and digits beyond ASCII become underscores, so that ASCII word boundaries hold."""
    return f"regexp_replace({t}, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}]', '_', 'g')"


def title_words(t: str) -> str:
    return f"regexp_extract_all({masked(t)}, '\\b[A-Za-z][A-Za-z''’-]*\\b')"


def is_title(t: str) -> str:
    w = title_words(t)
    return f"(len({w}) >= 2 and len(list_filter({w}, lambda w: regexp_matches(w, '^[A-Z]'))) * 10 >= len({w}) * 6)"


def is_prose(t: str) -> str:
    return f"(len({translatable(t)}) > 0 and not {is_title(t)})"


def lexicon_words(t: str) -> str:
    return f"regexp_extract_all({masked(t)}, '\\b[a-z][a-z''’-]+\\b')"


def latinised(t: str) -> str:
    return f"translate({t}, '{DEVANAGARI_DIGITS}', '0123456789')"


def numbers(t: str) -> str:
    return f"regexp_extract_all(replace({latinised(t)}, '{NO_BREAK}', ' '), '[0-9]+(?:,[0-9]{{3}})*(?:\\.[0-9]+)?')"


def raw_numbers(t: str) -> str:
    return f"regexp_extract_all(replace({t}, '{NO_BREAK}', ' '), '\\p{{Nd}}+(?:,\\p{{Nd}}{{3}})*(?:\\.\\p{{Nd}}+)?')"


def nouns(t: str) -> str:
    common = ", ".join(f"'{w}'" for w in [*SENTENCE_STARTERS, *DEMONYMS])
    edge = "[\"''()\\[\\],;:.!?]+"
    inner = f"list_transform(string_split(regexp_replace({t}, '([.!?]){BLANK}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: list_filter(string_split_regex(s, '{BLANK}+'), lambda w: w <> '')[2:])"
    bare = f"list_transform(flatten({inner}), lambda w: regexp_replace(w, '^{edge}|{edge}$', '', 'g'))"
    return f"list_sort(list_distinct(list_filter({bare}, lambda w: regexp_full_match(w, '[A-Z][A-Za-z''&.-]+[A-Za-z]') and w <> upper(w) and not list_contains([{common}], lower(w)))))"


def has_term(t: str, term: str) -> str:
    quoted = "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in term)
    return f"regexp_matches({t}, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){quoted}([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')"


def count_of(t: str, part: str) -> str:
    return f"(len(string_split({t}, '{part}')) - 1)"


def unbalanced(t: str, tag: str) -> str:
    return f"({count_of(t, f'<{tag}>')} <> {count_of(t, f'</{tag}>')})"


def collapsed(t: str) -> str:
    return f"trim(regexp_replace({t}, '[ \\t\\r\\n]+', ' ', 'g'), ' ')"


def typographic(t: str) -> str:
    for a, b in LIGATURES.items():
        t = f"replace({t}, '{a}', '{b}')"
    return "translate({}, '{}', '{}')".format(t, *(q.replace("'", "''") for q in QUOTES))


def joined(t: str) -> str:
    return f"coalesce(array_to_string({t}, '|'), '')"
