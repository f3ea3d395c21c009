"""Secret scans: assignment-aware lexing of source and configuration text.

Base spans are regular matches of three kinds (assign, access, hex), leftmost and non-overlapping
within a kind. Beside them a lexer parses name-literal pairs, propagates constants and scores the
literals by how sensitive the target name is and how much like a credential the literal looks; the
fourth kind, `lexed`, holds the contents of literals whose score passes. Positions are code points,
ends exclusive.

Pairs are `name op literal` (`=`, `:`, `:=`, `=>`, `+=`, `.=`, `||=`, `?=`), with quoted names,
subscripts, option dashes and type annotations (`name: Type = literal`, generic arguments of up to
200 characters), `#define NAME literal`, `define("NAME", literal)`, XML elements, and the attribute
pairs key/name and value. Literals are quoted (also tripled or with a prefix), joined by `+` or
adjacency, or bare. A bare word counts as a literal if it has a digit, or both cases and a sign; a
path of identifiers, and what is called or subscripted, is a reference. A name that is assigned
another name, or a join of names and literals, stands for the literals behind it: names form a graph
whose nodes hold counts of characters, so that propagation takes memory in proportion to the text.

Defined results: null and empty texts have no spans; texts of any length are scanned whole; equal
texts have equal spans; a name that is assigned again stands for its last literals; extra columns
stay; an existing column named like an added one is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts_udf

KINDS = ("assign", "access", "hex", "lexed")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more among all runs

_NAME = r"[A-Za-z_][\w.\-]*+"
_OP = r"[\x20\t]*+(?P<op>::?=|=>|(?:\+|\.|\?|\|\|)?=(?![=>])|:(?!:))"
_PAIR = re.compile(
    rf"""(?<![\w.\-])(?:--?)?(?P<q>["'`]?)(?P<name>{_NAME})(?P=q)(?:[\x20\t]*\]|\[\w*\])?{_OP}[\x20\t]*+"""
    r"""|\#[\x20\t]*+define[\x20\t]++(?P<macro>[A-Za-z_]\w*+)[\x20\t]++"""
    r"""|\bdefine\([\x20\t]*+["'](?P<constant>[A-Za-z_]\w*+)["'][\x20\t]*+,[\x20\t]*+""",
    re.A,
)
#: A type between a name's colon and its `=`.
_TYPE = re.compile(
    r"""[A-Za-z_&*][\w.&*:]*+(?:\[[^\]\n"']{0,200}+\]|<[^>\n"']{0,200}+>)?\??(?:[\x20\t]*\|[\x20\t]*[A-Za-z_][\w.]*+){0,8}"""
    r"""(?:[\x20\t]++=(?![=>])|=(?=[\x20\t]*(?:[A-Za-z]{1,2}|[@$]{1,2})?["'`]))[\x20\t]*+""",
    re.A,
)
_OPERAND = re.compile(
    r"""(?:[uUrRbBfF]{1,2}|u8|[LU]|[@$]{1,2})?(?:\"""([\s\S]*?)\"""|\'\'\'([\s\S]*?)\'\'\'|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)|([A-Za-z0-9+/_.=\-!@#$%^*~]++)""",
    re.A,
)
_BARE = 6  # the group of _OPERAND without quotes
_JOIN = re.compile(r"[\x20\t]*+(?:\+|\.(?=[\x20\t]))[\x20\t]*+(?:\r?\n[\x20\t]*+)?")
_ADJACENT = re.compile(r"""[\x20\t]++(?=["'])""")
_PATH = re.compile(r"[A-Za-z_][\w]*+(?:\.[A-Za-z_][\w]*+)*+", re.A)
_ELEMENT = re.compile(r"<(?P<tag>[A-Za-z_][\w.:\-]*+)(?P<attributes>(?:\s[^<>]*+)?)>(?:(?P<content>[^<>]++)</(?P=tag)\s*+>)?", re.A)
_ATTRIBUTE = re.compile(r"""([\w.:\-]+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""", re.A)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"changeme|example|placeholder|undefined|your[_-]\w+|\$\{.*\}|\{\{.*\}\}|\$\(.*\)|\$\w+|%\(?\w+\)?s?%?|<.*>|[*x.]+", re.A | re.I)

#: How much a part of a name tells of a secret (fixed values).
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "credential": 3.0, "credentials": 3.0,
    "token": 2.5, "apikey": 3.0, "bearer": 2.0, "auth": 1.5, "private": 1.5, "access": 1.0, "signing": 1.5,
    "encryption": 1.5, "api": 1.0, "key": 1.5, "salt": 1.0, "session": 0.5, "pass": 1.5,
}
PASSES = 4.5


def name_score(name: str) -> float:
    """Sum over the distinct parts of a snake_case, kebab-case, dotted or camelCase name."""
    return sum(SENSITIVE.get(p, 0.0) for p in {x.lower() for x in _PARTS.findall(name)})


@dataclass(frozen=True, slots=True, eq=False)
class Parts:
    """What a name stands for: its own literal's span, or the names and literals it was joined from, with counts of all their characters."""

    spans: tuple[tuple[int, int], ...]
    below: tuple[Parts, ...]
    size: float
    counts: np.ndarray  # of code points modulo 128
    kinds: int  # a bit each for lower case, upper case, digits, others; another for white space
    short: str | None  # the whole literal, up to 64 characters


_KINDS = tuple(re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9\\s]", r"\s"))


def _literal(text: str, start: int = 0, end: int | None = None) -> Parts:
    whole = text[start:end]
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4") & np.uint32(127)
    kinds = sum(1 << k for k, p in enumerate(_KINDS) if p.search(whole))
    return Parts(((start, start + len(whole)),), (), len(whole), np.bincount(points, minlength=128).astype(np.float32), kinds, whole if len(whole) <= 64 else None)


def _chained(parts: list[Parts]) -> Parts:
    if len(parts) == 1:
        return parts[0]
    size, counts, kinds = sum(p.size for p in parts), np.sum([p.counts for p in parts], axis=0), 0
    for p in parts:
        kinds |= p.kinds
    if size > 1e15:  # only shares of characters and a length beyond any bound matter
        size, counts = 1e15, counts * np.float32(1e15 / size)
    short = "".join(p.short for p in parts) if size <= 64 else None
    return Parts((), tuple(dict.fromkeys(parts)), size, counts, kinds, short)


def _score(p: Parts) -> float:
    """0 to 3: length, entropy and kinds of characters; white space and placeholders count against it."""
    if p.size < 6 or p.kinds & 16 or (p.short is not None and _PLACEHOLDER.fullmatch(p.short)):
        return 0.0
    share = p.counts[p.counts > 0] / np.float64(p.size)
    entropy = -float((share * np.log2(share)).sum())
    return min(1.0, p.size / 16) + min(1.0, entropy / 3.5) + ((p.kinds & 15).bit_count() - 1) / 3


def literal_score(literal: str) -> float:
    return _score(_literal(literal))


def _is_value(word: str) -> bool:
    """Of a bare word: whether it is a literal, not a word of the language or a reference."""
    if _PATH.fullmatch(word) and "." in word and not any(len(x) >= 24 and re.search("[0-9]", x) for x in word.split(".")):
        return False
    return bool(re.search("[0-9]", word) or (re.search("[a-z]", word) and re.search("[A-Z]", word) and re.search("[+/=!@#$%^*~]", word)))


class Lexer:
    """The pairs of one text, and the spans of literals that reach a sensitive name."""

    def __init__(self, text: str):
        self.text = text
        self.names: dict[str, Parts] = {}
        self.found: set[tuple[int, int]] = set()
        self.marked: set[int] = set()
        self.keep: list[Parts] = []  # what is marked stays, so that its id isn't given to another

    def operand(self, at: int) -> tuple[Parts | None, int, bool] | None:
        """(what it stands for, its end, whether it is quoted) of the operand at a place."""
        m = _OPERAND.match(self.text, at)
        if not m:
            return None
        if m.lastindex != _BARE:
            return _literal(self.text, *m.span(m.lastindex)), m.end(), True
        word, end = m[_BARE].rstrip("."), m.end()
        if self.text[end : end + 1] in ("(", "["):
            return None, end, False
        known = self.names.get(word)
        if known is None and word and _is_value(word):
            known = _literal(self.text, at, at + len(word))
        return known, end, False

    def value(self, at: int) -> tuple[list[Parts], int, int | None]:
        """Parts of the joined operands from a place on, where they end, and where a quoted one with a pair of its own begins."""
        parts, inner = [], None
        while got := self.operand(at):
            part, end, quoted = got
            if part is not None and part.size:
                parts.append(part)
            if quoted and inner is None and re.search("[=:]", self.text[at:end]):
                inner = at + 1
            at = end
            more = _JOIN.match(self.text, at) or (_ADJACENT.match(self.text, at) if quoted else None)
            if not more:
                break
            at = more.end()
        return parts, at, inner

    def judge(self, name_scores: float, value: Parts) -> None:
        if name_scores < 2.5 or id(value) in self.marked or name_scores + _score(value) < PASSES:
            return
        todo = [value]
        while todo:
            p = todo.pop()
            if id(p) not in self.marked:
                self.marked.add(id(p))
                self.keep.append(p)
                self.found.update((a, b) for a, b in p.spans if b > a)
                todo += p.below

    def pairs(self) -> None:
        at = 0
        while m := _PAIR.search(self.text, at):
            name, at = m["name"] or m["macro"] or m["constant"], m.end()
            if m["op"] == ":" and (kind := _TYPE.match(self.text, at)):
                at = kind.end()
            parts, end, inner = self.value(at)
            at = inner or max(at, end)
            if m["op"] in ("+=", ".=") and name in self.names:
                parts.insert(0, self.names[name])
            if parts:
                self.names[name] = value = _chained(parts)
                self.judge(name_score(name), value)

    def elements(self) -> None:
        for m in _ELEMENT.finditer(self.text):
            names, values = [m["tag"]], []
            if m["content"] and m["content"].strip():
                lead = len(m["content"]) - len(m["content"].lstrip())
                values.append(_literal(self.text, m.start("content") + lead, m.start("content") + len(m["content"].rstrip())))
            for a in _ATTRIBUTE.finditer(m["attributes"]):
                if a[1] in ("key", "name", "id"):
                    names.append(a[a.lastindex])
                elif a[1] == "value":
                    values.append(_literal(self.text, *(m.start("attributes") + x for x in a.span(a.lastindex))))
            for value in values:
                self.judge(max(map(name_score, names)), value)


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, by start."""
    lexer = Lexer(text)
    if "=" in text or ":" in text or "define" in text:
        lexer.pairs()
    if "</" in text or "/>" in text:
        lexer.elements()
    return sorted(lexer.found)


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all spans of a text, sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out += [(a, 3, b) for a, b in lexed(text)]
    out.sort()
    return out


def _scan(raw: np.ndarray, starts: np.ndarray) -> dict:
    whole, out = raw.tobytes(), []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(whole[a:b].decode("utf-8", "replace"))])
    return {"secrets": out}


def redacted(text: str) -> str:
    """The text with every run of overlapping spans replaced by one mark."""
    parts, done = [], 0
    for start, kind, end in spans_of(text):
        if start >= done:
            parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]]) if done else text


def _redact(raw: np.ndarray, starts: np.ndarray) -> dict:
    whole = raw.tobytes()
    return {"text": [redacted(whole[a:b].decode("utf-8", "replace")) for a, b in zip(starts[:-1], starts[1:], strict=True)]}


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds `secrets`: array of struct<kind, start, end> by start, then kind."""
    return documents.withColumn("secrets", texts_udf(_scan, "secrets array<struct<kind:string,start:int,end:int>>")(F.col(text)).secrets)


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every secret in the texts by a mark of its kind; null texts stay null."""
    return documents.withColumn(text, F.when(F.col(text).isNotNull(), texts_udf(_redact, "text string")(F.col(text)).text))


def _count(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s.kind != "lexed")
    return found.select(
        "doc_id", *(_count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"),
    )
