"""Stages around an external model: who goes to it, what is sent, and what becomes of the answers.

Each takes a provider and a path where the answers are kept (jobs.call_all()), so that a stage can
be run again; pages whose answers don't hold up stay as they were.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import glossary, jobs, state

TERMS = "struct<terms:array<struct<english:string,marathi:string,kind:string>>>"
REMARKS = "struct<findings:array<struct<kind:string,severity:string,detail:string>>>"


class Capitals:
    """A local provider of terms: each distinct capitalised word of seven and more letters, marked."""

    def __init__(self, mark: str = "म "):
        self.mark = mark

    def call(self, request: str) -> str:
        import re

        found = dict.fromkeys(re.findall(r"[A-Z][a-z]{6,}", json.loads(request)["text"]))
        return json.dumps({"terms": [{"english": w, "marathi": self.mark + w, "kind": "word"} for w in found]}, ensure_ascii=False)


class Opening:
    """A local provider of summaries: the first `size` characters."""

    def __init__(self, size: int = 60):
        self.size = size

    def call(self, request: str) -> str:
        return json.loads(request)["text"][: self.size]


class Lengths:
    """A local reviewer of page images: remarks on texts that are long or short."""

    def call(self, request: str) -> str:
        n = len(json.loads(request)["text"])
        remarks = [{"kind": "crowded", "severity": "high", "detail": str(n)}] if n > 4000 else [{"kind": "sparse", "severity": "low", "detail": str(n)}] if n < 400 else []
        return json.dumps({"findings": remarks})


def settled(blocks: DataFrame, results: DataFrame, column: str) -> DataFrame:
    """blocks with draft or final from the answers of pages that are whole and valid; other pages stay."""
    answers = jobs.parsed(results)
    good = jobs.validated(answers).where("ok").select("page_no")
    said = answers.join(good, "page_no", "left_semi").select("page_no", F.explode(jobs.last_answers(F.col("answers"))).alias("a"))
    last = said.select("page_no", F.col("a.id").alias("block_index"), F.col("a.text").alias("text"))
    ids = blocks.select("page_no", F.col("block_index").cast("int").alias("block_index"), "id").join(last, ["page_no", "block_index"])
    return state.set_text(blocks, ids.select("id", "text"), column)


def translate(blocks: DataFrame, chapters: DataFrame, provider: jobs.Provider, path: str) -> DataFrame:
    """blocks with drafts for pages that lacked one."""
    work = blocks.join(state.pages_needing(blocks, "draft"), "page_no", "left_semi")
    return settled(blocks, jobs.call_all(jobs.page_jobs(work, chapters), provider, path), "draft")


def review(blocks: DataFrame, chapters: DataFrame, provider: jobs.Provider, path: str, force: bool = False) -> DataFrame:
    """blocks with final texts for pages that are drafted whole and not all final; drafts are sent."""
    ready = blocks.join(state.review_ready(blocks, force), "page_no", "left_semi").withColumn("text", F.col("draft"))
    return settled(blocks, jobs.call_all(jobs.page_jobs(ready, chapters), provider, path), "final")


def _texts(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """Jobs of one text each, named by a whole number."""
    return texts.select(F.col(key).cast("long").alias("page_no"), F.array(F.lit(0)).alias("ids"), F.to_json(F.struct(text.alias("text"))).alias("request"))


def extract_terms(sections: DataFrame, locked: DataFrame, provider: jobs.Provider, path: str) -> DataFrame:
    """The glossary of sections (section: a number, text): terms of all answers, the first of each, locked ones over them."""
    got = jobs.call_all(_texts(sections, "section", F.col("text")), provider, path).where("error is null")
    listed = got.select("page_no", F.posexplode(F.from_json("response", TERMS, {"mode": "FAILFAST"}).terms).alias("at", "t"))
    terms = listed.select("t.english", F.col("t.marathi").alias("target"), "t.kind", (F.col("page_no") * 1_000_000 + F.col("at")).alias("pos"))
    return glossary.merged(glossary.candidates([terms]), locked)


def summaries(chapters: DataFrame, provider: jobs.Provider, path: str) -> DataFrame:
    """(no, chapter, summary) of chapters (no, chapter, text): short ones have an empty summary and aren't sent; a failed one has null."""
    asked = jobs.summary_requests(chapters).join(chapters.select("no", "chapter"), "chapter")
    got = jobs.call_all(_texts(asked.where("not skipped"), "no", F.col("text")), provider, path).select(F.col("page_no").alias("no"), "response")
    return asked.join(got, "no", "left").select("no", "chapter", F.when(F.col("skipped"), F.lit("")).otherwise(F.col("response")).alias("summary"))


def outline(entries: DataFrame, provider: jobs.Provider, path: str, batch: int = 200) -> DataFrame:
    """(idx, title): translated titles of outline entries (idx, title), `batch` to a call; entries that weren't answered keep theirs."""
    rows = entries.select(F.expr(f"idx div {batch}").alias("page_no"), F.col("idx").cast("int").alias("block_index"), F.col("title").alias("text"))
    got = jobs.parsed(jobs.call_all(jobs.page_jobs(rows, rows.select("page_no", F.lit("outline").alias("chapter")).distinct()), provider, path))
    said = got.select(F.explode("answers").alias("a")).select(F.col("a.id").cast("long").alias("idx"), F.col("a.text").alias("new"))
    return entries.join(said, "idx", "left").select("idx", F.coalesce(F.nullif("new", F.lit("")), "title").alias("title"))


def vision_findings(pages: DataFrame, provider: jobs.Provider, path: str, found: DataFrame | None = None) -> DataFrame:
    """(page_no, kind, severity, detail): remarks of medium and high severity on rendered pages (page_no, text), after automated findings of the same columns. A page whose call failed has none."""
    got = jobs.call_all(_texts(pages, "page_no", F.col("text")), provider, path).where("error is null")
    remarks = got.select("page_no", F.explode(F.from_json("response", REMARKS, {"mode": "FAILFAST"}).findings).alias("f")).select("page_no", "f.*").where(F.col("severity").isin("medium", "high"))
    return remarks if found is None else found.select("page_no", "kind", "severity", "detail").unionByName(remarks)


def untranslated_paragraphs(groups: DataFrame) -> DataFrame:
    """(page_no, group_no, kind) of merged paragraphs (source, text) of prose without Devanagari, or equal to their source."""
    t = T.strip_markup(F.coalesce("text", F.lit("")))
    kinds = F.array_compact(F.array(F.when(~T.has_devanagari(t), F.lit("no_devanagari")), F.when(T.strip(t) == T.strip(F.col("source")), F.lit("passthrough"))))
    return groups.where(T.is_prose(F.col("source"))).select("page_no", "group_no", F.explode(kinds).alias("kind"))
