"""Jobs for an external model: payloads, calls behind an interface, validation, retries.

A provider is any object with call(request) -> answer: a text, or an Answer that says how it ended.
Calls run in tasks, `concurrency` at a time by partition count. Answers are written once, as they
come, and everything after reads them; a failed page is an error row beside the good ones, and
raise_failures() stops the stage when they are safe. A second run calls for failed pages only.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import exists

FRONT = "(front matter)"
ANSWER = "struct<blocks:array<struct<id:int,marathi:string,note:string>>>"
SUMMARY_MIN, SUMMARY_MAX = 400, 40_000


class ProviderError(RuntimeError):
    """A call failed for good."""


class Transient(RuntimeError):
    """A call may succeed when repeated."""


class TimedOut(Transient):
    """Repeating a slow call seldom helps: the second ends it."""


class Provider(Protocol):
    def call(self, request: str) -> str | Answer: ...


class Echo:
    """A local provider: gives every text back, marked."""

    def __init__(self, mark: str = "म "):
        self.mark = mark

    def call(self, request: str) -> str:
        blocks = json.loads(request)["blocks"]
        return json.dumps({"blocks": [{"id": b["id"], "marathi": self.mark + b["text"], "note": ""} for b in blocks]}, ensure_ascii=False)


@dataclass(frozen=True)
class Answer:
    """What a model said, and whether it came to an end by itself."""

    text: str | None
    complete: bool = True


def content(answer: str | Answer | None) -> str:
    """The text of a whole, non-blank answer; others end the call for good."""
    got = answer if isinstance(answer, Answer) else Answer(answer)
    if not got.complete:
        raise ProviderError("the answer was cut off")
    if not (got.text or "").strip():
        raise ProviderError("the answer is empty")
    return got.text


@dataclass(frozen=True)
class Policy:
    """Which failures are worth another call: transient ones, `attempts` calls in all, `slow` timeouts among them; pauses double."""

    attempts: int = 4
    pause: float = 3.0
    slow: int = 2

    def again(self, failures: list[Transient]) -> bool:
        return len(failures) < self.attempts and sum(isinstance(f, TimedOut) for f in failures) < self.slow

    def call(self, once: Callable[[], str], sleep: Callable[[float], None] = time.sleep) -> str:
        failures: list[Transient] = []
        while True:
            try:
                return once()
            except Transient as f:
                failures.append(f)
            if not self.again(failures):
                raise ProviderError(f"gave up after {len(failures)} calls: {failures[-1]!r}") from failures[-1]
            sleep(self.pause * 2 ** (len(failures) - 1))


def page_jobs(blocks: DataFrame, chapters: DataFrame) -> DataFrame:
    """(page_no, chapter, ids, request) of each page; texts in block order. blocks: page_no, block_index, text."""
    parts = F.array_sort(F.collect_list(F.struct(F.col("block_index").alias("id"), "text")))  # a page's blocks
    pages = blocks.groupBy("page_no").agg(parts.alias("blocks"))
    got = pages.join(chapters.select("page_no", "chapter"), "page_no", "left")
    return got.select("page_no", F.coalesce("chapter", F.lit(FRONT)).alias("chapter"), F.transform("blocks", lambda b: b.id).alias("ids"), F.to_json(F.struct("blocks")).alias("request"))


RESULT = "page_no long, ids array<int>, response string, error string"


def call_all(jobs: DataFrame, provider: Provider, path: str, concurrency: int = 6, policy: Policy = Policy()) -> DataFrame:
    """(page_no, ids, response, error) of every page, read from `path`, where the answers are kept; one of response and error is null.

    Pages that have an answer there aren't called for again. A repeated action reads, and calls nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    out.append((r.page_no, list(r.ids), policy.call(lambda r=r: content(provider.call(r.request))), None))
                except Exception as e:  # noqa: BLE001  a page's failure is a row
                    out.append((r.page_no, list(r.ids), None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["page_no", "ids", "response", "error"])

    spark = jobs.sparkSession
    todo = jobs.select("page_no", "ids", "request")
    if exists(spark, path):
        todo = todo.join(spark.read.schema(RESULT).parquet(path).where("error is null").select("page_no"), "page_no", "left_anti")
    todo.repartition(concurrency, "page_no").mapInPandas(run, RESULT).write.mode("append").parquet(path)
    kept = spark.read.schema(RESULT).parquet(path)
    best = kept.groupBy("page_no").agg(F.max_by(F.struct("ids", "response", "error"), F.col("error").isNull().cast("int")).alias("r"))
    return best.select("page_no", "r.*")


def last_answers(answers: Column) -> Column:
    """Of the answers (id, text) to one id the last, by id."""
    placed = F.array_sort(F.transform(answers, lambda a, k: F.struct(a.id.alias("id"), k.alias("at"), a.text.alias("text"))))
    last = F.transform(F.array(placed), lambda s: F.filter(s, lambda x, k: ~F.get(s, k + 1).id.eqNullSafe(x.id)))[0]
    return F.transform(last, lambda x: F.struct(x.id.alias("id"), x.text.alias("text")))


def validated(responses: DataFrame) -> DataFrame:
    """(page_no, missing, empty, ok) from sent ids and answers (id, text): ids never answered, and ids whose last answer is blank. Other ids are let through unless blank."""
    got = responses.withColumn("_last", last_answers(F.col("answers")))
    answered = F.array(F.transform("_last", lambda a: a.id))
    missing = F.transform(answered, lambda had: F.array_sort(F.filter("ids", lambda i: ~F.array_contains(had, i))))[0]
    blank = lambda a: F.regexp_replace(F.coalesce(a.text, F.lit("")), r"[\x20\x09-\x0D]", "") == ""
    empty = F.transform(F.filter("_last", blank), lambda a: a.id)
    out = got.select("page_no", missing.alias("missing"), empty.alias("empty"))
    return out.withColumn("ok", (F.size("missing") == 0) & (F.size("empty") == 0))


def parsed(responses: DataFrame) -> DataFrame:
    """Answers of the responses that came, from JSON; malformed JSON raises."""
    return responses.where("error is null").withColumn("_a", F.from_json("response", ANSWER, {"mode": "FAILFAST"})).select("page_no", "ids", F.transform("_a.blocks", lambda b: F.struct(b.id.alias("id"), b.marathi.alias("text"))).alias("answers"))


def raise_failures(results: DataFrame, most: int = 10) -> None:
    """Stops a stage whose results have errors, after its good pages were kept."""
    bad = results.where("error is not null").select("page_no", "error").orderBy("page_no").limit(most).collect()
    if bad:
        raise ProviderError("; ".join(f"p{r.page_no}: {r.error}" for r in bad))


def summary_requests(chapters: DataFrame) -> DataFrame:
    """Chapters (chapter, text) cut to what a summary call takes; short ones need none and get an empty summary."""
    return chapters.select("chapter", F.left("text", F.lit(SUMMARY_MAX)).alias("text"), (F.length("text") < SUMMARY_MIN).alias("skipped"))


def salvage(answer: Column, fallback: Column, field: str) -> Column:
    """A field of the JSON object in a chatty answer, else the fallback."""
    from ..functions.text import first_json

    return F.coalesce(F.get_json_object(first_json(answer), f"$.{field}"), fallback)
