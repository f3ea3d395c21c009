"""Blocks from raw page content: filtering, numbering, joining spans and lines, styled runs."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.markup import RUNS

SPAN = "struct<text:string,size:double,flags:int,font:string>"
BLOCK = f"struct<type:int,bbox:struct<x0:double,y0:double,x1:double,y1:double>,lines:array<struct<spans:array<{SPAN}>>>>"
ITALIC, BOLD = 1 << 1, 1 << 4  # flag bits


def line_blocks(documents: DataFrame) -> DataFrame:
    """A block for each line with something on it: page_no, block_index from 0, text. No shuffle."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return documents.select(F.col("doc_id").alias("page_no"), "lang", "source", F.posexplode(lines).alias("block_index", "text"))


#: What typographic characters become, as T.typographic() has it.
PLAIN = {**T.LIGATURES, **dict(zip(*T.QUOTES, strict=True))}
INK = re.compile(r"[^\x20\x09-\x0D]")


@lru_cache(4096)
def _style(flags: int, font: str) -> tuple[bool, bool]:
    """Italic and bold, by flags or the font's name."""
    font = font.lower()
    return bool(flags & ITALIC) or "italic" in font or "oblique" in font, bool(flags & BOLD) or "bold" in font or "black" in font


@lru_cache(4096)
def _rounded(size: float) -> float:
    """To two places as the engine rounds."""
    if not abs(size) < 2**53:
        return size if size == size else math.nan  # one object, so that they count as equal
    return float(Decimal(repr(size)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def _plain(text: str) -> str:
    if not text.isascii():
        for c, plain in PLAIN.items():
            if c in text:  # a search is far cheaper than a table for each character
                text = text.replace(c, plain)
    return text


def _single(text: str) -> str:
    """Runs of space, tab, CR and LF become one space."""
    for c in "\t\r\n":
        text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def _merged(runs: list[tuple]) -> list[tuple]:
    """As markup.merge_runs()."""
    out: list[tuple] = []
    for start, end, i, b in sorted(runs):
        if out and start <= out[-1][1] and out[-1][2:] == (i, b):
            out[-1] = (out[-1][0], max(out[-1][1], end), i, b)
        else:
            out.append((start, end, i, b))
    return out


def assembled(lines: list[list[tuple]]) -> tuple[str, float, float, list[tuple]] | None:
    """(text, size, size_max, runs) of a raw block's lines of spans (text, size, flags, font); None if it is blank.

    Spans join without a separator, lines with a space; one hyphen at a line's end goes with the
    space. White space is collapsed in the text and in the offsets alike; then characters are composed.
    """
    raw, runs, sizes = "", [], []
    for at, spans in enumerate(lines, 1):
        before = len(raw)
        for text, size, flags, font in spans:
            if not text:
                continue
            begin, raw = len(raw), raw + _plain(text)
            style = _style(flags, font)
            if True in style:
                runs.append((begin, len(raw), *style))
            sizes.append(_rounded(size))
        if at < len(lines) and len(raw) > before:
            if raw.endswith("-") and not raw.endswith("--"):
                raw = raw[:-1]
                runs = [(start, min(end, len(raw)), *style) for start, end, *style in runs]
            else:
                raw += " "
    text = _single(raw).strip(" ")
    if not INK.search(text):
        return None
    if text != raw:
        lead = raw[0] in " \t\r\n"
        place = lambda k: max(0, min(len(_single(raw[:k])) - lead, len(text)))  # noqa: E731  where an offset of the raw text lies in the collapsed one
        runs = [(place(start), place(end), *style) for start, end, *style in runs]
    runs = _merged([r for r in runs if r[1] > r[0]])
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):  # each offset moves to where its prefix ends after that
        ends = lambda k: len(unicodedata.normalize("NFC", text[:k]))
        runs = [r for r in ((ends(start), ends(end), *style) for start, end, *style in runs) if r[0] < r[1]]
        text = unicodedata.normalize("NFC", text)
    counts = Counter(sizes)  # the most frequent size; of ties the smallest
    return text, min(counts, key=lambda s: (-counts[s], s != s, s)), max(counts, key=lambda s: (s != s, s)), runs


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of pages (page_no, blocks: raw blocks): text ones that aren't blank, numbered from 0, composed.

    Raw blocks go to Python one to a row, so a batch is bounded in them however long a page is; nothing is shuffled.
    """
    sides = ["x0", "y0", "x1", "y1"]
    style = f"struct<size:double,size_max:double,runs:{RUNS}>"
    run_type = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("i", pa.bool_()), ("b", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = 0
        for batch in batches:
            lines = batch["lines"]
            (spans,) = lines.values.flatten()
            line_at, span_at = lines.offsets.to_numpy().tolist(), spans.offsets.to_numpy().tolist()
            fields = zip(spans.values.flatten(), ("", 0.0, 0, ""), strict=True)  # what stands for nulls
            pieces = list(zip(*(pc.fill_null(c, v).to_numpy(zero_copy_only=False).tolist() for c, v in fields), strict=True))
            rows, numbers, got = [], [], []
            for k, pos in enumerate(batch["pos"].to_numpy().tolist()):
                index = index if pos else 0  # a page begins
                if block := assembled([pieces[span_at[j] : span_at[j + 1]] for j in range(line_at[k], line_at[k + 1])]):
                    rows.append(k)
                    numbers.append(index)
                    got.append(block)
                    index += 1
            text, size, most, runs = zip(*got, strict=True) if got else ((), (), (), ())
            flat = [r for rs in runs for r in rs]
            fields = [pa.array([r[k] for r in flat], f.type) for k, f in enumerate(run_type)]
            runs = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, runs))], pa.int32()), pa.StructArray.from_arrays(fields, fields=list(run_type)))
            styles = pa.StructArray.from_arrays([pa.array(size, pa.float64()), pa.array(most, pa.float64()), runs], ["size", "size_max", "runs"])
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept["page_no"], pa.array(numbers, pa.int32()), *(kept[c] for c in sides), pa.array(text, pa.string()), styles], names=["page_no", "block_index", *sides, "source_text", "style"])

    raw = pages.select("page_no", F.posexplode(F.filter("blocks", lambda b: b.type == 0)).alias("pos", "b"))
    raw = raw.select("page_no", "pos", *(F.round(F.col(f"b.bbox.{c}"), 2).alias(c) for c in sides), F.col("b.lines").cast(f"array<struct<spans:array<{SPAN}>>>").alias("lines"))
    return raw.mapInArrow(run, f"page_no {pages.schema['page_no'].dataType.simpleString()}, block_index int, x0 double, y0 double, x1 double, y1 double, source_text string, style {style}")
