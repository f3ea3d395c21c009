"""WARC archives: written as one record per page, read back by boundary-chain verification.

Archives are plain WARC/1.1 files, written by Spark's own writer into any folder that it reaches.
Reading cuts blocks of files at every line that looks like the start of a record, and so also inside
payloads that hold such a line. Tasks emit a candidate for each with the place where its successor
must start, by its Content-Length; places in a file follow from the sums of the blocks before. From the start of each
file, pointer jumping over runs of candidates that follow each other keeps those that the chain
reaches; the others were magic inside payloads, and their bytes go back to the record around them.
A chain that doesn't end with its file raises an error. Candidates are ordered by place within a
file, without their bytes but for cut ones: own archives are of one task's size, a foreign one of
tens of GB has its (narrow) candidates sorted in one task.

Defined results: a null payload is written as an empty one; of equal payloads of at least
`MIN_REVISIT` bytes the one with the largest page_id is the response and the others revisit it (a
null page_id never is the largest unless all are null; rows that repeat the largest page_id are all
responses; a revisit names its response by page_id and digest, so that a page_id with several payloads
adds no rows); line ends in URLs are percent-encoded; empty tables give empty archives; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from .common import map_arrow, materialise, scratch, ship, table

MIN_REVISIT = 1000
#: Rows of repeated payloads that are broadcast at most (60 bytes each); beyond, they are joined.
BROADCAST_ROWS = 200_000

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
_LINE = MAGIC[:-1].encode()
_DATE = "2024-01-01T00:00:00Z"
_HEADER = re.compile(rb"^([A-Za-z0-9-]+):[ \t]*(.*?)\r?$", re.M)

_CANDIDATE = "file string, size long, block long, at long, length long, declared long, kind string, page_id long, refers_to long, promised string, payload_bytes long, digest string, magic boolean, within boolean, raw binary"
_PLACED = "file string, size long, pos long, length long, declared long, kind string, page_id long, refers_to long, promised string, payload_bytes long, digest string, raw binary"
_SAID = ("declared", "kind", "page_id", "refers_to", "promised", "payload_bytes", "digest")
_RECORD = "page_id long, kind string, refers_to long, promised string, payload_bytes long, digest string"
_RAW = "file string, block long, at long, length long, raw binary"


def elect(pages: DataFrame, payload: str = "html") -> DataFrame:
    """Adds _payload, _digest, _bytes and refers_to (the response's page_id where a page revisits it)."""
    whole = pages.withColumn("_payload", F.coalesce(F.col(payload), F.lit("")))
    named = whole.withColumn("_digest", F.sha1(F.col("_payload").cast("binary"))).withColumn("_bytes", F.octet_length("_payload").cast("long"))
    repeated = (
        named.where(F.col("_bytes") >= MIN_REVISIT).groupBy(F.col("_digest").alias("_same"))
        .agg(F.max("page_id").alias("_response"), F.count("*").alias("_n")).where("_n > 1 and _response is not null").drop("_n")
    )
    repeated = materialise(repeated, "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = broadcast(repeated)
    joined = named.join(repeated, (F.col("_digest") == F.col("_same")) & (F.col("_bytes") >= MIN_REVISIT), "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_response")), F.col("_response"))).drop("_same", "_response")


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write(pages: DataFrame, path: str, payload: str = "html", url: str = "url") -> None:
    """Writes pages (page_id, url and payload) as archives below `path`."""
    p = elect(pages.select("page_id", url, payload), payload)
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    uri = F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page = F.col("page_id").cast("string")
    block = F.when(again, http).otherwise(F.concat(http, F.col("_payload")))
    record = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page, F.lit("none")), F.lit(">"))),
        _header("WARC-Date", F.lit(_DATE)),
        _header("WARC-Target-URI", uri),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        _header("WARC-Page-ID", page),
        _header("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END),
        block,
    )
    p.select(record.alias("value")).write.option("lineSep", END).option("compression", "none").text(path)


def _number(value: bytes | None) -> int | None:
    found = re.search(rb"\d+", value) if value else None
    if not found:
        return None
    return -int(found[0]) if value[: found.start()].endswith(b"-") else int(found[0])


def parse(record: bytes) -> dict | None:
    """What a candidate (without its magic) says of itself; None without proper headers."""
    head = record.find(b"\r\n\r\n")
    if head < 0:
        return None
    fields = {k.lower(): v for k, v in _HEADER.findall(record[:head])}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return None
    declared = head + 4 + int(length)
    promised = fields.get(b"warc-payload-digest")
    out = {
        "declared": declared, "kind": fields[b"warc-type"].decode("latin-1"), "page_id": _number(fields.get(b"warc-page-id")), "refers_to": _number(fields.get(b"warc-refers-to")),
        "promised": promised.rpartition(b":")[2].decode("latin-1").lower() if promised else None,
    }
    if declared <= len(record):
        block = record[head + 4 : declared]
        payload = block[block.find(b"\r\n\r\n") + 4 :]
        out |= {"payload_bytes": len(payload), "digest": hashlib.sha1(payload).hexdigest()}
    return out


def _pieces(batches):
    """(file, size, block, place in the block, bytes) of every piece of a block: up to its first magic line, then from each on."""
    key, at, start, lines = None, 0, 0, []
    for batch in batches:
        for f, s, b, v in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "block", "value")), strict=True):
            if (f, s, b) != key or v == _LINE:
                if lines:
                    yield (*key, start, b"\n".join([*lines, b""]))
                if (f, s, b) != key:
                    key, at = (f, s, b), 0
                start, lines = at, []
            lines.append(v)
            at += len(v) + 1
    if lines:
        yield (*key, start, b"\n".join([*lines, b""]))


def _batched(rows, fields: list[tuple[str, pa.DataType]], most: int = 1 << 22):
    """Record batches of about `most` bytes of raw values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[-1] or b"")
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(n, _KINDS[t]) for n, t in (c.split() for c in schema.split(", "))]


def _candidates(batches):
    """A row for each piece: what it says of itself if it begins with magic, and its bytes if it isn't a whole record or follows one that isn't."""

    def rows():
        inside = None
        for file, size, block, at, piece in _pieces(batches):
            if at == 0:
                inside = None
            magic = piece.startswith(_LINE + b"\n")
            said = (parse(piece[len(MAGIC) :]) if magic else None) or {}
            whole = "digest" in said
            within = inside is not None and at < inside
            if not whole and not within:
                inside = at + len(MAGIC) + said["declared"] if said else None
            raw = piece if within or not whole else None
            yield (file, size, block, at, len(piece), *(said.get(n) for n in _SAID), magic, within, raw)

    yield from _batched(rows(), _fields(_CANDIDATE))


def _raw(batches):
    """Every piece with its bytes."""
    yield from _batched(((f, b, at, len(p), p) for f, _, b, at, p in _pieces(batches)), _fields(_RAW))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and block. A separator of one byte never lies across two blocks."""
    got = spark.read.option("lineSep", "\n").text(path)
    return got.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _placed(candidates: DataFrame) -> DataFrame:
    """With `pos`, the place in the file, from the sums of the blocks before."""
    blocks = candidates.groupBy("file", "block").agg(F.max(F.col("at") + F.col("length")).alias("upto"))
    base = blocks.selectExpr("file", "block", "coalesce(sum(upto) over (partition by file order by block rows between unbounded preceding and 1 preceding), 0L) as base")
    return candidates.join(base, ["file", "block"]).withColumn("pos", F.col("base") + F.col("at")).drop("base", "at", "block")


def _merged(placed: DataFrame) -> DataFrame:
    """Pieces that a block's end cut off, put back to the piece before; then every piece begins with magic."""
    fields = _fields(_PLACED)

    def together(batch):
        def rows():
            for g in batch.to_pylist():
                parts = g["parts"]
                first, length = parts[0], sum(p["length"] for p in parts)
                if first["digest"] is not None:
                    yield (g["file"], g["size"], first["pos"], length, *(first[n] for n in _SAID), first["raw"])
                else:
                    raw = b"".join(p["raw"] for p in parts)
                    said = parse(raw[len(MAGIC) :]) or {}
                    yield (g["file"], g["size"], first["pos"], length, *(said.get(n) for n in _SAID), None if "digest" in said and not g["within"] else raw)

        yield from _batched(rows(), fields)

    names = [n for n, _ in fields]
    heads = placed.selectExpr("*", "coalesce(last(if(magic, pos, null), true) over (partition by file order by pos rows between unbounded preceding and current row), 0) as head")
    loose = heads.where("pos <> head").select("file", "head").distinct().withColumn("open", F.lit(True))
    marked = materialise(heads.join(loose, ["file", "head"], "left"), "heads")
    whole = marked.where("open is null").select(*names)
    held = F.struct("pos", "length", *_SAID, "raw")
    parts = marked.where("open").groupBy("file", "size", "head").agg(F.array_sort(F.collect_list(held)).alias("parts"), F.bool_or("within").alias("within"))
    return whole.union(map_arrow(parts.drop("head"), together, _PLACED))


def chain(placed: DataFrame) -> DataFrame:
    """The candidates that the chain from each file's start reaches; `next` is where the successor must start."""
    linked = placed.withColumn("next", F.col("pos") + F.col("declared") + len(MAGIC) + len(END))
    order = "partition by file order by pos"
    near = linked.selectExpr("*", f"lag(next) over ({order}) as before", f"lead(pos) over ({order}) as following")
    near = materialise(near, "linked")
    aims = near.where("next is not null and next <> coalesce(following, -1)").select("file", F.col("next").alias("pos"), F.lit(True).alias("aimed")).distinct()
    heads = near.join(aims, ["file", "pos"], "left").selectExpr("*", "coalesce(aimed, false) or coalesce(before <> pos, true) as head")
    runs = materialise(heads.selectExpr("*", f"max(if(head, pos, null)) over ({order} rows between unbounded preceding and current row) as run"), "runs")
    jump = materialise(runs.groupBy("file", "run").agg(F.max_by("next", "pos").alias("to")), "jumps")
    reached = materialise(runs.select("file").distinct().select("file", F.lit(0).cast("long").alias("run")), "reached")
    while True:
        step = reached.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"))
        new = step.join(reached, ["file", "run"], "left_anti").join(jump.select("file", "run"), ["file", "run"], "left_semi").distinct()
        new = materialise(new, "reached")
        if new.isEmpty():
            break
        reached = materialise(reached.union(new), "reached")
        far = jump.select("file", F.col("run").alias("to"), F.col("to").alias("far"))
        jump = materialise(jump.join(far, ["file", "to"], "left").select("file", "run", F.coalesce("far", "to").alias("to")), "jumps")
    return runs.join(reached, ["file", "run"]).drop("run", "head", "aimed", "before", "following")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, kind, refers_to, promised, payload_bytes, digest of every record of the archives below `path`, from their bytes. promised: the digest that its header names, digest: that of its payload."""
    ship()
    found = materialise(_merged(_placed(materialise(_lines(spark, path).mapInArrow(_candidates, _CANDIDATE), "candidates"))), "placed")
    kept = materialise(chain(found.drop("raw")), "chained")
    ends = kept.groupBy("file").agg(F.max("next").alias("end"))
    broken = found.select("file", "size").distinct().join(ends, "file", "left").where("end is null or end <> size").first()
    if broken:
        raise ValueError(f"the chain of {broken.file} ends at {broken.end} of {broken.size}")
    inner = len(MAGIC)
    whole = kept.where(f"declared + {inner} <= length")
    cut = kept.where(f"declared + {inner} > length")
    got = ["page_id", "kind", "refers_to", "promised", "payload_bytes", "digest"]
    if cut.isEmpty():
        return whole.select(*got)
    return whole.select(*got).union(_rejoined(spark, path, found, cut).select(*got))


def _rejoined(spark: SparkSession, path: str, found: DataFrame, cut: DataFrame) -> DataFrame:
    """Records in several pieces, put together by place: those across two blocks, and those whose payloads hold magic lines.

    A record must fit in a row, as it did when it was written. Pieces whose bytes the first pass
    didn't keep are read again.
    """
    # a span ends before the next record of the chain, so the last record that starts at or before a piece is the only one it can belong to
    starts = cut.select("file", "pos", F.col("pos").alias("start"), F.col("next").alias("stop"))
    ordered = found.select("file", "pos", "length", "raw").join(starts, ["file", "pos"], "left")
    before = "over (partition by file order by pos rows between unbounded preceding and current row)"
    inside = materialise(ordered.selectExpr("file", "pos", "length", "raw", f"last(start, true) {before} as start", f"last(stop, true) {before} as stop").where("pos < stop").drop("stop"), "pieces")
    lost = inside.where("raw is null").selectExpr("file", "pos as begin", "pos + length as end", "start")
    inside = inside.drop("length")
    if not lost.isEmpty():
        again = _placed(_lines(spark, path).mapInArrow(_raw, _RAW)).select("file", "pos", "raw")
        more = again.join(lost, "file").where("pos >= begin and pos < end")  # of a file, the few pieces that the first pass took for records
        inside = inside.where("raw is not null").unionByName(more.select("file", "pos", "raw", "start"))
    joined = inside.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("parts"))

    def parsed(batch):
        rows = [parse(b"".join(p["raw"] for p in parts)[len(MAGIC) :]) or {} for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _fields(_RECORD)], [n for n, _ in _fields(_RECORD)])

    return map_arrow(joined.select("parts"), parsed, _RECORD)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from archives."""
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    records = materialise(read(spark, path), "records")
    full = records.where("kind = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("digest").alias("promised")).distinct()
    revisits = records.where("kind = 'revisit'").select("page_id", "refers_to", "promised", "kind").join(full, ["refers_to", "promised"], "left")  # a page_id may have several payloads
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = records.where("kind = 'response'").select("page_id", "payload_bytes", "digest", "kind", F.lit(None).cast("long")).toDF(*columns)
    return first.union(revisits.select("page_id", "n", "promised", "kind", "refers_to").toDF(*columns))


ORACLE_SQL = f"""
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as payload_digest from p),
r as (select *, case when payload_bytes >= {MIN_REVISIT} then max(page_id) over (partition by payload_digest) end as response from d)
select page_id, payload_bytes, payload_digest, case when response <> page_id then 'revisit' else 'response' end as record_type,
    case when response <> page_id then response end as refers_to from r
"""
