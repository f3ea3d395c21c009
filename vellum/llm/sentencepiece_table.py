"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model has a whitespace marker after another character, no merge crosses from
one marked word into the next. A text is then cut into chunks (its markers with the word after
them), each distinct chunk is segmented once by the library and kept in a table with its ids and
its decoded text, and the ids of a text are joined by position.

The table comes in two forms that give the same ids. `encode()` and `round_trip()` keep one in each
worker, bounded in bytes, in two generations: what was used since the last turn is kept, the rest
goes, so a frequent chunk is segmented once a worker and a rare one once a turn. `joined()` builds
one table of all distinct chunks of the corpus by aggregation, segments each once, and joins the ids
back by chunk and place. That moves a row for every word: the README has both forms' figures, and
the first is the one that the queries use.

Defined results: null and empty texts have the end id only and decode to the empty text; texts of
any length are encoded whole; extra columns stay; an existing column named like an added one is
replaced. A model whose pieces cross markers, or that rewrites its input, is refused.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, texts_udf

MARK = "▁"
#: Bytes of chunks and ids (as text) in a generation of a worker's table, at most, but for those of one block of texts.
MOST_BYTES = 2_000_000
#: Characters of a chunk that is kept; a longer one is segmented where it stands.
LONGEST = 64
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Chunks of one model: ids joined by spaces, and what a chunk decodes to, without its first space, where that is another text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        if any(re.search(f"[^{MARK}]{MARK}", m.id_to_piece(i)) for i in range(m.get_piece_size())):
            raise ValueError("pieces of this model cross whitespace markers")
        if any(m.decode(m.encode(x)) != x for x in ("  a  b ", "ﬁ Å", "\n a\t")):
            raise ValueError("this model normalises its input")
        self.mark = m.piece_to_id(MARK)
        self.end = m.eos_id()
        self.new: dict[str, str] = {}  # ids of the chunks used since the last turn
        self.old: dict[str, str] = {}  # and of those used in the turn before
        self.decoded: dict[str, str] = {}  # of chunks that don't decode to themselves
        self.bytes = 0
        self.segmented = 0

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks in order, each without its first marker."""
        if not text:
            return []
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:].replace(MARK, " ") for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def segment(self, chunks: list[str]) -> tuple[list[str], list[str]]:
        """Ids joined by spaces, and what they decode to, of each chunk."""
        ids = self.model.encode(chunks, num_threads=1)
        ids = [x if c else [self.mark] for c, x in zip(chunks, ids, strict=True)]  # a marker alone
        return [" ".join(map(str, x)) for x in ids], self.model.decode(ids, num_threads=1)

    def learn(self, chunks: set[str]) -> None:
        """Puts the chunks of a block into the table."""
        if self.bytes > MOST_BYTES:
            self.old, self.new, self.bytes = self.new, {}, 0
            self.decoded = {c: d for c, d in self.decoded.items() if c in self.old}
        lacking = []
        for c in chunks - self.new.keys():
            if (had := self.old.get(c)) is None:
                lacking.append(c)
            else:
                self.new[c] = had
                self.bytes += len(c) + len(had)
        if lacking:
            self.segmented += len(lacking)
            for c, x, d in zip(lacking, *self.segment(lacking), strict=True):
                self.new[c] = x
                self.bytes += len(c) + len(x)
                if c != d:
                    self.decoded[c] = d

    def forget_long(self, chunks: set[str]) -> None:
        for c in chunks:
            if len(c) > LONGEST:
                self.bytes -= len(c) + len(self.new.pop(c, ""))
                self.decoded.pop(c, None)

    def encode(self, text: str) -> str:
        """Ids with the end id, in decimal, joined by one space."""
        got = [self.new[c] for c in self.chunks(text)]
        got.append(str(self.end))
        return " ".join(got)

    def decode(self, text: str) -> str:
        """What the model's decode() makes of encode(text)."""
        if not self.decoded and MARK not in text:
            return text
        return " ".join([self.decoded.get(c, c) for c in self.chunks(text)])


_tables: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    if path not in _tables:
        _tables[path] = ChunkTable(path)
    return _tables[path]


def _texts(raw: np.ndarray, starts: np.ndarray, known: ChunkTable):
    """The texts of a block, with their chunks in the table."""
    whole = raw.tobytes()
    texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(starts[:-1], starts[1:], strict=True)]
    need: set[str] = set()
    for t in texts:
        need.update(known.chunks(t))
    known.learn(need)
    yield from texts
    known.forget_long(need)


def encode(documents: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds `ids` (array<int>, the end id last) to every row."""
    path = path or default_model()

    def run(raw: np.ndarray, starts: np.ndarray) -> dict:
        known = chunk_table(path)
        return {"ids": [np.array(known.encode(t).split(" "), np.int32) for t in _texts(raw, starts, known)]}

    return documents.withColumn("ids", texts_udf(run, "ids array<int>")(F.col(text)).ids)


def round_trip(documents: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to every row."""
    path = path or default_model()

    def run(raw: np.ndarray, starts: np.ndarray) -> dict:
        known = chunk_table(path)
        n, ids, back = [], [], []
        for t in _texts(raw, starts, known):
            joined = known.encode(t)
            n.append(joined.count(" ") + 1)
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            back.append(hashlib.sha256(known.decode(t).encode()).hexdigest())
        return {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": back}

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    got = documents.withColumn("_pieces", texts_udf(run, kind)(F.col(text)))
    return got.withColumns({c: F.col(f"_pieces.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop("_pieces")


def _distinct_chunks(batch: pa.RecordBatch):
    """(row, place, chunk) of every chunk of a batch of texts."""
    rows, places, chunks = [], [], []
    for row, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
        got = ChunkTable.chunks(t or "")
        rows += [row] * len(got)
        places += range(len(got))
        chunks += got
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(places, pa.int32()), pa.array(chunks, pa.string())], ["row", "place", "chunk"])


def joined(documents: DataFrame, row: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(row, ids) of every row, by a table of the corpus's distinct chunks: each is segmented once, and its ids are joined back by place. `row` must be a whole number that names a row."""
    path = path or default_model()

    def segmented(batch: pa.RecordBatch):
        ids, _ = chunk_table(path).segment(batch.column("chunk").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(ids)], ["chunk", "ids"])

    texts = documents.select(F.col(row).cast("long").alias("row"), F.col(text).alias("text"))
    placed = map_arrow(texts, _distinct_chunks, "row long, place int, chunk string")
    pieces = map_arrow(placed.select("chunk").distinct(), segmented, "chunk string, ids string")
    found = placed.join(pieces, "chunk").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "ids"))).alias("parts"))  # of one text
    whole = F.concat_ws(" ", F.transform("parts", lambda p: p.ids), F.lit(str(chunk_table(path).end)))
    ids = F.transform(F.split(whole, " "), lambda x: x.cast("int"))
    return texts.select("row").join(found, "row", "left").select(F.col("row").alias(row), ids.alias("ids"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(documents).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
