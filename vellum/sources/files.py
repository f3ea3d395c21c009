"""Sources and sinks: raw pages, images, JSON artefacts, dictionaries and configuration."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assemble import BLOCK
from .tables import file_system

PAGES = f"page_no long, width double, height double, rotation int, blocks array<{BLOCK}>"
MARKS = "level int, title string, page int, idx int"


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Nested page records (page, block, line, span) from JSON lines."""
    return spark.read.schema(PAGES).json(path)


def parsed_files(spark: SparkSession, path: str, parse: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that `parse` makes of each binary file: the place to plug in a document library."""
    names = spark.createDataFrame([], schema).columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rows = list(parse(r.path, r.content))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def image_streams(images: DataFrame) -> DataFrame:
    """One row for each xref, from its first page, with size, hash of the raw bytes and file name. images: page_no, xref, ext, content."""
    first = images.groupBy("xref").agg(F.min("page_no").alias("page_no"), F.min_by(F.struct("ext", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("n_bytes")), "page_no").alias("i"))
    name = F.format_string("p%04d_x%d.%s", F.col("page_no").cast("int"), F.col("xref").cast("int"), "i.ext")
    return first.select("xref", "page_no", "i.sha256", "i.ext", "i.n_bytes", name.alias("filepath"))


def distinct_streams(streams: DataFrame) -> DataFrame:
    """One row for each content hash: what saving without repeated streams keeps."""
    return streams.groupBy("sha256").agg(F.min("xref").alias("xref"), F.max("n_bytes").alias("n_bytes"), F.count("*").alias("uses"))


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON artefact; malformed input raises rather than counting as empty."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def swap_in(df: DataFrame, path: str) -> None:
    """Replaces a table whole. A new version is written beside the old ones, then a pointer names it; readers (current()) see the old or the new one.

    A crash at any step leaves the pointer on a whole version: the rename that sets it is one step,
    and the versions before go only after it. `path` itself holds the versions and the pointers.
    """
    spark = df.sparkSession
    fs, root = file_system(spark, path)
    old = _versions(fs, root)
    version = f"v{(old[-1][0] + 1 if old else 1):010d}"
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.delete(fs_path(f"{path}/{version}"), True)  # left by a crash before its pointer was set
    df.write.parquet(f"{path}/{version}")
    pointer = fs_path(f"{path}/_{version}.new")
    fs.create(pointer, True).close()
    if not fs.rename(pointer, fs_path(f"{path}/_{version}.current")):
        raise OSError(f"{path}: {version} is there already")
    for _, name in old:
        fs.delete(fs_path(f"{path}/_{name}.current"), False)
        fs.delete(fs_path(f"{path}/{name}"), True)


def _versions(fs, root) -> list[tuple[int, str]]:
    """(number, name) of the versions that a pointer names, in order."""
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    return sorted((int(n[2:-8]), n[1:-8]) for n in names if n.startswith("_v") and n.endswith(".current"))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that swap_in() put there last, None before the first."""
    had = _versions(*file_system(spark, path))
    return spark.read.parquet(f"{path}/{had[-1][1]}") if had else None


def read_in_batches(spark: SparkSession, path: str, schema: str, size: int, use: Callable[[pd.DataFrame], pd.DataFrame], out: str) -> DataFrame:
    """JSON lines given to `use` in batches of `size` rows (fewer at the end of a task's share)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            while sum(map(len, held)) >= size:
                rows = pd.concat(held, ignore_index=True)
                held = [rows.iloc[size:]]
                yield use(rows.iloc[:size])
        if held and sum(map(len, held)):
            yield use(pd.concat(held, ignore_index=True))

    return read_json(spark, path, schema).mapInPandas(run, out)


class Config:
    """Nested settings with dotted lookup; a missing key raises unless a default is given."""

    _none = object()

    def __init__(self, values: dict, root: str = "."):
        self.values, self.root = values, root

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        return cls(json.loads(text) if path.endswith(".json") else parse_yaml(text), path.rpartition("/")[0] or ".")

    def get(self, key: str, default=_none):
        at = self.values
        for part in key.split("."):
            if not isinstance(at, dict) or part not in at:
                if default is self._none:
                    raise KeyError(key)
                return default
            at = at[part]
        return at

    def path(self, key: str) -> str:
        value = str(self.get(key))
        return value if value.startswith("/") or "://" in value else f"{self.root}/{value}"


def parse_yaml(text: str) -> dict:
    """Nested mappings, lists of scalars and scalars: what such a configuration uses."""

    def scalar(s: str):
        s = s.strip()
        if s[:1] in "\"'" and s[-1:] == s[:1] and len(s) > 1:
            return s[1:-1]
        if s.startswith("[") and s.endswith("]"):
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        low = s.lower()
        if low in ("true", "false"):
            return low == "true"
        if low in ("", "null", "~"):
            return None
        for kind in (int, float):
            try:
                return kind(s)
            except ValueError:
                pass
        return s

    root: dict = {}
    stack: list[tuple[int, dict | list]] = [(-1, root)]
    pending: tuple[int, dict, str] | None = None
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not body.strip():
            continue
        depth, item = len(body) - len(body.lstrip()), body.strip()
        if pending and depth > pending[0]:
            child: dict | list = [] if item.startswith("- ") else {}
            pending[1][pending[2]] = child
            stack.append((pending[0], child))
        pending = None
        while depth <= stack[-1][0]:
            stack.pop()
        at = stack[-1][1]
        if item.startswith("- "):
            at.append(scalar(item[2:]))
        else:
            key, _, value = item.partition(":")
            at[key.strip()] = scalar(value)
            if not value.strip():
                pending = (depth, at, key.strip())
    return root
