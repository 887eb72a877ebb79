"""A splittable reader of GeoJSON: one large document is read by several tasks, each a range of its bytes.

A feature belongs to the task in whose range its first byte lies. A task that begins inside a feature passes over the objects
that are left of it, none of which is a feature, until one is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A brace, a key and a colon: within a text a brace is never followed by these, as its quotes are escaped or end it.
OBJECT = re.compile(rb'\{\s*(?:\}|"(?:[^"\\]|\\.)*"\s*:)', re.S)
TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}]', re.S)
CHUNK = 1 << 20


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class _Window:
    """Bytes of a file from a moving place on, read as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data, self.done = file, at, b"", False
        file.seek(at)

    def more(self) -> bool:
        part = b"" if self.done else self.file.read(CHUNK)
        self.done = not part
        self.data += part
        return bool(part)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def object_end(w: _Window) -> int:
    """Where the object at the window's begin ends; 0 if it never does or holds other features."""
    depth, at = 0, 0
    while True:
        for m in TOKEN.finditer(w.data, at):
            if m[0] == b"{":
                depth += 1
            elif m[0] == b"}":
                depth -= 1
                if not depth:
                    return m.end()
            elif depth == 1 and m[0] == b'"features"' and w.data[m.end() : m.end() + 64].lstrip()[:1] == b":":
                return 0
            at = m.end()
        if not w.more():
            return 0


def features_between(file, start: int, end: int) -> Iterator[str]:
    """The features of a file whose first byte lies in the range."""
    w = _Window(file, start)
    while True:
        m = OBJECT.search(w.data)
        while m is None:
            w.drop(max(0, len(w.data) - 2 * CHUNK))  # a key may lie across what has been read
            if w.at >= end or not w.more():
                return
            m = OBJECT.search(w.data)
        w.drop(m.start())
        if w.at >= end:
            return
        n = object_end(w)
        try:
            found = json.loads(w.data[:n]) if n else None
        except ValueError:
            found = None
        if isinstance(found, dict) and found.get("type") == "Feature":
            yield w.data[:n].decode()
        w.drop(n if found is not None else 1)


def _filesystem(path: str):
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (pyarrow.fs.LocalFileSystem(), path)


class FeatureReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], max(1, int(options.get("splitBytes", 32 << 20)))

    def partitions(self):
        fs, path = _filesystem(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.is_file else [f for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, at, min(f.size, at + self.split)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.split)]

    def read(self, partition):
        fs, _ = _filesystem(self.path)
        with fs.open_input_file(partition.path) as file:
            for text in features_between(file, partition.start, partition.end):
                yield (text,)


class FeatureCollections(DataSource):
    """``format("feature_collections")``: (feature: its JSON text). Options: path, a file or folder of them; splitBytes."""

    @classmethod
    def name(cls):
        return "feature_collections"

    def schema(self):
        return "feature string"

    def reader(self, schema):
        return FeatureReader(self.options)


def split_features(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """(feature) of all documents below a path, which pyarrow's file systems reach."""
    spark.dataSource.register(FeatureCollections)
    return spark.read.format("feature_collections").option("splitBytes", split_bytes).load(path)
