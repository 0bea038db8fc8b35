"""A source of articles: MediaWiki XML dumps, plain or compressed.

`spark.read.format("article_dump").load(folder)` gives page_id, ns, title, timestamp, text. A plain file is cut into
ranges of bytes; a task reads the pages that begin in its range, so one file feeds many tasks. Files that end in .bz2
or .gz are read whole, one a task, as a stream. Conditions on title, ns and page_id are tested before a page's
text is decoded.
"""

from __future__ import annotations

import bz2
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from loomgraph.sources.named_files import filesystem

SCHEMA = "page_id bigint, ns int, title string, timestamp string, text string"
KINDS = {"page_id": pa.int64(), "ns": pa.int32(), "title": pa.string(), "timestamp": pa.string(), "text": pa.string()}
OPEN, CLOSE = b"<page>", b"</page>"
_TEXT = re.compile(rb"<text\b[^>]*?(?:/>|>(.*?)</text>)", re.S)
_FIELD = {n: re.compile(rb"<%s>(.*?)</%s>" % (t, t), re.S) for n, t in (("page_id", b"id"), ("ns", b"ns"), ("title", b"title"), ("timestamp", b"timestamp"))}
STEP = 1 << 20
#: Conditions that are tested on a page's own fields; a missing field meets none.
TESTS = {
    IsNotNull: lambda v, f: True,
    EqualTo: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
    StringStartsWith: lambda v, f: v.startswith(f.value),
    StringEndsWith: lambda v, f: v.endswith(f.value),
    StringContains: lambda v, f: f.value in v,
}


@dataclass
class Range(InputPartition):
    """The pages that begin at bytes from start to end of a file; a compressed file is one range."""

    path: str
    start: int
    end: int


class ArticleDump(DataSource):
    """Options: path (a file or a folder, read with its subfolders) and partition_bytes (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "article_dump"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], int(self.options.get("partition_bytes", 64 << 20)), schema.names)


def field(page: bytes, name: str):
    """A field of a page's head; null where it is missing or no number."""
    m = _FIELD[name].search(page)
    if m is None:
        return None
    value = unescape(m[1].decode("utf-8", "replace"))
    if name in ("page_id", "ns"):
        return int(value) if re.fullmatch(r"-?\d+", value.strip()) else None
    return value


class Reader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int, names: list[str]):
        self.path, self.partition_bytes, self.names = path, partition_bytes, names
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute in (("title",), ("ns",), ("page_id",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, root = filesystem(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no dump at {self.path}")
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type != fs.FileType.File or f.base_name.startswith(("_", ".")) or not f.size:
                continue
            step = f.size if f.path.endswith((".bz2", ".gz")) else self.partition_bytes
            out += [Range(f.path, a, min(f.size, a + step)) for a in range(0, f.size, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows, size = [], 0
        for page in self.pages(partition):
            head = page.partition(b"<text")[0]
            if all((v := field(head, f.attribute[0])) is not None and TESTS[type(f)](v, f) for f in self.filters):
                m = _TEXT.search(page)
                text = None if m is None else unescape((m[1] or b"").decode("utf-8", "replace"))
                rows.append([text if n == "text" else field(head, n) for n in self.names])
                size += 100 + len(text or "")
                if size >= 8 << 20:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], KINDS[n]) for i, n in enumerate(self.names)], self.names)

    def pages(self, part: Range) -> Iterator[bytes]:
        """The pages that begin in a range; the last one may end behind it. A page that is cut off at the end of a file is left out."""
        store, _ = filesystem(self.path)
        packed = part.path.endswith((".bz2", ".gz"))
        with store.open_input_stream(part.path, compression=None) if packed else store.open_input_file(part.path) as f:
            if packed:
                chunks, at, end = self.unpacked(f, part.path), 0, None
            else:
                f.seek(part.start)
                chunks, at, end = iter(lambda: f.read(STEP), b""), part.start, part.end
            held = b""
            while True:
                a = held.find(OPEN)
                if a >= 0 and end is not None and at + a >= end:
                    return
                z = held.find(CLOSE, a) if a >= 0 else -1
                if z >= 0:
                    yield held[a : z + len(CLOSE)]
                    at, held = at + z + len(CLOSE), held[z + len(CLOSE) :]
                    continue
                if a < 0:  # what may be the beginning of a tag is kept
                    cut = max(0, len(held) - len(OPEN) + 1)
                    at, held = at + cut, held[cut:]
                    if end is not None and at >= end:
                        return
                more = [next(chunks, b"")]
                if a >= 0:  # a long page: read twice as much each time
                    while more[-1] and sum(map(len, more)) < len(held):
                        more.append(next(chunks, b""))
                if not more[0]:
                    return
                held += b"".join(more)

    @staticmethod
    def unpacked(f, path: str) -> Iterator[bytes]:
        """The bytes of a compressed file of one or more members."""
        new = bz2.BZ2Decompressor if path.endswith(".bz2") else lambda: zlib.decompressobj(31)
        z, left = new(), b""
        while True:
            data = left or f.read(STEP)
            if not data:
                return
            left = b""
            if out := z.decompress(data):
                yield out
            if z.eof:
                left, z = z.unused_data, new()


def register(spark: SparkSession, pushdown: bool = False) -> None:
    """With pushdown, conditions are handed to the source, by a setting of the session.

    Spark 4.1 keeps one set of conditions for a loaded frame: one that occurs twice in a plan, under different
    conditions, gives wrong rows then. Load it once for each (a test holds that), or leave pushdown off.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", str(pushdown).lower())
    spark.dataSource.register(ArticleDump)


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def page_xml(page_id: Column, title: Column, text: Column, ns: Column | None = None, timestamp: Column | None = None) -> Column:
    """A page of a dump; null fields are left out."""
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), escaped(c.cast("string")), F.lit(f"</{name}>")), F.lit(""))
    body = F.coalesce(F.concat(F.lit('<text xml:space="preserve">'), escaped(text), F.lit("</text>")), F.lit(""))
    none = F.lit(None).cast("string")
    return F.concat(F.lit("<page>"), tag("title", title), tag("ns", ns if ns is not None else none), tag("id", page_id), F.lit("<revision>"), tag("timestamp", timestamp if timestamp is not None else none), body, F.lit("</revision></page>"))
