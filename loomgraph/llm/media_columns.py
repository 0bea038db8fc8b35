"""Interleaved document sequences: text and media in the order of the page.

HTML becomes an ordered array of structs (position, kind, text, digest): text runs, media references by
the digest of their payload, and captions, each with its place. Payloads live in a store keyed by digest;
a digest join resolves references, and the array's order and the captions' places never change.

Payloads are stored as grey images: 24 x 24 samples of 8 bits to a tile, tiles stacked, in the PGM format.

Defined results: null HTML is an empty sequence, a null text an empty payload (one tile of filler). A
reference whose payload isn't in the store stays, unresolved. Scripts, styles and the like give no text. Repeated rows
get equal results, rows that share a key a sequence each, a null key stays null. Pages and texts of any length are
read whole. Empty tables give empty results. Columns beside the named ones are never read, so names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import scratch, slices, table

SIDE = 24
UNIT = SIDE * SIDE
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string>>"


#: Elements that text runs through, and those whose contents are no text of the page.
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time u var wbr".split())
UNSEEN = frozenset("script style template noscript title textarea".split())
MEDIA = frozenset("img source video audio".split())


class _Sequence(HTMLParser):
    """A figcaption lasts to its end tag or, where that is missing, to the end of its figure or to the next figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.caption, self.unseen = [], [], False, None

    def flush(self):
        t = " ".join("".join(self.text).split())
        if t:
            self.items.append({"position": len(self.items), "kind": "caption" if self.caption else "text", "text": t, "digest": None})
        self.text = []

    def handle_starttag(self, tag, attrs):
        if self.unseen:
            return
        if tag in UNSEEN:
            self.unseen = tag
            return
        if tag in MEDIA and (src := dict(attrs).get("src")):
            self.flush()
            self.items.append({"position": len(self.items), "kind": "media", "text": dict(attrs).get("alt"), "digest": src.removeprefix("sha256:")})
        elif tag not in INLINE:
            self.flush()
        if tag in ("figcaption", "figure"):
            self.caption = tag == "figcaption"

    def handle_startendtag(self, tag, attrs):
        if tag not in UNSEEN:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.unseen:
            if tag == self.unseen:
                self.unseen = None
            return
        if tag not in INLINE:
            self.flush()
        if tag in ("figcaption", "figure"):
            self.caption = False

    def handle_data(self, data):
        if not self.unseen:
            self.text.append(data)


def sequence(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.items


def interleave(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Returns key, items (SEQUENCE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string())]))
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence(x.as_py()) for x in b.column(1)], kind)], ["key", "items"])

    return pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{html}`").alias("html")).mapInArrow(run, f"key long, items {SEQUENCE}")


def resolve(sequences: DataFrame, store: DataFrame) -> DataFrame:
    """Joins each media item with its payload's columns by digest: key, position, kind, text, digest, and those of the store.

    Items are exploded with their positions, so order and captions survive the shuffle. Items without a
    digest go past the join; a digest that very many share is split by the engine's skew handling.
    """
    x = sequences.select("key", F.explode("items").alias("i")).select("key", "i.*")
    media = x.where("digest is not null").join(store, "digest", "left")
    return media.unionByName(x.where("digest is null"), allowMissingColumns=True)


def encode(payload: bytes) -> bytes:
    """The payload, padded with 255 to a positive multiple of a tile, as a PGM image."""
    n = max(1, -(-len(payload) // UNIT))
    return b"P5\n%d %d\n255\n" % (SIDE, n * SIDE) + payload + b"\xff" * (n * UNIT - len(payload))


def decode(image: bytes) -> np.ndarray:
    """The samples of a PGM image."""
    magic, size, top, data = image.split(b"\n", 3)
    w, h = map(int, size.split())
    if magic != b"P5" or top != b"255" or len(data) != w * h:
        raise ValueError("not such an image")
    return np.frombuffer(data, np.uint8).reshape(h, w)


def features(samples: np.ndarray) -> str:
    """Mean and deviation of the samples, the entropy of their histogram, and an average hash of the 8 x 8 means of all tiles."""
    count = np.bincount(samples.ravel(), minlength=256)
    p = count[count > 0] / samples.size
    value = np.arange(256)
    mean = float((count * value).sum() / samples.size)
    spread = float(np.sqrt(max(0.0, (count * value * value).sum() / samples.size - mean * mean)))
    grid = samples.reshape(-1, 8, SIDE // 8, 8, SIDE // 8).mean(axis=(0, 2, 4), dtype=np.float64)
    bits = "".join("1" if x > grid.mean() else "0" for x in grid.ravel())
    return f"mean={mean:.4f};std={spread:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};ahash={int(bits, 2):016x}"


def store(texts: DataFrame, text: str) -> DataFrame:
    """The media store: digest (of the text), n_bytes, media. Within a run of rows each digest is stored once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            seen = {}
            for x in b.column(0):
                raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
                seen.setdefault(sha256(raw).hexdigest(), raw)
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(map(len, seen.values()), pa.int64()), pa.array(map(encode, seen.values()), pa.binary())], ["digest", "n_bytes", "media"])

    return texts.select(F.col(f"`{text}`")).mapInArrow(run, "digest string, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Reads stored media back: digest, n_bytes and what follows from the stored bytes, a row for each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for x in b.column(2):
                image = x.as_py()
                samples = decode(image)
                payload = samples.tobytes()
                rows.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:][-32:]), len(image), sha256(image).hexdigest(), features(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names)

    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    shape = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, shape).dropDuplicates(["digest"])


def op3(spark, sf_dir: str) -> DataFrame:
    """Query op3_media_columns: each document is a page with one figure, whose payload is the document's text."""
    docs = table(spark, sf_dir, "documents")
    known = scratch(describe(scratch(store(docs, "text"), "media")), "features")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    page = F.concat(F.lit("<article><h1>"), F.col("doc_id").cast("string"), F.lit('</h1><figure><img src="sha256:'), digest, F.lit('" alt="text"><figcaption>'), F.col("doc_id").cast("string"), F.lit("</figcaption></figure></article>"))
    items = interleave(docs.select("doc_id", page.alias("html")), "doc_id", "html")
    x = resolve(items, known).where("kind = 'media'")
    return x.select(F.col("key").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")
