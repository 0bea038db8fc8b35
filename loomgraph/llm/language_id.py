"""Language identification by bit-sliced Bloom filters over byte n-grams.

Each slot of the filter holds one bit for each language; an n-gram sets its language's bit in `probes`
slots, and the bitwise and of an n-gram's slots is the set of all languages that contain it. A text's n-grams
vote by population counts for each language, from which the share that false positives alone would give (the
filter's fill to the power of probes) is taken out; the language with the highest corrected share decides.

A slot is one number of 8 to 64 bits; beyond 64 languages it has several.

Learned are the n-grams whose share of a language's n-grams is at least `least_share`, so a language has at
most 1 / least_share of them and the filter's size is fixed. Counts cover all training texts.

Defined results: null texts and texts without a letter are `und` with score 0; so is every text if nothing
could be learned. Ties go to the first language in order. Repeated rows get equal results; a null key stays null. Texts of
any length are read whole, empty tables give empty results, extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import slices, table

GRAM = 4
SLOTS = 1 << 20
PROBES = 3
LEAST_SHARE = 2e-5


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The byte n-grams of texts in lower case, a space before and after, and the number for each text."""
    raw = [f" {t.lower()} ".encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw) + b"\0" * GRAM, np.uint8).astype(np.uint32)
    flat[(flat >= 9) & (flat <= 13)] = 32
    n = int(size.sum())
    code = flat[:n].copy()
    for k in range(1, GRAM):
        code |= flat[k : n + k] << np.uint32(8 * k)
    # those that would run into the next text go
    ends = np.cumsum(size)
    ok = np.ones(n, bool)
    for k in range(1, GRAM):
        at = ends - k
        ok[at[(at >= 0) & (size >= k)]] = False
    return code[ok], np.maximum(size - (GRAM - 1), 0)


def slots(code: np.ndarray, probe: int) -> np.ndarray:
    """Multiplicative hashing, another odd multiplier for each probe."""
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 * 2 * probe & (1 << 64) - 1)) >> np.uint64(64 - 20)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs: text, lang. Returns lang, g, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merge(parts):
            g = np.concatenate([p[0] for p in parts])
            order = np.argsort(g, kind="stable")
            g, n = g[order], np.concatenate([p[1] for p in parts])[order]
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            return g[first], np.add.reduceat(n, first)

        for b in slices(batches, 4 << 20):
            langs = np.array(b.column(1).to_pylist(), dtype=object)
            texts = b.column(0).to_pylist()
            for lang in sorted(set(langs)):
                code, _ = grams([texts[i] for i in np.flatnonzero(langs == lang)])
                if code.size:
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(code, return_counts=True))
                    if len(parts) > 8:
                        held[lang] = [merge(parts)]
        for lang, parts in held.items():
            g, n = merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "g", "n"])

    part = docs.select("text", "lang").mapInArrow(run, "lang string, g long, n long")
    return part.groupBy("lang", "g").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, least_share: float = LEAST_SHARE) -> tuple[list[str], np.ndarray]:
    """docs: text, lang (rows without a language are left out). Returns the languages and the filter."""
    from loomgraph.llm.common import scratch

    counts = scratch(gram_counts(docs.where("lang is not null and text is not null")), "grams")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = counts.join(total, "lang").where(F.col("n") >= F.col("total") * least_share).select("lang", "g").toPandas()
    langs = sorted(rows["lang"].unique())
    kind = next(k for n, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (1 << 30, np.uint64)) if len(langs) <= n)
    table_ = np.zeros((max(1, -(-len(langs) // 64)), SLOTS), kind)
    for i, lang in enumerate(langs):
        g = rows.loc[rows["lang"] == lang, "g"].to_numpy(np.int64).astype(np.uint32)
        for p in range(PROBES):
            table_[i // 64, slots(g, p)] |= kind(1 << i % 64)
    return langs, table_


def predict(docs: DataFrame, langs: list[str], filter_: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns key, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)  # at most 8 MB for each 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = shared.value
        kind = slot.dtype.type
        bit = lambda x, i: (x[i // 64] >> kind(i % 64)) & kind(1)
        noise = np.array([np.mean(bit(slot, i)) ** PROBES for i in range(len(langs))])
        for b in slices(batches, 4 << 20):
            texts, letters = b.column(1).to_pylist(), b.column(2).to_pylist()
            code, size = grams(texts)
            found = slot[:, slots(code, 0)]
            for p in range(1, PROBES):
                found &= slot[:, slots(code, p)]
            ends = np.cumsum(size)
            share = np.zeros((len(texts), len(langs)))
            for i in range(len(langs)):
                total = np.concatenate([[0], np.cumsum(bit(found, i), dtype=np.int64)])
                hits = total[ends] - total[ends - size]
                share[:, i] = np.clip((hits / np.maximum(size, 1) - noise[i]) / max(1e-9, 1 - noise[i]), 0, 1)
            best = share.argmax(axis=1) if langs else np.zeros(len(texts), int)
            known = [bool(x) and bool(langs) for x in letters]
            pred = [langs[i] if k else "und" for i, k in zip(best, known, strict=True)]
            sums = share.sum(axis=1)
            got = [float(share[r, i] / sums[r]) if k and sums[r] > 0 else 0.0 for r, (i, k) in enumerate(zip(best, known, strict=True))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(got, pa.float64())], ["key", "lang_pred", "score"])

    own = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return own.mapInArrow(run, "key long, lang_pred string, score double")


def op4(spark, sf_dir: str) -> DataFrame:
    """Query op4_language_id."""
    held = lambda c: F.crc32(F.col(c).cast("string")) % 4 == 2
    docs = table(spark, sf_dir, "documents")
    langs, filter_ = fit(docs.where(~held("doc_id")).select("text", "lang"))
    x = predict(docs, langs, filter_)
    return x.select(F.col("key").alias("doc_id"), held("key").alias("held_out"), "lang_pred", "score")
