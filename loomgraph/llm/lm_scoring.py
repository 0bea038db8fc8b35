"""Language-model scoring by subword lattice likelihood.

The vocabulary's pieces and their existing scores define arcs over each word; every segmentation of a word
into pieces (bytes where no piece fits) is weighted, and a forward recursion in log space sums them all. No
piece crosses a word's start, so a text's marginal probability is the product of its words' marginals and
that of one end.

The file's scores are ranks, not logarithms of probabilities; they give the first weights (one over the
rank) and one expectation step over the training words turns these into relative frequencies: the expected
number of times that each piece is used, over all segmentations of all distinct training words. A word that
was seen in training has one arc more, over its whole length, weighted by its relative frequency; the share
of words seen once sets how much weight the pieces keep. The vocabulary itself is never changed.

Training texts may belong to groups (languages, say). Then each group has its own word frequencies and its
own frequencies of pieces, and a text's probability is the sum over groups of the group's share times the
text's probability in it: a text's own group is never read when it is scored. The weight that a group keeps
for words that it hasn't seen is parted between those that other groups have seen and those that none has, as
among the group's words seen once. The former part goes to all training words, nine tenths by their frequency
in all groups and one by the pieces of all groups, the latter to all other words by the group's pieces; so
all words' weights sum to one at most.

Counts cover all training texts and are shuffled by word. The words of highest count (at most `head_words`, a
few MB) are broadcast; all other words reach their texts by a join.

Defined results: null and empty texts score one end. Repeated rows get equal results. With no training text
every word is unseen. A null group is a group of its own; beyond `most_groups` groups, the smaller ones are
taken together. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import scratch, slices, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"


def arcs(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> first weight (natural logarithm) from the vocabulary's own scores; bytes as <0x..>; </s> is the end."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {}
    for i in range(m.get_piece_size()):
        piece, score = m.id_to_piece(i), m.get_score(i)
        if m.is_byte(i) or piece == "</s>":
            out[piece] = -math.log(m.get_piece_size())
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) and score > -1e8:
            out[piece] = -math.log(2.0 - score)
    total = math.log(sum(map(math.exp, out.values())))
    return {k: v - total for k, v in out.items()}


def trie(weights: dict[str, float]) -> dict:
    """Nested dicts by character; the value under None is (piece, weight, its exponential)."""
    root: dict = {}
    for piece, w in weights.items():
        if not (piece.startswith("<0x") or piece == "</s>"):
            node = root
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = (piece, w, math.exp(w))
    return root


def plus(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


class Lattice:
    def __init__(self, weights: dict[str, float]):
        self.root, self.byte = trie(weights), [weights[f"<0x{b:02X}>"] for b in range(256)]
        self.chars: dict[str, tuple] = {}

    def char(self, c: str) -> tuple[tuple[str, ...], float, float]:
        """A character's bytes as pieces, their weight and its exponential."""
        if (got := self.chars.get(c)) is None:
            raw = c.encode("utf-8", "surrogateescape")
            w = sum(self.byte[b] for b in raw)
            got = self.chars[c] = tuple(f"<0x{b:02X}>" for b in raw), w, math.exp(w)
        return got

    def forward(self, word: bytes, keep: bool = False):
        """log of the sum over all segmentations; with keep also the table and the arcs (start, end, piece, weight)."""
        text = START + word.decode("utf-8", "surrogateescape")
        n, none = len(text), -math.inf
        alpha, used = [none] * (n + 1), []
        alpha[0] = 0.0
        for i, c in enumerate(text):
            a = alpha[i]
            node = self.root.get(c)
            # any character can be spelled by its bytes
            raw, w, _ = self.char(c)
            x = a + w
            alpha[i + 1] = x if alpha[i + 1] == none else plus(alpha[i + 1], x)
            if keep:
                used.append((i, i + 1, raw, w))
            j = i
            while node is not None:
                j += 1
                if (hit := node.get(None)) is not None:
                    x = a + hit[1]
                    y = alpha[j]
                    alpha[j] = x if y == none else plus(y, x)
                    if keep:
                        used.append((i, j, hit[0], hit[1]))
                if j == n:
                    break
                node = node.get(text[j])
        return (alpha, used) if keep else alpha[n]

    def expect(self, word: bytes, *counts: Counter) -> None:
        """Adds the expected uses of each piece over all segmentations of the word.

        Words of up to 32 characters are far from where products of weights underflow and are summed
        directly, longer ones in log space.
        """
        n = len(START) + len(word.decode("utf-8", "surrogateescape"))
        for piece, p in self.uses(word) if n <= 32 else self.uses_log(word):
            for c in counts:
                if isinstance(piece, tuple):
                    for b in piece:
                        c[b] = c.get(b, 0.0) + p
                else:
                    c[piece] = c.get(piece, 0.0) + p

    def uses(self, word: bytes) -> Iterator[tuple]:
        text = START + word.decode("utf-8", "surrogateescape")
        n, used = len(text), []
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        alpha[0] = beta[n] = 1.0
        for i, c in enumerate(text):
            a = alpha[i]
            raw, _, w = self.char(c)
            alpha[i + 1] += a * w
            used.append((i, i + 1, raw, w))
            node, j = self.root.get(c), i
            while node is not None:
                j += 1
                if (hit := node.get(None)) is not None:
                    alpha[j] += a * hit[2]
                    used.append((i, j, hit[0], hit[2]))
                if j == n:
                    break
                node = node.get(text[j])
        total = alpha[n]
        for i, j, piece, w in reversed(used):
            x = w * beta[j]
            beta[i] += x
            yield piece, alpha[i] * x / total

    def uses_log(self, word: bytes) -> Iterator[tuple]:
        alpha, used = self.forward(word, True)
        n, none = len(alpha) - 1, -math.inf
        beta = [none] * (n + 1)
        beta[n] = 0.0
        for i, j, piece, w in reversed(used):
            x = w + beta[j]
            beta[i] = x if beta[i] == none else plus(beta[i], x)
            yield piece, math.exp(alpha[i] + x - alpha[n])


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, groups: int) -> DataFrame:
    """docs: text, g (group's number of a training text, -1 for others). Returns w (binary), c0, c1, ... (in each group), c (in training texts), n (in all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for g, x in c.items():
                yield pa.RecordBatch.from_arrays([pa.array(x.keys(), pa.binary()), pa.array([g] * len(x), pa.int32()), pa.array(x.values(), pa.int64())], ["w", "g", "n"])
            c.clear()

        c: dict[int, Counter] = {}
        for b in slices(batches):
            for t, g in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                c.setdefault(g, Counter()).update(tokens(t.as_py()))
            if sum(map(len, c.values())) > 300_000:
                yield from out()
        yield from out()

    part = docs.select("text", "g").mapInArrow(run, "w binary, g int, n long")
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return part.groupBy("w").agg(*[of(F.col("g") == k).alias(f"c{k}") for k in range(groups)], of(F.col("g") >= 0).alias("c"), F.sum("n").alias("n"))


def fit(words: DataFrame, first: dict[str, float], groups: int = 1) -> list[dict[str, float]]:
    """One expectation step over the distinct training words: weights for each group's words, and last for all groups'.

    Each has an entry for each piece of the vocabulary.
    """
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(first)  # the vocabulary's size bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, counts = Lattice(shared.value), [Counter() for _ in range(groups)]
        for b in batches:
            has = np.array([b.column(1 + k).to_numpy() > 0 for k in range(groups)]).T
            for w, of in zip(b.column(0).to_pylist(), has, strict=True):
                lattice.expect(w, *[counts[k] for k in np.flatnonzero(of)])
        for k, c in enumerate(counts):
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(c), pa.int32()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.float64())], ["g", "piece", "x"])

    part = words.where("c > 0").select("w", *[f"c{k}" for k in range(groups)]).mapInArrow(run, "g int, piece string, x double")
    got: list[dict[str, float]] = [{} for _ in range(groups)]
    for r in part.groupBy("g", "piece").agg(F.sum("x").alias("x")).collect():  # groups times the vocabulary's size at most
        got[r.g][r.piece] = r.x
    got.append({p: sum(x.get(p, 0.0) for x in got) for p in first})
    out = []
    for x in got:
        x = {p: x.get(p, 0.0) + 0.01 for p in first if p != "</s>"}
        total = math.log(sum(x.values()))
        out.append({p: math.log(v) - total for p, v in x.items()})
    return out


def score(docs: DataFrame, train: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, head_words: int = 200_000, group: str | None = None, most_groups: int = 16) -> DataFrame:
    """train: name of a boolean column; group: of a column that groups the training texts. Returns key, train, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    kind = F.col(f"`{group}`").cast("string") if group else F.lit("")
    own = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{train}`"), F.lit(False)).alias("train"), kind.alias("kind"))
    kinds = own.where("train").groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("kind").isNull(), "kind")
    named = [r.kind for r in kinds.limit(most_groups - 1).collect()]
    # what isn't among the named is the last group
    number = F.lit(len(named))
    for k, x in enumerate(named):
        number = F.when(F.col("kind").eqNullSafe(F.lit(x)), k).otherwise(number)
    own = own.withColumn("g", F.when(F.col("train"), number).otherwise(-1).cast("int"))
    texts_of = {r.g: r.n for r in own.where("train").groupBy("g").agg(F.count("*").alias("n")).collect()}  # most_groups rows at most
    groups, ends = max(1, len(texts_of)), sum(texts_of.values())
    cs, lps = [f"c{k}" for k in range(groups)], [f"lp{k}" for k in range(groups)]
    words = scratch(word_counts(own, groups), "words")
    zero, once = F.lit(0).cast("long"), lambda c: F.count_if(F.col(c) == 1)
    t = words.where("c > 0").agg(F.count("*"), *[F.coalesce(F.sum(c), zero) for c in cs], *[once(c) for c in cs], *[F.count_if((F.col(c) == 1) & (F.col("c") > 1)) for c in cs]).first()
    total, v = t[1 : 1 + groups], t[0] + (ends > 0)
    n = sum(total) + ends
    scale = math.log10(n + 0.1 * (v + 1))
    # Good and Turing: the share of words seen once is that of words not seen
    spare = [(h + 1) / (x + 2) for x, h in zip(total, t[1 + groups : 1 + 2 * groups], strict=True)]
    elsewhere = [(o + 1) / (h + 2) for h, o in zip(t[1 + groups : 1 + 2 * groups], t[1 + 2 * groups :], strict=True)]
    p_end = (ends + 0.5) / (n + 1)
    pieces = spark.sparkContext.broadcast(fit(words, arcs(vocabulary), groups))

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, every, floor = [Lattice(x) for x in pieces.value], max(1, sum(total)), 1e-300
        for b in batches:
            w, c = b.column(0).to_pylist(), b.column(1 + groups).to_numpy()
            new = np.flatnonzero(c == 0)
            low = np.zeros(len(w))
            for i in np.flatnonzero(c > 0):
                low[i] = lattices[-1].forward(w[i])
            # of words seen in training
            low = np.logaddexp(low + math.log(0.1), np.log(np.maximum(c * (0.9 / every), floor)))
            out = []
            for k in range(groups):
                rest = low + math.log(elsewhere[k])
                rest[new] = [lattices[k].forward(w[i]) + math.log1p(-elsewhere[k]) for i in new]
                seen = np.log(np.maximum(b.column(1 + k).to_numpy() / max(1, total[k]), floor))
                out.append(pa.array(np.where(c > 0, np.logaddexp(rest + math.log(spare[k]), seen + math.log1p(-spare[k])), rest + math.log(spare[k])) / math.log(10)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1 + groups), b.column(2 + groups), *out], ["w", "c", "n", *lps])

    scored = scratch(words.select("w", *cs, "c", "n").mapInArrow(marginals, ", ".join(["w binary", "c long", "n long", *(f"{x} double" for x in lps)])), "scored")
    # words by the size of their count, in sixteenths of a power of two (1,024 sizes at most): whole sizes from the top, as far as they fit
    step, left, least = F.floor(F.log2("n") * 16), head_words, 1 << 20
    for r in sorted(scored.groupBy(step.alias("b")).agg(F.count("*").alias("m")).collect(), reverse=True):
        left -= r.m
        if left < 0:
            break
        least = r.b
    top = scored.where(step >= least).select("w", "c", *lps).toPandas()  # head_words rows at most
    head = spark.sparkContext.broadcast((list(top["w"].map(bytes)), top["c"].to_numpy(np.int64), top[lps].to_numpy(float)))
    log_end, log_no_end = math.log10(p_end), math.log10(1 - p_end)
    base_end = math.log10(ends + 0.1) - scale

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, lp = head.value
        place = {w: i for i, w in enumerate(names)}.get
        base = np.append(np.log10(c + 0.1), 0.0)
        known = np.append(c > 0, False)
        lp = np.vstack([lp, np.zeros((1, groups))])
        miss = len(names)
        for b in slices(batches):
            n, k, bs, sc, tail = [], [], [], [], []
            for x in b.column(1):
                w = tokens(x.as_py())
                i = np.fromiter((place(y, miss) for y in w), np.int64, len(w))
                gone = np.flatnonzero(i == miss)
                n.append(len(w))
                k.append(int(known[i].sum()))
                bs.append(float(base[i].sum()))
                sc.append(lp[i].sum(axis=0))
                tail.append([w[j] for j in gone])
            sums = np.array(sc).reshape(len(n), groups).T
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(bs, pa.float64()), *map(pa.array, sums), pa.array(tail, pa.list_(pa.binary()))],
                ["key", "train", "n", "k", "bs", *lps, "tail"],
            )

    # the texts' sums over head words and their other words, written once for the two uses below
    parts = own.select("key", "text", "train").mapInArrow(texts, ", ".join(["key long, train boolean, n long, k long, bs double", *(f"{x} double" for x in lps), "tail array<binary>"]))
    parts = scratch(parts.withColumn("row", F.monotonically_increasing_id()), "texts")
    tail = parts.select("row", F.explode("tail").alias("w")).groupBy("row", "w").agg(F.count("*").alias("m"))
    tail = tail.join(scored.select("w", "c", *lps), "w").groupBy("row").agg(
        F.sum(F.col("m") * (F.col("c") > 0).cast("long")).alias("k2"), F.sum(F.col("m") * F.log10(F.col("c") + F.lit(0.1))).alias("bs2"), *[F.sum(F.col("m") * F.col(x)).alias(f"t_{x}") for x in lps]
    )
    x = parts.drop("tail").join(tail, "row", "left")
    zero = F.lit(0.0)
    share = [math.log10((texts_of.get(k, 0) + 0.5) / (ends + 0.5 * groups)) for k in range(groups)]
    each = F.array(*[F.col(y) + F.coalesce(f"t_{y}", zero) + F.lit(share[k]) for k, y in enumerate(lps)])
    x = x.withColumn("each", each).withColumn("most", F.array_max("each"))
    marginal = F.col("most") + F.log10(F.aggregate("each", zero, lambda a, y: a + F.pow(F.lit(10.0), y - F.col("most"))))
    return x.select(
        "key",
        "train",
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("k") + F.coalesce("k2", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("bs") + F.coalesce("bs2", zero) - F.col("n") * F.lit(scale) + F.lit(base_end)).alias("base_score"),
        (marginal + F.col("n") * F.lit(log_no_end) + F.lit(log_end)).alias("score"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    """Query op2_lm_scoring."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 10 != 0).alias("train"))
    x = score(docs, "train", group="lang")
    return x.select(F.col("key").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
