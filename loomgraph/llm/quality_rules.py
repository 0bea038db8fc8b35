"""Quality rules as a bitmask ledger (native).

Every rule is evaluated once for each row. The ledger stores one failure bit for each rule and the
measurements behind them. A policy is a named, versioned set of rules (a mask); applying it, comparing
versions and computing ablations only read the bits.

Defined results: a null or empty text has no words, all measurements are 0, and it fails `few_words`.
Repeated rows are judged each for itself. Empty tables give empty results. The row's own columns stay; the
ledger's column names are made unlike them where needed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE_CHARS, fresh, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rule name -> SQL over the measurements that is true where a text fails. The position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 4 * n_lines",
    "word_length": "n_words > 0 and (2 * word_chars < 5 * n_words or word_chars > 14 * n_words)",
    "shouting": "10 * n_upper > 3 * word_chars",
}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeats"))
STRICT = Policy("strict", 1, tuple(RULES))


def ledger(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str, str]:
    """Adds two columns, a long of failure bits and a struct of measurements; returns the frame and their names.

    Words repeated in five-word windows: each window becomes a 64-bit hash. Where all hashes of a text
    differ, none repeats; else the hashes are sorted with their positions, neighbours of equal hash are the
    repeated windows, and the words that they cover are counted once each.
    """
    t, w, h, s, d, m, bits = fresh(docs, "_t", "_w", "_h", "_s", "_d", "measures", "fail_bits")
    keep = [F.col(f"`{c}`") for c in docs.columns]
    x = docs.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t))
    x = x.select("*", words(F.col(t)).alias(w))
    five = ", ".join(f"{w}[i + {k}]" for k in range(5))
    x = x.select("*", F.expr(f"if(size({w}) < 6, cast(array() as array<bigint>), transform(sequence(0, size({w}) - 5), i -> xxhash64({five})))").alias(h))
    x = x.select(
        "*",
        F.expr(
            f"if(size(array_distinct({h})) = size({h}), cast(array() as array<struct<v:bigint,p:int>>), array_sort(transform({h}, (v, p) -> struct(v as v, p as p))))"
        ).alias(s),
    )
    x = x.select(
        "*",
        F.expr(
            f"if(size({s}) = 0, cast(array() as array<int>), array_sort(transform(filter(sequence(0, size({s}) - 1), "
            f"k -> (k > 0 and {s}[greatest(k - 1, 0)].v = {s}[k].v) or (k < size({s}) - 1 and {s}[least(k + 1, size({s}) - 1)].v = {s}[k].v)), k -> {s}[k].p)))"
        ).alias(d),
    )
    lines = F.filter(F.split(F.col(t), "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    n_chars = F.length(t)
    without = lambda chars: n_chars - F.length(F.translate(F.col(t), chars, ""))
    repeated = F.expr(
        f"if(size({d}) = 0, 0L, aggregate(sequence(0, size({d}) - 1), 0L, (a, k) -> a + if(k = size({d}) - 1, 5, least(5, {d}[least(k + 1, size({d}) - 1)] - {d}[k]))))"
    )
    x = x.select("*", lines.alias(ln := fresh(x, "_l")[0]))
    x = x.select(
        *keep,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            (n_chars - without(SPACE_CHARS)).cast("long").alias("word_chars"),
            without(SYMBOLS).cast("long").alias("n_symbols"),
            F.size(ln).cast("long").alias("n_lines"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            without(UPPER).cast("long").alias("n_upper"),
        ).alias(m),
    )
    # spark_partition_id() keeps the optimizer from pushing a later filter on the bits below this
    # projection, which would evaluate every rule again inside the filter's lambdas
    return x.select("*", F.when(F.spark_partition_id() >= 0, failures(m)).alias(bits)), bits, m


def failures(measures: str) -> Column:
    """One bit for each rule, evaluated over the measurement struct."""
    out = F.lit(0).cast("long")
    for i, sql in enumerate(RULES.values()):
        sql = re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"{measures}.\1", sql)
        out = out.bitwiseOR(F.when(F.expr(sql), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out


def passes(bits: str, policy: Policy) -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def keep(docs: DataFrame, policy: Policy = STRICT, text: str = "text") -> DataFrame:
    """The rows that the policy accepts, with their own columns."""
    led, bits, _ = ledger(docs, text)
    return led.where(passes(bits, policy)).select(*[F.col(f"`{c}`") for c in docs.columns])


def ablations(led: DataFrame, bits: str, policy: Policy) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that only it rejects, rows kept without it.

    The ledger is first counted by its bits (2 ** rules groups at most), then read bitwise.
    """
    by = led.groupBy(F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in policy.rules])
    x = by.select("b", "n", F.explode(rules).alias("r"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return x.groupBy(F.col("r.rule").alias("rule")).agg(
        count(F.col("b").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        count(F.col("b") == F.col("r.bit")).alias("n_only"),
        count((F.col("b") == 0) | (F.col("b") == F.col("r.bit"))).alias("n_kept_without"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    """Query op7_quality_rules: the ledger of `documents`, judged by the base and the strict policy."""
    from loomgraph.llm.common import table

    led, bits, m = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return led.select(
        "doc_id",
        *[F.col(f"{m}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~passes(bits, BASE)).alias("base_failed"),
        passes(bits, STRICT).alias("kept"),
        F.col(bits).alias("fail_bits"),
    )


def ablation_report(spark, sf_dir: str) -> DataFrame:
    """Query quality_ablations: for each policy and rule over `documents`, what the rule rejects, alone rejects, and what is kept without it."""
    from loomgraph.llm.common import scratch, table

    led, bits, _ = ledger(table(spark, sf_dir, "documents").select("text"))
    # the rules are evaluated once; both policies read the bits
    led = scratch(led.select(F.col(bits).alias("bits")), "bits")
    of = lambda p: ablations(led, "bits", p).select(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), "*")
    return of(BASE).unionByName(of(STRICT))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
  row_number() OVER () AS r FROM documents),
g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
k AS (SELECT r, CAST(sum(least(5, coalesce(nx - i, 5))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM d) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words,
  CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper FROM w LEFT JOIN k USING (r)),
b AS (SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
  + 8 * (10 * n_dup_lines > 4 * n_lines)::INT + 16 * (n_words > 0 AND (2 * word_chars < 5 * n_words OR word_chars > 14 * n_words))::INT
  + 32 * (10 * n_upper > 3 * word_chars)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

#: Of the query quality_ablations, over op7's bits.
ABLATIONS_SQL = f"""WITH q AS ({OP7_SQL}), p AS (SELECT * FROM (VALUES ('base', 3), ('strict', 63)) AS v(policy, mask)),
r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeats', 2), ('symbols', 4), ('dup_lines', 8), ('word_length', 16), ('shouting', 32)) AS v(rule, bit))
SELECT policy, 1 AS version, rule, CAST(count_if(fail_bits & mask & bit <> 0) AS BIGINT) AS n_failed, CAST(count_if(fail_bits & mask = bit) AS BIGINT) AS n_only,
CAST(count_if(fail_bits & mask = 0 OR fail_bits & mask = bit) AS BIGINT) AS n_kept_without FROM q, p, r WHERE mask & bit <> 0 GROUP BY policy, rule"""
