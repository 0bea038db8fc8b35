"""Triples: Turtle text, statement groups, graph patterns and traversal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def turtle(triples: DataFrame, by: list[str], order: str) -> DataFrame:
    """One block for each group: `s p o .` lines in order; groups without triples are not made here."""
    line = F.concat_ws(" ", "s", "p", "o", F.lit("."))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return triples.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("turtle"))


def match(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """A basic graph pattern: terms that begin with ? are variables, patterns that share one are joined on it."""

    def one(pattern: tuple[str, str, str]) -> DataFrame:
        x, bound = triples, {}
        for c, term in zip("spo", pattern, strict=True):
            if term.startswith("?"):
                bound.setdefault(term[1:], []).append(c)
            else:
                x = x.where(F.col(c) == term)
        for cs in bound.values():
            for c in cs[1:]:
                x = x.where(F.col(c) == F.col(cs[0]))
        return x.select(*[F.col(cs[0]).alias(v) for v, cs in bound.items()])

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in b.columns if c in a.columns]
        if not shared:
            raise ValueError("a pattern shares no variable with those before it")
        return a.join(b, shared)

    return reduce(join, map(one, patterns))


def hops(edges: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """edges: u, v; starts: u. Nodes within k steps: root, node, depth (the least)."""
    out = front = starts.select(F.col("u").alias("root"), F.col("u").alias("node"), F.lit(0).alias("depth"))
    for d in range(1, k + 1):
        front = front.join(edges, F.col("node") == F.col("u")).select("root", F.col("v").alias("node"), F.lit(d).alias("depth")).distinct()
        out = out.unionByName(front)
    return out.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def distinct_triples(triples: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """by, s, p, o, the least order of each triple of a group and how many more there were."""
    return triples.groupBy(*by, "s", "p", "o").agg(F.min(order).alias(order), (F.count("*") - 1).alias("n_duplicates"))


def pattern_flags(triples: DataFrame, by: list[str]) -> DataFrame:
    """What a group's triples show: roles, blank nodes, dates, descriptions, comments, quotations, texts."""
    s, p, o = F.coalesce("s", F.lit("")), F.coalesce("p", F.lit("")), F.coalesce("o", F.lit(""))
    flags = {
        "has_role": o.contains("Role"),
        "has_blank_node": s.startswith("_:") | o.startswith("_:"),
        "has_dates": F.lower(p).contains("date"),
        "has_description": p == "schema:description",
        "has_comment": F.lower(p).contains("comment"),
        "has_quotation": o.contains("Quotation"),
        "has_text": p.contains("schema:text"),
    }
    return triples.groupBy(*by).agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
