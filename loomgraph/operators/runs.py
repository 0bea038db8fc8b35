"""Whole runs: sample pages to chunk notebooks, facts of chunks, triples of statements, training examples.

A run takes what an earlier one left, does what has changed and returns the new state and counters, which come with
the write of that state. Models are functions of a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions.cid import cid
from loomgraph.functions.render import rdf_cell
from loomgraph.operators import chunks as C
from loomgraph.operators import graph as G
from loomgraph.operators import notebooks as B
from loomgraph.session import shared_folder
from loomgraph.sources import artefacts as A
from loomgraph.sources import readers

ERROR = "# Error:"
#: How many statements make an example.
FEWEST, MOST = 2, 50


def slug(title: Column) -> Column:
    return F.translate(F.lower(title), " /", "__")


def sample_run(listed: DataFrame, articles: DataFrame, folder: str, saved: DataFrame | None = None, most: int = 1500, least: int = 60, index: str | None = None) -> DataFrame:
    """Chunks of the listed pages: title, chunk_num (from 0), section_context, text, saved.

    listed: id, title; articles: as notebooks.source_notebook() takes them, by title; saved: cells of the notebooks that
    are in the folder (path, cell_idx, cell_type, source), None where there are none. Pages whose notebook is there
    are read from it; the others are cut into chunks of up to `most` characters, those under `least` left out, and a
    notebook for each page that has chunks is written, all or none. Pages without an article or chunks are passed over.
    index: a folder that lists the notebooks. Pages are cut once: chunks are written down before they are used.
    """
    page = listed.select("id", "title", slug(F.col("title")).alias("slug"))
    rest = page
    out = None
    if saved is not None:
        known = saved.withColumn("slug", F.url_decode(F.regexp_extract("path", r"([^/]*)_chunks\.ipynb$", 1)))
        found = readers.chunk_cells(known, ["slug"]).join(page, "slug").select("title", "chunk_num", "section_context", "text", F.lit(True).alias("saved"))
        rest, out = page.join(known.select("slug").distinct(), "slug", "left_anti"), found
    todo = rest.join(articles, "title")
    cut = C.chunk_articles(todo, "id", "title", "content", most, least)
    cut = cut.join(rest, F.col("key") == F.col("id")).select("title", F.col("chunk_num").alias("chunk_index"), F.col("section_context").alias("breadcrumb"), F.col("text").alias("content"))
    path = shared_folder(listed.sparkSession, "cut")
    cut.write.parquet(path)
    cut = listed.sparkSession.read.parquet(path)
    with_chunks = todo.join(cut.select("title").distinct(), "title", "left_semi")
    cells = B.chunks_notebook(with_chunks, cut, ["title"], most, 0)
    B.write_files(cells, ["title"], folder, F.concat(slug(F.col("title")), F.lit("_chunks")), index)
    new = cut.select("title", F.col("chunk_index").alias("chunk_num"), F.col("breadcrumb").alias("section_context"), F.col("content").alias("text"), F.lit(False).alias("saved"))
    return new if out is None else out.unionByName(new)


def facts_run(chunks: DataFrame, old: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, keys: list[str]) -> dict[str, int]:
    """Facts of each chunk. chunks: keys, text; old: keys, from_cid, content, of the run before; the new state goes to path.

    Unchanged chunks keep their cell, make(rows) answers the others (keys, content). Returns processed, skipped, errors
    (answers that begin with # Error:) and total, of the chunks at hand.
    """
    now = chunks.withColumn("cid", cid(F.col("text")))
    cells, status = B.upsert_cells(old, now, keys, make)
    state = cells.join(status, keys, "left").withColumn("status", F.coalesce("status", F.lit("gone")))
    failed = (F.col("status") != "skip") & F.col("content").startswith(ERROR) & (F.col("status") != "gone")
    return A.save_counted(
        state, path,
        {"processed": F.count_if(F.col("status").isin("generate", "regenerate") & ~failed), "skipped": F.count_if(F.col("status") == "skip"), "errors": F.count_if(failed), "total": F.count_if(F.col("status") != "gone")},
    )


def statements_of(facts: DataFrame, chunk: str = "chunk", text: str = "facts") -> DataFrame:
    """chunk, stmt_idx (from 1), stmt_key, statement, cid of the statements in facts; cells that hold an error have none."""
    x = facts.where(~F.coalesce(F.col(text), F.lit("")).startswith(ERROR)).select(F.col(chunk).alias("chunk"), F.posexplode(T.statements_v1(F.coalesce(text, F.lit("")))).alias("i", "statement"))
    n = (F.col("i") + 1).cast("string")
    return x.select("chunk", (F.col("i") + 1).alias("stmt_idx"), F.concat_ws("_", F.col("chunk").cast("string"), n).alias("stmt_key"), "statement", cid(F.col("statement")).alias("cid"))


def rdf_run(facts: DataFrame, old: DataFrame, make: Callable[[DataFrame], DataFrame], path: str) -> dict[str, int]:
    """Triples of the statements in facts (chunk, facts). old: chunk, stmt_key, from_cid, content; the new state goes to path.

    A chunk of whose statements one has changed or is new is redone whole: make(statements) gives chunk, stmt_key, ord, s,
    p, o, which are deduplicated and become a cell for each statement; a statement without triples gets a note.
    Returns processed and skipped (statements), errors (chunks of facts that hold one), without (statements for which
    nothing was made) and triples. Statements are taken from the facts once: they are written down before they are used.
    """
    given = shared_folder(facts.sparkSession, "statements")
    statements_of(facts).write.parquet(given)
    statements = facts.sparkSession.read.parquet(given)

    def cells(todo: DataFrame) -> DataFrame:
        keyed = todo.select("chunk", "stmt_key", "statement", F.regexp_extract("stmt_key", r"_(\d+)$", 1).cast("int").alias("stmt_idx"))
        made = G.distinct_triples(make(keyed), ["chunk", "stmt_key"])
        n = made.groupBy("chunk", "stmt_key").agg(F.count("*").alias("n_triples"))
        x = keyed.join(G.turtle(made, ["chunk", "stmt_key"], "ord"), ["chunk", "stmt_key"], "left").join(n, ["chunk", "stmt_key"], "left")
        cell = rdf_cell(F.col("chunk"), F.col("stmt_idx"), F.col("statement"), F.col("turtle"))
        return x.select("chunk", "stmt_key", F.concat(cell, F.lit("\n")).alias("content"), "n_triples")

    state, chunks = B.upsert_chunks(old.select("chunk", "stmt_key", "from_cid", "content"), statements, lambda todo: cells(todo).drop("n_triples"))
    state = state.join(chunks.select("chunk", F.col("skip").alias("kept")), "chunk", "left")
    line = F.filter(F.split("content", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    new = F.col("kept").isNotNull() & ~F.col("kept")
    out = A.save_counted(
        state, path,
        {"processed": F.count_if(new), "skipped": F.count_if(F.coalesce("kept", F.lit(False))), "without": F.count_if(new & (F.size(line) == 0)), "triples": F.coalesce(F.sum(F.when(new, F.size(line))), F.lit(0))},
    )
    return out | {"errors": facts.where(F.coalesce("facts", F.lit("")).startswith(ERROR)).count()}


def examples(chunks: DataFrame, facts: DataFrame, by: list[str], order: str, fewest: int = FEWEST, most: int = MOST) -> DataFrame:
    """by, chunk_num, text, section_context, statements: chunks with their facts, by number.

    A number that is null or 0 counts as none. Of several chunks or facts of a number the last by `order` counts, and
    facts of fewer or more statements make no example.
    """
    last = lambda x, *rest: x.where("chunk_num <> 0").groupBy(*by, "chunk_num").agg(F.max_by(F.struct(*rest), order).alias("r")).select(*by, "chunk_num", "r.*")
    x = last(chunks, "text", "section_context").join(last(facts, "statements"), [*by, "chunk_num"])
    return x.where(F.size("statements").between(fewest, most))


def fewshot(rows: DataFrame, key: str, size: str, k: int = 10, used: DataFrame | None = None, fewest: int = FEWEST, most: int = MOST) -> DataFrame:
    """The k rows of the most statements, ties by key, among those of an allowed size that aren't in used (key)."""
    x = rows.where(F.col(size).between(fewest, most))
    x = x if used is None else x.join(used.select(key).distinct(), key, "left_anti")
    return x.orderBy(F.desc(size), key).limit(k)


#: Upper ends and names of the buckets of iteration counts.
BUCKETS = ((5, "1-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100"), (None, "100+"))


def iteration_buckets(counts: DataFrame, n: str = "n") -> DataFrame:
    """bucket, n: how many runs took so many iterations; every bucket is there."""
    name = F.lit(BUCKETS[-1][1])
    for top, of in reversed(BUCKETS[:-1]):
        name = F.when(F.col(n) <= top, of).otherwise(name)
    found = counts.groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))
    names = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(of) for _, of in BUCKETS])).alias("bucket"))
    return names.join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(rows: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """bin, n: equal widths from the least to the greatest value, which falls into the last; of one value only, into the first."""
    m = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.coalesce(F.try_divide((F.col(value) - F.col("lo")) * float(bins), F.col("hi") - F.col("lo")), F.lit(0.0))
    k = rows.where(F.col(value).isNotNull()).join(m, F.lit(True)).select(F.least(F.lit(bins - 1), F.floor(at)).cast("int").alias("bin"))  # one row
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(k.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
