import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import chunks as C
from loomgraph.operators import graph as G
from loomgraph.operators import relational as R
from loomgraph.operators import turtle as U
from loomgraph.sources import readers


def one(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr(F.col("x"))).collect()]


def test_chunks_cases():
    text = "Intro text that is long enough.\n== Section 1 ==\nBody text that is also long enough."
    got = C.chunk_text("Albert Einstein", text, 1500, 20)
    assert [c for _, c in got] == ["Albert Einstein", "Albert Einstein > Section 1"]
    assert C.chunk_text("T", "") == C.chunk_text("T", None) == []
    assert all(len(t) <= 1000 for t, _ in C.chunk_text("T", "x" * 5000, 1000, 10))
    assert C.chunk_text("T", " " * 3000 + "some text" + " " * 3000, 100, 5) == [("some text", "T")]
    parts = C.chunk_text("T", "A sentence here. Another one here. A third is here.", 30, 5)
    assert parts[1][0].startswith(". ")


def test_recursive_splitter():
    got = C.split_recursive("aaa bbb ccc ddd\n\neee fff", 8, 4)
    assert got == ["aaa bbb", "bbb ccc", "ccc ddd", "eee fff"]
    assert "".join(C.split_recursive("x" * 25, 10, 0)) == "x" * 25


def test_statements(spark):
    want = ["Statement one", "Statement two"]
    for t in ("- Statement one\n- Statement two", "* Statement one\n* Statement two", "1. Statement one\n2. Statement two", "- Statement one\n\n\n- Statement two"):
        assert one(spark, [t], T.statements_v1) == [want]
        assert one(spark, [t], T.statements_v2) == [want]
    odd = "- a\n1. b\n10. c\n**Context:** z\n---\n2)d e\n• q\n-"
    assert one(spark, [odd], T.statements_v1) == [["a", "b", "*Context:** z", "--", "e", "q"]]


def test_scores(spark):
    assert one(spark, ["0.5", "1.5", "-0.5", " 0.5 ", "invalid", None], T.score) == [0.5, 1.0, 0.0, 0.5, 0.5, 0.5]
    assert one(spark, ["true", "True", "yes", "valid", "false", "no", None], T.truth) == [True, True, True, True, False, False, False]
    assert one(spark, ["[3.1]", "", None, "( )"], T.statement_id) == ["3.1", "unknown", "unknown", "unknown"]
    assert one(spark, ["3", "13", "x"], T.month_name) == ["March", "13", "x"]


def test_links_and_keys(spark):
    assert [[tuple(l) for l in r] for r in one(spark, ["see [A b](/wiki/A) and [C](/c)"], T.links)] == [[("A b", "/wiki/A"), ("C", "/c")]]
    assert one(spark, [" Albert Einstein! ", "é"], T.entity_key) == ["albert_einstein", ""]
    assert one(spark, ["A/b c~d*é"], lambda c: T.wiki_url(c, "")) == ["A/b_c~d%2A%C3%A9"]


def test_classifications(spark):
    raw = "1: bad – too vague\n\n 0 : GOOD - x\n0: Good: yes: it is \n7: GOOD - beyond\nprose 2: GOOD - x\n99999999999999999999: BAD - x\n1: GOOD - again"
    df = spark.createDataFrame([(raw, ["a", "b", "c"]), (None, ["d"]), ("", []), (None, None)], "raw string, s array<string>")
    c = T.classifications(F.col("raw"), F.col("s"))
    got = df.select(c.alias("c"), T.good_share(c, F.col("s")).alias("v")).collect()
    assert [tuple(r) for r in got[0].c] == [(0, "a", "GOOD", "yes: it is"), (1, "b", "BAD", "too vague"), (1, "b", "GOOD", "again"), (2, "c", "BAD", T.UNCLASSIFIED), (7, "", "GOOD", "beyond")]
    assert got[0].v == 1.0
    assert [tuple(r) for r in got[1].c] == [(0, "d", "BAD", T.UNCLASSIFIED)] and got[1].v == 0.0
    assert [(r.c, r.v) for r in got[2:]] == [([], 0.0), ([], 0.0)]


def test_entity_context(spark):
    got = one(spark, ["[A](/wiki/A) [B](/wiki/B) [A](/wiki/C)", "none"], lambda c: T.entity_context(T.links(c)))
    assert got == [T.LINKS_HEAD + "\n  - [A](/wiki/A)\n  - [B](/wiki/B)", T.NO_LINKS]


def test_sections(spark):
    t = "intro\n== A ==\n=== B ===\nx\n== C ==\n"
    df = spark.createDataFrame([(t, "T")], "text string, title string").withColumn("h", T.sections("text", "title"))
    got = df.select(F.inline(T.breadcrumbs("h", "title"))).collect()
    assert [(r.level, r.breadcrumb, r.start_pos) for r in got] == [(2, "T > A", 6), (3, "T > A > B", 14), (2, "T > C", 26)]


def test_as_of_and_upsert(spark):
    p = spark.createDataFrame([(1, 0), (1, 5), (1, 9)], "k int, pos int")
    m = spark.createDataFrame([(1, 5, "a"), (1, 9, "b")], "k int, start int, v string")
    assert sorted((r.pos, r.v) for r in R.as_of(p, m, ["k"], "pos", "start", "v", "Introduction").collect()) == [(0, "Introduction"), (5, "a"), (9, "b")]
    rows = spark.createDataFrame([("k", 1, "L", "T", "u", "d", 1, "x"), ("k", 0, "M", "T", "w", "", 2, "y")], "key string, ord int, label string, type string, uri string, description string, chunk int, alias string")
    r = R.upsert_entities(rows).first()
    assert (r.label, r.uri, r.descriptions, r.source_chunks, r.aliases) == ("M", "u", ["d"], [2, 1], ["x", "y"])
    wiki = R.WIKI + "/wiki/A"
    shape = "key string, ord int, label string, type string, uri string, description string, chunk int, alias string, wikidata string"
    rows = [("a", 0, "A", "T", None, "z", None, "Al", None), ("a", 1, "A", "T", wiki, "b", 4, "", "Q1"), ("a", 2, "A", "T", "late", "z", 3, "Al", "Q2"), ("b", 3, "B", "T", None, None, None, None, None), ("c", 4, "C", "T", "", "", None, "Al", "")]
    df = spark.createDataFrame(rows, shape)
    got = {r.key: r for r in R.upsert_entities(df, "http://x").collect()}
    assert (got["a"].uri, got["a"].descriptions, got["a"].source_chunks, got["a"].aliases, got["a"].wikidata) == (wiki, ["z", "b"], [4, 3], ["Al"], "Q1")
    assert (got["b"].uri, got["b"].descriptions, got["b"].wikidata, got["c"].uri) == ("http://x#t_b", [], None, "http://x#t_c")
    assert R.upsert_entities(df, R.WIKI + "/wiki/P").where("key = 'a'").first().uri == R.WIKI + "/wiki/P#t_a"
    labels = spark.createDataFrame([("AL ",), ("b",), ("none",)], "label string")
    found = R.lookup_entities(labels, "label", R.upsert_entities(df), R.alias_targets(df)).collect()
    assert {r.label: r.found for r in found} == {"AL ": "c", "b": "b", "none": None}


def test_turtle_validity():
    ok = '@prefix schema: <https://schema.org/> .\n@prefix wiki: <https://en.wikipedia.org/wiki/> .\nwiki:Albert_Einstein a schema:Person ; schema:name "Albert Einstein" .'
    assert U.parse(ok)
    for bad in ("This is prose {random json maybe?}", "wiki:A a", ok.split("\n")[2]):
        with pytest.raises(U.TurtleError):
            U.parse(bad)


def test_graph_pattern(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "q", "c"), ("x", "p", "y")], "s string, p string, o string")
    assert [tuple(r) for r in G.match(t, [("?m", "q", "?z"), ("?a", "p", "?m")]).select("a", "m", "z").collect()] == [("a", "b", "c")]


def test_top_pages(spark):
    j = '{"items":[{"articles":[{"article":"Test_Article","views":1000},{"article":"Another_Article","views":500},{"article":"Special:Page","views":300},{"article":"Main_Page","views":10000}]}]}'
    got = readers.top_pages(spark.createDataFrame([(j,)], "value string"), 10).collect()
    assert [tuple(r) for r in got] == [("Test Article", 1000), ("Another Article", 500)]


def test_notebook_cells(spark, tmp_path):
    import json

    (tmp_path / "a.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": ["x\n", "y"]}, {"cell_type": "raw", "source": "{}"}], "nbformat": 4}))
    got = readers.notebook_cells(spark, str(tmp_path / "a.ipynb")).orderBy("cell_idx").collect()
    assert [(r.cell_type, r.source) for r in got] == [("markdown", "x\ny"), ("raw", "{}")]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_chunker_and_its_sql_agree():
    """Random texts with headers, blank lines, sentences and long runs."""
    import random

    import duckdb
    import pandas as pd

    from loomgraph.plans.catalogue import CHUNKS_SQL

    rng = random.Random(4)
    part = lambda: rng.choice(["word ", "A sentence here. ", "\n\n", f"\n== Head {rng.randrange(9)} ==\n", "\n=== Sub ===\n", "x" * rng.randrange(400), " ", " \n", "== no =="])
    rows = [(d, "".join(part() for _ in range(rng.randrange(80)))) for d in range(400)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = con.sql(CHUNKS_SQL.replace("{cid}", "piece")).fetchall()
    want = []
    for d, t in rows:
        found = C.chunk_text(f"Doc {d}", t, 1500, 60)
        want += [(d, i, len(found), s, len(p), p) for i, (p, s) in enumerate(found)]
    assert sorted(got) == sorted(want)


def test_recursive_splitter_and_its_sql_agree():
    """Random texts of paragraphs, lines, words and runs longer than a chunk."""
    import random

    import duckdb
    import pandas as pd

    from loomgraph.plans.extraction import RECURSIVE_SQL

    rng, rows = random.Random(4), []
    for d in range(40):
        kinds = rng.sample(["word ", "A sentence here. ", "\n\n", "\n", "x" * 300, "y" * 50 + " ", "z" * 2100, " ", "ü "], rng.randint(2, 7))
        rows.append((d, "".join(rng.choice(kinds) for _ in range(rng.randrange(40)))))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = con.sql(RECURSIVE_SQL.replace("{cid}", "chunk")).fetchall()
    assert sorted(got) == sorted((d, i, len(p), p) for d, t in rows for i, p in enumerate(C.split_recursive(t, 2000, 128)))
