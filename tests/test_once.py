"""Expressions over lists are computed once a row, not once an entry; equal results, plain code beside them."""

import re
import time

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import answers as Y
from loomgraph.operators import relational as O
from loomgraph.operators import runs as R
from loomgraph.operators import wikitext as W
from loomgraph.plans import catalogue
from loomgraph.sources import readers

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strip_is_unicode_white_space(spark):
    df = spark.range(0x10000).where("id NOT BETWEEN 55296 AND 57343").select(F.concat(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')"), F.lit("a b")).alias("c"))
    df = df.select(F.concat("c", F.substring("c", 1, 1)).alias("c"))
    assert df.where(T.strip(F.col("c")) != F.regexp_replace("c", r"(?U)^\s+|(?U)\s+$", "")).count() == 0
    df = spark.createDataFrame([("\u2003 x\n y \n\x85\u3000",), ("\n \n",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(T.strip(F.col("c"))).collect()] == ["x\n y", "", "", None]


def test_bootstrap_chunks_sort_once_and_read_each_cell_once(spark):
    cells = [
        (1, 0, "markdown", "**Context:** A\n**Chunk:** 2 of 3\n**Chunk:** x\n\n---\n\none\n---\ntwo"), (1, 1, "markdown", "**Context:** none\n---"), (1, 2, "code", "**Context:** B\n---\nx"), (1, 3, "raw", '{"type": "chunk", "cid": "a"}'),
        (1, 4, "raw", '{"type": "chunk", "cid": "b"}'), (1, 5, "markdown", "**Context:** C\n---\nc"), (1, 6, "raw", None), (1, 7, "raw", '{"type": "chunk"}'),
        (2, 0, "markdown", "---\n**Context:** D\n d\n"), (2, 1, None, "x"), (2, 2, "markdown", None), (2, 3, "raw", '{"type": "chunk"}'), (2, 4, "markdown", "**Context:** E\n---\ne"),
    ]
    x = readers.bootstrap_chunks(spark.createDataFrame(cells, "nb long, cell_idx int, cell_type string, source string"), ["nb"])
    assert x.columns == ["nb", "chunk_num", "section_context", "text", "cid"]
    p = plan(x)
    assert sorted(map(tuple, x.collect())) == [(1, 2, "A", "one\ntwo", "a"), (2, None, "D", "d", None)]
    assert (len(re.findall(r"\bSort \[", p)), p.count("Exchange"), p.count("split(")) == (1, 1, 1)


def judged(raw, statements):
    """classifications() in plain Python, for lines without Unicode blanks."""
    said = [m.groups() for m in (re.match(r"(\d+):\s*(GOOD|BAD)\s*[-–:]\s*(.+)", line.strip(), re.I) for line in raw.split("\n")) if m]
    out = [(int(i), statements[int(i)] if int(i) < len(statements) else "", c.upper(), r.strip()) for i, c, r in said]
    known = {r[0] for r in out}
    return sorted(out + [(i, s, "BAD", T.UNCLASSIFIED) for i, s in enumerate(statements) if i not in known], key=lambda r: r[0])


def test_classifications_of_many_lines(spark):
    n = 6000
    given = [f"s{i}" for i in range(n)]
    raw = "\n".join(f"{i * 7 % n}: {'good' if i % 2 else 'BAD'} - r{i}" if i % 3 else f" {n + i} none" for i in range(n)) + "\n5: GOOD: again\n5: BAD: more"
    df = spark.createDataFrame([(raw, given)], "raw string, s array<string>")
    t = time.monotonic()
    got = df.select(T.classifications(F.col("raw"), F.col("s")).alias("c")).first().c
    took = time.monotonic() - t
    assert [tuple(r) for r in got] == judged(raw, given)
    assert took < 20, took  # before: each line was read again for each statement


def test_judge_completion_reads_answers_once(spark):
    p = plan(catalogue.judge_completion(spark, DIR))
    assert p.count("regexp_extract(") == 3


def test_answers_look_fields_up_once(spark):
    said = [
        '{"entities": [{"id": "a", "label": " ", "type": null}, null, [1], {}, {"id": "b", "label": "L", "type": "T", "description": ""}, {"id": true, "label": 1.5, "type": {"x": 1}, "description": 3}], "relations": {"a": 1}}',
        '```json\n{"relations": [{"source": "a", "target": "b", "type": "t", "more": 1}], "entities": null}\n```', "{}", "[]", "null", '"x"', "", None,
    ]
    x = Y.parse(spark.createDataFrame(list(enumerate(said)), "n int, a string"), "a")
    p = plan(x.select("errors"))
    got = [r.asDict(True) for r in x.orderBy("n").collect()]
    assert got[0]["entities"] == [{"id": "b", "label": "L", "type": "T", "description": ""}] and got[0]["relations"] == [] and got[0]["corrupt"] is None
    assert got[0]["errors"] == [
        "entities[0].label: empty", "entities[0].type: missing", "entities[1]: an object expected", "entities[2]: an object expected", "entities[3].id: missing", "entities[3].label: missing", "entities[3].type: missing",
        "entities[5].id: a text expected, not boolean", "entities[5].label: a text expected, not decimal", "entities[5].type: a text expected, not object", "entities[5].description: a text expected, not bigint", "relations: a list expected",
    ]
    assert got[1]["relations"] == [{"source": "a", "target": "b", "type": "t", "description": None}] and got[1]["errors"] == []
    assert [(r["corrupt"], r["entities"], r["errors"]) for r in got[2:]] == [(None, [], []), *[(t, [], []) for t in said[3:]]]
    assert p.count("$.label") == 2, p  # its kind and its text


def test_article_is_parsed_once(monkeypatch):
    n, parse = [], W.parse
    monkeypatch.setattr(W, "parse", lambda text: n.append(text) or parse(text))
    got = W.article("Order", "{{Infobox order\n| date = {{birth date|2020|1|2}}\n| list = {{hlist|a|[[C1|c1]]}}\n}}\n''Text'' <ref>x</ref>[[D]].", "https://x", 1000)
    assert got["content"] == "=== Infobox: order ===\n\n**date**: 2 January 2020\n\n**list**: a, [c1](/wiki/C1)\n\n\n*Text* [D](/wiki/D)."
    assert got["links"] == [("c1", "https://x/wiki/C1"), ("D", "https://x/wiki/D")] and len(n) == 1


def test_rdf_run_takes_statements_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    facts = spark.createDataFrame([(1, "- a\n- b"), (2, "# Error: x\n- c"), (3, None)], "chunk long, facts string")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    old = spark.createDataFrame([], "chunk long, stmt_key string, from_cid string, content string")
    make = lambda x: x.where("stmt_idx = 1").select("chunk", "stmt_key", F.lit(0).alias("ord"), F.lit("ex:s").alias("s"), F.lit("ex:p").alias("p"), F.lit("ex:o").alias("o"))
    got = R.rdf_run(facts.mapInArrow(count, facts.schema), old, make, str(tmp_path / "o"))
    assert got == {"processed": 2, "skipped": 0, "without": 1, "triples": 1, "errors": 1}
    assert seen.value == 6  # for the statements and for the errors


def test_endpoints_tasks_grow_with_relations(spark):
    rel = spark.range(40).selectExpr("id % 7 AS chunk", "id AS line", "concat('p', id % 5) AS source_id", "concat('s', id % 3) AS target_id")
    m = spark.range(60).selectExpr("id % 7 AS chunk", "IF(id % 2 = 0, concat('p', id % 5), concat('s', id % 3)) AS id", "IF(id % 4 < 2, 'A', 'x') AS label")
    known = spark.createDataFrame([("a", "e1")], "key string, id string")
    x = O.endpoints(rel, m, known, per=2)
    assert x.rdd.getNumPartitions() == 20
    rows = m.groupBy("chunk", "id").agg(F.min("label").alias("label")).collect()
    ids = {(r.chunk, r.id): "e1" if r.label == "A" else r.id for r in rows}
    want = [(r.chunk, r.line, ids[r.chunk, r.source_id], ids[r.chunk, r.target_id]) for r in rel.collect() if (r.chunk, r.source_id) in ids and (r.chunk, r.target_id) in ids]
    assert want and sorted(map(tuple, x.collect())) == sorted(want)
