import json

from pyspark.sql import functions as F

from loomgraph.functions import render as N
from loomgraph.operators import chunks as C
from loomgraph.sources import readers
from loomgraph.streaming import incremental


def test_positions(spark):
    rows = [(["ab", "ab", "zz", "b"], "xababb"), ([], "x"), (["a"], None), (None, "x"), (["é😀", "x"], "é😀x")]
    df = spark.createDataFrame(rows, "c array<string>, t string")
    assert [r[0] for r in df.select(C.positions(F.col("c"), F.col("t"))).collect()] == [[1, 3, 4, 5], [], None, None, [0, 2]]


def test_recursive_chunks(spark):
    df = spark.createDataFrame([(1, "aaa bbb ccc ddd\n\neee fff"), (2, None), (3, "")], "id long, text string")
    got = C.recursive_chunks(df, "id", "text", 8, 4).orderBy("key", "chunk_num").collect()
    assert [(r.key, r.chunk_num, r.chunk) for r in got] == [(1, i, c) for i, c in enumerate(["aaa bbb", "bbb ccc", "ccc ddd", "eee fff"])]


def test_signed_cells(spark):
    sig = lambda **k: json.dumps(k)
    chunk = "**Context:** T > S\n**Chunk:** 2 of 3\n\n---\n\nbody\n---\nmore\n"
    rows = [
        (0, "markdown", "# head"), (1, "markdown", chunk), (2, "raw", sig(_type="chunk", **{"dcterms:identifier": "baf1"})),
        (3, "markdown", "**Chunk:** 5 of 9\n---\n1. One. Two\n2)x\nno\n12. "), (4, "raw", sig(type="statements", cid="c")),
        (5, "markdown", chunk), (6, "raw", "broken"), (7, "markdown", "plain"), (8, "raw", sig(type="chunk", cid="baf2")), (9, "markdown", chunk),
    ]
    cells = spark.createDataFrame([("p", *r) for r in rows], "path string, cell_idx int, cell_type string, source string")
    got = readers.chunk_cells(cells, ["path"]).orderBy("cid").collect()
    assert [tuple(r) for r in got] == [("p", 1, "T > S", "body\n---\nmore", "baf1"), ("p", 0, "", "", "baf2")]
    assert [(r.chunk_num, r.statements) for r in readers.statement_cells(cells, ["path"]).collect()] == [(5, ["One. Two", "2)x", "12."])]


def test_vocabulary(spark):
    graph = {
        "@graph": [
            {"@id": "schema:Person", "@type": "rdfs:Class", "rdfs:label": "Person", "rdfs:comment": "x" * 600, "rdfs:subClassOf": {"@id": "schema:Thing"}},
            {"@id": "schema:name", "@type": "rdf:Property", "rdfs:label": {"@value": "name", "@language": "en"}, "schema:domainIncludes": [{"@id": f"schema:D{i}"} for i in range(5)], "schema:rangeIncludes": {"@id": "schema:Text"}},
            {"@id": "other:x", "@type": "rdfs:Class"},
        ]
    }
    got = {r.uri: r for r in readers.vocabulary(spark.createDataFrame([(json.dumps(graph),)], "value string")).collect()}
    assert set(got) == {"schema:Person", "schema:name"}
    assert (got["schema:Person"].term_type, len(got["schema:Person"].description), got["schema:Person"].parent) == ("class", 500, "schema:Thing")
    assert (got["schema:name"].label, got["schema:name"].domain, got["schema:name"].range) == ("name", "schema:D0, schema:D1, schema:D2", "schema:Text")


def test_streaming_upsert(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.json").write_text('{"text": "a", "at": "2024-01-01T00:00:00"}\n{"text": "b", "at": "2024-01-01T00:00:01"}\n')
    stream = lambda: incremental.signed(spark.readStream.schema("text string, at timestamp").json(str(source)), "text", "at")
    run = lambda n: stream().writeStream.foreachBatch(incremental.upsert_to(out)).option("checkpointLocation", str(tmp_path / n)).trigger(availableNow=True).start().awaitTermination()
    run("one")
    (source / "b.json").write_text('{"text": "b", "at": "2024-01-01T00:00:02"}\n{"text": "c", "at": "2024-01-01T00:00:03"}\n')
    run("one")
    run("two")  # a stream begun anew adds nothing
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_rendered_texts(spark):
    df = spark.createDataFrame([(None, "", "d", "r")], "a string, b string, c string, e string")
    one = lambda c: df.select(c).first()[0]
    a, b, c, e = map(F.col, "abce")
    assert one(N.term_text(c, a, b, e, a)) == "d | value is r"
    assert one(N.prompt_context({"prefixes": a, "usage_examples": c})) == "## Examples\nd"
    assert one(N.emit_error({"statement_id": c, "subject": a, "predicate": c, "object_value": b})).count(";") == 1
    assert one(N.emit_error(dict.fromkeys(("statement_id", "subject", "predicate", "object_value"), c))) is None
    assert one(N.class_answer(F.array().cast("array<struct<prefix:string,score:double,uri:string,description:string,hint:string,parent:string>>"))) == N.CLASS_NONE
    assert one(N.baseline_input(c, c, F.lit(1), b)) == one(N.baseline_input(c, c, F.lit(1)))
    assert one(N.improvement(F.lit(1.0), F.lit(0.0))) is None and one(N.improvement(F.lit(0.75), F.lit(0.5))) == 0.25
    for text, want in (("", False), ("# a\n\n # b", False), ('{"@id": "x"}', False), ("# Error: x\na b c .", False), ("# s\na b c .", True)):
        assert one(N.has_triples(F.lit(text))) is want


def test_rdf_cell_shows_calls(spark):
    head, none = "# Statement [1.2]: s", "# No triples emitted for this statement"
    emit = [("emit_triple", f'{{"n": {i}}}') for i in range(4)] + [("emit_triples", "é" * 300), ("emit_triple", "sixth")]
    rows = [("a b c .", emit), (None, emit), ("", [("find_class", "x")]), (None, []), (None, None), (None, [None, ("emit_triple", None)])]
    df = spark.createDataFrame(rows, "block string, calls array<struct<name: string, args: string>>")
    got = [r[0] for r in df.select(N.rdf_cell(F.lit(1), F.lit(2), F.lit("s"), F.col("block"), F.col("calls"))).collect()]
    shown = [f'#   emit_triple: {{"n": {i}}}' for i in range(4)] + ["#   emit_triples: " + "é" * 200]
    bare = f"{head}\n{none}"
    assert got == [
        f"{head}\na b c .", "\n".join([bare, "# Debug: 6 emit tool calls made for chunk", *shown]), bare, bare, bare,
        f"{bare}\n# Debug: 1 emit tool calls made for chunk\n#   emit_triple: ",
    ]
