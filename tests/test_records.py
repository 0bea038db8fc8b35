"""Signatures, upserts, artefacts, searches and hooks beyond what the registered queries cover."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import hooks as H
from loomgraph.functions import provenance as P
from loomgraph.functions import render as N
from loomgraph.functions import text as T
from loomgraph.functions.cid import cid
from loomgraph.operators import chunks as C
from loomgraph.operators import notebooks as B
from loomgraph.operators import relational as R
from loomgraph.sources import artefacts as A
from loomgraph.sources import readers


def one(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(f(F.col("c"))).collect()]


def test_signature_fields(spark):
    made = json.loads(one(spark, ["abc"], lambda c: P.make_signature(F.lit(3), F.lit("chunk"), c, F.lit(""), F.lit("repro:InputData"), stmt_key=F.lit("3_2"), chunk_num=F.lit(None).cast("int")))[0])
    assert made["@id"] == "ipfs://abc" and made["@type"] == ["prov:Entity", "repro:InputData"] and made["prov:label"] == "chunk:3"
    assert "prov:wasDerivedFrom" not in made and made["_stmt_key"] == "3_2" and "_chunk_num" not in made and made["_cell"] == 3
    assert made["@context"]["prov:wasDerivedFrom"] == {"@type": "@id"}
    texts = ['{"cell": 1, "cid": "x"}', ' {"@id": "ipfs://y", "prov:wasDerivedFrom": "ipfs://z", "@type": "prov:Entity"} ', '{"cid": "x"}', "{", None, "[]"]
    got = one(spark, texts, P.parse_signature)
    assert (got[0].type, got[0].cid, got[0].from_cid) == ("unknown", "x", None)
    assert (got[1].cid, got[1].from_cid, got[1].types, got[1].identifier) == ("y", "z", ["prov:Entity"], "y")
    assert got[2:] == [None] * 4


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "old"), (2, "b", "old"), (4, "d", "old")], "k int, from_cid string, content string")
    new = spark.createDataFrame([(1, "a", "x"), (2, "B", "x"), (3, "c", "x"), (5, None, "x")], "k int, cid string, _from string")
    seen = []

    def make(rows):
        seen.extend(r.k for r in rows.collect())
        return rows.select("k", F.lit("new").alias("content"))

    cells, status = B.upsert_cells(old, new, ["k"], make)
    assert sorted(seen) == [2, 3, 5]
    assert sorted(map(tuple, cells.collect()), key=str) == [(1, "a", "old"), (2, "B", "new"), (3, "c", "new"), (4, "d", "old"), (5, None, "new")]
    assert dict(map(tuple, status.collect())) == {1: "skip", 2: "regenerate", 3: "generate", 5: "generate"}
    assert B.upsert_cells(old.limit(0), new.limit(0), ["k"], lambda r: r.select("k", F.lit("new").alias("content")))[0].count() == 0


def test_artefacts(spark, tmp_path):
    rows = spark.createDataFrame([(i, f'é "{i}"', None if i else "s") for i in range(5)], "ord long, chunk_text string, section_context string")
    whole = A.save_examples(rows, "trainset", str(tmp_path)).first()
    got = {r.ord: r for r in A.load(spark, str(tmp_path), "trainset").collect()}
    want = [json.dumps({"chunk_text": f'é "{i}"', "section_context": None if i else "s"}, sort_keys=True) for i in range(5)]
    assert [got[i].cid for i in range(5)] == [A.cid_of(w) for w in want]
    assert (whole.n, whole.cid) == (5, A.cid_of("".join(map(A.cid_of, want))))
    texts = rows.select("ord", F.concat(F.lit("t"), "ord").alias("t"))
    two = A.rows_cid(texts, "ord", "t", fan_in=2).first().cid
    level = [A.cid_of(f"t{i}") for i in range(5)]
    while len(level) > 1:
        level = [A.cid_of("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    assert two == level[0]
    with pytest.raises(FileNotFoundError):
        A.load(spark, str(tmp_path), "devset")
    assert A.load(spark, str(tmp_path), "baseline", required=False) is None
    config = json.loads(A.config_json({"model": "m", "temperature": 0.5}))
    assert config["cid"] == A.cid_of(json.dumps({"model": "m", "temperature": 0.5}, sort_keys=True))
    assert one(spark, ["x"], cid) == [A.cid_of("x")]
    runs = spark.createDataFrame([(0.5, 10, "c", "", "d"), (0.5, 10, "", "", "d")], "score double, eval_size int, config_cid string, extractor_cid string, devset_cid string")
    assert [r.input_cid is None for r in A.baselines(runs).collect()] == [False, True]


def test_notebooks_are_saved_by_name(spark, tmp_path):
    cells = spark.createDataFrame([("a/b", 0, "markdown", 'x "é"\n'), ("a/b", 1, "code", "1"), ("c", 0, "raw", "{}")], "nb string, cell_idx int, cell_type string, source string")
    B.save(cells, "nb", str(tmp_path / "n"))
    B.save(cells.where("nb = 'c'").withColumn("source", F.lit("new")), "nb", str(tmp_path / "n"))
    got = {(r.cell_idx, r.cell_type, r.source) for r in readers.notebook_cells(spark, f"{tmp_path}/n/*/*").collect()}
    assert got == {(0, "markdown", 'x "é"\n'), (1, "code", "1"), (0, "raw", "new")}


def test_places_are_counted_in_ranges(spark):
    rows = spark.createDataFrame([(i * i, "x") for i in range(1, 400)], "n long, _range string").repartition(5)
    got = sorted((r.n, r.place) for r in R.numbered(rows, "n", "place", per=7).collect())
    assert got == [(i * i, i) for i in range(1, 400)]
    assert R.numbered(rows.limit(0), "n", "place").count() == 0
    a, b = (sorted(map(tuple, R.seeded_split(rows.withColumn("_h", F.lit(1)), "n", 0.8, per=p).collect())) for p in (3, 100_000))
    assert a == b and sum(r[-1] == "train" for r in a) == 319


def test_names_of_helpers_do_not_clash(spark):
    p = spark.createDataFrame([(1, 5, "a", 1, 2)], "k int, at int, _v string, _at int, _probe int")
    m = spark.createDataFrame([(1, 3, "hit"), (1, 6, "later")], "k int, mark int, value string")
    assert [tuple(r) for r in R.as_of(p, m, ["k"], "at", "mark", "value").collect()] == [(1, 5, "a", 1, 2, "hit")]
    x = spark.createDataFrame([("A b", 1, 2, 3, "f")], "label string, _k int, _a int, _c int, found string")
    e, al = spark.createDataFrame([("ab",)], "key string"), spark.createDataFrame([("a_b", "ab")], "alias_key string, key string")
    assert [tuple(r) for r in R.lookup_entities(x, "label", e, al).collect()] == [("A b", 1, 2, 3, "f", "ab")]


def test_texts(spark):
    assert one(spark, ["A b#See also", "A#", "#x"], lambda c: T.wiki_url(c, "/w/")) == ["/w/A_b#See%20also", "/w/A#", "/w/#x"]
    assert one(spark, ["[a](/wiki/A) [b](http://x) [a](/wiki/C)"], lambda c: T.link_map(T.article_links(c, "http:/"))) == [{"a": "http://wiki/C"}]
    assert one(spark, ["x"], lambda c: N.numbered(F.array(c, c), "ids")) == ["[1] x\n[2] x"] and one(spark, ["x"], lambda c: N.numbered(F.array(c), "index")) == ["0: x"]
    assert json.loads(one(spark, ['é"\n'], lambda c: N.sample_cell(c, F.lit(5), F.lit(1), F.lit(2)))[0]) == {"title": 'é"\n', "views": 5, "index": 1, "total": 2}
    assert one(spark, ["x"], lambda c: N.property_answer(F.array().cast("array<struct<prefix:string,score:double,uri:string,domain:string,range:string,description:string,hint:string>>"))) == [N.PROPERTY_NONE]
    assert one(spark, ["x"], lambda c: N.examples_text(F.array().cast("array<string>"))) == [N.NO_EXAMPLES]
    assert len(C.split_recursive("x" * 400_000)) == len(range(0, 400_000 - 128, 2000 - 128))


def test_hooks(spark):
    assert one(spark, ["ab", None, ""], lambda c: H.embedding(c, lambda: lambda texts: [[float(len(t))] for t in texts])) == [[2.0], None, [0.0]]
    rows = H.tool_loop(spark.createDataFrame([(1, "p")], "k int, prompt string"), ["k"], "prompt", lambda: lambda messages: ("", [("t", {})]), {"t": lambda: "ok"}, most=3).collect()
    assert [(r.iteration, r.tool, r.result) for r in rows] == [(1, "t", "ok"), (2, "t", "ok"), (3, "t", "ok"), (3, None, "")]
    x, mean = H.evaluated(spark.createDataFrame([(1.0,), (None,)], "s double"), lambda df: F.col("s"))
    assert mean.first().mean == 0.5 and x.count() == 2


def test_entry_works_without_the_optional_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "loomgraph"), tmp_path / "loomgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) + 1 > 100 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_responses_of_services(spark):
    """Missing pages, bad responses, no pages, several pages."""
    page = lambda **pages: json.dumps({"query": {"pages": {k.strip("_"): v for k, v in pages.items()}}})
    values = [page(_7={"extract": "a"}, _8={"extract": "b"}), page(**{"-1": {"missing": ""}}), page(_7={"title": "t"}), page(), "{}", "[", "", None]
    df = spark.createDataFrame([(i, v, "own") for i, v in enumerate(values)], "i long, value string, content string")
    got = readers.page_extracts(df)
    assert got.columns == ["i", "content"]
    assert [r.content for r in got.orderBy("i").collect()] == ["a", None, "", None, None, None, None, None]
    values = [page(_7={"pageprops": {"wikibase_item": "Q1"}}), page(_7={"pageprops": {}}), page(_7={}), page(), '{"query": 3}', "[", None]
    df = spark.createDataFrame(enumerate(values), "i long, value string")
    assert [r.item for r in readers.item_ids(df).orderBy("i").collect()] == ["Q1"] + [None] * 6
    assert readers.page_extracts(df.limit(0)).count() == readers.item_ids(df.limit(0)).count() == 0


def test_search_of_runs(spark):
    df = spark.createDataFrame([("a", 1), ("c", 3), ("b", 3), ("d", None)], "run string, at int")
    assert [r.run for r in A.search(df, "at", "run", 3).collect()] == ["b", "c", "a"]
    assert A.search(df.limit(0), "at", "run", 1).count() == 0
