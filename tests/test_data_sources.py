import bz2
import gzip
import json
import os
import pickle

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import notebooks as B
from loomgraph.sources import article_dump as D
from loomgraph.sources import named_files as N
from loomgraph.sources import readers

PAGES = [(1, 0, "A & B", "2020-01-01T00:00:00Z", "text <ref>x</ref> & 'q'\n\n"), (2, 0, "Empty", None, ""), (3, 4, "Talk:Ä", "t", "ü" * 3000), (4, 0, "No text", None, None), (5, None, None, None, "none")]


def xml(spark, rows):
    df = spark.createDataFrame(rows, D.SCHEMA)
    return [r[0] for r in df.coalesce(1).select(D.page_xml(F.col("page_id"), F.col("title"), F.col("text"), F.col("ns"), F.col("timestamp"))).collect()]


def load(spark, path, **options):
    D.register(spark, pushdown=True)
    return spark.read.format("article_dump").options(**options).load(str(path))


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_dump_ranges(spark, tmp_path):
    """Every page once, wherever files are cut."""
    text = "<mediawiki>\n<siteinfo/>\n" + "\n".join(xml(spark, PAGES)) + "\n<page><title>cut off</title>"
    (tmp_path / "d.xml").write_text(text, encoding="utf-8")
    for step in (1, 7, 50, 999, 1 << 20):
        reader = D.Reader(str(tmp_path), step, list(D.KINDS))
        got = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*b.to_pydict().values(), strict=True)]
        assert sorted(got, key=str) == sorted(PAGES, key=str)
    got = load(spark, tmp_path, partition_bytes=999)
    assert plain(got) == sorted(PAGES, key=str) and got.rdd.getNumPartitions() > 3


def test_dump_compressed_and_pruned(spark, tmp_path):
    pages = xml(spark, PAGES)
    os.mkdir(tmp_path / "sub")
    # members of their own, as multistream dumps have
    (tmp_path / "a.xml.bz2").write_bytes(bz2.compress("".join(pages[:2]).encode()) + bz2.compress(pages[2].encode()))
    (tmp_path / "sub" / "b.xml.gz").write_bytes(gzip.compress(pages[3].encode()) + gzip.compress(pages[4].encode()))
    (tmp_path / "_SUCCESS").write_text("<page>")
    got = load(spark, tmp_path)
    assert plain(got) == sorted(PAGES, key=str)
    assert plain(got.where("title = 'Empty'").select("page_id")) == [(2,)]
    os.mkdir(tmp_path / "none")
    assert load(spark, tmp_path / "none").count() == 0
    with pytest.raises(Exception, match="no dump at"):
        load(spark, tmp_path / "missing").count()


def test_dump_filters(spark, tmp_path, capsys):
    (tmp_path / "d.xml").write_text("".join(xml(spark, PAGES)), encoding="utf-8")
    for where, want in [("title = 'A & B'", [1]), ("title in ('Empty', 'No text')", [2, 4]), ("title like 'Talk:%' and ns = 4", [3]), ("page_id >= 4", [4, 5]), ("title is null", [5]), ("title > 'E' and title like '%t'", [4]), ("title = 'a' or page_id = 1", [1]), ("not title = 'Empty'", [1, 3, 4])]:
        assert [r.page_id for r in load(spark, tmp_path).where(where).orderBy("page_id").collect()] == want, where
    both = load(spark, tmp_path).where("ns = 0").unionByName(load(spark, tmp_path).where("ns >= 1"))
    assert [r.page_id for r in both.orderBy("page_id").collect()] == [1, 2, 3, 4]
    load(spark, tmp_path).where("title like 'Talk:%'").explain()
    plan = capsys.readouterr().out
    # a filter that the source takes isn't evaluated again
    assert "BatchScan article_dump" in plan and "Filter " not in plan


def sink(spark, rows, path, mode="append", **options):
    N.register(spark)
    spark.createDataFrame(rows, "path string, value string").repartition(3).write.format("named_files").mode(mode).options(**options).save(str(path))


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(path) for f in fs}


def test_named_files(spark, tmp_path):
    sink(spark, [("a", "1"), ("x/b", "ü\n"), ("c", None)], tmp_path / "o", suffix=".txt")
    assert tree(tmp_path / "o") == {"a.txt": "1", "x/b.txt": "ü\n", "c.txt": ""}
    sink(spark, [("a", "2"), ("y/d", "3")], tmp_path / "o", suffix=".txt")
    assert tree(tmp_path / "o") == {"a.txt": "2", "x/b.txt": "ü\n", "c.txt": "", "y/d.txt": "3"}
    sink(spark, [("z", "4")], tmp_path / "o", "overwrite")
    assert tree(tmp_path / "o") == {"z": "4"}
    assert os.listdir(tmp_path / "o") == ["z"]


@pytest.mark.parametrize("bad", [[("../a", "x")], [("/a", "x")], [(None, "x")], [("", "x")], [("a//b", "x")], [("ok", "x"), ("ok", "y")]])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    sink(spark, [("keep", "1")], tmp_path / "o")
    with pytest.raises(Exception):
        sink(spark, [(f"n{i}", "x") for i in range(20)] + bad, tmp_path / "o")
    assert tree(tmp_path / "o") == {"keep": "1"} and os.listdir(tmp_path / "o") == ["keep"]


ARTICLE = {"title": "Ada L", "url": "https://x/wiki/Ada_L", "fetched_at": "2020-01-01", "content": 'She "wrote".\nä', "license": "CC BY-SA 4.0", "license_url": "https://l", "attribution": "W", "registry": "{}", "generated_by": "p", "generated_at": "now"}


def test_notebooks_written_and_read(spark, tmp_path):
    a = spark.createDataFrame([ARTICLE])
    chunks = spark.createDataFrame([("Ada L", i, f"Ada L > S{i}", f"chunk {i}") for i in range(3)], "title string, chunk_index int, breadcrumb string, content string")
    src, chk = B.source_notebook(a, ["title"]), B.chunks_notebook(a, chunks, ["title"], 2000, 128)
    B.write_files(src, ["title"], str(tmp_path / "src"), F.lit("ada/source"))
    B.write_files(chk, ["title"], str(tmp_path / "chk"), F.lit("ada/chunks"))
    assert list(tree(tmp_path / "src")) == ["ada/source.ipynb"]
    nb = json.loads(tree(tmp_path / "src")["ada/source.ipynb"])
    assert [c["cell_type"] for c in nb["cells"]] == ["markdown", "raw", "code", "raw"] and nb["nbformat"] == 4
    assert nb["cells"][0]["source"].startswith("# Source Content: Ada L\n\n## Provenance\n\n```yaml\nsource_url: https://x/wiki/Ada_L\narticle_title: Ada L\nfetched_at: 2020-01-01\ncontent_length: 14\n")
    cells = readers.notebook_cells(spark, f"{tmp_path}/src/*/*.ipynb")
    sig = B.signatures(cells, ["path"]).first()
    content = spark.sql("select 1").select(B.cid(F.lit(ARTICLE["content"])).alias("c"), B.cid(F.lit(ARTICLE["url"])).alias("u")).first()
    assert (sig.cell, sig.type, sig.cid, sig.from_cid, sig.label, sig.types) == (1, "source", content.c, content.u, "source:Ada L", ["prov:Entity", "repro:InputData"])
    found = readers.chunk_cells(readers.notebook_cells(spark, f"{tmp_path}/chk/*/*.ipynb"), ["path"]).orderBy("chunk_num").collect()
    assert [(r.chunk_num, r.section_context, r.text) for r in found] == [(i, f"Ada L > S{i}", f"chunk {i}") for i in range(3)]
    sigs = B.signatures(readers.notebook_cells(spark, f"{tmp_path}/chk/*/*.ipynb"), ["path"]).collect()
    assert {s.from_cid for s in sigs} == {content.c} and [s.label for s in sorted(sigs, key=lambda s: s.cell)] == ["chunk:1/3", "chunk:2/3", "chunk:3/3"]


def test_notebooks_out_of_articles_rows(spark):
    """The same text as by cells, without a shuffle; also for none, a null and what JSON escapes."""
    rows = [ARTICLE | {"title": f"T{i}", "n": n} for i, n in enumerate([0, 1, 3, 12, None])]
    a = spark.createDataFrame(rows).withColumn("l", F.expr("transform(sequence(1, n), i -> struct('A > \"' || i as breadcrumb, 'text ' || i || chr(10) || 'ü\\\\ ' as content))"))
    a = a.withColumn("l", F.when(F.col("n") == 0, F.expr("filter(l, x -> false)")).otherwise(F.col("l")))
    cells = B.chunks_notebook(a, a.select("title", F.posexplode("l").alias("chunk_index", "c")).select("title", "chunk_index", "c.*"), ["title"], 2000, 128)
    got = B.chunked(a, ["title"], F.col("l"), 2000, 128)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, B.ipynb(cells, ["title"]).collect())) and got.count() == 5
    assert "Exchange" not in got._jdf.queryExecution().sparkPlan().toString()


def test_files_read_by_an_index(spark, tmp_path):
    """Messages to the driver hold no paths; the index, not a listing, says what is read."""
    rows = [(f"d{i % 7}/n{i}", f"text {i} ü\n" * (i % 3)) for i in range(500)]
    sink(spark, rows, tmp_path / "o", suffix=".txt", index=str(tmp_path / "i"))
    (tmp_path / "o" / "stray.txt").write_text("x")
    assert plain(N.read_named(spark, str(tmp_path / "o"), str(tmp_path / "i"))) == sorted(((p + ".txt", v) for p, v in rows), key=str)
    sink(spark, [("d0/n0", "new"), ("e/n", "2")], tmp_path / "o", suffix=".txt", index=str(tmp_path / "i"))
    again = {p + ".txt": v for p, v in rows} | {"d0/n0.txt": "new", "e/n.txt": "2"}
    assert plain(N.read_named(spark, str(tmp_path / "o"), str(tmp_path / "i"))) == sorted(again.items(), key=str)
    os.remove(tmp_path / "o" / "e" / "n.txt")
    with pytest.raises(Exception, match="n.txt"):
        N.read_named(spark, str(tmp_path / "o"), str(tmp_path / "i")).count()

    written = N.Writer(str(tmp_path / "m"), "", False).write(iter([pa.RecordBatch.from_pydict({"path": [f"p{i}" for i in range(1000)], "value": ["x"] * 1000})]))
    assert len(pickle.dumps(written)) < 1000


def test_files_are_not_broadcast(spark, tmp_path):
    """By the size of the list alone, files of any size would go through the driver."""
    sink(spark, [(f"n{i}", "text") for i in range(20)], tmp_path / "o", index=str(tmp_path / "i"))
    files, other = N.read_named(spark, str(tmp_path / "o"), str(tmp_path / "i")), spark.range(20).select(F.concat(F.lit("n"), "id").alias("path"))
    for x in (files.join(other, "path"), other.join(files.select("path").distinct(), "path", "left_anti"), files.join(files.groupBy("path").agg(F.max("value")), "path")):
        assert "Broadcast" not in x._jdf.queryExecution().sparkPlan().toString()
        assert x.count() in (0, 20)


def test_a_customer_has_one_file(spark):
    """Not one for each range of keys: that was up to a file an order."""
    from loomgraph.plans.graphs import order_files

    sf = "/root/testdata/sf0.001"
    files = order_files(spark, sf).groupBy("article").agg(F.count("*").alias("n"))
    assert files.agg(F.max("n")).first()[0] == 1
