import random

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import chunks as C
from loomgraph.operators import graph as G
from loomgraph.operators import runs as R
from loomgraph.sources import readers

META = {"url": "u", "fetched_at": "f", "license": "l", "license_url": "lu", "attribution": "a", "registry": "{}", "generated_by": "g", "generated_at": "n"}


def articles(spark, rows):
    return spark.createDataFrame(rows, "title string, content string").select("title", "content", *[F.lit(v).alias(k) for k, v in META.items()])


def chunks(df):
    return sorted((r.title, r.chunk_num, r.section_context, r.text, r.saved) for r in df.collect())


def test_sample_run_resumes(spark, tmp_path):
    text = lambda n: "\n== Part ==\n".join(f"This is paragraph {i} of text number {n}, long enough to be kept as a chunk." for i in range(4))
    rows = [("A b/c", text(1)), ("D", text(2)), ("Short", "too short"), ("E", text(3))]
    listed = spark.createDataFrame([(1, "A b/c"), (2, "D"), (3, "Short"), (4, "None")], "id long, title string")
    want = lambda t, x, s: [(t, i, c, p, s) for i, (p, c) in enumerate(C.chunk_text(t, x, 1500, 60))]
    first = R.sample_run(listed.where("id <> 2"), articles(spark, rows), str(tmp_path / "o"))
    assert chunks(first) == want("A b/c", rows[0][1], False)
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["a_b_c_chunks.ipynb"]
    # the article has changed since, but its notebook is there
    again = articles(spark, [("A b/c", text(9)), *rows[1:]])
    second = R.sample_run(listed, again, str(tmp_path / "o"), readers.notebook_cells(spark, f"{tmp_path}/o/*.ipynb"))
    assert chunks(second) == sorted(want("A b/c", rows[0][1], True) + want("D", rows[1][1], False))
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["a_b_c_chunks.ipynb", "d_chunks.ipynb"]


def test_rdf_run(spark, tmp_path):
    facts = spark.createDataFrame([(1, "- one\n- two"), (2, "- same\n"), (3, "# Error: x\n- no"), (4, None), (5, "prose")], "chunk int, facts string")
    s = {r.stmt_key: r.cid for r in R.statements_of(facts).collect()}
    assert sorted(s) == ["1_1", "1_2", "2_1"]
    old = spark.createDataFrame([(2, "2_1", s["2_1"], "kept"), (1, "1_1", s["1_1"], "goes"), (9, "9_1", "x", "no source")], "chunk int, stmt_key string, from_cid string, content string")

    def make(rows):
        t = rows.where("stmt_idx = 1").select("chunk", "stmt_key", F.lit("a").alias("s"), F.lit("b").alias("p"), F.lit("c").alias("o"), F.lit(0).alias("ord"))
        return t.unionByName(t.withColumn("ord", F.lit(3))).unionByName(t.withColumns({"o": F.lit("d"), "ord": F.lit(1)}))

    got = R.rdf_run(facts, old, make, str(tmp_path / "o"))
    assert got == {"processed": 2, "skipped": 1, "without": 1, "triples": 2, "errors": 1}
    cells = {r.stmt_key: (r.from_cid, r.content) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert cells == {
        "1_1": (s["1_1"], "# Statement [1.1]: one\na b c .\na b d .\n"), "1_2": (s["1_2"], "# Statement [1.2]: two\n# No triples emitted for this statement\n"),
        "2_1": (s["2_1"], "kept"), "9_1": ("x", "no source"),
    }


def test_facts_run(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "k int, text string")
    make = lambda rows: rows.select("k", F.when(F.col("k") == 3, "# Error: no").otherwise("- f").alias("content"))
    none = spark.createDataFrame([], "k int, from_cid string, content string")
    assert R.facts_run(chunks, none, make, str(tmp_path / "a"), ["k"]) == {"processed": 3, "skipped": 0, "errors": 1, "total": 4}
    old = spark.read.parquet(str(tmp_path / "a")).select("k", "from_cid", "content")
    assert R.facts_run(chunks, old, make, str(tmp_path / "b"), ["k"]) == {"processed": 0, "skipped": 4, "errors": 0, "total": 4}


def test_examples_and_fewshot(spark):
    c = spark.createDataFrame([(1, "a", "s", 0), (1, "b", "s", 1), (0, "z", "s", 0), (None, "z", "s", 0), (2, "c", "s", 0), (3, "d", "s", 0), (4, "e", "s", 0)], "chunk_num int, text string, section_context string, at int").withColumn("n", F.lit("x"))
    f = spark.createDataFrame([(1, ["p", "q"], 0), (1, ["r", "s"], 2), (0, ["p", "q"], 0), (None, ["p", "q"], 0), (2, ["one"], 0), (3, ["v"] * 51, 0), (4, ["v"] * 50, 0)], "chunk_num int, statements array<string>, at int").withColumn("n", F.lit("x"))
    got = sorted((r.chunk_num, r.text, r.statements[0], len(r.statements)) for r in R.examples(c, f, ["n"], "at").collect())
    assert got == [(1, "b", "r", 2), (4, "e", "v", 50)]
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 50), ("d", 51), ("e", 50), ("f", 7)], "k string, n int")
    assert [r.k for r in R.fewshot(rows, "k", "n", 3).collect()] == ["c", "e", "f"]
    assert [r.k for r in R.fewshot(rows, "k", "n", 3, rows.where("k = 'c'")).collect()] == ["e", "f", "b"]


def test_histograms_and_flags(spark):
    v = spark.createDataFrame([(1.0,), (2.0,), (11.0,), (None,)], "v double")
    assert {r.bin: r.n for r in R.histogram(v, "v", 10).collect() if r.n} == {0: 1, 1: 1, 9: 1}
    one = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert {r.bin: r.n for r in R.histogram(one, "v", 5).collect()} == {0: 4, 1: 0, 2: 0, 3: 0, 4: 0}
    assert sum(r.n for r in R.histogram(v.limit(0), "v", 5).collect()) == 0
    n = spark.createDataFrame([(x,) for x in (1, 5, 6, 10, 100, 101)], "n int")
    assert {r.bucket: r.n for r in R.iteration_buckets(n).collect()} == {"1-5": 2, "6-10": 2, "11-20": 0, "21-50": 0, "51-100": 1, "100+": 1}
    t = spark.createDataFrame([(1, "_:b", "schema:startDate", "x"), (2, "a", "rdfs:comment", "_:c"), (3, None, "schema:textual", "schema:Role")], "g int, s string, p string, o string")
    got = {r.g: [k for k, x in r.asDict().items() if x is True] for r in G.pattern_flags(t, ["g"]).collect()}
    assert got == {1: ["has_blank_node", "has_dates"], 2: ["has_blank_node", "has_comment"], 3: ["has_role", "has_text"]}


def test_one_link_of_each_label(spark):
    rng = random.Random(3)
    rows = [[(rng.choice("abc"), str(i)) for i in range(n)] for n in (0, 1, 5, 30)] + [None]
    df = spark.createDataFrame([(r,) for r in rows], "l array<struct<label:string,href:string>>")
    for last in (False, True):
        got = [r.v for r in df.select(T.one_of_each(F.col("l"), last).alias("v")).collect()]
        for links, found in zip(rows, got, strict=True):
            if links is None:
                assert found is None
                continue
            keep = {}
            for i, (k, h) in enumerate(links):
                if last or k not in keep:
                    keep[k] = (i, k, h)
            assert [tuple(x) for x in found] == [(k, h) for _, k, h in sorted(keep.values())]


def test_numbered_ranges(spark):
    """Clustered and negative numbers, texts, and nothing."""
    from loomgraph.operators import relational

    values = [*range(300), *range(10**15, 10**15 + 200), -5, 10**18]
    df = spark.createDataFrame([(v, str(v), "x") for v in values], "v long, t string, _range string").repartition(4)
    for order, key in (("v", lambda v: v), ("t", str)):
        got = {r.v: r.n for r in relational.numbered(df, order, "n", per=40).collect()}
        assert got == {v: i + 1 for i, v in enumerate(sorted(values, key=key))}
    assert relational.numbered(df.limit(0), "v", "n").count() == 0


def test_sample_run_cuts_once(spark, tmp_path):
    """The chunks that are returned are those written down, not cut again."""
    listed = spark.createDataFrame([(1, "Ada")], "id long, title string")
    got = R.sample_run(listed, articles(spark, [("Ada", "word " * 100)]), str(tmp_path / "o"), index=str(tmp_path / "i"))
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r.saved for r in got.collect()] == [False]
    back = readers.listed_cells(spark, str(tmp_path / "o"), str(tmp_path / "i"))
    again = R.sample_run(listed, articles(spark, [("Ada", "word " * 100)]), str(tmp_path / "o"), back)
    assert [(r.saved, r.text) for r in again.collect()] == [(True, got.first().text)]
