import pytest
from pyspark.sql import functions as F

from loomgraph.operators import turtle as T

XSD, RDF = T.XSD, T.RDF


def test_parse_forms():
    text = """# comment
@prefix ex: <http://x/> .
PREFIX : <http://d/>
@base <http://b/dir/file> .
ex:a a ex:C , :D ; ex:p "q \\"x\\" \\u00e9\\n" , 'one'@en-GB , \"\"\"long "text"
line\"\"\" , "5"^^ex:n ;; ex:q 1 , -2.5 , 1e3 , true , <rel#f> , <> ; .
[ ex:p [ ex:q _:n1 ] ] .
[] ex:list ( 1 ex:b () ) .
_:n1 ex:p ex:a%20b , ex:c\\,d , ex:e.f .
<http://x/z> <http://x/p> ex: ."""
    a, p, q = "<http://x/a>", "<http://x/p>", "<http://x/q>"
    want = [
        (a, f"<{RDF}type>", "<http://x/C>"), (a, f"<{RDF}type>", "<http://d/D>"),
        (a, p, '"q \\"x\\" é\\n"'), (a, p, '"one"@en-gb'), (a, p, '"long \\"text\\"\\nline"'), (a, p, '"5"^^<http://x/n>'),
        (a, q, f'"1"^^<{XSD}integer>'), (a, q, f'"-2.5"^^<{XSD}decimal>'), (a, q, f'"1e3"^^<{XSD}double>'), (a, q, f'"true"^^<{XSD}boolean>'), (a, q, "<http://b/dir/rel#f>"), (a, q, "<http://b/dir/file>"),
        ("_:g2", q, "_:ln1"), ("_:g1", p, "_:g2"),
        ("_:g4", f"<{RDF}first>", f"<{RDF}nil>"), ("_:g4", f"<{RDF}rest>", f"<{RDF}nil>"), ("_:g5", f"<{RDF}first>", "<http://x/b>"), ("_:g5", f"<{RDF}rest>", "_:g4"),
        ("_:g6", f"<{RDF}first>", f'"1"^^<{XSD}integer>'), ("_:g6", f"<{RDF}rest>", "_:g5"), ("_:g3", "<http://x/list>", "_:g6"),
        ("_:ln1", p, "<http://x/a%20b>"), ("_:ln1", p, "<http://x/c,d>"), ("_:ln1", p, "<http://x/e.f>"),
        ("<http://x/z>", p, "<http://x/>"),
    ]
    assert T.parse(text) == want
    assert T.parse("") == T.parse(None) == T.parse("# only a comment") == []


@pytest.mark.parametrize(
    ("text", "line", "reason"),
    [
        ("ex:a ex:b ex:c .", 1, "prefix 'ex:' isn't declared"),
        ("@prefix ex: <http://x/> .\nex:a ex:b", 2, "a term expected at the end"),
        ("@prefix ex: <http://x/> .\n\nex:a ex:b ex:c", 3, "'.' expected at the end"),
        ("@prefix ex: <http://x/>\nex:a ex:b ex:c .", 2, "'.' expected, not 'ex:a'"),
        ("<a> <b> \"open .\n", 1, "unexpected '\"open .\\n'"),
        ("<a> <b> [ <c> <d> .", 1, "']' expected, not '.'"),
        ("This is prose {random json maybe?}", 1, "a term expected, not 'This'"),
        ('"x" <b> <c> .', 1, "a literal can't be a subject"),
        ("<a> \"x\" <c> .", 1, "an IRI expected, not '\"x\"'"),
        ('<a> <b> "\\x" .', 1, "bad escape \\x"),
        ("<a> <b> " + "[ <c> " * 300 + "<d>", 1, "nested deeper than 200"),
        ("<a> <b> <c> .\n<a b> <b> <c> .", 2, "unexpected '<a b> <b> <c> .'"),
    ],
)
def test_parse_failures(text, line, reason):
    with pytest.raises(T.TurtleError) as e:
        T.parse(text)
    assert (e.value.line, e.value.reason) == (line, reason)


def test_quoted_round_trip():
    for s in ("", 'a "b" \\ c', "x\ny\r\tz", "ünï", "\\u0041", "'''", '"""'):
        lit = T.quoted(s)
        assert T.parse(f"<a> <b> {lit} .") == [("<a>", "<b>", lit)]


def test_read_frame(spark):
    rows = [(1, "<a> <b> <c>, <d> .", 9, "n"), (2, "oops", 9, "n"), (3, None, 9, None), (4, "", 9, "n"), (1, "<a> <b> <c>, <d> .", 9, "n"), (5, "<a> <b> <c> .\n" * 50_000 + "x", 9, "n"), (6, "<a> <b> <c> .\n" * 50_000, 9, "n")]
    got = T.read(spark.createDataFrame(rows, "id int, turtle string, S int, error string"))
    assert got.columns == ["id", "S", "error", "ord", "s_", "p", "o", "line", "error_"]
    small = sorted(map(tuple, got.where("id < 6").collect()), key=str)
    want = [(1, 9, "n", 0, "<a>", "<b>", "<c>", None, None), (1, 9, "n", 1, "<a>", "<b>", "<d>", None, None)] * 2
    want += [(2, 9, "n", None, None, None, None, 1, "a term expected, not 'oops'"), (5, 9, "n", None, None, None, None, 50_001, "a term expected, not 'x'")]
    assert small == sorted(want, key=str)
    assert got.where("id = 6").agg(F.count("*"), F.max("ord")).first()[:] == (50_000, 49_999)
    assert T.read(spark.createDataFrame([], "turtle string")).count() == 0


def test_sql_function(spark):
    spark.udtf.register("turtle_triples", T.turtle_triples)
    got = spark.sql("SELECT id, s, p, o, line, error FROM VALUES (1, '<a> <b> <c> .'), (2, 'x'), (3, cast(null as string)) AS f(id, v), LATERAL turtle_triples(v)").collect()
    assert sorted(map(tuple, got)) == [(1, "<a>", "<b>", "<c>", None, None), (2, None, None, None, 1, "a term expected, not 'x'")]


def test_written_file_is_read(spark, tmp_path):
    head = T.header(F.col("title"), F.lit("https://x/Y"), F.lit("CC BY-SA 4.0"), F.lit("now"))
    files = spark.createDataFrame([("A b", "<#a> schema:name \"x\" .")], "title string, body string").select("title", F.concat(head, F.col("body")).alias("value"))
    assert files.first().value.split("\n")[5] == "@prefix schema: <https://schema.org/> ."
    T.save(files, "title", str(tmp_path / "out"))
    back = spark.read.text(f"{tmp_path}/out", wholetext=True)
    assert [r[1:4] for r in map(tuple, T.read(back.withColumnRenamed("value", "turtle")).drop("title").select("ord", "s", "p", "o").collect())] == [("<https://x/Y#a>", "<https://schema.org/name>", '"x"')]


def test_valid(spark):
    df = spark.createDataFrame([("@prefix ex: <http://x/> .\nex:a ex:b ex:c .",), ("ex:a ex:b ex:c .",), ("prose",), (None,)], "v string")
    assert [r.ok for r in df.select(T.is_valid(F.col("v")).alias("ok")).collect()] == [True, False, False, True]
