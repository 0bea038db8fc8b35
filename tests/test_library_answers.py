import json
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from loomgraph.functions import canonical as C
from loomgraph.operators import answers as A
from loomgraph.operators import library as L
from loomgraph.sources.artefacts import cid_of


def test_texts_and_numbers_as_json_dumps(spark):
    texts = ["", "plain", 'q " \\ /', "a\nb\r\t\b\f", "\x00\x1f\x7f", "é ü 漢", "😀 x", "퟿￿", None, " ", "~}|"]
    got = [r.j for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.value(F.col("t"), S.StringType()).alias("j")).collect()]
    assert got == [json.dumps(t) for t in texts]
    rng = random.Random(1)
    xs = [0.0, -0.0, 1.0, -1.5, 0.1, 100.0, 123456789.0, 1e15, 1e16, 1.5e16, 123456789012345680.0, 1e-4, 1e-5, 1.25e-7, 2.3e-308, 1.7976931348623157e308, math.inf, -math.inf, math.nan, 1 / 3, 2e22, 9999999.0, 1e7, 12345678.9, 0.001, 0.00123]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 15) for _ in range(5000)]
    got = [r.j for r in spark.createDataFrame([(x,) for x in xs], "x double").select(C.value(F.col("x"), S.DoubleType()).alias("j")).collect()]
    bad = [(g, json.dumps(x)) for g, x in zip(got, xs) if g != json.dumps(x)]
    assert not bad, bad
    xs = [rng.uniform(-1, 1) * 10 ** rng.randint(16, 300) for _ in range(2000)]
    got = [r.j for r in spark.createDataFrame([(x,) for x in xs], "x double").select(C.value(F.col("x"), S.DoubleType()).alias("j")).collect()]
    assert [json.loads(g) for g in got] == xs and sum(g != json.dumps(x) for g, x in zip(got, xs)) < 20


def test_nested_rows_and_ids(spark):
    shape = "b struct<z:int,a:array<string>>, a map<string,struct<n:double,ok:boolean>>, `c d` array<array<long>>, e string"
    rows = [((1, ["x", None, "é"]), {"k2": (1.0, True), "k1": None, "é": (0.5, False)}, [[1, 2], [], None], "t"), ((None, []), {}, [], None), (None, None, None, "")]
    df = spark.createDataFrame(rows, shape)

    def plain(r):
        b, a, c, e = r
        return {"b": None if b is None else {"z": b[0], "a": b[1]}, "a": None if a is None else {k: None if v is None else {"n": v[0], "ok": v[1]} for k, v in a.items()}, "c d": c, "e": e}

    want = [json.dumps(plain(r), sort_keys=True) for r in rows]
    out = C.with_cid(df.select("*", C.row(df).alias("j")), ["a", "b", "c d", "e"]).collect()
    assert [r.j for r in out] == want and [r.cid for r in out] == [cid_of(w) for w in want]
    with pytest.raises(TypeError):
        C.value(F.col("x"), S.BinaryType())


def test_change_log(spark, tmp_path):
    rows = [(1, "class", "A", None, "one"), (2, "class", "A", None, "two"), (3, "class", "A", True, None), (5, "class", "A", None, "three"), (1, "prefix", "ex", None, None), (1, "example", "A", None, "e1"), (2, "example", "A", None, "e2"), (4, "example", "A", True, None), (5, "example", "A", None, "e3"), (1, "odd", "A", None, "x"), (1, "class", None, None, "x"), (None, "class", "B", None, "x")]
    changes = spark.createDataFrame(rows, "version long, kind string, key string, removed boolean, label string")
    L.append(None, changes, str(tmp_path / "log"))
    L.append(None, changes.where("version = 5"), str(tmp_path / "log"))  # the same change again
    log = spark.read.parquet(str(tmp_path / "log"))
    held = lambda v: list((r.kind, r.key, r.label) for r in L.snapshot(log.distinct(), v).collect())
    assert sorted(map(str, held(1))) == sorted(map(str, [("class", "A", "one"), ("example", "A", "e1"), ("prefix", "ex", None)]))
    assert sorted(map(str, held(2))) == sorted(map(str, [("class", "A", "two"), ("example", "A", "e1"), ("example", "A", "e2"), ("prefix", "ex", None)]))
    assert sorted(map(str, held(4))) == sorted(map(str, [("prefix", "ex", None)]))
    assert sorted(map(str, held(None))) == sorted(map(str, [("class", "A", "three"), ("example", "A", "e3"), ("prefix", "ex", None)]))
    assert L.snapshot(log, 0).count() == 0


def test_probe_and_prefixes(spark):
    held = spark.createDataFrame([("class", "http://x/A", 1, None, None, None, None, None, None), ("property", "http://x/A", 1, "p", None, None, None, None, None), ("property", "http://x/p", 1, "lp", "d", None, "D", None, None)], "kind string, key string, version long, " + L.ENTRY)
    uris = spark.createDataFrame([(0, "http://x/A"), (1, "http://x/p"), (2, "http://x/none"), (3, None), (4, "http://x/A")], "ord int, uri string")
    got = sorted(tuple(r) for r in L.probe(uris, "uri", held).collect())
    a = ("http://x/A", "class", "A", "No description", None, None)
    assert got == [(0, *a), (1, "http://x/p", "property", "lp", "d", "D", "Any"), (4, *a)]
    known = [(0, "m", "http://m."), (1, "h", "http://"), (2, "u", "urn:ü"), (3, "x", "http://m.x/"), (4, "owl", "o:"), (5, "e", "")]
    p = spark.createDataFrame(known[:5], "ord int, prefix string, ns string")
    urls = ["http://m.x/1", "http://y", "urn:üa", "urn:u", "", None, "http://m.x/1"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    want = sorted(((u, next((n for _, n, ns in known[:5] if u is not None and u.startswith(ns)), None)) for u in urls), key=str)
    assert sorted((tuple(r) for r in L.first_prefix(df, "u", p).collect()), key=str) == want
    assert L.prefix_block(df, "u", p).first().block == "@prefix h: <http://> .\n@prefix m: <http://m.> .\n@prefix owl: <o:> .\n@prefix u: <urn:ü> ."
    assert L.first_prefix(df, "u", spark.createDataFrame(known[5:], "ord int, prefix string, ns string")).where("u is not null and prefix is null").count() == 0


def test_answers(spark):
    good = {"entities": [{"id": "e1", "label": "A", "type": "T", "extra": 1}, {"id": "e2", "label": "B", "type": "T", "description": "d"}], "relations": [{"source": "e1", "target": "e2", "type": "knows"}]}
    rows = [
        (1, json.dumps(good)), (2, "Sure:\n```json\n" + json.dumps(good) + "\n```\nDone."), (3, "no json"), (4, None), (5, "[1, 2]"),
        (6, json.dumps({"entities": [{"id": "e1", "label": 3, "type": " "}, "x", {"id": "e2", "label": "B", "type": "T", "description": 1}, None], "relations": {"source": "a"}})),
        (7, "{}"), (8, json.dumps({"entities": None, "relations": [{"source": "a", "target": None, "type": "t"}]})), (9, '{"entities": [{"id": "e1"'),
    ]
    got = {r.id: r for r in A.parse(spark.createDataFrame(rows, "id int, a string"), "a").collect()}
    for i in (1, 2):
        assert [tuple(x) for x in got[i].entities] == [("e1", "A", "T", None), ("e2", "B", "T", "d")]
        assert [tuple(x) for x in got[i].relations] == [("e1", "e2", "knows", None)] and got[i].errors == [] and got[i].corrupt is None
    assert [got[i].corrupt for i in (3, 4, 5, 9)] == ["no json", None, "[1, 2]", '{"entities": [{"id": "e1"']
    assert all(got[i].entities == [] and got[i].relations == [] for i in (3, 4, 5, 7, 9))
    assert got[6].entities == [] and got[6].errors == ["entities[0].label: a text expected, not bigint", "entities[0].type: empty", "entities[1]: an object expected", "entities[2].description: a text expected, not bigint", "entities[3]: an object expected", "relations: a list expected"]
    assert got[7].errors == [] and got[8].errors == ["relations[0].target: missing"]
