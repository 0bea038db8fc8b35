import numpy as np
import pyarrow as pa
import pytest

from loomgraph.operators import vectors as V


def data(n, dims, seed, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) if not clusters else rng.normal(size=(clusters, dims))[rng.integers(clusters, size=n)] + 0.4 * rng.normal(size=(n, dims))
    return [[float(np.float32(v)) for v in r] for r in x]


def brute(queries, terms, k, least, cosine):
    out = {}
    for qi, q in queries:
        found = []
        for ti, t in terms:
            a, b = np.array(q), np.array(t)
            n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
            if cosine and n == 0:
                continue
            s = float((a * b).sum())
            s = s / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum()) if cosine else s
            if least is None or s > least:
                found.append((-s, ti))
        out |= {(qi, r + 1): (ti, round(-s, 9)) for r, (s, ti) in enumerate(sorted(found)[:k])}
    return out


def ranked(df):
    return {(r.qid, r["rank"]): (r.tid, round(r.score, 9)) for r in df.collect()}


@pytest.mark.parametrize(("cosine", "least"), [(True, 0.0), (False, None), (True, None)])
def test_top_k_by_brute_force(spark, monkeypatch, cosine, least):
    monkeypatch.setattr(V, "QUERIES", 7)
    terms = list(enumerate(data(60, 8, 1)))
    terms += [(100 + i, terms[3][1]) for i in range(12)] + [(200, [0.0] * 8)]  # copies tie, a zero vector
    queries = list(enumerate(data(20, 8, 2))) + [(50, terms[3][1]), (51, [0.0] * 8)]
    t = spark.createDataFrame([*terms, (300, None), (301, [1.0, None] + [0.0] * 6)], "tid long, embedding array<float>").repartition(3)
    q = spark.createDataFrame(queries, "qid long, embedding array<float>")
    assert ranked(V.top_k(q, t, "qid", "tid", 5, least, cosine)) == brute(queries, terms, 5, least, cosine)
    assert V.top_k(q.limit(0), t, "qid", "tid").count() == V.top_k(q, t.limit(0), "qid", "tid").count() == 0


def test_groups_and_text_ids(spark):
    terms = list(enumerate(data(50, 4, 3)))
    t = spark.createDataFrame([(f"t{i:02d}", v, "ab"[i % 2]) for i, v in terms], "tid string, embedding array<double>, kind string")
    queries = list(enumerate(data(5, 4, 4)))
    q = spark.createDataFrame(queries, "qid long, embedding array<double>")
    got = {(r.kind, r.qid, r["rank"]): r.tid for r in V.top_k(q, t, "qid", "tid", 3, None, group="kind").collect()}
    for g in (0, 1):
        want = brute(queries, [(f"t{i:02d}", v) for i, v in terms if i % 2 == g], 3, None, True)
        assert {k[1:]: v for k, v in got.items() if k[0] == "ab"[g]} == {k: v[0] for k, v in want.items()}


def test_unequal_lengths_fail(spark):
    t = spark.createDataFrame([(1, [1.0, 2.0])], "tid long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0])], "qid long, embedding array<double>")
    with pytest.raises(Exception, match="unequal length"):
        V.top_k(q, t, "qid", "tid").collect()


def test_stored_index_recall_and_exactness(spark, tmp_path):
    vectors = data(3000, 16, 5, clusters=40)
    t = spark.createDataFrame(list(enumerate(vectors)), "tid long, embedding array<float>")
    V.build_index(t, "tid", str(tmp_path / "i"))
    blocks = spark.read.parquet(f"{tmp_path}/i/blocks")
    ids = [i for r in blocks.collect() for i in r.ids]
    assert sorted(ids) == list(range(3000)) and blocks.select("cell").distinct().count() > 20
    queries = [(i, vectors[i]) for i in range(0, 3000, 20)]
    q = spark.createDataFrame(queries, "qid long, embedding array<float>")
    exact = ranked(V.search(spark, str(tmp_path / "i"), q, "qid", "tid", 5))
    assert exact == ranked(V.top_k(q, t, "qid", "tid", 5)) == brute(queries, list(enumerate(vectors)), 5, 0.0, True)
    some = ranked(V.search(spark, str(tmp_path / "i"), q, "qid", "tid", 5, probes=8))
    want = {(k[0], v[0]) for k, v in exact.items()}
    assert len(want & {(k[0], v[0]) for k, v in some.items()}) >= 0.9 * len(want)


def test_index_of_nothing_and_of_one_vector(spark, tmp_path):
    t = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)] + [(9, [0.0, 0.0]), (10, None)], "tid long, embedding array<double>")
    V.build_index(t, "tid", str(tmp_path / "i"), cells=4)
    q = spark.createDataFrame([(1, [2.0, 0.0])], "qid long, embedding array<double>")
    assert [r.tid for r in V.search(spark, str(tmp_path / "i"), q, "qid", "tid", 3, probes=4).orderBy("rank").collect()] == [0, 1, 2]
    V.build_index(t.limit(0), "tid", str(tmp_path / "none"))
    assert V.search(spark, str(tmp_path / "none"), q, "qid", "tid").count() == 0


def test_slices_of_a_block(monkeypatch):
    """A block's queries are multiplied in slices, with the result of the whole."""
    rng = np.random.default_rng(3)
    q, t = rng.normal(size=(600, 5)), rng.normal(size=(90, 5))
    args = pa.array(range(600)), q, pa.array(range(90)), t, 4, 0.0
    sizes, whole = [], V.best_pairs
    monkeypatch.setattr(V, "best_pairs", lambda ids, m, *rest: sizes.append(len(m)) or whole(ids, m, *rest))
    for cosine in (True, False):
        assert V.sliced_pairs(*args, cosine) == whole(*args, cosine)
    assert max(sizes) <= 256 and sum(sizes) == 1200
