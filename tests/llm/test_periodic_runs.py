import os
import random
import zlib
from hashlib import sha256

import pytest

from loomgraph.llm import periodic_runs as P

SF = "/root/testdata/sf0.001"


def brute(s, shortest=6, least=4):
    """Every stretch that keeps a period and that no neighbour extends, with its smallest period."""
    out = {}
    for p in range(1, len(s) // least + 1):
        i = 0
        while i + p < len(s):
            a = i
            while i + p < len(s) and s[i] == s[i + p]:
                i += 1
            if i > a and i + p - a >= max(shortest, least * p):
                out.setdefault((a, i + p - a), p)
            i += i == a
    return sorted((a, n, p) for (a, n), p in out.items() if all(s[k] != s[k + q] for q in range(1, p) for k in [next((k for k in range(a, a + n - q) if s[k] != s[k + q]), a)]))


def planted(rng, n, k):
    s = [rng.randrange(k) for _ in range(n)]
    if n > 8 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 4))
        for i in range(a, n):
            s[i] = s[a + (i - a) % p]
    return s


def test_runs_by_brute_force():
    rng = random.Random(3)
    for _ in range(4000):
        s = planted(rng, rng.randint(0, 50), rng.choice([1, 2, 2, 3, 5]))
        assert P.runs(s) == brute(s)
        assert P.runs(s, 3, 3) == brute(s, 3, 3)
        w = [b"w%d" % x for x in s]
        assert P.text_runs(w) == brute(s)


def test_lyndon_edges():
    rng = random.Random(4)
    for _ in range(500):
        s = planted(rng, rng.randint(1, 30), 2)
        smaller, shared = P.lyndon(s)
        for i in range(len(s)):
            j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
            assert smaller[i] == j
            assert shared[i] == next((k for k in range(len(s) - j) if s[i + k] != s[j + k]), len(s) - j)


def test_hard_texts_take_little_time():
    """No quadratic time on texts that repeat themselves in many ways; Fibonacci words need the most, some log(n) / 2."""
    n = 40_000
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    blocks = [x for k in range(400) for x in [0] * k + [1]]
    for s in ([0] * n, b, blocks, list(range(500)) * 120, list(range(500, 0, -1)) * 120, [bin(i).count("1") & 1 for i in range(n)]):
        compared = 0

        class Item(int):
            def __eq__(self, other):
                nonlocal compared
                compared += 1
                return int(self) == int(other)

            __hash__ = int.__hash__

        P.lyndon([Item(x) for x in s])
        assert compared < 9 * len(s)


def test_collapse():
    w = b"a b a b a b a b c c c c c c c d".split()
    found = P.text_runs(w)
    assert found == [(0, 8, 2), (8, 7, 1)]
    assert b" ".join(P.collapse(w, found)) == b"a b c d"
    # a run inside a longer period's run: a word that any run drops is dropped
    w = (b"x " * 6 + b"y ").split() * 5
    kept = set(range(len(w)))
    for a, n, p in brute(w):
        kept -= set(range(a + p, a + n))
    assert P.collapse(w, P.text_runs(w)) == [w[i] for i in sorted(kept)]


def test_find_defined_results(spark):
    long = "x " * 5 + "one two three " * 100_000
    rows = [(1, None, 7), (2, "", 7), (3, " \t\n\x0b\f\r", 7), (4, "go " * 6, 7), (4, "go " * 6, 7), (None, "a b " * 4, 7), (5, long, None), (6, "ü\u00a0ü " * 6, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, RUNS int")
    x, n, r, c = P.find(df)
    assert (n, r, c) == ("n_words", "runs_", "collapsed") and x.columns[:3] == df.columns
    got = [(v.doc_id, v.n_words, [tuple(t) for t in v.runs_], v.collapsed, v.RUNS) for v in x.collect()]
    want = [(1, 0, [], "", 7), (2, 0, [], "", 7), (3, 0, [], "", 7), *[(4, 6, [(0, 6, 1)], "go", 7)] * 2, (None, 8, [(0, 8, 2)], "a b", 7), (5, 300_005, [(5, 300_000, 3)], "x " * 5 + "one two three", None), (6, 6, [(0, 6, 1)], "ü\u00a0ü", 7)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert P.find(df.limit(0))[0].count() == 0


def expected(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    # a period of a run is at most a quarter of its length, which a word's places bound
    often = {x for x in set(w) if w.count(x) >= 4}
    r, i = [], 0
    while i < n:
        j = i
        while j < n and w[j] in often:
            j += 1
        r += [(i + a, k, p) for a, k, p in brute(w[i:j])]
        i = j + 1
    kept = [True] * n
    for a, k, p in r:
        kept[a + p : a + k] = [False] * (k - p)
    best = min(r, key=lambda v: (-v[1], v[0], v[2])) if r else (None, None, None)
    digest = lambda b: sha256(b).hexdigest()
    return (doc_id, len(r), *best, 1000 * best[1] // best[2] if r else None, digest("".join(f"{a},{k},{p}\n" for a, k, p in sorted(r)).encode()), digest(b" ".join(x for x, y in zip(w, kept) if y)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_op12_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = P.op12(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        if len((t or "").split()) < 3000:
            assert got[d] == expected(d, t)


def test_op12_odd_rows(spark, tmp_path):
    damaged = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(damaged, "a b c d e f g h i j k l m n o p q r s t"), (damaged, None), (damaged, "one"), (None, "a " * 9), (1001, "a  b\u2003c " * 8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, P.op12(spark, str(tmp_path)).collect()), key=str) == sorted((expected(*r) for r in rows), key=str)
