import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import patterns as P
from loomgraph.operators import traversal as V


def walk(edges, starts, most=None):
    """Depth and least shortest path of each node, by plain search."""
    out = {}
    for r in starts:
        front, seen, d = {r: [r]}, {r: (0, [r])}, 0
        while front and (most is None or d < most):
            d += 1
            step = {}
            for u, path in front.items():
                for a, b in edges:
                    if a == u and b not in seen:
                        step[b] = min(step.get(b, [*path, b]), [*path, b])
            front = step
            seen |= {v: (d, p) for v, p in front.items()}
        out |= {(r, v): x for v, x in seen.items()}
    return out


def reached(df):
    return {(r.root, r.node): (r.depth, *([list(r.path)] if "path" in df.columns else [])) for r in df.collect()}


def test_reach_by_plain_search(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)] + [(0, 0), (1, 2), (2, 1), (1, 2)]
    starts = [0, 1, 7, 7, 99]
    e = spark.createDataFrame([*edges, (None, 1), (1, None)], "u int, v int")
    s = spark.createDataFrame([(x,) for x in [*starts, None]], "u int")
    assert reached(V.reach(e, s, paths=True)) == walk(edges, set(starts))
    assert reached(V.reach(e, s, 2)) == {k: (d,) for k, (d, _) in walk(edges, set(starts), 2).items()}


def test_reach_long_chain_cycle_and_empty(spark):
    n = 25
    e = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % n}") for i in range(n)], "u string, v string")
    got = reached(V.reach(e, spark.createDataFrame([("n0",)], "u string")))
    assert got == {("n0", f"n{i}"): (i,) for i in range(n)}
    none = spark.createDataFrame([], "u string")
    assert V.reach(e, none, paths=True).count() == 0
    assert reached(V.reach(e.where("false"), spark.createDataFrame([("x",)], "u string"))) == {("x", "x"): (0,)}


def solve(triples, patterns, optional=()):
    """Solutions as sets of bindings, pattern by pattern."""
    made = []

    def extend(rows, group):
        for pattern in P.flatten(group, made):
            out = []
            for b in rows:
                for t in triples:
                    c, ok = dict(b), True
                    for term, v in zip(pattern, t):
                        if v is None:
                            ok = False
                        elif term.startswith("?"):
                            ok &= c.setdefault(term, v) == v
                        else:
                            ok &= term == v
                    if ok:
                        out.append(c)
            rows = out
        return rows

    rows = extend([{}], patterns)
    for g in optional:
        rows = [c for b in rows for c in (extend([b], g) or [b])]
    names = sorted({v for g in [patterns, *optional] for p in P.flatten(g, []) for v in p if v.startswith("?") and not v.startswith("?_b")})
    shown = [tuple(b.get(n) for n in names) for b in {tuple(sorted(b.items())): b for b in rows}.values()]
    return [n[1:] for n in names], sorted(shown, key=str)


def graph(rng, n, annotated=False):
    out = set()
    while len(out) < n:
        out.add((rng.choice("abcdef"), rng.choice("pqrs"), rng.choice("abcxyz")))
    return [(*t, f"t{i}") if annotated else t for i, t in enumerate(sorted(out))]


CASES = [
    ([("?a", "p", "?b")], []),
    ([("?a", "p", "?b"), ("?a", "q", "?c"), ("?a", "r", "x")], []),
    ([("?a", "p", "?a")], []),
    ([("?a", "p", "?b"), ("?a", "q", "?b")], []),
    ([("?a", "p", "?b"), ("?b", "q", "?c"), ("?b", "r", "?d")], []),
    ([("?a", "?p", "?b"), ("?b", "q", "?c")], []),
    ([("a", "p", "?b"), ("a", "q", "?c")], []),
    ([("?a", "p", [("q", "?c"), ("r", [("p", "?d")])])], []),
    ([("?a", "p", "?b")], [[("?a", "q", "?c")], [("?b", "r", "?d"), ("?b", "s", "?e")]]),
    ([("?a", "p", "?b"), ("?a", "q", "?c")], [[("?a", "r", "?d")], [("?a", "s", "?b2")]]),
    ([("?a", "p", "x"), ("?a", "p", "?b"), ("?a", "p", "y")], []),
    ([("?a", "none", "?b"), ("?a", "p", "?c")], []),
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("collected", [10_000, 1])
def test_solutions_by_extension(spark, monkeypatch, case, collected):
    """Also where no value may be collected, so that predicates of several values are joined."""
    monkeypatch.setattr(P, "COLLECTED", collected)
    patterns, optional = CASES[case]
    t = graph(random.Random(case), 60)
    df = spark.createDataFrame([*t, t[0], (None, "p", "x"), ("a", None, "x"), ("a", "p", None)], "s string, p string, o string")
    names, want = solve(t, patterns, optional)
    got = P.solutions(df, patterns, optional)
    assert sorted(got.columns) == names
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == want


def test_filters_annotations_and_stored_statistics(spark):
    base = [("s1", "p", "o1", "t1"), ("s2", "p", "o2", "t2"), ("s3", "p", "o3", "t3"), ("s4", "p", "o4", None)]
    notes = [("t1", "conf", "0.95", None), ("t1", "by", "m1", None), ("t2", "conf", "0.2", None), ("t2", "by", "m1", None), ("t3", "conf", "0.99", None), ("m1", "v", "2", None)]
    df = spark.createDataFrame(base + notes, "s string, p string, o string, t string")
    patterns = P.annotated("?s", "?p", "?o", [("conf", "?c"), ("by", "?by")])
    got = P.solutions(df, patterns, [[("?by", "v", "?v")]], ["cast(?c as double) >= 0.9"], P.statistics(df))
    assert [tuple(r) for r in got.select("s", "p", "o", "c", "by", "v", "_t").collect()] == [("s1", "p", "o1", "0.95", "m1", "2", "t1")]
    # a filter on an optional variable sees its null
    got = P.solutions(df, [("?t", "conf", "?c")], [[("?t", "by", "?by")]], ["?by is null"])
    assert [tuple(r) for r in got.select("t", "c").collect()] == [("t3", "0.99")]


def test_bad_patterns(spark):
    df = spark.createDataFrame([("a", "p", "b")], "s string, p string, o string")
    for patterns, optional, filters in [([("?a", "p", "?b"), ("?x", "p", "?y")], [], []), ([("?a", "p", "?b")], [[("?x", "p", "?y")]], []), ([("a", "p", "b")], [], []), ([("?a", "p", "?b")], [], ["?z > 1"])]:
        with pytest.raises(ValueError):
            P.solutions(df, patterns, optional, filters)


def test_a_star_is_one_shuffle(spark):
    t = graph(random.Random(1), 50)
    df = spark.createDataFrame(t, "s string, p string, o string")
    stats = spark.createDataFrame([(p, 20, 1) for p in "pqrs"], "p string, n long, most long")
    plan = P.solutions(df, [("?a", "p", "?b"), ("?a", "q", "?c"), ("?a", "r", "?d")], [[("?a", "s", "?e")]], stats=stats)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 0 and plan.count("HashAggregate") + plan.count("SortAggregate") == 2


def test_keyed_rows_answer_as_triples(spark, monkeypatch):
    """Unique and repeated keys, nulls, given values and optional parts; no star is an aggregate over exploded triples."""
    patterns = [("?m", "who", "?p"), ("?m", "org", "?o"), ("?m", "during", "?i"), ("?i", "from", [("day", "?a")])]
    cases = [(patterns, [[("?i", "to", [("day", "?z")])]]), (patterns, [[("?m", "role", "?r")]]), ([("?m", "role", "x"), ("?m", "who", "?p")], []), ([("?b", "day", "?d")], []), ([("m1", "who", "?p"), ("m1", "org", "?o")], [])]
    for n, chosen in ((6, cases[:2]), (24, cases)):
        rows = spark.createDataFrame([(i % 6 if i % 7 else None, i % 4, i % 5 if i % 5 else None, "xy"[i % 2], i % 3) for i in range(1, n)], "k int, p int, o int, r string, d int")
        c = lambda h, n="k": F.concat(F.lit(h), F.col(n).cast("string"))
        keyed = [
            P.Keyed(rows, "m", ("k",), (("who", c("p", "p")), ("org", c("o", "o")), ("role", F.col("r")), ("during", c("i")))),
            P.Keyed(rows, "i", ("k",), (("from", c("_:b")), ("to", F.when(F.col("p") > 1, c("_:e"))))),
            P.Keyed(rows, "_:b", ("k",), (("day", F.col("d")),)), P.Keyed(rows, "_:e", ("k",), (("day", F.col("d") + 5),)),
        ]
        g = P.Graph(keyed)
        for need, maybe in chosen:
            want = P.solutions(g.triples, need, maybe)
            with monkeypatch.context() as m:
                m.setattr(P.Star, "solve", None)
                got = P.solutions(g, need, maybe)
            assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect())), (n, need, maybe)
    both = P.Graph(keyed[:1], spark.createDataFrame([("m1", "who", "p9")], "s string, p string, o string"))
    got = P.solutions(both, [("?m", "who", "?p"), ("?m", "org", "?o")])
    assert ("m1", "p9") in {(r.m, r.p) for r in got.collect()} and got.count() == P.solutions(both.triples, [("?m", "who", "?p"), ("?m", "org", "?o")]).count()


def test_linked_stars_are_one_aggregate(spark):
    """Unique and repeated keys, nulls, conditions of links, optional parts, chosen variables: as the triples, without a join."""
    need = [("?m", "who", "?p"), ("?m", "org", "?o"), ("?m", "during", "?i"), ("?i", "from", [("day", "?a")])]
    end = ("?i", "to", [("day", "?z")])
    cases = [
        ([*need, end], [], [], None), (need, [[end]], [], None), (need, [[end], [("?m", "role", "?r")]], ["?z is null or ?z > '5'"], ["m", "o", "a", "z", "r"]), (need, [[end]], ["?a > '0'"], ["o", "z"]),
        (need, [[end]], [], ["m", "p"]), ([*need, ("?m", "role", "x")], [[("?i", "none", "?x")]], [], None), ([*need, ("?p", "name", "?n")], [[end]], [], None), ([("?i", "from", "?b"), ("?b", "day", "?a")], [], [], None),
        ([("?m", "during", "?i"), ("?m", "who", "?p"), ("?i", "to", "?e")], [[("?e", "day", "?z")], [("?p", "name", "?n")]], [], None), ([("?m", "during", "?i"), ("?i", "from", "?b"), ("?b", "day", "?p"), ("?m", "who", "?p")], [], [], None),
    ]
    for n in (6, 24):
        rows = spark.createDataFrame([(i % 6 if i % 7 else None, i % 4, i % 5 if i % 5 else None, "xy"[i % 2], i % 3) for i in range(1, n)], "k int, p int, o int, r string, d int")
        c = lambda h, n: F.concat(F.lit(h), F.col(n).cast("string"))
        keyed = [
            P.Keyed(rows, "m", ("k",), (("who", c("p", "p")), ("org", c("o", "o")), ("role", F.col("r")), ("during", P.Link("i")))),
            P.Keyed(rows, "i", ("k",), (("from", P.Link("_:b")), ("to", P.Link("_:e", F.col("p") > 1)))),
            P.Keyed(rows, "_:b", ("k",), (("day", F.col("d")),)), P.Keyed(rows, "_:e", ("k",), (("day", F.when(F.col("p") > 1, F.col("d") + 5)),)),
        ]
        for names in (None, spark.createDataFrame([("p1", "name", "one"), ("p2", "name", "two"), ("p2", "name", "zwei")], "s string, p string, o string")):
            g = P.Graph(keyed, names)
            for patterns, maybe, filters, only in cases[:: 1 if names is None and n == 24 else 6]:
                want = P.solutions(g.triples, patterns, maybe, filters)
                want = want if only is None else want.select(only).distinct()
                got = P.solutions(g, patterns, maybe, filters, only=only)
                assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect())), (n, patterns, maybe, only)


def test_memberships_are_read_in_one_shuffle(spark):
    """Neither joins nor a last shuffle for what is alike: a key has its solutions in one place."""
    from loomgraph.plans import graphs

    for q in (graphs.membership_periods, graphs.membership_open):
        df = q(spark, "/root/testdata/sf0.01")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange ") == 1, plan
