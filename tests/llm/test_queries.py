"""The registered queries at sf0.001, against their SQL or plain code."""

import itertools
import os
import random

import pytest

from loomgraph.llm import html_extract, mixing, packing, registry, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def documents(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def n_words(text):
    return len((text or "").encode().split())


def test_op1(spark):
    rows = packing.op1(spark, SF).collect()
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for d, t, _ in documents(spark):
        own = sorted(by_doc[d], key=lambda r: r.piece)
        assert sum(r.n_words for r in own) == n_words(t) and [r.piece for r in own] == list(range(len(own)))
        assert all(r.n_words == max(packing.CAPACITIES) for r in own[:-1])
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        ends = list(itertools.accumulate(r.n_words for r in own))
        assert [r.offset for r in own] == [0, *ends[:-1]]
        assert {r.capacity for r in own} == {min(c for c in packing.CAPACITIES if c >= ends[-1])}


def best(sizes, caps, overhead):
    """The least cost of any packing, by putting the sizes into bins one after the other."""

    def put(i, bins):
        if i == len(sizes):
            return sum(min(c for c in caps if c >= b) + overhead for b in bins)
        out = put(i + 1, [*bins, sizes[i]])
        for k, b in enumerate(bins):
            if b + sizes[i] <= max(caps) and b not in bins[:k]:
                out = min(out, put(i + 1, [*bins[:k], b + sizes[i], *bins[k + 1 :]]))
        return out

    return put(0, [])


def test_packing_against_every_packing():
    rng = random.Random(6)
    ratio = []
    for _ in range(150):
        caps, overhead = tuple(sorted(rng.sample(range(4, 30), rng.choice([1, 2, 3])))), rng.choice([0, 1, 4])
        sizes = [rng.randint(1, max(caps)) for _ in range(rng.randint(1, 7))]
        where, offset, final = packing.pack(sizes, caps, overhead)
        used = [sum(n for n, b in zip(sizes, where) if b == k) for k in range(len(final))]
        assert all(c in caps and u <= c and c == min(x for x in caps if x >= u) for u, c in zip(used, final))
        least = best(sorted(sizes, reverse=True), caps, overhead)
        assert packing.cost(final, overhead) >= least
        ratio.append(packing.cost(final, overhead) / least)
    assert max(ratio) < 1.6 and sum(ratio) / len(ratio) < 1.03


def test_op8(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html_extract.op8(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    assert all((r.url, r.text, r.n_chars) == (pages[r.page_id].url, html_extract.main_text(pages[r.page_id].html), len(r.text)) for r in got)


def test_op9(spark):
    docs = documents(spark)
    fps = {d: simhash.fingerprint(t) for d, t, _ in docs}
    up = {d: d for d in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9(spark, SF).collect()}
    assert got == {d: (f"{fps[d]:016x}", find(d)) for d in fps}


def test_op10(spark):
    docs, by = {d: (t, s) for d, t, s in documents(spark)}, {}
    rows = mixing.op10(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        t, s = docs[r.doc_id]
        assert r["size"] == n_words(t) and r.source == s and r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
        by.setdefault(s, []).append(r)
    order = sorted((s for s in by if s is not None)) + [s for s in by if s is None]
    weight, size = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {s: sum(r["size"] for r in by[s]) for s in order}
    full, total = {}, sum(size.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > 3 * size[s]]
        if not over:
            break
        full |= {s: 3 * size[s] for s in over}
    for s in order:
        target = full.get(s, level * weight[s])
        assert {r.source_size for r in by[s]} == {size[s]} and all(abs(r.target - target) < 1e-6 * max(1, target) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target) <= max(r["size"] for r in by[s])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op10(spark, SF).collect()))
