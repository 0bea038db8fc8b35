import os
import math
import zlib
from collections import Counter
from hashlib import sha256
from html.parser import HTMLParser

import pytest

from loomgraph.llm import html_extract, language_id, lm_scoring, media_columns, warc

SF = "/root/testdata/sf0.001"


def segmentations(text, weights, byte):
    if not text:
        return 1.0
    total = math.exp(sum(byte[b] for b in text[0].encode())) * segmentations(text[1:], weights, byte)
    for k in range(1, len(text) + 1):
        if text[:k] in weights:
            total += math.exp(weights[text[:k]]) * segmentations(text[k:], weights, byte)
    return total


def test_lattice_sums_all_segmentations():
    w = lm_scoring.arcs()
    lat = lm_scoring.Lattice(w)
    pieces = {k: v for k, v in w.items() if not k.startswith("<0x") and k != "</s>"}
    for word in ("the", "onth", "éa", "%%", "ß|x"):
        want = math.log(segmentations(lm_scoring.START + word, pieces, lat.byte))
        assert abs(lat.forward(word.encode()) - want) < 1e-9
        counts = Counter()
        lat.expect(word.encode(), counts)
        long = sum(x * (1 if p.startswith("<0x") else len(p.encode())) for p, x in counts.items())
        assert abs(long - len((lm_scoring.START + word).encode())) < 1e-9
    assert math.isfinite(lat.forward(b"x" * 5000))
    for word in (b"another", "é\udc80".encode("utf-8", "surrogatepass"), b"ab" * 15):
        direct, logs = Counter(), Counter()
        for got, uses in ((direct, lat.uses), (logs, lat.uses_log)):
            for piece, p in uses(word):
                got[piece] += p
        assert direct.keys() == logs.keys() and all(abs(direct[k] - logs[k]) < 1e-9 for k in logs)


@pytest.mark.parametrize("head", [3, 100_000])
def test_lm_base_and_edges(spark, head):
    texts = [(0, "a b a"), (1, "A c"), (2, None), (3, ""), (4, "zz a"), (4, "zz a"), (5, "q " * 3000)]
    rows = [(i, t, i not in (3, 4), "x") for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean, w string")
    c, ends = Counter(), 0
    for _, t, train, _ in rows:
        if train:
            c.update((t or "").lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    got = lm_scoring.score(docs, "train", head_words=head).collect()
    assert len(got) == len(rows)
    for r in got:
        w = (dict(texts)[r.key] or "").lower().split()
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
    assert lm_scoring.score(docs.limit(0), "train").count() == 0


def test_lm_groups_marginalise(spark):
    """Two groups against sums by hand; a text's own group has no say in its score."""
    rows = [(0, "a b a c", True, "x"), (1, "a a b", True, "x"), (2, "d e d", True, "y"), (3, "a f", True, None), (4, "a d", False, "x"), (5, "a d", False, "y"), (6, "unseen", False, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean, lang string")
    got = {r.key: r.score for r in lm_scoring.score(docs, "train", group="lang").collect()}
    c = {g: Counter(w for _, t, train, k in rows if train and k == g for w in t.split()) for g in ("x", "y", None)}
    every, ends = sum(c.values(), Counter()), 4
    own = lm_scoring.word_counts(docs.selectExpr("text", "cast(case when not train then -1 when lang = 'x' then 0 when lang = 'y' then 1 else 2 end as int) as g"), 3)
    lat = [lm_scoring.Lattice(w) for w in lm_scoring.fit(own, lm_scoring.arcs(), 3)]
    end = (ends + 0.5) / (every.total() + ends + 1)

    def by_hand(text):
        p = 0.0
        for k, g in enumerate(("x", "y", None)):
            spare = (sum(v == 1 for v in c[g].values()) + 1) / (c[g].total() + 2)
            o = (sum(v == 1 and every[w] > 1 for w, v in c[g].items()) + 1) / (sum(v == 1 for v in c[g].values()) + 2)
            q = (sum(t and j == g for *_, t, j in rows) + 0.5) / (ends + 1.5)
            for w in text.split():
                low = o * (0.1 * math.exp(lat[3].forward(w.encode())) + 0.9 * every[w] / every.total()) if every[w] else (1 - o) * math.exp(lat[k].forward(w.encode()))
                q *= (1 - end) * ((1 - spare) * c[g][w] / c[g].total() + spare * low)
            p += q * end
        return math.log10(p)

    assert got[4] == got[5]
    assert all(abs(got[i] - by_hand(t)) < 1e-9 for i, t, *_ in rows)


def test_lm_held_out_beats_the_base(spark):
    held = [r for r in lm_scoring.op2(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_id_held_out_accuracy(spark):
    out = language_id.op4(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in out if r.held_out]
    assert len(out) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_id_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !!", None), (4, "the cat", "en"), (5, "der hund", "de"), (5, "der hund", "de")], "doc_id long, text string, lang string")
    langs, f = language_id.fit(docs.select("text", "lang"))
    got = sorted((r.key, r.lang_pred) for r in language_id.predict(docs, langs, f).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de"), (5, "de")]
    langs, f = language_id.fit(docs.limit(0).select("text", "lang"))
    assert {r.lang_pred for r in language_id.predict(docs, langs, f).collect()} == {"und"}


def test_language_id_with_many_languages(spark):
    """More languages than a number has bits; hits recomputed by sets."""
    import numpy as np

    text = lambda i: f"{chr(0x4E00 + 5 * i)}{chr(0x4E01 + 5 * i)}{chr(0x4E02 + 5 * i)} word"
    rows = [(i, text(i), f"l{i:03}", "k", "g") for i in range(70)]
    docs = spark.createDataFrame([*rows, (None, text(3), None, "k", "g")], "doc_id long, text string, lang string, key string, g string")
    langs, f = language_id.fit(docs.select("text", "lang"), least_share=0.0)
    assert len(langs) == 70 and f.shape == (2, language_id.SLOTS)
    got = {r.key: (r.lang_pred, r.score) for r in language_id.predict(docs, langs, f).collect()}
    assert {k: x for k, (x, _) in got.items()} == {i: f"l{i:03}" for i in range(70)} | {None: "l003"}
    of = [set(language_id.grams([text(i)])[0].tolist()) for i in range(70)]
    code = language_id.grams([text(5)])[0]
    noise = [float(np.mean((f[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) ** language_id.PROBES for i in range(70)]
    share = [max(0.0, (sum(c in of[i] for c in code.tolist()) / len(code) - noise[i]) / (1 - noise[i])) for i in range(70)]
    assert abs(got[5][1] - share[5] / sum(share)) < 1e-9
    long = spark.createDataFrame([(1, text(1) * 50_000, "x")], "doc_id long, text string, key string")
    assert language_id.predict(long, langs, f).first().lang_pred == "l001"
    assert language_id.predict(docs.limit(0), langs, f).count() == 0


def test_bloom_has_no_false_negatives(spark):
    import numpy as np

    code, size = language_id.grams(["hello", None, "a", ""])
    assert size.tolist() == [4, 0, 0, 0] and len(code) == 4
    f = np.zeros(language_id.SLOTS, np.uint8)
    for p in range(language_id.PROBES):
        f[language_id.slots(code, p)] |= 1
    assert all((f[language_id.slots(code, p)] & 1).all() for p in range(language_id.PROBES))


def test_media_round_trip(spark):
    for raw in (b"", b"x", b"y" * 576, bytes(range(256)) * 9, "é\n".encode() * 400):
        image = media_columns.encode(raw)
        back = media_columns.decode(image).tobytes()
        assert back[: len(raw)] == raw and set(back[len(raw) :]) <= {255} and len(back) % 576 == 0 and len(back) >= 576
    got = {r.doc_id: r for r in media_columns.op3(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        raw = (d.text or "").encode()
        pay = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))


def test_sequences_stay_in_order(spark):
    html = '<p>one <b>two</b></p><figure><img src="sha256:aa" alt="A"><figcaption>cap &amp; a</figcaption></figure><p>three<img src="sha256:zz">four</p>'
    items = media_columns.interleave(spark.createDataFrame([(1, html), (2, None)], "id long, html string"), "id", "html")
    store = spark.createDataFrame([("aa", 7)], "digest string, size long")
    got = sorted(media_columns.resolve(items, store).collect(), key=lambda r: (r.key, r.position))
    assert [(r.position, r.kind, r.text, r.size) for r in got] == [(0, "text", "one two", None), (1, "media", "A", 7), (2, "caption", "cap & a", None), (3, "text", "three", None), (4, "media", None, None), (5, "text", "four", None)]


def test_warc(spark):
    long, short = "<p>" + "é" * 60 + "</p>", "<p>hi</p>"
    rows = [(3, "u", long, "x"), (1, "u v", long, "x"), (2, None, short, "x"), (5, "u", short, "x"), (6, "u", None, "x"), (7, "u", "", "x"), (9, "u", long, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    got = {r.key: r for r in warc.read(warc.write(pages, archive_bytes=200)).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {3: ("revisit", 1), 9: ("revisit", 1), 1: ("response", None), 2: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert bytes(got[1].payload).decode() == long and got[6].payload_bytes == 0
    blob = b"".join(bytes(r.content) for r in warc.write(pages).collect())
    members = list(warc.members(blob, step=7))
    assert len(members) == 7
    with pytest.raises(ValueError):
        list(warc.members(blob[:-3]))
    with pytest.raises(ValueError):
        warc.parse(next(m for m in members if b"hi</p>" in m).replace(b"hi</p>", b"ho</p>"))
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_warc_keys_that_are_shared_or_null(spark, tmp_path):
    import duckdb

    a, b, c, short = "<p>" + "a" * 120, "<p>" + "b" * 150, "<p>" + "c" * 180, "<p>hi"
    rows = [(1, "u", a), (2, "u", b), (4, "u", a), (4, "u", b), (4, "u", c), (5, "u", c), (5, "u", short), (None, "u", a), (None, "u", c), (None, "u", short)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read(warc.write(pages.repartition(3))).collect()
    full = Counter({(1, a): 1, (2, b): 1, (4, c): 1, (5, short): 1, (None, a): 1, (None, c): 1, (None, short): 1})
    assert Counter((r.key, bytes(r.payload).decode()) for r in got if r.record_type == "response") == full
    assert sorted((r.key, r.refers_to) for r in got if r.record_type == "revisit") == [(4, 1), (4, 2), (5, 4)]
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({warc.OP6_SQL})").fetchall()
    assert Counter(map(tuple, warc.op6(spark, str(tmp_path)).select(*columns).collect())) == Counter(want)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><header><h1>Head  line</h1></header><p>First <a href="y">link</a> text &amp; more.<p>Short.<br>Next &lt;b&gt;
<aside>Side</aside><form>Mail <input></form><div class="ad">Buy</div><p>Last.</p><section id="comments"><p>Nice post!</p></section></article><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    assert html_extract.main_text(PAGE) == "Head line\n\nFirst link text & more.\n\nShort. Next <b>\n\nLast."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") == html_extract.main_text("<nav>x") == ""
    assert html_extract.main_text("<article><p>a &am") == "a &am"
    assert html_extract.main_text("<article><p>a</p><p cla") == "a"
    soup = "<div>Menu</div><div>" + "The cat is on the mat and it is of the house. " * 5 + "</div><div>So be it.</div><div>" + "It was for the dog that they have come to us. " * 5 + "</div><div><a>One</a> <a>Two</a></div>"
    assert [x[:8] for x in html_extract.main_text(soup).split("\n\n")][-3:] == ["The cat ", "So be it", "It was f"]
    assert html_extract.inherit([1, 0, 0, -1, 0]) == [1, 1, -1, -1, -1]
    assert html_extract.inherit([1, 0, -1], 1) == [1, 1, -1] and html_extract.inherit([0], 1) == [1]
    assert html_extract.main_text("<article><p>Energy is <math><mi>E</mi></math> and <canvas>c</canvas> ok<noscript> so</noscript>.") == "Energy is E and c ok so."
    assert html_extract.main_text(f"<article><p><a href=x>{'linked ' * 20}</a></p>") == ("linked " * 20).strip()
    assert html_extract.main_text("<article><p data-x=don't>One.</p><p title='a > b'>Two.</p>") == "One.\n\nTwo."
    assert html_extract.main_text("<article><p>It was for the dog that they have come to us.</p><p><a>One</a> <a>Two</a> <a>Three</a></p></article>") == "It was for the dog that they have come to us."
    assert len(html_extract.main_text("<article>" + "<p>The cat is on the mat.</p>" * 50_000)) == 50_000 * 24 - 2
    assert html_extract.inherit([0, 0]) == [-1, -1]
    said = "It was for the dog that they have come to us."
    for kept in (
        f'<p title="hidden">{said}</p>', f"<p data-hidden>{said}</p>", f'<p data-role="navigation" title="x class=ad">{said}</p>', f'<section class="related-work"><h2>Related work</h2><p>{said}</p></section>',
        f'<div class="social-science"><p>{said}</p></div>', f'<p id="form-and-function">{said}</p>', f"<p class=notice>{said}</p>", f"<p>{said}</p><p>See <a>Alpha report</a>, <a>Beta report</a>, <a>Gamma report</a>.</p>",
        f'<div class="no-comment-policy"><p>{said}</p></div>', f'<p class="legal">{said}</p>',
    ):
        got = html_extract.main_text(f"<article>{kept}</article>")
        assert said in got and ("See" not in kept or got.endswith("See Alpha report, Beta report, Gamma report.")) and ("<h2>" not in kept or got.startswith("Related work")), kept
    for gone in (
        f"<p hidden>{said}</p>", f"<p hidden=''>{said}</p>", f'<div class="x ad">{said}</div>', f"<div class=cookie-banner>{said}</div>", f"<div id=commentList><p>{said}</p></div>", f'<div class="social-share"><p>Share this</p></div>',
        f'<div title=">" role="navigation">{said}</div>', f"<div style='display: none'>{said}</div>", "<p class=related>Also read</p>", f'<div class="newsletter-signup"><p>{said}</p></div>', f'<div class="side&#98;ar">{said}</div>',
    ):
        assert html_extract.main_text(f"<article><p>It was so for the dog that they came to us.</p>{gone}</article>") == "It was so for the dog that they came to us.", gone
    assert html_extract.main_text(f'<div class="related-work"><p>{said}</p></div>') == ("" if html_extract.named("related-work") else said)
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r.key, r.n_chars) for r in html_extract.extract(df).collect()) == [(1, 58), (1, 58), (2, 0)]
    clash = spark.createDataFrame([(1, "u", PAGE, "k", "t"), (None, "u", PAGE, "k", "t")], "page_id long, url string, html string, key string, text string")
    assert Counter((r.key, r.n_chars) for r in html_extract.extract(clash).collect()) == Counter([(None, 58), (1, 58)])
    assert html_extract.extract(clash.limit(0)).count() == 0


class Tree(HTMLParser):
    """The text of articles by a plain walk with the standard parser, block by block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.parts = [], [], []

    def close_block(self):
        t = " ".join("".join(self.parts).split())
        if t and any(x in ("article", "main") for x, _ in self.stack) and not any(bad for _, bad in self.stack):
            self.out.append(t)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in html_extract.BLOCK:
            self.close_block()
        if tag not in html_extract.VOID:
            self.stack.append((tag, tag in ("nav", "footer", "aside", "form", "script", "style", "head") or any(k == "class" and v for k, v in attrs)))

    def handle_endtag(self, tag):
        if tag in html_extract.BLOCK:
            self.close_block()
        if any(x == tag for x, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.parts.append(data)


def test_html_against_a_plain_walk(spark):
    """Every page of the table: the same text; each rule decides some blocks, the second pass too."""
    rules = Counter()
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        walk = Tree()
        walk.feed(r.html or "")
        walk.close()
        walk.close_block()
        found = html_extract.blocks(r.html or "")
        rules.update(rule for _, rule in html_extract.classify(found))
        assert html_extract.main_text(r.html) == "\n\n".join(walk.out), r.page_id
    assert set(rules) == {"links", "container", "density", "neighbours"} and rules["density"] > 1000 and rules["neighbours"] > 100, rules


def test_media_sequence_of_odd_pages(spark):
    seq = lambda h: [(i["kind"], i["text"], i["digest"]) for i in media_columns.sequence(h)]
    page = '<p>a <b>b</b> c</p><script>var x = "<p>no</p>";</script><style>p{}</style><figure><img src="sha256:1" alt="A"><figcaption>cap <i>one</i></figure><p>after</p><template><p>no</p></template><img src="sha256:2"/>end'
    assert seq(page) == [("text", "a b c", None), ("media", "A", "1"), ("caption", "cap one", None), ("text", "after", None), ("media", None, "2"), ("text", "end", None)]
    assert [i["position"] for i in media_columns.sequence(page)] == list(range(6))
    assert seq("<figure><figcaption>x<figure><img src=3>y") == [("caption", "x", None), ("media", None, "3"), ("text", "y", None)]
    assert seq("<figcaption>x</figcaption>y") == [("caption", "x", None), ("text", "y", None)]
    assert seq(None) == seq("") == seq("<script>open") == [] and seq("<p>cut off <b") == [("text", "cut off <b", None)]
    df = spark.createDataFrame([(None, "<p>a</p>", 1), (1, None, 1), (1, "<p>a</p><img src='sha256:q'>", 1), (1, "<p>a</p><img src='sha256:q'>", 1)], "k long, html string, items int")
    x = media_columns.interleave(df, "k", "html")
    assert sorted((r.key is None, len(r["items"])) for r in x.collect()) == [(False, 0), (False, 2), (False, 2), (True, 1)]
    store = media_columns.describe(media_columns.store(spark.createDataFrame([(None, 3), ("", 3), ("t" * 2000, 3)], "text string, digest int"), "text"))
    assert sorted((r.n_bytes, r.payload_bytes) for r in store.collect()) == [(0, 576), (2000, 2304)]
    got = media_columns.resolve(x, store).where("kind = 'media'").collect()
    assert [(r.digest, r.n_bytes) for r in got] == [("q", None)] * 2
    assert media_columns.interleave(df.limit(0), "k", "html").count() == 0 and media_columns.store(df.select("html").limit(0), "html").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_media_sequences_of_pages_are_a_plain_walk(spark):
    """Text between tags that part blocks, in order, without what stands in scripts and the like."""
    import re
    from html import unescape

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    got = {r.key: [i.text for i in r["items"] if i.kind != "media"] for r in media_columns.interleave(rows, "page_id", "html").collect()}
    skip = "|".join(sorted(media_columns.UNSEEN))
    for r in rows.collect():
        h = re.sub(rf"(?is)<!--.*?-->|<!doctype[^>]*>|<({skip})\b.*?</\1\s*>", "", r.html or "")
        h = re.sub(rf"(?is)</?(?:{'|'.join(sorted(media_columns.INLINE))})\b[^>]*>", "", h)
        want = [" ".join(unescape(t).split()) for t in re.split(r"(?s)<[a-zA-Z/][^>]*>", h)]
        assert got[r.page_id] == [t for t in want if t], r.page_id
