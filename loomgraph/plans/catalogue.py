"""The registered queries and, for each, the SQL that an independent engine answers it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import render as N
from loomgraph.functions import text as T
from loomgraph.functions.cid import cid, cid_to_uri, uri_to_cid
from loomgraph.functions.provenance import parse_signature
from loomgraph.operators import chunks as C
from loomgraph.operators import graph as G
from loomgraph.operators import library as L
from loomgraph.operators import relational as R
from loomgraph.operators import runs
from loomgraph.session import table
from loomgraph.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def cid_sql(x: str) -> str:
    """The content id in DuckDB: 58 digits of five bits each, out of the hex of prefix and hash."""
    return f"""'b' || list_aggregate(list_transform(range(58), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567',
  1 + CAST(list_sum(list_transform(range(5), lambda j:
    (instr('0123456789abcdef', substr(rpad('01551220' || sha256({x}), 76, '0'), CAST(((i*5+j)//4) + 1 AS INTEGER), 1)) - 1)
      // CAST(pow(2, 3 - (i*5+j) % 4) AS INTEGER) % 2 * CAST(pow(2, 4 - j) AS INTEGER))) AS INTEGER), 1)), 'string_agg', '')"""


def body() -> Column:
    return F.coalesce("text", F.lit(""))


#: Anchors of the pages, in DuckDB: page_id, pos, label, href.
ANCHORS_SQL = """a AS (SELECT page_id, i - 1 AS pos, ls[i] AS label, hs[i] AS href FROM (SELECT page_id, ls, hs, unnest(range(1, len(ls) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS ls, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hs FROM pages)))"""
KEY_SQL = "trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '_', 'g'), '_')"


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.anchors(F.col("html"))).alias("pos", "a"))
    return x.select("page_id", F.col("pos").cast("long"), "a.*")


def order_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as triples: ord, stmt (o_orderkey), s, p, o; customers twice, so that duplicates occur."""
    o = table(spark, sf_dir, "orders")
    s = F.concat(F.lit("ex:o"), "o_orderkey")
    rows = F.array(
        F.struct(F.lit(0).alias("n"), F.lit("ex:customer").alias("p"), F.concat(F.lit("ex:c"), "o_custkey").alias("o")),
        F.struct(F.lit(1).alias("n"), F.lit("ex:status").alias("p"), F.concat(F.lit('"'), "o_orderstatus", F.lit('"')).alias("o")),
        F.struct(F.lit(2).alias("n"), F.lit("ex:customer").alias("p"), F.concat(F.lit("ex:c"), "o_custkey").alias("o")),
    )
    return o.select("o_orderkey", s.alias("s"), F.explode(rows).alias("r")).select((F.col("o_orderkey") * 3 + F.col("r.n")).alias("ord"), F.col("o_orderkey").alias("stmt"), "s", "r.p", "r.o")


TRIPLES_SQL = """t AS (SELECT o_orderkey * 3 + n AS ord, o_orderkey AS stmt, 'ex:o' || o_orderkey AS s, CASE n WHEN 1 THEN 'ex:status' ELSE 'ex:customer' END AS p,
  CASE n WHEN 1 THEN '"' || o_orderstatus || '"' ELSE 'ex:c' || o_custkey END AS o FROM orders, (SELECT unnest([0, 1, 2]) AS n))"""


@query(f"""SELECT doc_id, {cid_sql("coalesce(text, '')")} AS cid, CAST(len(l) AS BIGINT) AS n_statements, CAST(len(list_distinct(l)) AS BIGINT) AS n_distinct
FROM (SELECT doc_id, text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents)""")
def statement_rollup(spark, sf_dir):
    """Lines of each document as statements: content id, number of statements, distinct statements."""
    lines = F.filter(F.split(body(), "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", cid(body()).alias("cid"), F.size(lines).cast("long").alias("n_statements"), F.size(F.array_distinct(lines)).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, c AS cid, 'ipfs://' || c AS uri, c AS back FROM (SELECT doc_id, {cid_sql('text')} AS c FROM documents)")
def cid_uri_roundtrip(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", cid(F.col("text")).alias("cid"))
    return x.select("doc_id", "cid", cid_to_uri(F.col("cid")).alias("uri"), uri_to_cid(cid_to_uri(F.col("cid"))).alias("back"))


@query("SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return x.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_first_wins(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), "doc_id", "source")
    return R.first_wins(x, ["h"], "doc_id").select("doc_id", "source")


@query(f"WITH {ANCHORS_SQL} SELECT page_id, pos, label, href FROM a")
def link_extract(spark, sf_dir):
    return anchors(spark, sf_dir)


@query(f"WITH {ANCHORS_SQL} SELECT page_id, label, arg_max(href, pos) AS href FROM a GROUP BY 1, 2")
def link_map(spark, sf_dir):
    """Label to link of each page, the last one wins."""
    return anchors(spark, sf_dir).groupBy("page_id", "label").agg(F.max_by("href", "pos").alias("href"))


@query(f"WITH {ANCHORS_SQL} SELECT DISTINCT label, {KEY_SQL.format(x='label')} AS key, 'thing_' || {KEY_SQL.format(x='label')} AS id, 'http://x/y#thing_' || {KEY_SQL.format(x='label')} AS uri FROM a")
def entity_key(spark, sf_dir):
    x = anchors(spark, sf_dir).select("label").distinct()
    return x.select("label", T.entity_key(F.col("label")).alias("key"), T.entity_id(F.lit("Thing"), F.col("label")).alias("id"), T.entity_uri(F.lit("http://x/y"), F.lit("Thing"), F.col("label")).alias("uri"))


@query(f"WITH {ANCHORS_SQL} SELECT DISTINCT label, 'https://en.wikipedia.org/wiki/' || replace(url_encode(replace(label, ' ', '_')), '%2F', '/') AS url, replace(replace(lower(label), ' ', '_'), '/', '_') AS slug FROM a")
def wiki_url_encode(spark, sf_dir):
    x = anchors(spark, sf_dir).select("label").distinct()
    return x.select("label", T.wiki_url(F.col("label"), "https://en.wikipedia.org/wiki/").alias("url"), T.slug(F.col("label")).alias("slug"))


@query(f"""WITH {ANCHORS_SQL} SELECT key, arg_min(label, ord) AS label, arg_max(href, ord) AS uri, count(DISTINCT page_id) AS n_pages,
array_to_string(list_sort(list_distinct(list(label))), '|') AS aliases FROM (SELECT *, page_id * 100000 + pos AS ord, {KEY_SQL.format(x='label')} AS key FROM a) GROUP BY key""")
def registry_upsert(spark, sf_dir):
    x = anchors(spark, sf_dir).select(T.entity_key(F.col("label")).alias("key"), F.struct("page_id", "pos").alias("ord"), "label", F.lit("Thing").alias("type"), F.col("href").alias("uri"), F.lit(None).cast("string").alias("description"), F.col("page_id").alias("chunk"), F.col("label").alias("alias"))
    return R.upsert_entities(x).select("key", "label", "uri", F.size("source_chunks").cast("long").alias("n_pages"), F.array_join("aliases", "|").alias("aliases"))


@query(f"""WITH {ANCHORS_SQL}, k AS (SELECT {KEY_SQL.format(x='label')} AS key, min(label) AS canonical FROM a GROUP BY 1)
SELECT page_id, pos, label, canonical FROM a LEFT JOIN k ON {KEY_SQL.format(x='a.label')} = k.key""")
def alias_lookup(spark, sf_dir):
    """Each label is an alias of the least label with its key."""
    a = anchors(spark, sf_dir)
    aliases = R.alias_targets(a.select(F.col("label").alias("alias"), F.col("label").alias("key"), F.struct(F.lit(0).alias("o")).alias("ord"))).select("alias_key")
    least = a.groupBy(T.entity_key(F.col("label")).alias("alias_key")).agg(F.min("label").alias("key"))
    x = R.lookup_entities(a, "label", least.select("key"), aliases.join(least, "alias_key"))
    return x.select("page_id", "pos", "label", F.col("found").alias("canonical"))


def region_text(spark, sf_dir):
    """Regions and nations as an article with headers of levels 2 and 3."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = F.concat(F.lit("=== "), "n_name", F.lit(" ===\nabout "), "n_name")
    x = n.groupBy("r_regionkey", "r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", lines.alias("l")))), lambda v: v["l"]), "\n").alias("body"))
    return x.select("r_regionkey", F.concat(F.lit("intro\n== "), "r_name", F.lit(" ==\n"), "body").alias("text"), F.lit("World").alias("title"))


REGION_SQL = """x AS (SELECT r_regionkey, r_name, 'intro' || chr(10) || '== ' || r_name || ' ==' || chr(10) AS head, n_nationkey, n_name,
  '=== ' || n_name || ' ===' || chr(10) || 'about ' || n_name AS l FROM nation JOIN region ON n_regionkey = r_regionkey),
h AS (SELECT DISTINCT r_regionkey, 2 AS level, r_name AS title, 6 AS start_pos, 'World > ' || r_name AS breadcrumb FROM x UNION ALL
SELECT r_regionkey, 3, n_name, length(head) + coalesce(sum(length(l) + 1) OVER (PARTITION BY r_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 'World > ' || r_name || ' > ' || n_name FROM x)"""


@query(f"WITH {REGION_SQL} SELECT r_regionkey, level, title, CAST(start_pos AS INTEGER) AS start_pos, breadcrumb FROM h")
def sections_hierarchy(spark, sf_dir):
    x = region_text(spark, sf_dir).withColumn("h", T.sections("text", "title"))
    return x.select("r_regionkey", F.inline(T.breadcrumbs("h", "title"))).select("r_regionkey", "level", "title", "start_pos", "breadcrumb")


@query(f"""WITH {REGION_SQL}, p AS (SELECT r_regionkey, unnest(range(0, 200, 7)) AS pos FROM region)
SELECT p.r_regionkey, CAST(pos AS INTEGER) AS pos, coalesce(h.title, 'Introduction') AS section FROM p ASOF LEFT JOIN h ON p.r_regionkey = h.r_regionkey AND p.pos >= h.start_pos""")
def section_asof(spark, sf_dir):
    x = region_text(spark, sf_dir)
    heads = x.select("r_regionkey", F.inline(T.sections("text", "title"))).select("r_regionkey", F.col("title").alias("section"), "start_pos")
    probes = x.select("r_regionkey", F.explode(F.sequence(F.lit(0), F.lit(199), F.lit(7))).alias("pos"))
    return R.as_of(probes, heads, ["r_regionkey"], "pos", "start_pos", "section", "Introduction")


@query("""SELECT doc_id, CAST(i AS INTEGER) AS chunk_num, CAST(i * 900 AS INTEGER) AS char_start, CAST(i * 900 + length(substr(text, CAST(i * 900 + 1 AS INTEGER), 1000)) AS INTEGER) AS char_end,
sha256(substr(text, CAST(i * 900 + 1 AS INTEGER), 1000)) AS h FROM (SELECT doc_id, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - 100) / 900) AS INTEGER) - 1) + 1)) AS i FROM documents WHERE length(text) > 0)
WHERE length(substr(text, CAST(i * 900 + 1 AS INTEGER), 1000)) >= 60""")
def chunk_fixed(spark, sf_dir):
    x = C.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 1000, 100, 60)
    return x.select("doc_id", "chunk_num", "char_start", "char_end", F.sha2("chunk", 256).alias("h"))


#: Splits texts at headers, and each section's text again and again at the last blank line, sentence end or hard limit.
CHUNKS_SQL = r"""WITH RECURSIVE h AS (SELECT doc_id, string_split_regex(text, '\n==+\s+.+?\s+==+\n') AS b, regexp_extract_all(text, '\n(==+\s+.+?\s+==+)\n', 1) AS hs FROM documents WHERE regexp_matches(text, '[^ \t\r\n]')),
p AS (SELECT doc_id, i, trim(b[i], chr(32) || chr(9) || chr(10) || chr(13)) AS t, CASE WHEN i > 1 THEN regexp_extract(hs[i - 1], '==+\s+(.+?)\s+==+', 1) END AS section FROM (SELECT doc_id, b, hs, unnest(range(1, len(b) + 1)) AS i FROM h)),
r AS (SELECT doc_id, i, section, 0 AS n, t AS cur, CAST(NULL AS VARCHAR) AS piece FROM p WHERE NOT regexp_matches(t, '^==+\s+.+?\s+==+')
UNION ALL SELECT doc_id, i, section, n + 1, CASE WHEN length(cur) > 1500 THEN ltrim(substr(cur, cut + 1), chr(32) || chr(9) || chr(10) || chr(13)) ELSE '' END, CASE WHEN length(cur) > 1500 THEN left(cur, cut) ELSE cur END
FROM (SELECT *, CASE WHEN blank > 0 THEN blank WHEN blank < 0 AND stop > 0 THEN stop ELSE 1500 END AS cut FROM (SELECT *, CASE WHEN strpos(back, chr(10) || chr(10)) > 0 THEN 1500 - strpos(back, chr(10) || chr(10)) - 1 ELSE -1 END AS blank,
CASE WHEN strpos(back, ' .') > 0 THEN 1500 - strpos(back, ' .') - 1 ELSE -1 END AS stop FROM (SELECT *, reverse(left(cur, 1500)) AS back FROM r WHERE cur <> '')))),
c AS (SELECT doc_id, i, n, section, trim(piece, chr(32) || chr(9) || chr(10) || chr(13)) AS piece FROM r WHERE piece IS NOT NULL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, n) - 1 AS INTEGER) AS chunk_num, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks,
'Doc ' || doc_id || coalesce(' > ' || section, '') AS section_context, CAST(length(piece) AS INTEGER) AS n_chars, {cid} AS cid FROM c WHERE length(piece) >= 60"""


@query(CHUNKS_SQL.replace("{cid}", cid_sql("piece")))
def chunk_article(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Doc "), "doc_id").alias("title"), "text")
    x = C.chunk_articles(x, "doc_id", "title", "text", 1500, 60)
    return x.select(F.col("key").alias("doc_id"), "chunk_num", "total_chunks", "section_context", F.length("text").alias("n_chars"), cid(F.col("text")).alias("cid"))


@query("""SELECT doc_id, CAST(i AS INTEGER) AS stmt_idx, '0_' || i AS stmt_key, trim(l[i]) AS statement FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents))""")
def statements_parse(spark, sf_dir):
    """Every line gets a bullet; the parser takes it off again, numbers from 1 and drops empty lines."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("- "), x)), "\n")
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.statements_v1(marked)).alias("i", "statement"))
    return x.select("doc_id", (F.col("i") + 1).alias("stmt_idx"), F.concat(F.lit("0_"), F.col("i") + 1).alias("stmt_key"), "statement")


def signatures(spark, sf_dir):
    """Signatures of an earlier run, which saw another text where doc_id % 3 = 1 and no document where doc_id % 3 = 2."""
    d = table(spark, sf_dir, "documents").where("doc_id % 3 <> 2")
    return d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("from_cid"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'regenerate' ELSE 'generate' END AS status FROM documents")
def incr_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("cid"))
    s = signatures(spark, sf_dir)
    done, todo = R.unchanged(d, s, ["doc_id"], "cid", "from_cid")
    known = todo.join(s.select("doc_id", F.lit(1).alias("k")), "doc_id", "left")
    return done.select("doc_id", F.lit("skip").alias("status")).unionByName(known.select("doc_id", F.when(F.col("k").isNotNull(), "regenerate").otherwise("generate").alias("status")))


@query("SELECT source, bool_and(doc_id % 3 = 0) AS all_unchanged, CAST(count_if(doc_id % 3 = 0) AS BIGINT) AS n_unchanged, count(*) AS n FROM documents GROUP BY source")
def incr_chunk_all(spark, sf_dir):
    """A source may be skipped only if all its documents are unchanged."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("cid"))
    s = signatures(spark, sf_dir)
    x = d.join(s, "doc_id", "left").withColumn("same", F.coalesce(F.col("cid") == F.col("from_cid"), F.lit(False)))
    return x.groupBy("source").agg(F.bool_and("same").alias("all_unchanged"), F.count_if("same").alias("n_unchanged"), F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 2")
def processed_set(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(signatures(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")


@query(f"WITH {TRIPLES_SQL} SELECT stmt, s, p, o, min(ord) AS ord, count(*) - 1 AS n_duplicates FROM t GROUP BY ALL")
def triples_dedup(spark, sf_dir):
    return G.distinct_triples(order_triples(spark, sf_dir), ["stmt"])


@query(f"WITH {TRIPLES_SQL} SELECT stmt, string_agg(s || ' ' || p || ' ' || o || ' .', chr(10) ORDER BY ord) AS turtle FROM t GROUP BY stmt")
def turtle_block(spark, sf_dir):
    return G.turtle(order_triples(spark, sf_dir), ["stmt"], "ord")


@query(f"WITH {TRIPLES_SQL} SELECT l.l_orderkey AS stmt, coalesce(string_agg(s || ' ' || p || ' ' || o || ' .', chr(10) ORDER BY ord), '# No triples emitted') AS turtle FROM (SELECT DISTINCT l_orderkey FROM lineitem) l LEFT JOIN (SELECT * FROM t WHERE stmt % 5 <> 0) t ON l.l_orderkey = t.stmt GROUP BY 1")
def triples_left(spark, sf_dir):
    """Statements with their triples; those without keep a note."""
    stmts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stmt")).distinct()
    t = G.turtle(order_triples(spark, sf_dir).where("stmt % 5 <> 0"), ["stmt"], "ord")
    return stmts.join(t, "stmt", "left").select("stmt", F.coalesce("turtle", F.lit("# No triples emitted")).alias("turtle"))


@query(f"WITH {TRIPLES_SQL} SELECT stmt, count(*) AS n FROM t WHERE stmt NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 1) GROUP BY 1")
def triples_orphans(spark, sf_dir):
    """Triples whose statement isn't known."""
    stmts = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("stmt")).distinct()
    return order_triples(spark, sf_dir).join(stmts, "stmt", "left_anti").groupBy("stmt").agg(F.count("*").alias("n"))


@query(f"WITH {TRIPLES_SQL} SELECT s, bool_or(p = 'ex:customer') AS has_customer, bool_or(o LIKE '%F%') AS has_f, bool_or(p LIKE '%date%') AS has_date FROM t GROUP BY s")
def triple_flags(spark, sf_dir):
    return order_triples(spark, sf_dir).groupBy("s").agg(F.bool_or(F.col("p") == "ex:customer").alias("has_customer"), F.bool_or(F.col("o").contains("F")).alias("has_f"), F.bool_or(F.col("p").contains("date")).alias("has_date"))


@query("""SELECT l_orderkey AS order_id, l_linenumber AS line, 'ex:p' || l_partkey AS part, 1 - l_discount AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE 1 - l_discount > 0.97 AND o_orderstatus = 'F'""")
def bgp_confidence(spark, sf_dir):
    """Annotated triples above a confidence."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("ex:p"), "l_partkey").alias("part"), (1 - F.col("l_discount")).alias("confidence"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_id"))
    return li.where("confidence > 0.97").join(o, "order_id")


@query(f"WITH {TRIPLES_SQL} SELECT a.o AS customer, count(*) AS n FROM t a JOIN t b ON a.s = b.s WHERE a.p = 'ex:customer' AND b.p = 'ex:status' AND b.o = '\"F\"' GROUP BY 1")
def bgp_count(spark, sf_dir):
    return G.match(order_triples(spark, sf_dir), [("?order", "ex:customer", "?customer"), ("?order", "ex:status", '"F"')]).groupBy("customer").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS u, 'n' || c_nationkey AS v FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
w AS (SELECT DISTINCT u AS root, u AS node, 0 AS depth FROM e WHERE u LIKE 'o%' UNION ALL SELECT root, v, depth + 1 FROM w JOIN e ON node = u WHERE depth < 3) SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2""")
def prov_chain(spark, sf_dir):
    """Lineage: order, customer, nation, region."""
    part = lambda t, a, b, x, y: table(spark, sf_dir, t).select(F.concat(F.lit(x), a).alias("u"), F.concat(F.lit(y), b).alias("v"))
    e = part("customer", "c_custkey", "c_nationkey", "c", "n").unionByName(part("nation", "n_nationkey", "n_regionkey", "n", "r")).unionByName(part("orders", "o_orderkey", "o_custkey", "o", "c"))
    return G.hops(e, e.where("u like 'o%'").select("u").distinct(), 3)


COS_SQL = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(t.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])))"


@query(f"""SELECT q.vec_id AS qid, t.vec_id AS tid, round({COS_SQL}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS_SQL} DESC, t.vec_id) AS INTEGER) AS rank
FROM embeddings q, embeddings t WHERE q.vec_id % 20 = 0 AND t.label % 2 = 0 AND {COS_SQL} > 0 QUALIFY rank <= 5""")
def vocab_topk(spark, sf_dir):
    """Queries: every twentieth vector; terms: those of one kind."""
    e = table(spark, sf_dir, "embeddings")
    x = R.top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e.where("label % 2 = 0").select(F.col("vec_id").alias("tid"), "embedding"), "qid", "tid", 5)
    return x.withColumn("score", F.round("score", 6))


@query("""SELECT qid, tid, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS qid, t.vec_id AS tid, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) DESC, t.vec_id) AS rank FROM embeddings q, embeddings t WHERE q.vec_id % 20 = 0) WHERE rank <= 3""")
def library_dot_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = R.top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("tid"), "embedding"), "qid", "tid", 3, None, T.dot)
    return x.withColumn("score", F.round("score", 6))


@query("""SELECT doc_id, list_sum(list_transform(range(384), lambda i: (CAST(('0x' || substr(sha256(text), CAST((i % 32) * 2 + 1 AS INTEGER), 2)) AS INTEGER) - 128) / 128.0)) AS total FROM documents""")
def mock_embedding(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.aggregate(T.mock_embedding(F.col("text")), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT 'User ' || user_id AS title, count(*) AS views FROM events WHERE user_id % 10 <> 0 GROUP BY user_id ORDER BY views DESC, user_id LIMIT 50")
def pageviews_top(spark, sf_dir):
    """A response of the service, the thousand users with most events as its articles, read by the reader."""
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("views")).orderBy(F.desc("views"), "user_id").limit(1000)
    article = F.concat(F.when(F.col("user_id") % 10 == 0, "Special:").otherwise(""), F.lit("User_"), "user_id")
    a = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("views")).alias("o"), "user_id", article.alias("article"), "views"))), lambda r: F.struct(r["article"].alias("article"), r["views"].alias("views")))
    response = x.agg(F.to_json(F.struct(F.array(F.struct(a.alias("articles"))).alias("items"))).alias("value"))
    return readers.top_pages(response, 50)


@query("""SELECT user_id, views FROM (SELECT user_id, count(*) AS views FROM events GROUP BY 1) ORDER BY -ln((CAST(('0x' || substr(md5('42:' || user_id), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) / sqrt(views), user_id LIMIT 40""")
def power_law_sample(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("views"))
    return R.weighted_sample(x, "user_id", F.sqrt("views"), 40)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'dev' END AS split FROM documents")
def split_80_20(spark, sf_dir):
    return R.seeded_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.8)


@query("SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS lo, max(v) AS hi, median(v) AS mid, avg(v) AS mean FROM (SELECT count(*) AS v FROM events GROUP BY user_id)")
def views_stats(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("v"))
    return x.agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.median("v").alias("mid"), F.avg("v").alias("mean"))


@query("""WITH v AS (SELECT count(*) AS v FROM events GROUP BY user_id), m AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
SELECT CAST(b AS INTEGER) AS bin, count(v) AS n FROM (SELECT unnest(range(30)) AS b) LEFT JOIN (SELECT v, least(29, CAST(floor((v - lo) * 30.0 / (hi - lo)) AS BIGINT)) AS k FROM v, m) ON b = k GROUP BY 1""")
def views_hist(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("v"))
    return runs.histogram(x, "v", 30)


@query("""WITH c AS (SELECT count(*) AS n FROM conversations GROUP BY conv_id), b AS (SELECT CASE WHEN n <= 5 THEN '1-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' ELSE '100+' END AS bucket FROM c)
SELECT x.bucket, count(b.bucket) AS n FROM (SELECT unnest(['1-5', '6-10', '11-20', '21-50', '51-100', '100+']) AS bucket) x LEFT JOIN b ON x.bucket = b.bucket GROUP BY 1""")
def iteration_buckets(spark, sf_dir):
    return runs.iteration_buckets(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")))


@query("SELECT min(n) AS lo, max(n) AS hi, avg(n) AS mean, CAST(count_if(n >= 8) AS BIGINT) AS n_limit FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def iteration_stats(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return x.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.avg("n").alias("mean"), F.count_if(F.col("n") >= 8).alias("n_limit"))


@query("""SELECT source, CAST(count_if(quality = 1) AS BIGINT) AS n_good, CAST(count_if(coalesce(quality, 0) = 0) AS BIGINT) AS n_bad, count_if(quality = 1) / count(*) AS score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def classify_score(spark, sf_dir):
    """Unlabelled rows count as bad."""
    x = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return x.groupBy("source").agg(F.count_if(good).alias("n_good"), F.count_if(~good).alias("n_bad"), (F.count_if(good) / F.count("*")).alias("score"))


@query("""SELECT event_id, least(1.0, greatest(0.0, coalesce(try_cast(trim(v) AS DOUBLE), 0.5))) AS score, event_id % 4 < 2 AS truth, 0.3 * 1.0 + 0.7 * least(1.0, greatest(0.0, coalesce(try_cast(trim(v) AS DOUBLE), 0.5))) AS total
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bad' ELSE ' ' || CAST(value / 50 AS VARCHAR) || ' ' END AS v FROM events)""")
def score_parse(spark, sf_dir):
    v = F.when(F.col("event_id") % 4 == 0, "bad").otherwise(F.concat(F.lit(" "), (F.col("value") / 50).cast("string"), F.lit(" ")))
    t = F.element_at(F.array(F.lit(" Yes"), F.lit("VALID"), F.lit("no"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    s = T.score(v)
    return table(spark, sf_dir, "events").select("event_id", s.alias("score"), T.truth(t).alias("truth"), T.weighted([F.lit(1.0), s], [0.3, 0.7]).alias("total"))


@query("""SELECT u.conv_id, u.turn, u.text AS chunk, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND u.conv_id <> 0""")
def training_examples(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user' and conv_id <> 0").select("conv_id", "turn", F.col("text").alias("chunk"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) BETWEEN 2 AND 50 ORDER BY n DESC, conv_id LIMIT 10")
def fewshot_select(spark, sf_dir):
    return runs.fewshot(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "n", 10)


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2')")
def fewshot_exclude(spark, sf_dir):
    used = spark.createDataFrame([("src1",), ("src2",)], "source string")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(F.broadcast(used), "source", "left_anti").select("doc_id")


@query("""SELECT string_agg('@prefix ' || p || ': <' || ns || '> .', chr(10) ORDER BY p) AS block FROM (SELECT DISTINCT p, ns FROM (SELECT * FROM (VALUES ('ex', 'http://'), ('exs', 'https://'), ('owl', 'http://www.w3.org/2002/07/owl#'), ('no', 'urn:none')) AS v(p, ns)) WHERE p = 'owl' OR EXISTS (SELECT 1 FROM pages WHERE starts_with(url, ns)))""")
def prefix_block(spark, sf_dir):
    """Namespaces that are in use, and those that always are."""
    known = spark.createDataFrame([(0, "ex", "http://"), (1, "exs", "https://"), (2, "owl", "http://www.w3.org/2002/07/owl#"), (3, "no", "urn:none")], "ord int, prefix string, ns string")
    return L.prefix_block(table(spark, sf_dir, "pages"), "url", known)


@query("""WITH e AS (SELECT lower(c_mktsegment) AS key, min(c_custkey) AS first FROM customer GROUP BY 1) SELECT key, first, 'segment_' || row_number() OVER (ORDER BY first) AS id FROM e""")
def kg_entities(spark, sf_dir):
    """Entities by label in lower case, numbered in the order of their first mention."""
    e = table(spark, sf_dir, "customer").groupBy(F.lower("c_mktsegment").alias("key")).agg(F.min("c_custkey").alias("first"))
    return R.numbered(e, "first", "n").select("key", "first", F.concat(F.lit("segment_"), "n").alias("id"))


@query("""SELECT o_orderkey, coalesce(c_name, '?') AS source_label, coalesce(n_name, '?') AS target_label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 11 <> 0) ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def kg_relations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0").select("c_custkey", "c_name", "c_nationkey")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return x.select("o_orderkey", F.coalesce("c_name", F.lit("?")).alias("source_label"), F.coalesce("n_name", F.lit("?")).alias("target_label"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN NULL ELSE sha256(text) END AS cid, CASE doc_id % 3 WHEN 0 THEN 'chunk' WHEN 1 THEN 'facts' END AS type FROM documents""")
def sig_parse(spark, sf_dir):
    """Signatures of the two layouts, and text that is none."""
    h = F.sha2("text", 256)
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.to_json(F.struct(F.concat(F.lit("ipfs://"), h).alias("@id"), F.lit("chunk").alias("_type")))).when(k == 1, F.to_json(F.struct(h.alias("cid"), F.lit("facts").alias("type"), F.lit(1).alias("cell")))).otherwise("not json")
    x = table(spark, sf_dir, "documents").select("doc_id", parse_signature(raw).alias("sig"))
    return x.select("doc_id", "sig.cid", "sig.type")


@query("""SELECT doc_id, '**Context:** ' || source || chr(10) || '**Chunk:** 1 of 1' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text || chr(10) AS cell FROM documents""")
def render_chunk_cell(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.chunk_cell(F.col("source"), F.lit(1), F.lit(1), F.col("text")).alias("cell"))


@query("""SELECT conv_id, '**Context:** Conversation' || chr(10) || '**Chunk:** 1 of 1' || chr(10) || '**Statements:** ' || count(*) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg((turn + 1) || '. ' || text, chr(10) ORDER BY turn) || chr(10) AS cell FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, text FROM conversations) GROUP BY conv_id""")
def render_statements(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", N.statements_cell(F.lit("Conversation"), F.lit(1), F.lit(1), F.transform("t", lambda x: x["text"])).alias("cell"))


@query("""WITH s AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents), u AS (SELECT doc_id, l, len(l) AS n, unnest(range(0, len(l) + 1)) AS i FROM s)
SELECT doc_id, i AS index, CASE WHEN i = n THEN '' ELSE l[i + 1] END AS statement, CASE WHEN i = n OR i % 3 = 0 THEN 'GOOD' ELSE 'BAD' END AS classification,
CASE WHEN i = n THEN 'extra' WHEN i % 3 = 0 THEN 'fine' WHEN i % 3 = 1 THEN 'no' ELSE 'Not explicitly classified by judge' END AS reason, CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((n + 2) // 3 + 1 AS DOUBLE) / n END AS score FROM u""")
def judge_completion(spark, sf_dir):
    """Lines of documents as statements; a stand-in judge speaks of two in three and of one that isn't there."""
    lines = F.filter(F.split(body(), "\n"), lambda x: F.trim(x) != "")
    x = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    said = F.transform("l", lambda x, i: F.concat(i.cast("string"), F.when(i % 3 == 0, ": good - fine").when(i % 3 == 1, ":BAD: no ").otherwise(" nothing")))
    found = T.classifications(F.concat_ws("\n", F.concat(F.size("l"), F.lit(": GOOD – extra")), F.array_join(said, "\n")), F.col("l"))
    # a column of its own would be computed for the score, for the rows and for the filters that inline() brings
    scored = lambda c: T.let(T.good_share(c, F.col("l")), lambda score: F.transform(c, lambda r: F.struct(score.alias("score"), *[r[n].alias(n) for n in ("index", "statement", "classification", "reason")])))
    return x.select("doc_id", F.inline(T.let(found, scored)))


@query(f"""WITH {ANCHORS_SQL}, f AS (SELECT page_id, label, arg_min(href, pos) AS href, min(pos) AS pos FROM a GROUP BY 1, 2)
SELECT p.page_id, coalesce('Linked entities (use these Wikipedia URLs as entity URIs):' || chr(10) || string_agg('  - [' || label || '](' || href || ')', chr(10) ORDER BY pos), 'No linked entities in this chunk.') AS context
FROM pages p LEFT JOIN f ON p.page_id = f.page_id GROUP BY p.page_id""")
def entity_context(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.entity_context(T.anchors(F.coalesce("html", F.lit("")))).alias("context"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
