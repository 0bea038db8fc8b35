"""Registered queries of article parsing, notebook cells, prompts and the rendered texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import render as N
from loomgraph.functions import text as T
from loomgraph.functions.cid import cid
from loomgraph.operators import chunks as C
from loomgraph.operators import graph as G
from loomgraph.operators import relational as R
from loomgraph.operators import turtle as U
from loomgraph.operators import wikitext as W
from loomgraph.plans.catalogue import ANCHORS_SQL, COS_SQL, TRIPLES_SQL, anchors, body, cid_sql, incr_status, judge_completion, order_triples, query, turtle_block, vocab_topk
from loomgraph.plans.catalogue import ORACLES
from loomgraph.session import shared_folder, table
from loomgraph.sources import artefacts as A
from loomgraph.sources import readers

LINES_SQL = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '')"


@query(f"""WITH {ANCHORS_SQL}, l AS (SELECT *, '/wiki/' || replace(url_encode(replace(label, ' ', '_')), '%2F', '/') AS path FROM a)
SELECT p.page_id, '=== Infobox: page ===' || chr(10) || chr(10) || '**number**: ' || p.page_id || chr(10) || chr(10) || chr(10) || '**Page**' || chr(10) || chr(10) || '== Links ==' ||
  coalesce(chr(10) || chr(10) || string_agg('* [' || label || '](' || path || ')', chr(10) ORDER BY pos), '') AS content,
count(DISTINCT label) AS n_links, 'Pages' AS category, CAST(p.page_id AS VARCHAR) AS number FROM pages p LEFT JOIN l ON p.page_id = l.page_id GROUP BY p.page_id""")
def wikitext_article(spark, sf_dir):
    """Each page's anchors written as a wikitext article, and read again."""
    found = F.transform(T.anchors(F.coalesce("html", F.lit(""))), lambda a: F.concat(F.lit("* [["), a["label"], F.lit("]]")))
    box = F.concat(F.lit("{{Infobox page\n| image = x.png\n| number = "), F.col("page_id").cast("string"), F.lit("\n| none = {{unknown|x}}\n}}\n"))
    text = F.concat(box, F.lit("'''Page''' {{cite|t=1}}<ref>note</ref>\n== Links ==\n"), F.array_join(found, "\n"), F.lit("\n[[Category:Pages]]"))
    x = W.articles(table(spark, sf_dir, "pages").select("page_id", F.lit("Page").alias("title"), text.alias("text")), "page_id", "title", "text", most=1 << 30)
    number = F.element_at("infobox", F.lit("number"))
    return x.select(F.col("key").alias("page_id"), "content", F.size("links").cast("long").alias("n_links"), F.element_at("categories", 1).alias("category"), number.alias("number"))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text, {LINES_SQL} AS l FROM documents), p AS (SELECT doc_id, 0 AS i, -1 AS char_start FROM d UNION ALL
SELECT p.doc_id, i + 1, CASE WHEN instr(substr(text, char_start + 2), l[i + 1]) = 0 THEN char_start + 1 ELSE char_start + instr(substr(text, char_start + 2), l[i + 1]) END FROM p JOIN d ON p.doc_id = d.doc_id WHERE i < len(l))
SELECT p.doc_id, CAST(i - 1 AS INTEGER) AS chunk_num, CAST(char_start AS INTEGER) AS char_start, CAST(char_start + length(l[i]) AS INTEGER) AS char_end FROM p JOIN d ON p.doc_id = d.doc_id WHERE i > 0""")
def chunk_position(spark, sf_dir):
    """Lines as chunks, found again in their documents."""
    lines = F.filter(F.split(body(), "\n"), lambda x: F.trim(x) != "")
    x = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"), "text").select("doc_id", F.posexplode(F.arrays_zip("l", C.positions(F.col("l"), F.col("text")).alias("p"))).alias("chunk_num", "c"))
    return x.select("doc_id", "chunk_num", F.col("c.p").alias("char_start"), (F.col("c.p") + F.length("c.l")).alias("char_end"))


#: Splits at the coarsest separator that occurs; neighbours that fit are merged, from one emitted chunk to the next; long parts go one level down.
RECURSIVE_SQL = r"""WITH RECURSIVE g AS (SELECT doc_id, CAST([] AS INTEGER[]) AS path, text, 1 AS lvl FROM documents WHERE text <> ''
UNION ALL SELECT doc_id, list_append(path, CAST(i AS INTEGER)), part, s + 1 FROM (SELECT doc_id, path, s, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT *, list_filter(CASE s WHEN 4 THEN list_transform(range(1, length(text) + 1), lambda k: text[k]) ELSE string_split(text, [chr(10) || chr(10), chr(10), ' '][s]) END, lambda x: x <> '') AS parts
  FROM (SELECT *, CASE WHEN lvl <= 1 AND contains(text, chr(10) || chr(10)) THEN 1 WHEN lvl <= 2 AND contains(text, chr(10)) THEN 2 WHEN lvl <= 3 AND contains(text, ' ') THEN 3 ELSE 4 END AS s FROM g))) WHERE length(part) > 2000 AND s < 4),
p AS (SELECT doc_id, path, s, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (SELECT *, list_filter(CASE s WHEN 4 THEN list_transform(range(1, length(text) + 1), lambda k: text[k]) ELSE string_split(text, [chr(10) || chr(10), chr(10), ' '][s]) END, lambda x: x <> '') AS parts
  FROM (SELECT *, CASE WHEN lvl <= 1 AND contains(text, chr(10) || chr(10)) THEN 1 WHEN lvl <= 2 AND contains(text, chr(10)) THEN 2 WHEN lvl <= 3 AND contains(text, ' ') THEN 3 ELSE 4 END AS s FROM g))),
q AS (SELECT *, length(part) > 2000 AND s < 4 AS long, [2, 1, 1, 0][s] AS w FROM p),
u AS (SELECT *, count_if(long) OVER (PARTITION BY doc_id, path ORDER BY i) AS run FROM q),
v AS (SELECT *, CAST(sum(length(part) + w) OVER (PARTITION BY doc_id, path, run ORDER BY i) AS INTEGER) AS t FROM u WHERE NOT long),
r AS (SELECT doc_id, path, run, s, w, CAST(min(i) AS INTEGER) AS base, list(part ORDER BY i) AS parts, list(t ORDER BY i) AS t FROM v GROUP BY ALL),
e AS (SELECT doc_id, path, run, 0 AS n, 1 AS lo, CAST(NULL AS INTEGER) AS first, CAST(NULL AS INTEGER) AS until FROM r
UNION ALL SELECT doc_id, path, run, n + 1, CASE WHEN k > len(t) THEN NULL ELSE least(k, CAST(len(list_filter(list_prepend(0, t), lambda x: x < greatest(t[k - 1] - w - 128, t[k] - w - 2000))) AS INTEGER) + 1) END, lo, k - 1
FROM (SELECT e.*, r.t, r.w, CAST(len(list_filter(r.t, lambda x: x <= 2000 + r.w + list_prepend(0, r.t)[e.lo])) AS INTEGER) + 1 AS k FROM e JOIN r ON e.doc_id = r.doc_id AND e.path = r.path AND e.run = r.run WHERE e.lo IS NOT NULL)),
c AS (SELECT e.doc_id, list_append(e.path, base + first - 1) AS place, trim(CASE s WHEN 1 THEN array_to_string(parts[first:until], E'\n\n') WHEN 2 THEN array_to_string(parts[first:until], E'\n') WHEN 3 THEN array_to_string(parts[first:until], ' ') ELSE array_to_string(parts[first:until], '') END, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS chunk FROM e JOIN r ON e.doc_id = r.doc_id AND e.path = r.path AND e.run = r.run WHERE first IS NOT NULL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS chunk_num, CAST(length(chunk) AS INTEGER) AS n_chars, {cid} AS cid FROM c WHERE chunk <> ''"""


@query(RECURSIVE_SQL.replace("{cid}", cid_sql("c.chunk")))
def chunk_recursive(spark, sf_dir):
    x = C.recursive_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return x.select(F.col("key").alias("doc_id"), "chunk_num", F.length("chunk").alias("n_chars"), cid(F.col("chunk")).alias("cid"))


@query(f"""WITH c AS ({ORACLES["judge_completion"]}), g AS (SELECT doc_id, any_value(score) AS score, count(*) AS n, count_if(classification = 'GOOD') AS good, string_agg('| ' || index || ' | ' || CASE classification WHEN 'GOOD' THEN '✅ ' ELSE '❌ ' END || classification || ' | ' ||
  replace(CASE WHEN length(statement) > 60 THEN substr(statement, 1, 60) || '...' ELSE statement END, '|', '\\|') || ' | ' || reason || ' |', chr(10) ORDER BY index) AS lines FROM c GROUP BY doc_id)
SELECT doc_id, '**Context:** Doc' || chr(10) || '**Chunk:** 1 of 1' || chr(10) || '**Score:** ' || printf('%.1f', score * 100) || '% (' || good || '/' || n || ' GOOD)' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ||
'| # | Classification | Statement | Reason |' || chr(10) || '|---|----------------|-----------|--------|' || chr(10) || lines || chr(10) || chr(10) || '**Missing facts:** none' || chr(10) AS cell FROM g""")
def render_classifications(spark, sf_dir):
    # a document's lines, not a group of unknown size, come together
    x = judge_completion(spark, sf_dir).groupBy("doc_id").agg(F.first("score").alias("score"), F.array_sort(F.collect_list(F.struct("index", "statement", "classification", "reason"))).alias("c"))
    return x.select("doc_id", N.classification_cell(F.lit("Doc"), F.lit(1), F.lit(1), F.col("c"), F.lit(""), F.col("score")).alias("cell"))


@query(f"""WITH {TRIPLES_SQL}, b AS (SELECT stmt, string_agg(s || ' ' || p || ' ' || o || ' .', chr(10) ORDER BY ord) AS turtle FROM t GROUP BY stmt)
SELECT o_custkey AS article, string_agg(turtle, chr(10) || chr(10) ORDER BY stmt) AS turtle FROM b JOIN orders ON stmt = o_orderkey WHERE stmt % 4 = 0 GROUP BY 1""")
def turtle_export(spark, sf_dir):
    """Cells of each article (customer) with triples; signatures, errors and comments stay out."""
    k = F.col("stmt") % 4
    x = turtle_block(spark, sf_dir).select("stmt", F.when(k == 0, F.col("turtle")).when(k == 1, F.lit('{"cid": "b"}')).when(k == 2, F.lit("# Error: none")).otherwise(F.lit("# Statement\n  # nothing\n")).alias("cell"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stmt"), F.col("o_custkey").alias("article"))
    return x.where(N.has_triples(F.col("cell"))).join(o, "stmt").groupBy("article").agg(N.in_order(F.col("stmt"), F.col("cell"), "\n\n").alias("turtle"))


@query("""SELECT event_id, nullif('ERROR: ' || array_to_string(list_filter([CASE WHEN event_id % 2 = 0 THEN 'statement_id is required (e.g., ''1'', ''2'')' END, CASE WHEN event_id % 3 = 0 THEN 'subject is required (e.g., ''<#entity_id>'' or ''schema:Person'')' END,
CASE WHEN event_id % 5 = 0 THEN 'predicate is required (e.g., ''schema:birthDate'' or ''rdf:type'')' END, CASE WHEN event_id % 7 = 0 THEN 'object_value is required (e.g., ''"value"'' or ''<#uri>'')' END], lambda x: x IS NOT NULL), '; '), 'ERROR: ') AS error FROM events""")
def emit_validation(spark, sf_dir):
    gap = lambda n, empty: F.when(F.col("event_id") % n == 0, F.lit(empty)).otherwise(F.col("event_type"))
    fields = {"statement_id": gap(2, ""), "subject": gap(3, None), "predicate": gap(5, ""), "object_value": gap(7, None)}
    return table(spark, sf_dir, "events").select("event_id", N.emit_error(fields).alias("error"))


@query("""SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' | ' || p_type END || ' | applies to ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' | value is ' || p_size END || ' | key words' AS search_text,
p_name || ' | applies to ' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' | value is ' || p_size END AS query_text FROM part""")
def term_text(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.col("p_type"))
    size = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("string"))
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", N.term_text(F.col("p_name"), kind, F.col("p_brand"), size, F.lit("key words")).alias("search_text"), N.property_query(F.col("p_name"), F.col("p_brand"), size).alias("query_text"))


@query(f"""WITH {ANCHORS_SQL}, f AS (SELECT page_id, label, pos, CASE WHEN pos % 2 = 0 THEN 'https://en.wikipedia.org/wiki/' || label ELSE href END AS uri FROM a)
SELECT p.page_id, coalesce(string_agg('<' || uri || '> # ' || label || ' (Thing)' || CASE WHEN pos % 3 = 0 THEN ' (Wikidata: Q' || pos || ')' ELSE '' END, chr(10) ORDER BY pos), '# No entities registered yet') AS registry,
coalesce(string_agg(CASE WHEN pos % 2 = 0 THEN '- [' || label || '](/wiki/' || label || ') (Thing)' ELSE '- ' || label || ' (Thing) - URI: ' || uri END, chr(10) ORDER BY pos), 'None yet') AS known FROM pages p LEFT JOIN f ON p.page_id = f.page_id GROUP BY p.page_id""")
def registry_prompt(spark, sf_dir):
    """Entities of each page, in order, as the two prompts show them."""
    x = anchors(spark, sf_dir).withColumn("uri", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("https://en.wikipedia.org/wiki/"), "label")).otherwise(F.col("href")))
    q = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("Q"), "pos"))
    lines = x.groupBy("page_id").agg(
        N.in_order(F.col("pos"), N.registry_line(F.col("uri"), F.col("label"), F.lit("Thing"), q)).alias("registry"), N.in_order(F.col("pos"), N.known_line(F.col("uri"), F.col("label"), F.lit("Thing"))).alias("known")
    )
    return table(spark, sf_dir, "pages").select("page_id").join(lines, "page_id", "left").select("page_id", F.coalesce("registry", F.lit(N.NO_ENTITIES)).alias("registry"), F.coalesce("known", F.lit(N.NO_KNOWN)).alias("known"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN '## Prefixes' || chr(10) || source END, CASE WHEN doc_id % 3 = 0 THEN '## Classes' || chr(10) || lang END, CASE WHEN doc_id % 5 = 0 THEN '## Notes' || chr(10) || source END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS context FROM documents""")
def prompt_context(spark, sf_dir):
    part = lambda n, c: F.when(F.col("doc_id") % n == 0, F.col(c)).otherwise(F.lit(""))
    parts = {"prefixes": part(2, "source"), "class_definitions": part(3, "lang"), "usage_examples": F.lit(None).cast("string"), "custom_annotation_needs": part(5, "source")}
    return table(spark, sf_dir, "documents").select("doc_id", N.prompt_context(parts).alias("context"))


@query(f"""WITH m AS ({ORACLES["vocab_topk"]}), g AS (SELECT qid, count_if(score >= 0.5) AS n_good, string_agg(CASE WHEN score >= 0.5 THEN chr(10) || '  schema:t' || tid || ' (' || printf('%.2f', score) || ')' || chr(10) || '    URI: https://schema.org/t' || tid || chr(10) || '    Description: term ' || tid ||
  CASE WHEN tid % 4 = 0 THEN chr(10) || '    Parent class: schema:Thing' ELSE '' END END, chr(10) ORDER BY rank) AS good,
string_agg(CASE WHEN score < 0.5 THEN '  schema:t' || tid || ' (' || printf('%.2f', score) || ') - LOW CONFIDENCE' END, chr(10) ORDER BY rank) FILTER (rank <= 2) AS weak FROM m GROUP BY qid)
SELECT qid, CASE WHEN n_good > 0 THEN 'Good matches (score >= 0.5):' || chr(10) || good ELSE 'WARNING: No good matches found (all scores < 0.5).' || chr(10) || 'Consider using schema:Thing or skipping this type assertion.' || chr(10) || chr(10) || 'Weak matches (not recommended):' || chr(10) || weak END AS answer FROM g""")
def class_answer(spark, sf_dir):
    """The five best terms of each query (an array of five at most) as the class search shows them."""
    name = lambda head: F.concat(F.lit(head), F.col("tid").cast("string"))
    parent = F.when(F.col("tid") % 4 == 0, "Thing")
    match = F.struct("rank", name("schema:t").alias("prefix"), "score", name("https://schema.org/t").alias("uri"), name("term ").alias("description"), F.lit("").alias("hint"), parent.alias("parent"))
    x = vocab_topk(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(match)).alias("m"))
    return x.select("qid", N.class_answer(F.col("m")).alias("answer"))


@query(f"""SELECT CASE WHEN score >= 0.5 THEN 'good' ELSE 'weak' END AS bucket, count(*) AS n FROM ({ORACLES["vocab_topk"]}) GROUP BY 1""")
def good_weak_matches(spark, sf_dir):
    return vocab_topk(spark, sf_dir).groupBy(F.when(F.col("score") >= 0.5, "good").otherwise("weak").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""SELECT q.vec_id AS qid, CASE q.vec_id // 20 % 3 WHEN 0 THEN 'subject' WHEN 1 THEN 'predicate' ELSE 'object' END AS part, t.vec_id AS tid, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS_SQL} DESC, t.vec_id) AS INTEGER) AS rank
FROM embeddings q, embeddings t WHERE q.vec_id % 20 = 0 AND t.label % 2 = CASE WHEN q.vec_id // 20 % 3 = 1 THEN 1 ELSE 0 END AND {COS_SQL} > 0 QUALIFY rank <= 3""")
def triple_components(spark, sf_dir):
    """Three terms for each part of a triple: classes for subjects and objects, properties for predicates."""
    e = table(spark, sf_dir, "embeddings")
    k = F.floor(F.col("vec_id") / 20) % 3
    part = F.when(k == 0, "subject").when(k == 1, "predicate").otherwise("object")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), part.alias("part"), "embedding")
    one = lambda w, kind: R.top_k(q.where(w), e.where(f"label % 2 = {kind}").select(F.col("vec_id").alias("tid"), "embedding"), "qid", "tid", 3)
    x = one("part <> 'predicate'", 0).unionByName(one("part = 'predicate'", 1))
    return x.join(q.select("qid", "part"), "qid").select("qid", "part", "tid", "rank")


@query(f"""WITH {TRIPLES_SQL}, b AS (SELECT stmt, string_agg(s || ' ' || p || ' ' || o || ' .', chr(10) ORDER BY ord) AS turtle FROM t WHERE stmt % 5 <> 0 GROUP BY stmt)
SELECT o_orderkey, '# Statement [1.' || o_orderkey || ']: order ' || o_orderkey || chr(10) || coalesce(turtle, '# No triples emitted for this statement') AS cell FROM orders LEFT JOIN b ON stmt = o_orderkey""")
def rdf_cell(spark, sf_dir):
    t = G.turtle(order_triples(spark, sf_dir).where("stmt % 5 <> 0"), ["stmt"], "ord")
    x = table(spark, sf_dir, "orders").select("o_orderkey").join(t, F.col("o_orderkey") == F.col("stmt"), "left")
    return x.select("o_orderkey", N.rdf_cell(F.lit(1), F.col("o_orderkey"), F.concat(F.lit("order "), "o_orderkey"), F.col("turtle")).alias("cell"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'emit_triples' WHEN 1 THEN 'emit_triple' ELSE 'find_class' END AS name,
  '{"subject": "order ' || l_orderkey || '", "object": "' || repeat('part ' || l_partkey || ' ', l_linenumber * 4) || '"}' AS args FROM lineitem),
e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, name, args) AS i FROM c WHERE name <> 'find_class'),
d AS (SELECT l_orderkey, '# Debug: ' || count(*) || ' emit tool calls made for chunk' || chr(10) || string_agg('#   ' || name || ': ' || left(args, 200), chr(10) ORDER BY i) FILTER (WHERE i <= 5) AS calls FROM e GROUP BY l_orderkey)
SELECT o_orderkey, '# Statement [1.' || o_orderkey || ']: order ' || o_orderkey || chr(10) || CASE WHEN o_orderstatus = 'F' THEN 'ex:o' || o_orderkey || ' ex:status "F" .'
  ELSE '# No triples emitted for this statement' || coalesce(chr(10) || calls, '') END AS cell FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""")
def rdf_cell_debug(spark, sf_dir):
    """Cells of statements with and without triples: the latter show the calls that should have emitted some."""
    k = F.col("l_linenumber") % 3
    name = F.when(k == 0, "emit_triples").when(k == 1, "emit_triple").otherwise("find_class")
    said = F.expr("repeat(concat('part ', l_partkey, ' '), cast(l_linenumber * 4 as int))")
    args = F.concat(F.lit('{"subject": "order '), "l_orderkey", F.lit('", "object": "'), said, F.lit('"}'))
    made = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", name.alias("name"), args.alias("args")).alias("call"))
    calls = made.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("call")).alias("calls"))  # an order's few lines
    x = table(spark, sf_dir, "orders").join(calls, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    block = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("ex:o"), "o_orderkey", F.lit(' ex:status "F" .')))
    return x.select("o_orderkey", N.rdf_cell(F.lit(1), F.col("o_orderkey"), F.concat(F.lit("order "), "o_orderkey"), block, F.col("calls")).alias("cell"))


@query(f"""WITH k AS (SELECT n_nationkey, {cid_sql("'{\"config_cid\": \"' || n_name || '\", \"devset_cid\": \"d\", \"eval_size\": ' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ', \"extractor_cid\": \"x\"' END || '}'")} AS input_cid FROM nation)
SELECT n_nationkey, input_cid, n_nationkey % 3 = 0 AS hit, CASE WHEN n_nationkey % 3 = 0 AND n_nationkey <> 0 THEN 0.5 END AS improvement FROM k""")
def baseline_lookup(spark, sf_dir):
    """Inputs of a run against a cache that knows every third one; improvement over the cached score."""
    n = table(spark, sf_dir, "nation")
    extractor = F.when(F.col("n_nationkey") % 2 == 0, F.lit("")).otherwise(F.lit("x"))
    key = N.baseline_input(F.col("n_name"), F.lit("d"), F.col("n_regionkey"), extractor)
    x = n.select("n_nationkey", key.alias("input_cid"))
    cache = x.where("n_nationkey % 3 = 0").select("input_cid", F.col("n_nationkey").cast("double").alias("score"))
    x = x.join(cache, "input_cid", "left")
    return x.select("n_nationkey", "input_cid", F.col("score").isNotNull().alias("hit"), N.improvement(F.col("score") + 0.5, F.col("score")).alias("improvement"))


@query("""WITH m AS (SELECT 'ex:m' || l_orderkey || '_' || l_linenumber AS s, * FROM lineitem)
SELECT a.s AS membership, a.o AS member, b.o AS begin, c.o AS organization FROM (SELECT DISTINCT s, 'ex:p' || l_partkey AS o FROM m) a JOIN (SELECT DISTINCT s, strftime(l_shipdate, '%Y-%m-%d') AS o FROM m WHERE l_linenumber > 1) b ON a.s = b.s
JOIN (SELECT DISTINCT s, 'ex:s' || l_suppkey AS o FROM m WHERE l_suppkey % 3 = 0) c ON a.s = c.s""")
def bgp_membership(spark, sf_dir):
    """Memberships with member, organisation and begin: a star of three patterns, which leaves out incomplete ones.

    The tables have no gaps, so two are made: a first line item has no begin, and a supplier whose key isn't a
    multiple of 3 stands for an organisation that is unknown, so that its memberships have none.
    """
    li = table(spark, sf_dir, "lineitem")
    s = F.concat(F.lit("ex:m"), "l_orderkey", F.lit("_"), "l_linenumber")
    edge = lambda p, o, where="true": li.where(where).select(s.alias("s"), F.lit(p).alias("p"), o.alias("o")).distinct()
    t = edge("ex:member", F.concat(F.lit("ex:p"), "l_partkey")).unionByName(edge("ex:begin", F.date_format("l_shipdate", "yyyy-MM-dd"), "l_linenumber > 1")).unionByName(edge("ex:org", F.concat(F.lit("ex:s"), "l_suppkey"), "l_suppkey % 3 = 0"))
    return G.match(t, [("?membership", "ex:member", "?member"), ("?membership", "ex:begin", "?begin"), ("?membership", "ex:org", "?organization")])


@query("SELECT status, count(*) AS n FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'regenerate' ELSE 'generate' END AS status FROM documents) GROUP BY 1")
def run_counters(spark, sf_dir):
    """Counters of a run, which come with the write of its rows."""
    names = ("skip", "regenerate", "generate")
    seen = A.save_counted(incr_status(spark, sf_dir), shared_folder(spark, "status"), {n: F.count_if(F.col("status") == n) for n in names})
    return spark.createDataFrame([(n, seen[n]) for n in names if seen[n]], "status string, n long")


@query("""SELECT conv_id, CAST(count_if(role = 'user') AS BIGINT) AS n_user, CAST(count_if(role = 'assistant') AS BIGINT) AS n_assistant, bool_or(contains(text, '?')) AS has_question, max(turn) AS last_turn FROM conversations GROUP BY 1""")
def tool_log_flags(spark, sf_dir):
    """Calls by kind and flags for each conversation."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.bool_or(F.col("text").contains("?")).alias("has_question"), F.max("turn").alias("last_turn"))


def document_cells(spark, sf_dir):
    """Each document as a notebook: a header, a signed chunk cell, a signed statements cell and one whose signature is broken."""
    cell = lambda i, kind, source: F.struct(F.lit(i).alias("cell_idx"), F.lit(kind).alias("cell_type"), source.alias("source"))
    sign = lambda kind: F.to_json(F.struct(F.lit(kind).alias("_type"), F.sha2(body(), 256).alias("dcterms:identifier")))
    chunk = F.concat(F.lit("**Context:** Doc > "), F.coalesce("source", F.lit("")), F.lit("\n**Chunk:** 3 of 9\n\n---\n\nx"), body(), F.lit("x\n"))
    stated = F.concat(F.lit("**Context:** Doc\n**Chunk:** 3 of 9\n**Statements:** 2\n\n---\n\n1. Doc "), F.col("doc_id").cast("string"), F.lit(".\nnot numbered\n10. Last\n"))
    cells = [cell(0, "markdown", F.lit("# Header")), cell(1, "markdown", chunk), cell(2, "raw", sign("chunk")), cell(3, "markdown", stated), cell(4, "raw", sign("statements")), cell(5, "markdown", chunk), cell(6, "raw", F.lit("not json"))]
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(*cells)))


@query("SELECT doc_id, 2 AS chunk_num, 'Doc > ' || coalesce(source, '') AS section_context, sha256('x' || coalesce(text, '') || 'x') AS h, sha256(coalesce(text, '')) AS cid FROM documents")
def notebook_chunks(spark, sf_dir):
    x = readers.chunk_cells(document_cells(spark, sf_dir), ["doc_id"])
    return x.select("doc_id", "chunk_num", "section_context", F.sha2("text", 256).alias("h"), "cid")


@query("SELECT doc_id, 3 AS chunk_num, 'Doc' AS section_context, 'Doc ' || doc_id || '.|Last' AS statements FROM documents")
def notebook_statements(spark, sf_dir):
    x = readers.statement_cells(document_cells(spark, sf_dir), ["doc_id"])
    return x.select("doc_id", "chunk_num", "section_context", F.array_join("statements", "|").alias("statements"))


@query(f"WITH {TRIPLES_SQL} SELECT DISTINCT stmt, stmt % 4 <> 0 AS valid FROM t")
def turtle_validity(spark, sf_dir):
    """Blocks of triples after their prefix, every fourth with prose after it."""
    block = F.concat(F.lit("@prefix ex: <http://example.org/> .\n"), "turtle")
    text = F.when(F.col("stmt") % 4 == 0, F.concat(block, F.lit("\nsome prose {maybe}"))).otherwise(block)
    return turtle_block(spark, sf_dir).select("stmt", U.is_valid(text).alias("valid"))


@query("SELECT o_custkey AS slug, arg_max(o_orderkey, o_orderkey) AS run, count(*) AS n_runs FROM orders GROUP BY 1")
def latest_run(spark, sf_dir):
    """Runs of each article (customer), and the one that a later run continues."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slug"), F.col("o_orderkey").alias("run"))
    return A.latest(runs, ["slug"], "run").join(runs.groupBy("slug").agg(F.count("*").alias("n_runs")), "slug").select("slug", "run", "n_runs")
