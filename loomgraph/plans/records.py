"""Registered queries of signatures, incremental runs, saved artefacts, vocabulary searches and model hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import hooks as H
from loomgraph.functions import provenance as P
from loomgraph.functions import render as N
from loomgraph.functions import text as T
from loomgraph.functions.cid import cid
from loomgraph.operators import notebooks as B
from loomgraph.operators import library as L
from loomgraph.operators import relational as R
from loomgraph.plans.catalogue import ANCHORS_SQL, COS_SQL, ORACLES, anchors, body, cid_sql, query, vocab_topk
from loomgraph.session import shared_folder, table
from loomgraph.sources import artefacts as A
from loomgraph.sources import readers
from loomgraph.streaming import incremental

LINES_SQL = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '')"
TEXT_CID = cid_sql("coalesce(text, '')")
SOURCE_CID = cid_sql("coalesce(source, '')")


def source():
    return F.coalesce("source", F.lit(""))


def document_signatures(spark, sf_dir):
    """Signatures over documents: two in three of the new layout, the others of the old one; every second is derived from its source."""
    k = F.col("doc_id")
    from_cid = F.when(k % 2 == 0, cid(source())).otherwise(F.lit(""))
    new = P.make_signature(k % 7, F.lit("chunk"), cid(body()), from_cid, F.lit("OutputData"), F.when(k % 5 == 0, source()), stmt_key=F.when(k % 4 == 0, F.concat((k % 5).cast("string"), F.lit("_1"))), chunk_num=(k % 5).cast("int"))
    old = F.to_json(F.struct((k % 7).alias("cell"), F.lit("rdf").alias("type"), cid(body()).alias("cid"), F.when(k % 2 == 0, cid(source())).alias("from_cid")))
    raw = F.when(k % 11 == 0, "not json").when(k % 3 == 0, old).otherwise(new)
    return table(spark, sf_dir, "documents").select("doc_id", source().alias("nb"), F.col("doc_id").alias("cell_idx"), F.lit("raw").alias("cell_type"), raw.alias("source"))


SIGNATURES_SQL = f"""s AS (SELECT doc_id, coalesce(source, '') AS nb, doc_id AS cell_idx, CAST(doc_id % 7 AS INTEGER) AS cell, doc_id % 3 = 0 AS old, {TEXT_CID} AS cid, CASE WHEN doc_id % 2 = 0 THEN {SOURCE_CID} END AS from_cid,
  CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 = 0 THEN (doc_id % 5) || '_1' END AS stmt_key, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 5 = 0 AND source <> '' THEN source ELSE 'chunk:' || (doc_id % 7) END END AS label FROM documents WHERE doc_id % 11 <> 0)"""


@query(f"""WITH {SIGNATURES_SQL} SELECT doc_id, cell, CASE WHEN old THEN 'rdf' ELSE 'chunk' END AS type, cid, from_cid, label, stmt_key, CASE WHEN old THEN NULL ELSE 'prov:Entity, repro:OutputData' END AS types,
CASE WHEN old THEN -1 ELSE CAST(doc_id % 5 AS INTEGER) END AS chunk_num FROM s""")
def sig_roundtrip(spark, sf_dir):
    """Signatures made and parsed again, of both layouts; other text is passed over."""
    x = B.signatures(document_signatures(spark, sf_dir), ["doc_id"])
    return x.select("doc_id", "cell", "type", "cid", "from_cid", "label", "stmt_key", F.array_join("types", ", ").alias("types"), F.coalesce("chunk_num", F.lit(-1)).alias("chunk_num"))


@query(f"WITH {SIGNATURES_SQL} SELECT nb, CAST(cell AS VARCHAR) AS key, max(cell_idx) AS cell_idx, arg_max(cid, cell_idx) AS cid FROM s GROUP BY 1, 2")
def signatures_by_cell(spark, sf_dir):
    return B.signatures_by_cell(document_signatures(spark, sf_dir), ["nb"]).select("nb", "key", "cell_idx", "cid")


@query(f"WITH {SIGNATURES_SQL} SELECT nb, coalesce(stmt_key, CAST(cell AS VARCHAR)) AS key, max(cell_idx) AS cell_idx, arg_max(cid, cell_idx) AS cid FROM s GROUP BY 1, 2")
def signatures_by_statement(spark, sf_dir):
    return B.signatures_by_statement(document_signatures(spark, sf_dir), ["nb"]).select("nb", "key", "cell_idx", "cid")


@query(f"WITH {SIGNATURES_SQL} SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS stage, CASE doc_id % 4 WHEN 0 THEN 'source' WHEN 1 THEN 'chunks' ELSE 'rdf' END AS notebook, cid FROM s WHERE doc_id % 4 <> 2")
def pipeline_signatures(spark, sf_dir):
    """Four notebooks of a run, of which the third isn't there."""
    x = document_signatures(spark, sf_dir)
    parts = [(name, None if i == 2 else x.where(F.col("doc_id") % 4 == i)) for i, name in enumerate(("source", "chunks", "facts", "rdf"))]
    return B.pipeline_signatures(parts, ["doc_id"]).select("doc_id", "stage", "notebook", "cid")


@query(f"""WITH {SIGNATURES_SQL} SELECT doc_id, '# Provenance metadata (REPRODUCE-ME / PROV-O)' || chr(10) || '@prefix prov: <http://www.w3.org/ns/prov#> .' || chr(10) || '@prefix repro: <https://w3id.org/reproduceme#> .' || chr(10) ||
'@prefix pplan: <http://purl.org/net/p-plan#> .' || chr(10) || '@prefix dcterms: <http://purl.org/dc/terms/> .' || chr(10) || '@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .' || chr(10) || chr(10) ||
'<ipfs://' || cid || '>' || chr(10) || '    a prov:Entity, repro:OutputData ;' || chr(10) || '    dcterms:identifier "' || cid || '" ;' || chr(10) || '    prov:label "' || coalesce(label, 'entity:' || substr(cid, 1, 12)) || '"' ||
CASE WHEN from_cid IS NOT NULL THEN ' ;' || chr(10) || '    prov:wasDerivedFrom <ipfs://' || from_cid || '>' ELSE '' END || ' .' || chr(10) AS ttl FROM s""")
def prov_ttl(spark, sf_dir):
    """Provenance of each document's signature as a Turtle file."""
    sigs = B.signatures(document_signatures(spark, sf_dir), ["doc_id"])
    return B.provenance_turtle(sigs, ["doc_id"], ["cell_idx"]).withColumnRenamed("turtle", "ttl")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE 'new' END AS content, {TEXT_CID} AS from_cid FROM documents UNION ALL SELECT -1, 'old', 'gone'""")
def incr_upsert(spark, sf_dir):
    """A run over cells of which one in three is unchanged, one changed and one new; a cell without a source stays."""
    d = table(spark, sf_dir, "documents")
    earlier = F.when(F.col("doc_id") % 3 == 1, cid(F.concat(body(), F.lit("x")))).otherwise(cid(body()))
    old = d.where("doc_id % 3 <> 2").select("doc_id", earlier.alias("from_cid"), F.lit("old").alias("content"))
    old = old.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("gone").alias("from_cid"), F.lit("old").alias("content")))
    cells, _ = B.upsert_cells(old, d.select("doc_id", cid(body()).alias("cid")), ["doc_id"], lambda rows: rows.select("doc_id", F.lit("new").alias("content")))
    return cells.select("doc_id", "content", "from_cid")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'regenerate' ELSE 'generate' END AS status FROM documents WHERE doc_id % 3 = 0""")
def incr_skip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("cid"))
    return B.status(d, earlier_run(spark, sf_dir), ["doc_id"]).where("status = 'skip'").select("doc_id", "status")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'regenerate' ELSE 'generate' END AS status FROM documents WHERE doc_id % 3 <> 0""")
def incr_regenerate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("cid"))
    return B.status(d, earlier_run(spark, sf_dir), ["doc_id"]).where("status <> 'skip'").select("doc_id", "status")


def earlier_run(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id % 3 <> 2")
    return d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("from_cid"))


def document_statements(spark, sf_dir):
    lines = F.filter(F.split(body(), "\n"), lambda x: F.trim(x) != "")
    x = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), F.posexplode(lines).alias("i", "statement"))
    return x.select("chunk", (F.col("i") + 1).alias("stmt_idx"), F.concat(F.col("chunk").cast("string"), F.lit("_"), (F.col("i") + 1).cast("string")).alias("stmt_key"), "statement", cid(F.col("statement")).alias("cid"))


@query(f"""SELECT chunk, CAST(n AS INTEGER) AS stmt_idx, chunk || '_' || n AS stmt_key, {cid_sql("statement")} AS cid FROM (SELECT chunk, n, l[n] AS statement FROM (SELECT doc_id AS chunk, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, {LINES_SQL} AS l FROM documents)))""")
def statement_keys(spark, sf_dir):
    """Statements of each chunk (document), numbered, with keys and content ids."""
    return document_statements(spark, sf_dir).select("chunk", "stmt_idx", "stmt_key", "cid")


@query(f"""SELECT chunk, i AS stmt_idx, CASE WHEN chunk % 3 = 0 THEN 'old' ELSE 'new' END AS content FROM (SELECT doc_id AS chunk, unnest(range(1, len({LINES_SQL}) + 1)) AS i FROM documents)""")
def rdf_upsert(spark, sf_dir):
    """Chunks are redone whole if one of their statements has changed (the first, in one chunk of three) or is new."""
    s = document_statements(spark, sf_dir)
    changed = (F.col("chunk") % 3 == 1) & (F.col("stmt_idx") == 1)
    old = s.where("chunk % 3 <> 2").select("chunk", "stmt_key", F.when(changed, F.lit("other")).otherwise(F.col("cid")).alias("from_cid"), F.lit("old").alias("content"))
    cells, _ = B.upsert_chunks(old, s.select("chunk", "stmt_key", "cid", "statement"), lambda rows: rows.select("chunk", "stmt_key", F.lit("new").alias("content")))
    return cells.select("chunk", F.split_part("stmt_key", F.lit("_"), F.lit(2)).cast("long").alias("stmt_idx"), "content")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'saved' ELSE 'made' END AS content FROM documents")
def page_resume(spark, sf_dir):
    """Pages whose chunks were saved by an earlier run, and the others."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    saved = d.where("doc_id % 3 = 0").select("doc_id", F.lit("saved").alias("content"))
    return B.resume(d, saved, ["doc_id"], lambda rows: rows.select("doc_id", F.lit("made").alias("content")))


def sample_notebooks(spark, sf_dir):
    """A notebook for each user: a header, a page's cell and its signature; some have another type or no JSON."""
    v = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("views"))
    page = N.sample_cell(F.concat(F.lit('User "'), "user_id", F.lit('"')), F.col("views"), F.lit(1), F.lit(1))
    content = F.when(F.col("user_id") % 7 == 0, "no json").otherwise(page)
    kind = F.when(F.col("user_id") % 5 == 0, "other").otherwise("sample_page")
    sig = P.make_signature(F.lit(1), kind, cid(content), F.lit(""), F.lit("InputData"))
    cell = lambda i, t, s: F.struct(F.lit(i).alias("cell_idx"), F.lit(t).alias("cell_type"), s.alias("source"))
    return v.select("user_id", F.inline(F.array(cell(0, "markdown", F.lit("# Sample")), cell(1, "raw", content), cell(2, "raw", sig))))


@query("""SELECT user_id, 'User "' || user_id || '"' AS title, count(*) AS views FROM events WHERE user_id % 5 <> 0 AND user_id % 7 <> 0 GROUP BY user_id""")
def sample_pages(spark, sf_dir):
    return readers.sample_pages(sample_notebooks(spark, sf_dir), ["user_id"]).select("user_id", "title", "views")


@query("""SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'no json' ELSE '{' || chr(10) || '  "title": "User \\"' || user_id || '\\"",' || chr(10) || '  "views": ' || count(*) || ',' || chr(10) || '  "index": 1,' || chr(10) || '  "total": 1' || chr(10) || '}' END AS source FROM events GROUP BY user_id""")
def sample_cells(spark, sf_dir):
    return sample_notebooks(spark, sf_dir).where("cell_idx = 1").select("user_id", "source")


def first_layout(spark, sf_dir):
    """Each document as a notebook of the first layout: provenance, registry, a signed cell of facts and one without a signature."""
    cell = lambda i, t, s: F.struct(F.lit(i).alias("cell_idx"), F.lit(t).alias("cell_type"), s.alias("source"))
    facts = F.concat(F.lit("**Context:** Doc\n**Chunk:** 3 of 9\n\n---\n\n- Doc "), F.col("doc_id").cast("string"), F.lit(".\nnot marked\n- Last\n"))
    sig = F.to_json(F.struct(F.lit(9).alias("cell"), F.lit("facts").alias("type"), F.sha2(body(), 256).alias("cid"), F.lit("x").alias("from_cid")))
    plain = F.concat(F.lit("words "), F.col("doc_id").cast("string"))
    cells = [cell(0, "markdown", F.lit("# Facts")), cell(1, "raw", F.lit("{}")), cell(2, "markdown", facts), cell(3, "raw", sig), cell(4, "markdown", plain), cell(5, "raw", F.lit("none"))]
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(*cells)))


@query(f"""SELECT doc_id, 9 AS cell_num, 'Doc' AS breadcrumb, '- Doc ' || doc_id || '.' || chr(10) || 'not marked' || chr(10) || '- Last' AS text, sha256(coalesce(text, '')) AS cid FROM documents
UNION ALL SELECT doc_id, 2, 'Unknown', 'words ' || doc_id, {cid_sql("'words ' || doc_id")} FROM documents""")
def content_cells(spark, sf_dir):
    x = readers.content_cells(first_layout(spark, sf_dir), ["doc_id"])
    return x.select("doc_id", "cell_num", "breadcrumb", "text", "cid")


@query("SELECT doc_id, 3 AS chunk_num, 'Doc' AS section_context, 'Doc ' || doc_id || '.|Last' AS statements, sha256(coalesce(text, '')) AS cid, 'x' AS from_cid FROM documents")
def fact_sets(spark, sf_dir):
    x = readers.fact_sets(first_layout(spark, sf_dir), ["doc_id"])
    return x.select("doc_id", "chunk_num", "section_context", F.array_join("statements", "|").alias("statements"), "cid", "from_cid")


def classified(spark, sf_dir):
    """Each document as a notebook with one signed cell of classifications: a good one, and a bad one with a reason."""
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("index"), F.concat(source(), F.lit(f" {i}")).alias("statement"), F.lit(k).alias("classification"), F.lit(r).alias("reason")) for i, k, r in ((0, "GOOD", "fine"), (1, "BAD", "two claims"))])
    missing = F.when(F.col("doc_id") % 3 == 0, "None").when(F.col("doc_id") % 3 == 1, "dates").otherwise("")
    data = F.struct(rows.alias("classifications"), missing.alias("missing_facts"), F.lit(0.5).alias("score"))
    sig = F.to_json(F.struct(F.sha2(body(), 256).alias("dcterms:identifier"), F.struct(F.lit("ipfs://from").alias("@id")).alias("prov:wasDerivedFrom"), F.lit("classifications").alias("_type"), F.col("doc_id").cast("int").alias("_chunk_num"), data.alias("_classification_data")))
    cell = lambda i, t, s: F.struct(F.lit(i).alias("cell_idx"), F.lit(t).alias("cell_type"), s.alias("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(cell(0, "markdown", F.lit("# H")), cell(1, "raw", F.lit("{}")), cell(2, "markdown", F.lit("table")), cell(3, "raw", sig))))


@query("SELECT doc_id, CAST(doc_id AS INTEGER) AS chunk_num, 2 AS n, CASE doc_id % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'dates' ELSE '' END AS missing_facts, CAST(0.5 AS DOUBLE) AS score, sha256(coalesce(text, '')) AS cid, 'from' AS from_cid FROM documents")
def classification_cells(spark, sf_dir):
    x = readers.classification_cells(classified(spark, sf_dir), ["doc_id"])
    return x.select("doc_id", "chunk_num", F.size("classifications").alias("n"), "missing_facts", "score", "cid", "from_cid")


@query("SELECT doc_id, 1 AS index, coalesce(source, '') || ' 1' AS statement, 'two claims' AS reason FROM documents")
def bad_view(spark, sf_dir):
    x = readers.bad_classifications(readers.classification_cells(classified(spark, sf_dir), ["doc_id"]))
    return x.select("doc_id", "index", "statement", "reason")


@query("SELECT doc_id, 'dates' AS missing_facts FROM documents WHERE doc_id % 3 = 1")
def missing_facts(spark, sf_dir):
    return readers.with_missing_facts(readers.classification_cells(classified(spark, sf_dir), ["doc_id"])).select("doc_id", "missing_facts")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '')) > 0")
def usable_facts(spark, sf_dir):
    """Cells without an error and with a statement."""
    lines = F.filter(F.split(body(), "\n"), lambda x: F.trim(x) != "")
    x = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "# Error: none").otherwise(body()).alias("facts"), lines.alias("l"))
    return readers.usable_facts(x, "facts", "l").select("doc_id")


@query(f"""SELECT doc_id, {cid_sql("'{\"chunk_text\": ' || coalesce('\"' || source || '\"', 'null') || ', \"section_context\": ' || coalesce('\"' || lang || '\"', 'null') || '}'")} AS cid, count(*) OVER () AS n FROM documents""")
def trainset_roundtrip(spark, sf_dir):
    """Examples saved with their ids and the whole set's id, and read again."""
    path = shared_folder(spark, "artefacts")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("chunk_text"), F.col("lang").alias("section_context"))
    whole = A.save_examples(rows, "trainset", path)
    return A.load(spark, path, "trainset").join(whole.select("n"), F.lit(True)).select(F.col("ord").alias("doc_id"), "cid", "n")  # one row


@query("SELECT vec_id, CASE label % 2 WHEN 0 THEN 'class' ELSE 'property' END AS prefix, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def vocabulary_roundtrip(spark, sf_dir):
    """Terms with embeddings saved by vocabulary, and read again."""
    path = shared_folder(spark, "vocabulary")
    A.save_vocabulary(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("label") % 2 == 0, "class").otherwise("property").alias("prefix")), path)
    x = spark.read.parquet(path)
    return x.select("vec_id", "prefix", F.size("embedding").cast("long").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total"))


@query(f"WITH {ANCHORS_SQL} SELECT page_id, label AS key, arg_max(href, pos) AS uri, count(*) AS n FROM a GROUP BY 1, 2")
def registry_roundtrip(spark, sf_dir):
    """Each page's anchors as a registry in JSON, and read again."""
    e = anchors(spark, sf_dir).groupBy("page_id", F.col("label").alias("key")).agg(F.max_by("href", "pos").alias("uri"), F.count("*").alias("n"))
    return A.registry_entities(A.registry_json(e, ["page_id"]), ["page_id"], "uri:string,n:long")


@query("SELECT 'entities' AS part, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer UNION ALL SELECT 'relations', count(*), CAST(sum(o_custkey) AS BIGINT) FROM orders")
def graph_export(spark, sf_dir):
    path = shared_folder(spark, "graph")
    A.export_graph(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey"), path)
    one = lambda p: spark.read.parquet(f"{path}/{p}").agg(F.lit(p).alias("part"), F.count("*").alias("n"), F.sum("id").alias("total"))
    return one("entities").unionByName(one("relations"))


@query("""SELECT doc_id, '# Chunks: Doc ' || doc_id || chr(10) || chr(10) || '## Provenance' || chr(10) || chr(10) || '```yaml' || chr(10) || 'source_url: http://x/' || doc_id || coalesce(chr(10) || 'article_title: ' || source, '') || chr(10) ||
'license: CC BY-SA 4.0' || chr(10) || '```' || chr(10) || chr(10) || '## Description' || chr(10) || chr(10) || 'Chunks of a document.' || chr(10) AS head FROM documents""")
def notebook_headers(spark, sf_dir):
    name = F.concat(F.lit("Chunks: Doc "), F.col("doc_id").cast("string"))
    fields = [("source_url", F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))), ("article_title", F.col("source")), ("license", F.lit("CC BY-SA 4.0"))]
    return table(spark, sf_dir, "documents").select("doc_id", B.header(name, fields, [("Description", "Chunks of a document.")]).alias("head"))


@query("SELECT c_mktsegment AS nb, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS INTEGER) AS cell_idx, 'raw' AS cell_type, c_name || chr(10) || '\"' AS source FROM customer")
def notebook_save(spark, sf_dir):
    """Notebooks (a cell for each customer of a segment) saved as JSON, and read by the notebook reader."""
    path = shared_folder(spark, "notebooks")
    cells = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("nb"), F.col("c_custkey").alias("cell_idx"), F.lit("raw").alias("cell_type"), F.concat("c_name", F.lit('\n"')).alias("source"))
    B.save(cells, "nb", path)
    x = readers.notebook_cells(spark, f"{path}/*/*")
    return x.select(F.url_decode(F.regexp_extract("path", "nb=([^/]*)/", 1)).alias("nb"), "cell_idx", "cell_type", "source")


@query("SELECT o_orderkey, 'data/' || lower(replace(replace(o_orderpriority, ' ', '_'), '/', '_')) || '/' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS path FROM orders")
def run_layout(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", A.run_path("data", F.col("o_orderpriority"), F.col("o_orderdate")).alias("path"))


@query("SELECT o_custkey AS slug, arg_max(o_orderkey, o_orderkey) AS run, count(*) AS n_files FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey) GROUP BY 1")
def run_continue(spark, sf_dir):
    """A new run of each article (customer) starts with copies of the files (line items) of the last one."""
    last = A.latest(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slug"), F.col("o_orderkey").alias("run")), ["slug"], "run")
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("name"))
    x = A.continue_from(files, last.select(F.col("slug").alias("path"), F.col("run").alias("from_path")))
    return x.groupBy(F.col("path").alias("slug")).agg(F.count("*").alias("n_files")).join(last, "slug").select("slug", "run", "n_files")


@query("""SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, CAST(year(CAST(ts AS DATE) - 30) AS INTEGER) AS year, CAST(month(CAST(ts AS DATE) - 30) AS INTEGER) AS month,
CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso, (epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01 00:00:00')) / 1000000.0 AS seconds FROM events""")
def date_functions(spark, sf_dir):
    y, m = A.month_before(F.col("ts"))
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", A.stamp(ts).alias("stamp"), y.alias("year"), m.alias("month"), A.iso(ts).alias("iso"), A.elapsed(F.lit("2020-01-01 00:00:00").cast("timestamp"), ts).alias("seconds"))


@query("""SELECT l_orderkey AS chunk, l_linenumber AS line, CASE WHEN lower(l_shipmode) = 'a' THEN 'e1' ELSE 'p' || l_linenumber END AS source_id, 'g_' || lower(l_linestatus) AS target_id FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_shipmode, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2) WHERE l_linenumber <> 3""")
def kg_endpoints(spark, sf_dir):
    """Relations of each chunk (order): both ends by the chunk's own mentions, then by the entities; third line items lack one."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))
    p, s = F.concat(F.lit("p"), "l_linenumber"), F.concat(F.lit("s"), "l_linenumber")
    rel = li.select(F.col("l_orderkey").alias("chunk"), F.col("l_linenumber").alias("line"), p.alias("source_id"), s.alias("target_id"))
    m = li.select(F.col("l_orderkey").alias("chunk"), p.alias("id"), F.col("l_returnflag").alias("label")).unionByName(li.where("l_linenumber <> 3").select(F.col("l_orderkey").alias("chunk"), s.alias("id"), F.col("l_linestatus").alias("label")))
    status = li.select(F.lower("l_linestatus").alias("key")).distinct().select("key", F.concat(F.lit("g_"), "key").alias("id"))
    known = status.unionByName(spark.range(1).select(F.lit("a").alias("key"), F.lit("e1").alias("id")))
    return R.endpoints(rel, m, known).select("chunk", "line", "source_id", "target_id")


@query(f"""WITH p AS (SELECT q.vec_id AS qid, CASE t.label % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS vocabulary, t.vec_id AS tid, {COS_SQL} AS score FROM embeddings q, embeddings t WHERE q.vec_id % 20 = 0 AND {COS_SQL} > 0),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid, vocabulary ORDER BY score DESC, tid) <= 5) SELECT qid, vocabulary, tid, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) AS INTEGER) AS rank FROM k QUALIFY rank <= 5""")
def vocab_merge_topk(spark, sf_dir):
    """The best five of each of three vocabularies, then the best five of all."""
    e = table(spark, sf_dir, "embeddings")
    k = F.col("label") % 3
    terms = e.select(F.col("vec_id").alias("tid"), "embedding", F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("vocabulary"))
    x = R.merged_top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), terms, "qid", "tid", "vocabulary", 5)
    return x.withColumn("score", F.round("score", 6))


@query("""WITH t AS (SELECT vec_id AS tid, embedding, CASE label % 2 WHEN 0 THEN 'class' ELSE 'property' END AS kind FROM embeddings), q AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, kind, tid, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS score FROM q, t WHERE qid % 40 = 0),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) <= 20)
SELECT qid, kind, tid, CAST(row_number() OVER (PARTITION BY qid, kind ORDER BY score DESC, tid) AS INTEGER) AS rank FROM k
UNION ALL SELECT qid, kind, tid, CAST(r AS INTEGER) FROM (SELECT qid FROM q WHERE qid % 40 <> 0), (SELECT kind, tid, row_number() OVER (PARTITION BY kind ORDER BY tid) AS r FROM t) WHERE r <= 20""")
def library_search(spark, sf_dir):
    """The twenty best terms of both kinds by product, split by kind; every second query has no embedding."""
    e = table(spark, sf_dir, "embeddings")
    terms = e.select(F.col("vec_id").alias("tid"), "embedding", F.when(F.col("label") % 2 == 0, "class").otherwise("property").alias("kind"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.when(F.col("vec_id") % 40 == 0, F.col("embedding")).alias("embedding"))
    return R.library_search(q, terms, "qid", "tid", "kind", "tid", 20)


@query("""SELECT t.vec_id, round(sqrt(list_sum(list_transform(range(1, len(t.embedding) + 1), lambda i: pow(CAST(t.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE), 2)))), 5) AS distance
FROM embeddings t, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY sqrt(list_sum(list_transform(range(1, len(t.embedding) + 1), lambda i: pow(CAST(t.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE), 2)))), t.vec_id LIMIT 10""")
def duck_similarity(spark, sf_dir):
    """The ten rows nearest to one vector."""
    e = table(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 0").select("embedding").first()
    return R.nearest_rows(e, list(first[0]) if first else [], 10, "vec_id").withColumn("distance", F.round("distance", 5))


@query(f"""WITH m AS ({ORACLES["vocab_topk"]}), g AS (SELECT qid, count_if(score >= 0.5) AS n_good, string_agg(CASE WHEN score >= 0.5 THEN chr(10) || '  schema:t' || tid || ' (' || printf('%.2f', score) || ')' || chr(10) || '    URI: https://schema.org/t' || tid || chr(10) || '    Domain (subject type): Thing' ||
  CASE WHEN tid % 4 = 0 THEN chr(10) || '    Range (object type): Text' ELSE '' END || chr(10) || '    Description: term ' || tid END, chr(10) ORDER BY rank) AS good,
string_agg(CASE WHEN score < 0.5 THEN '  schema:t' || tid || ' (' || printf('%.2f', score) || ') - TOO LOW, DO NOT USE' END, chr(10) ORDER BY rank) FILTER (rank <= 2) AS weak FROM m GROUP BY qid)
SELECT qid, CASE WHEN n_good > 0 THEN 'Good matches (score >= 0.5):' || chr(10) || good ELSE 'WARNING: No good matches found (all scores < 0.5).' || chr(10) || 'DO NOT emit a random/unrelated triple.' || chr(10) ||
'Options: 1) Skip this statement, 2) Use rdfs:comment to store as text' || chr(10) || chr(10) || 'Weak matches (DO NOT USE):' || chr(10) || weak END AS answer FROM g""")
def property_answer(spark, sf_dir):
    name = lambda head: F.concat(F.lit(head), F.col("tid").cast("string"))
    match = F.struct("rank", name("schema:t").alias("prefix"), "score", name("https://schema.org/t").alias("uri"), F.lit("Thing").alias("domain"), F.when(F.col("tid") % 4 == 0, "Text").alias("range"), name("term ").alias("description"), F.lit("").alias("hint"))
    x = vocab_topk(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(match)).alias("m"))  # five at most
    return x.select("qid", N.property_answer(F.col("m")).alias("answer"))


@query("""SELECT p_brand, string_agg('- ' || p_name || ' (http://x/' || p_partkey || '): ' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'No description' END, chr(10) ORDER BY p_partkey) AS classes,
string_agg('- ' || CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_name END || ' (http://x/' || p_partkey || ')' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '  Description: ' || p_type ELSE '' END || chr(10) || '  Domain: Any, Range: ' || p_size, chr(10) ORDER BY p_partkey) AS properties,
string_agg('```turtle' || chr(10) || p_name || chr(10) || '```', chr(10) ORDER BY p_partkey) FILTER (r <= 5) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) GROUP BY 1""")
def term_formatting(spark, sf_dir):
    """Terms (parts) of each brand as a prompt shows them."""
    uri = F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string"))
    about = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))
    named = F.when(F.col("p_partkey") % 3 != 0, F.col("p_name"))
    x = table(spark, sf_dir, "part").groupBy("p_brand").agg(
        N.in_order(F.col("p_partkey"), N.class_line(uri, F.col("p_name"), about)).alias("classes"),
        N.in_order(F.col("p_partkey"), N.property_lines(uri, named, about, F.lit(None).cast("string"), F.col("p_size").cast("string"))).alias("properties"),
        F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("e"),
    )
    return x.select("p_brand", "classes", "properties", N.examples_text(F.transform("e", lambda r: r["p_name"])).alias("examples"))


@query("SELECT avg(CAST(coalesce(quality, 0) AS DOUBLE)) AS mean, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)")
def metric_mean(spark, sf_dir):
    """The evaluator's mean over all documents; those without a label score 0."""
    x = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return H.evaluated(x, F.col("quality").cast("double"))[1]


@query("SELECT CAST(count_if(label % 2 = 0) AS BIGINT) AS n_classes, CAST(count_if(label % 2 <> 0) AS BIGINT) AS n_properties, count(*) AS n_terms FROM embeddings")
def term_counts(spark, sf_dir):
    return readers.term_counts(table(spark, sf_dir, "embeddings").select(F.when(F.col("label") % 2 == 0, "class").otherwise("property").alias("term_type")))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 3 = 0 THEN 'second' ELSE 'last' END AS value FROM events""")
def key_aliases(spark, sf_dir):
    """The first of several keys that has a value."""
    a = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("")
    b = F.when(F.col("event_id") % 3 == 0, "second")
    return table(spark, sf_dir, "events").select("event_id", T.first_given(a, b, F.lit("last")).alias("value"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 's ' || event_type || ' o .' || CASE WHEN event_id % 3 = 0 THEN '' ELSE chr(10) || '(1 errors skipped)' END
WHEN event_id % 3 = 0 THEN 'ERROR: item 0: missing [''predicate'']; item 1: missing [''predicate'']' ELSE 'ERROR: item 0: missing [''predicate'']; item 1: missing [''predicate'']; item 2: missing [''subject'', ''object'']' END AS answer FROM events""")
def emit_many(spark, sf_dir):
    """Calls that emit two equal triples, and a third that lacks its subject and object."""
    t = lambda s, p, o: F.struct(F.lit("1").alias("statement_id"), F.lit(s).alias("subject"), p.alias("predicate"), F.lit(o).alias("object"))
    p = F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.lit(""))
    two = F.array(t("s", p, "o"), t("s", p, "o"))
    calls = F.when(F.col("event_id") % 3 == 0, two).otherwise(F.concat(two, F.array(t("", F.col("event_type"), None))))
    return table(spark, sf_dir, "events").select("event_id", N.emit_many(calls)["answer"].alias("answer"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'hint ' || p_size END AS usage_hint FROM part")
def vocabulary_hints(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("label"))
    hints = p.select("label").distinct().where("cast(label as int) % 3 = 0").select("label", F.concat(F.lit("hint "), "label").alias("hint"))
    return readers.with_hints(p, hints).select("p_partkey", "usage_hint")


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 'm' WHEN starts_with(url, 'https://') THEN 's' WHEN starts_with(url, 'http://') THEN 'p' END AS prefix FROM pages")
def uri_prefix(spark, sf_dir):
    """Namespaces that begin alike: the first in order wins."""
    known = spark.createDataFrame([(0, "m", "https://m."), (1, "s", "https://"), (2, "p", "http://"), (3, "q", "http")], "ord int, prefix string, ns string")
    return L.first_prefix(table(spark, sf_dir, "pages").select("page_id", "url"), "url", known).select("page_id", "prefix")


@query(f"""WITH {ANCHORS_SQL} SELECT page_id, pos, label, 'https://en.wikipedia.org/wiki' || href AS href FROM a""")
def markdown_links(spark, sf_dir):
    """Anchors written as Markdown links, and found again."""
    md = F.array_join(F.transform(T.anchors(F.coalesce("html", F.lit(""))), lambda a: F.concat(F.lit("["), a["label"], F.lit("](/wiki"), a["href"], F.lit(")"))), " and [x](http://y) ")
    x = table(spark, sf_dir, "pages").select("page_id", F.posexplode(T.article_links(md, "https://en.wikipedia.org")).alias("pos", "l"))
    return x.select("page_id", F.col("pos").cast("long"), "l.*")


@query(f"""WITH {ANCHORS_SQL} SELECT page_id, label, arg_max(href, pos) AS href FROM a GROUP BY 1, 2""")
def markdown_link_map(spark, sf_dir):
    x = table(spark, sf_dir, "pages").select("page_id", T.link_map(T.anchors(F.coalesce("html", F.lit("")))).alias("m"))
    return x.select("page_id", F.explode("m").alias("label", "href"))


def _embed():
    return lambda texts: [[float(len(t)), float(sum(map(ord, t[:3])))] for t in texts]


@query("SELECT doc_id, CAST(length(lang) AS DOUBLE) AS a, CAST(unicode(lang) + unicode(substr(lang, 2)) AS DOUBLE) AS b FROM documents")
def embed_hook(spark, sf_dir):
    """A stand-in embedding function, called a batch at a time."""
    x = table(spark, sf_dir, "documents").select("doc_id", H.embedding(F.col("lang"), _embed).alias("v"))
    return x.select("doc_id", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))


def _facts():
    def answer(doc_id, lang):
        if doc_id % 5 == 0:
            raise ValueError("no answer")
        return f"- {lang}"

    return answer


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '# Error: no answer' ELSE '- ' || coalesce(lang, 'None') END AS content, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'processed' END AS status FROM documents")
def facts_chain(spark, sf_dir):
    """A stand-in model that fails on every fifth row."""
    return H.each(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], ["doc_id", "lang"], _facts)


def _turns():
    def turn(messages):
        n = sum(kind == "assistant" for kind, _ in messages)
        key = int(messages[0][1])
        calls = [[("find", {"text": "a"})], [("nothing", {})], [("find", {"other": 1}), ("fail", {})]]
        return ("done", []) if n >= key % 4 else ("", calls[n])

    return turn


def _find(text: str) -> str:
    return f"found {text}"


def _fail() -> str:
    raise ValueError("broken")


@query("""SELECT doc_id, CAST(i AS INTEGER) AS iteration, CAST(k AS INTEGER) AS call, tool, CASE WHEN tool IS NULL THEN 'done' WHEN r = 'type' THEN 'Invalid arguments' ELSE r END AS result FROM documents, (VALUES (1, 0, 'find', 'found a', 1), (2, 0, 'nothing', 'Unknown tool: nothing', 2), (3, 0, 'find', 'type', 3), (3, 1, 'fail', 'Error calling fail: broken', 3)) AS v(i, k, tool, r, least) WHERE doc_id % 4 >= least
UNION ALL SELECT doc_id, CAST(doc_id % 4 + 1 AS INTEGER), 0, NULL, 'done' FROM documents""")
def tool_loop(spark, sf_dir):
    """A stand-in model that calls tools in up to three turns: one that works, one that isn't there, wrong arguments, one that fails."""
    x = H.tool_loop(table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("prompt")), ["doc_id"], "prompt", _turns, {"find": _find, "fail": _fail})
    return x.select("doc_id", "iteration", "call", "tool", F.when(F.col("result").startswith("Invalid arguments"), "Invalid arguments").otherwise(F.col("result")).alias("result"))


@query("SELECT conv_id, CAST(count_if(role = 'user') AS BIGINT) AS \"user\", CAST(count_if(role = 'assistant') AS BIGINT) AS assistant FROM conversations GROUP BY 1")
def tool_log_pivot(spark, sf_dir):
    """Calls by kind, a column for each kind."""
    x = table(spark, sf_dir, "conversations").groupBy("conv_id").pivot("role", ["user", "assistant"]).count()
    return x.select("conv_id", F.coalesce("user", F.lit(0)).alias("user"), F.coalesce("assistant", F.lit(0)).alias("assistant"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN '' WHEN 2 THEN coalesce(text, '') END AS content FROM documents")
def page_extracts(spark, sf_dir):
    """Responses with a missing page, a page without a text, a page with one, and no JSON."""
    k, no = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    page = F.create_map(F.when(k == 0, "-1").otherwise(no), F.struct(F.when(k == 2, F.col("text")).alias("extract")))
    value = F.when(k == 3, "no json").otherwise(F.to_json(F.struct(F.struct(page.alias("pages")).alias("query"))))
    return readers.page_extracts(table(spark, sf_dir, "documents").select("doc_id", value.alias("value")))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Q' || page_id END AS item FROM pages")
def item_ids(spark, sf_dir):
    """Responses with an item, without properties, and with an error."""
    k, no = F.col("page_id") % 3, F.col("page_id").cast("string")
    props = F.when(k == 0, F.struct(F.concat(F.lit("Q"), no).alias("wikibase_item")))
    value = F.when(k == 2, '{"error": {"code": "x"}}').otherwise(F.to_json(F.struct(F.struct(F.create_map(no, F.struct(props.alias("pageprops"))).alias("pages")).alias("query"))))
    return readers.item_ids(table(spark, sf_dir, "pages").select("page_id", value.alias("value")))


@query("""SELECT 'schema:P' || p_partkey AS uri, p_name AS label, p_type AS description, CASE WHEN p_partkey % 2 = 0 THEN 'class' ELSE 'property' END AS term_type, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'schema:D0, schema:D1, schema:D2' END AS domain,
CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'schema:R' || p_size END AS range, CASE WHEN p_partkey % 2 = 0 THEN 'schema:Thing' END AS parent FROM part WHERE p_partkey % 5 <> 0""")
def vocabulary_scan(spark, sf_dir):
    """Parts of each brand as a JSON-LD document; one in five is of another vocabulary."""
    k = F.col("p_partkey")
    thing = lambda x: F.struct(x.alias("@id"))
    node = F.struct(
        F.concat(F.when(k % 5 == 0, "other:P").otherwise("schema:P"), k.cast("string")).alias("@id"),
        F.when(k % 2 == 0, "rdfs:Class").otherwise("rdf:Property").alias("@type"),
        F.col("p_name").alias("rdfs:label"),
        F.struct(F.col("p_type").alias("@value")).alias("rdfs:comment"),
        F.when(k % 2 != 0, F.array(*[thing(F.lit(f"schema:D{i}")) for i in range(4)])).alias("schema:domainIncludes"),
        F.when(k % 2 != 0, thing(F.concat(F.lit("schema:R"), F.col("p_size").cast("string")))).alias("schema:rangeIncludes"),
        F.when(k % 2 == 0, thing(F.lit("schema:Thing"))).alias("rdfs:subClassOf"),
    )
    # a document holds 20 parts of a brand at most, so none grows with the table
    x = table(spark, sf_dir, "part").groupBy("p_brand", F.floor(k / 20)).agg(F.collect_list(node).alias("@graph"))
    return readers.vocabulary(x.select(F.to_json(F.struct("`@graph`")).alias("value")))


@query("SELECT o_orderkey AS run, o_totalprice AS metric, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_traces FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def run_search(spark, sf_dir):
    """The latest run (order) with its metric and its number of traces (line items)."""
    last = A.search(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", 1)
    x = last.join(table(spark, sf_dir, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return x.groupBy(F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("metric")).agg(F.count("l_orderkey").alias("n_traces"))


@query(f"SELECT DISTINCT {TEXT_CID} AS cid FROM documents")
def stream_upsert(spark, sf_dir):
    """Documents as a stream: each content is signed and written once, though the stream is begun anew over the same table."""
    path, at = shared_folder(spark, "signed"), F.lit("2024-01-01 00:00:00").cast("timestamp")  # one time: no row is late
    shape = table(spark, sf_dir, "documents").schema
    for _ in range(2):
        # a pattern, since a stream reads folders only and the table may be a file
        rows = spark.readStream.schema(shape).parquet(f"{sf_dir}/{{documents}}.parquet").select(body().alias("content"), at.alias("at"))
        run = incremental.signed(rows, "content", "at").select("cid", "at").writeStream.foreachBatch(incremental.upsert_to(path))
        run.option("checkpointLocation", shared_folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("cid string").parquet(path)
