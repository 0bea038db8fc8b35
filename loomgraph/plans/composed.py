"""Registered queries of whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.cid import cid
from loomgraph.operators import graph as G
from loomgraph.operators import runs as R
from loomgraph.plans.catalogue import body, cid_sql, query
from loomgraph.plans.files import LINES_SQL, document_articles
from loomgraph.session import shared_folder, table
from loomgraph.sources import readers


@query()
def sample_run(spark, sf_dir):
    """Documents as listed pages in two runs: the second one takes the notebooks that the first has written for a third of them."""
    d, folder, index = document_articles(spark, sf_dir), shared_folder(spark, "sample"), shared_folder(spark, "sample_index")
    listed = d.select(F.col("doc_id").alias("id"), "title")
    R.sample_run(listed.where("id % 3 = 0"), d, folder, index=index)
    saved = readers.listed_cells(spark, folder, index)
    x = R.sample_run(listed, d, folder, saved)
    return x.select("title", "chunk_num", "section_context", F.sha2("text", 256).alias("h"), "saved")


@query("""SELECT 'processed' AS counter, CAST(count_if(doc_id % 3 <> 0 AND doc_id % 5 <> 0) AS BIGINT) AS n FROM documents UNION ALL SELECT 'skipped', CAST(count_if(doc_id % 3 = 0) AS BIGINT) FROM documents
UNION ALL SELECT 'errors', CAST(count_if(doc_id % 3 <> 0 AND doc_id % 5 = 0) AS BIGINT) FROM documents UNION ALL SELECT 'total', count(*) FROM documents
UNION ALL SELECT 'cells', count(*) + 1 FROM documents UNION ALL SELECT 'old cells', CAST(count_if(doc_id % 3 = 0) + 1 AS BIGINT) FROM documents""")
def facts_run(spark, sf_dir):
    """Facts of documents after a run that knew two in three and of which one in two is out of date; one answer in five fails."""
    d = table(spark, sf_dir, "documents").select("doc_id", body().alias("text"))
    earlier = F.when(F.col("doc_id") % 3 == 0, cid(F.col("text"))).otherwise(F.lit("before"))
    old = d.where("doc_id % 3 <> 2").select("doc_id", earlier.alias("from_cid"), F.lit("old").alias("content"))
    old = old.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("gone").alias("from_cid"), F.lit("old").alias("content")))
    answer = lambda rows: rows.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "# Error: none").otherwise("- new").alias("content"))
    path = shared_folder(spark, "facts")
    n = R.facts_run(d, old, answer, path, ["doc_id"])
    cells = spark.read.parquet(path)
    counted = spark.createDataFrame([(k, int(v)) for k, v in n.items()], "counter string, n long")
    kinds = cells.agg(F.count("*").alias("cells"), F.count_if(F.col("content") == "old").alias("old cells"))
    return counted.unionByName(kinds.unpivot([], ["cells", "old cells"], "counter", "n"))


@query(f"""WITH l AS (SELECT doc_id AS chunk, list_filter(list_transform({LINES_SQL}, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS l FROM documents WHERE doc_id % 7 <> 0),
s AS (SELECT chunk, l[n] AS statement, n FROM (SELECT chunk, l, unnest(range(1, len(l) + 1)) AS n FROM l))
SELECT chunk || '_' || n AS stmt_key, {cid_sql("s.statement")} AS from_cid, CASE WHEN chunk % 3 = 0 THEN 'old' ELSE '# Statement [' || chunk || '.' || n || ']: ' || statement || chr(10) ||
CASE WHEN n % 4 = 0 THEN '# No triples emitted for this statement' ELSE 'ex:c' || chunk || ' ex:says "' || n || '" .' || chr(10) || 'ex:c' || chunk || ' ex:n "' || length(statement) || '" .' END || chr(10) END AS content FROM s""")
def rdf_run(spark, sf_dir):
    """Triples of documents' lines: one chunk in three is up to date, in one its first statement has changed, one is new; one in seven holds an error."""
    marked = F.array_join(F.transform(F.filter(F.split(body(), "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("- "), x)), "\n")
    facts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("# Error: x\n"), marked)).otherwise(marked).alias("facts"))
    s = R.statements_of(facts)
    changed = (F.col("chunk") % 3 == 1) & (F.col("stmt_idx") == 1)
    old = s.where("chunk % 3 <> 2").select("chunk", "stmt_key", F.when(changed, "other").otherwise(F.col("cid")).alias("from_cid"), F.lit("old").alias("content"))

    def make(rows):
        subject = F.concat(F.lit("ex:c"), F.col("chunk").cast("string"))
        quote = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
        each = [(0, "ex:says", F.col("stmt_idx")), (1, "ex:n", F.length("statement")), (2, "ex:says", F.col("stmt_idx"))]  # the last one repeats
        t = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), subject.alias("s"), F.lit(p).alias("p"), quote(o).alias("o")) for i, p, o in each]))
        return rows.where("stmt_idx % 4 <> 0").select("chunk", "stmt_key", t.alias("t")).select("chunk", "stmt_key", "t.*")

    path = shared_folder(spark, "rdf")
    R.rdf_run(facts, old, make, path)
    return spark.read.parquet(path).select("stmt_key", "from_cid", "content")


@query("""WITH c AS (SELECT conv_id, turn AS chunk_num, text FROM conversations WHERE turn <> 0), f AS (SELECT conv_id, turn - 1 AS chunk_num, text, role FROM conversations WHERE turn > 1)
SELECT c.conv_id, CAST(c.chunk_num AS BIGINT) AS chunk_num, c.text AS chunk, CAST(len(string_split(f.text, '.')) AS INTEGER) AS n FROM c JOIN f ON c.conv_id = f.conv_id AND c.chunk_num = f.chunk_num WHERE len(string_split(f.text, '.')) BETWEEN 2 AND 50""")
def training_set(spark, sf_dir):
    """Turns as chunks and the sentences of the turns after them as facts; of repeated facts the last one counts."""
    c = table(spark, sf_dir, "conversations")
    chunks = c.select("conv_id", F.col("turn").alias("chunk_num"), "text", F.lit("Conversation").alias("section_context"), F.lit(0).alias("at"))
    facts = c.where("turn > 0").select("conv_id", (F.col("turn") - 1).alias("chunk_num"), F.split("text", r"\.").alias("statements"), F.lit(1).alias("at"))
    before = facts.withColumns({"statements": F.array(F.lit("before")), "at": F.lit(0)})
    x = R.examples(chunks, before.unionByName(facts), ["conv_id"], "at")
    return x.select("conv_id", "chunk_num", F.col("text").alias("chunk"), F.size("statements").alias("n"))


@query("""WITH t AS (SELECT o_orderkey AS stmt, CASE WHEN o_orderstatus = 'F' THEN '_:b' ELSE 'ex:o' END AS s, CASE o_orderkey % 6 WHEN 0 THEN 'schema:startDate' WHEN 1 THEN 'schema:description' WHEN 2 THEN 'rdfs:comment' WHEN 3 THEN 'schema:text' ELSE 'a' END AS p,
CASE WHEN o_orderkey % 5 = 0 THEN 'schema:Role' WHEN o_orderkey % 5 = 1 THEN 'schema:Quotation' ELSE o_orderpriority END AS o, o_custkey FROM orders)
SELECT o_custkey, bool_or(contains(o, 'Role')) AS has_role, bool_or(starts_with(s, '_:') OR starts_with(o, '_:')) AS has_blank_node, bool_or(contains(lower(p), 'date')) AS has_dates, bool_or(p = 'schema:description') AS has_description,
bool_or(contains(lower(p), 'comment')) AS has_comment, bool_or(contains(o, 'Quotation')) AS has_quotation, bool_or(contains(p, 'schema:text')) AS has_text FROM t GROUP BY 1""")
def pattern_flags(spark, sf_dir):
    """The seven flags of each customer's triples."""
    k = F.col("o_orderkey")
    p = F.when(k % 6 == 0, "schema:startDate").when(k % 6 == 1, "schema:description").when(k % 6 == 2, "rdfs:comment").when(k % 6 == 3, "schema:text").otherwise("a")
    o = F.when(k % 5 == 0, "schema:Role").when(k % 5 == 1, "schema:Quotation").otherwise(F.col("o_orderpriority"))
    t = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "_:b").otherwise("ex:o").alias("s"), p.alias("p"), o.alias("o"))
    return G.pattern_flags(t, ["o_custkey"])
