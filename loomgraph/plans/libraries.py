"""Registered queries of the schema library, of canonical ids and of structured answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import canonical
from loomgraph.operators import answers as Y
from loomgraph.operators import library as L
from loomgraph.plans.catalogue import ANCHORS_SQL, anchors, cid_sql, query
from loomgraph.session import shared_folder, table
from loomgraph.sources import artefacts as A


def part_changes(spark, sf_dir):
    """Line items as changes of a library of parts: each order is a version that puts its parts; returned ones are removed."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max(F.col("l_returnflag") == "R").alias("removed"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    x = li.join(p, "l_partkey")
    kind = F.when(F.col("l_partkey") % 2 == 0, "class").otherwise("property")
    return x.select(F.col("l_orderkey").alias("version"), kind.alias("kind"), F.concat(F.lit("p"), "l_partkey").alias("key"), "removed", F.concat("p_name", F.lit(" "), "l_orderkey").alias("label"))


@query("""WITH c AS (SELECT l_orderkey AS v, l_partkey AS k, max(l_returnflag = 'R') AS gone FROM lineitem GROUP BY 1, 2), a AS (SELECT max(v) AS as_of FROM c UNION ALL SELECT max(v) // 2 FROM c),
s AS (SELECT as_of, k, max(v) AS v, arg_max(gone, v) AS gone FROM c, a WHERE v <= as_of GROUP BY 1, 2)
SELECT as_of, CASE WHEN k % 2 = 0 THEN 'class' ELSE 'property' END AS kind, 'p' || k AS key, v AS version, p_name || ' ' || v AS label FROM s JOIN part ON k = p_partkey WHERE NOT gone""")
def library_versions(spark, sf_dir):
    """The library as of the last version and of the middle one, from a log that only grows."""
    path = shared_folder(spark, "log")
    L.append(None, part_changes(spark, sf_dir), path)
    log = spark.read.parquet(path)
    last = log.agg(F.max("version")).first()[0] or 0
    held = lambda v: L.snapshot(log, v).select(F.lit(v).cast("long").alias("as_of"), "kind", "key", "version", "label")
    return held(last).unionByName(held(last // 2))


@query(f"""WITH {ANCHORS_SQL}, d AS (SELECT href, min(label) AS label, count(*) AS n FROM a GROUP BY 1 HAVING count(*) % 3 <> 0)
SELECT page_id, pos, a.href AS uri, CASE WHEN n % 2 = 0 THEN 'class' ELSE 'property' END AS kind, CASE WHEN n % 4 < 2 THEN d.label ELSE string_split(a.href, '/')[-1] END AS label, CASE WHEN n % 2 = 0 THEN 'No description' ELSE '' END AS description,
CASE WHEN n % 2 = 1 THEN 'Any' END AS domain, CASE WHEN n % 2 = 1 THEN CASE WHEN n % 5 = 0 THEN 'Text' ELSE 'Any' END END AS range FROM a JOIN d ON a.href = d.href""")
def term_probes(spark, sf_dir):
    """Anchors' addresses against a library that knows two in three of them, with the defaults of what it doesn't say."""
    a = anchors(spark, sf_dir)
    n = F.col("n")
    d = a.groupBy(F.col("href").alias("key")).agg(F.min("label").alias("given"), F.count("*").alias("n")).where("n % 3 <> 0")
    changes = d.select(F.lit(1).cast("long").alias("version"), F.when(n % 2 == 0, "class").otherwise("property").alias("kind"), "key", F.when(n % 4 < 2, F.col("given")).alias("label"), F.when(n % 5 == 0, "Text").alias("range"))
    path = shared_folder(spark, "log")
    L.append(None, changes, path)
    x = a.select("page_id", "pos", F.col("href").alias("uri"))
    return L.probe(x, "uri", L.snapshot(spark.read.parquet(path))).select("page_id", "pos", "uri", "kind", "label", "description", "domain", "range")


CONFIG_SQL = """'{"balance": ' || c_acctbal || ', "ids": [' || c_custkey || ', ' || c_nationkey || '], "model": {"name": "' || c_name || '", "settings": {"a": true, "b": null}, "tags": ' ||
  CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '["' || c_mktsegment || '", "q\\"\\u00e9\\n"]' END || '}}'"""


@query(f"""WITH c AS (SELECT c_custkey, {CONFIG_SQL} AS js FROM customer) SELECT c_custkey, js, {cid_sql("js")} AS cid FROM c""")
def canonical_ids(spark, sf_dir):
    """Nested configurations as canonical JSON, saved with their ids and read again."""
    c = table(spark, sf_dir, "customer")
    tags = F.when(F.col("c_custkey") % 3 != 0, F.array("c_mktsegment", F.lit('q"é\n')))
    settings = F.create_map(F.lit("b"), F.lit(None).cast("boolean"), F.lit("a"), F.lit(True))
    model = F.struct(tags.alias("tags"), settings.alias("settings"), F.col("c_name").alias("name"))
    path = shared_folder(spark, "settings")
    rows = c.select(model.alias("model"), F.array(F.col("c_custkey"), F.col("c_nationkey").cast("long")).alias("ids"), F.col("c_acctbal").alias("balance"))
    A.save_settings(rows, path, "config")
    x = A.load(spark, path, "config")
    return x.select(F.col("ids")[0].alias("c_custkey"), canonical.row(x, ["model", "ids", "balance"]).alias("js"), "cid")


@query(f"""WITH k AS (SELECT doc_id, 'k' || doc_id AS c, coalesce(lang, '') AS s FROM documents), r AS (
SELECT doc_id, 'devset' AS kind, '{{"chunk_text": "' || c || '", "section_context": "' || s || '"}}' AS js FROM k UNION ALL
SELECT doc_id, 'fewshot_examples', '{{"chunk_text": "' || c || '", "section_context": "' || s || '", "statements": ["' || s || '", "two"]}}' FROM k UNION ALL
SELECT doc_id, 'training_data', '{{"chunk_num": ' || doc_id || ', "chunk_text": "' || c || '", "cid": "x", "section_context": "' || s || '", "statements": ["' || s || '", "two"]}}' FROM k UNION ALL
SELECT doc_id, 'evaluation', '{{"chunk_text": "' || c || '", "classifications": [{{"index": 0, "reason": null}}], "score": 0.5, "section_context": "' || s || '", "statements": ["' || s || '", "two"]}}' FROM k)
SELECT doc_id, kind, {cid_sql("js")} AS cid FROM r""")
def dataset_ids(spark, sf_dir):
    """Four kinds of data sets saved, each row with its id, and read again."""
    s = F.coalesce("lang", F.lit(""))
    found = F.array(F.struct(F.lit(None).cast("string").alias("reason"), F.lit(0).alias("index")))
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("chunk_text"), s.alias("section_context"), F.array(s, F.lit("two")).alias("statements"),
        F.col("doc_id").alias("chunk_num"), F.lit("x").alias("cid"), found.alias("classifications"), F.lit(0.5).alias("score"),
    )
    path, out = shared_folder(spark, "sets"), None
    for kind in ("devset", "fewshot_examples", "training_data", "evaluation"):
        A.save_examples(d, kind, path)
        x = A.load(spark, path, kind)
        x = x.select(F.col("ord").alias("doc_id"), F.lit(kind).alias("kind"), F.col("row_cid" if "row_cid" in x.columns else "cid").alias("cid"))
        out = x if out is None else out.unionByName(x)
    return out


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN 'not json ' || o_orderkey END AS corrupt, CASE WHEN o_orderkey % 5 IN (0, 4) THEN 2 WHEN o_orderkey % 5 = 3 THEN 0 ELSE 1 END AS n_entities,
CASE WHEN o_orderkey % 5 IN (0, 4) THEN 'c' || o_custkey || '>' || 'o' || o_orderkey ELSE '' END AS edges,
CASE o_orderkey % 5 WHEN 1 THEN 'entities[1].label: a text expected, not bigint; relations[0].target: missing' WHEN 2 THEN 'entities[0]: an object expected; relations: a list expected' ELSE '' END AS errors FROM orders""")
def structured_answers(spark, sf_dir):
    """Answers about orders: good ones, bare and in a fence, ones with wrong fields, and one in five that is no JSON."""
    k, key, cust = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    a = say('{"id": "c', cust, '", "label": "customer", "type": "Person"}')
    b = say('{"id": "o', key, '", "label": "order", "type": "Thing", "description": "d"}')
    good = say('{"entities": [', a, ", ", b, '], "relations": [{"source": "c', cust, '", "target": "o', key, '", "type": "placed"}]}')
    wrong = say('{"entities": [', a, ', {"id": "o', key, '", "label": 5, "type": "Thing"}], "relations": [{"source": "c', cust, '", "type": "placed"}]}')
    shape = say('{"entities": ["c", ', b, '], "relations": "none"}')
    fenced = say("Here it is:\n```json\n", good, "\n```\n")
    answer = F.when(k == 0, good).when(k == 1, wrong).when(k == 2, shape).when(k == 3, say("not json ", key)).otherwise(fenced)
    x = Y.parse(table(spark, sf_dir, "orders").select("o_orderkey", answer.alias("answer")), "answer")
    edges = F.array_join(F.transform("relations", lambda r: F.concat(r["source"], F.lit(">"), r["target"])), ",")
    return x.select("o_orderkey", "corrupt", F.size("entities").alias("n_entities"), edges.alias("edges"), F.array_join("errors", "; ").alias("errors"))
