"""Registered queries of text functions: statements, ids, months, formats, section addresses, infobox values."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import render as N
from loomgraph.functions import text as T
from loomgraph.operators import wikitext as W
from loomgraph.plans.catalogue import body, query
from loomgraph.session import table

#: Lines of documents, in DuckDB.
LINES_SQL = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '')"


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n, sha256(coalesce(array_to_string(l, '|'), '')) AS h FROM l""")
def statements_all_lines(spark, sf_dir):
    """Lines with bullets, stars, numbers or nothing before them; the markers go, all lines stay."""
    marked = F.transform(F.split(body(), "\n"), lambda x, i: F.concat(F.element_at(F.array(F.lit("- "), F.lit("* "), F.lit("12. "), F.lit("")), (i % 4 + 1).cast("int")), x, F.lit(" ")))
    got = T.statements_v2(F.array_join(marked, "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(got).alias("n"), F.sha2(F.array_join(got, "|"), 256).alias("h"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'unknown' ELSE CAST(event_id AS VARCHAR) END AS id, CASE WHEN event_id % 15 BETWEEN 1 AND 12 THEN
['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][CAST(event_id % 15 AS INTEGER)] WHEN event_id % 15 = 14 THEN 'x' ELSE CAST(event_id % 15 AS VARCHAR) END AS month,
format('{:,}', event_id * 1000 + 7) AS thousands, printf('%02d', event_id % 100) AS padded, printf('%.2f', value) AS two FROM events""")
def ids_months_formats(spark, sf_dir):
    """Statement ids in brackets and quotes, month names, and the number formats of texts."""
    i = F.col("event_id")
    key = i.cast("string")
    raw = F.when(i % 5 == 0, key).when(i % 5 == 1, F.concat(F.lit("["), key, F.lit("]"))).when(i % 5 == 2, F.concat(F.lit(" ('"), key, F.lit("')"))).when(i % 5 == 3, F.concat(F.lit('"'), key, F.lit('"'))).otherwise(F.lit("[]"))
    month = F.when(i % 15 == 14, "x").otherwise((i % 15).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", T.statement_id(raw).alias("id"), T.month_name(month).alias("month"), F.format_number(i * 1000 + 7, 0).alias("thousands"), F.format_string("%02d", i % 100).alias("padded"), F.format_string("%.2f", "value").alias("two")
    )


@query(f"""WITH l AS (SELECT doc_id, {LINES_SQL} AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS s, unnest(range(0, len(l))) AS i FROM l)
SELECT d.doc_id, coalesce(string_agg('[' || (i + 1) || '] ' || s, chr(10) ORDER BY i), '') AS ids, coalesce(string_agg(i || ': ' || s, chr(10) ORDER BY i), '') AS "index", coalesce(string_agg((i + 1) || '. ' || s, chr(10) ORDER BY i), '') AS list FROM documents d LEFT JOIN u ON d.doc_id = u.doc_id GROUP BY d.doc_id""")
def numbered_lines(spark, sf_dir):
    """Lines of documents in the three forms in which prompts number them."""
    lines = F.filter(F.split(body(), "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", *[N.numbered(lines, form).alias(form) for form in ("ids", "index", "list")])


@query("""SELECT p_partkey, 'https://x/wiki/' || replace(url_encode(replace(p_name, ' ', '_')), '%7E', '~') || CASE WHEN p_partkey % 2 = 0 THEN '#' || replace(url_encode(p_type), '+', '%20') ELSE '' END AS url FROM part""")
def section_urls(spark, sf_dir):
    """Addresses of pages, every second with a section, whose blanks are encoded, not underscored."""
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("#"), "p_type")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.wiki_url(title, "https://x/wiki/").alias("url"))


@query("""SELECT o_orderkey, day(o_orderdate) || ' ' || ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][month(o_orderdate)] || ' ' || year(o_orderdate) AS date,
o_orderstatus || ', [c' || o_custkey || '](/wiki/C' || o_custkey || ')' AS list, o_orderpriority AS bare FROM orders""")
def infobox_values(spark, sf_dir):
    """Orders as infoboxes: a date template, a list with a link, and a text with an unknown template; as the article shows them."""
    day = F.concat(F.lit("{{birth date|"), F.year("o_orderdate"), F.lit("|"), F.month("o_orderdate"), F.lit("|"), F.dayofmonth("o_orderdate"), F.lit("|df=y}}"))
    listed = F.concat(F.lit("{{hlist|"), "o_orderstatus", F.lit("|[[C"), "o_custkey", F.lit("|c"), "o_custkey", F.lit("]]}}"))
    bare = F.concat("o_orderpriority", F.lit("{{unknown|x}}"))
    text = F.concat(F.lit("{{Infobox order\n| date = "), day, F.lit("\n| list = "), listed, F.lit("\n| bare = "), bare, F.lit("\n}}\nText."))
    x = W.articles(table(spark, sf_dir, "orders").select("o_orderkey", F.lit("Order").alias("title"), text.alias("text")), "o_orderkey", "title", "text")
    return x.select(F.col("key").alias("o_orderkey"), *[F.regexp_extract("content", rf"\*\*{n}\*\*: (.*)", 1).alias(n) for n in ("date", "list", "bare")])
