"""Readers: notebooks, JSON-LD vocabularies, pageview responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.cid import cid as content_id
from loomgraph.functions.names import fresh
from loomgraph.functions.provenance import parse_signature
from loomgraph.functions.text import let, strip
from loomgraph.sources.named_files import read_named

#: Titles and prefixes that page lists leave out.
NAMESPACES = ("Special:", "Wikipedia:", "File:", "Template:", "Category:", "Portal:")
CELL = "array<struct<cell_type:string,source:array<string>>>"


def notebook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of notebooks (nbformat 4): path, cell_idx, cell_type, source; source may be a string or a list."""
    return _cells(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def listed_cells(spark: SparkSession, folder: str, index: str) -> DataFrame:
    """As notebook_cells(), of the notebooks below a folder that an index lists; path: below the folder. For many files: no listing on the driver."""
    return _cells(read_named(spark, folder, index))


def _cells(raw: DataFrame) -> DataFrame:
    as_list = F.from_json("value", "cells array<struct<cell_type:string,source:string>>")["cells"]
    x = raw.select("path", F.posexplode(as_list).alias("cell_idx", "c"))
    source = F.coalesce(F.array_join(F.from_json("c.source", "array<string>"), ""), F.col("c.source"))
    return x.select("path", "cell_idx", F.col("c.cell_type").alias("cell_type"), F.when(F.col("c.source").startswith("["), source).otherwise(F.col("c.source")).alias("source"))


def top_pages(responses: DataFrame, limit: int) -> DataFrame:
    """responses: value (JSON of the pageviews service). Returns title, views of the first `limit` articles."""
    shape = "items array<struct<articles:array<struct<article:string,views:long>>>>"
    x = responses.select(F.posexplode(F.from_json("value", shape)["items"][0]["articles"]).alias("pos", "a")).select("pos", "a.*")
    skip = F.col("article").isin("Main_Page", "-") | F.col("article").contains("(disambiguation)")
    for n in NAMESPACES:
        skip = skip | F.col("article").startswith(n)
    return x.where(~skip).orderBy("pos").limit(limit).select(F.translate("article", "_", " ").alias("title"), "views")


def page_extracts(responses: DataFrame) -> DataFrame:
    """responses: value (JSON of the extracts service) and other columns. Returns these with content: the first page's text.

    A page without a text has an empty one; a missing page (id -1), no page and a bad response have none.
    """
    page = F.get(F.map_entries(F.from_json("value", "query struct<pages:map<string,struct<extract:string>>>")["query"]["pages"]), F.lit(0))
    content = F.when(page["key"] != "-1", F.coalesce(page["value"]["extract"], F.lit("")))
    return responses.select(*[c for c in responses.columns if c not in ("value", "content")], content.alias("content"))


def item_ids(responses: DataFrame) -> DataFrame:
    """responses: value (JSON of the page properties service) and other columns. Returns these with item: the id in the
    first page's properties, null where there is none or the response is bad."""
    pages = F.from_json("value", "query struct<pages:map<string,struct<pageprops:struct<wikibase_item:string>>>>")["query"]["pages"]
    item = F.get(F.map_values(pages), F.lit(0))["pageprops"]["wikibase_item"]
    return responses.select(*[c for c in responses.columns if c not in ("value", "item")], item.alias("item"))


def vocabulary(documents: DataFrame, prefix: str = "schema:") -> DataFrame:
    """documents: value (JSON-LD with a @graph). Returns uri, label, description, term_type, domain, range, parent."""
    node = F.explode(F.from_json("value", "`@graph` array<map<string,string>>")["@graph"]).alias("n")
    x = documents.select(node)
    get = lambda k: F.col("n")[k]
    text = lambda c: F.coalesce(F.get_json_object(c, "$.@value"), c)
    ids = lambda c: F.coalesce(F.from_json(c, "array<struct<`@id`:string>>")["@id"], F.array(F.get_json_object(c, "$.@id")))
    first3 = lambda k: F.array_join(F.slice(ids(get(k)), 1, 3), ", ")
    kinds = get("@type")
    return x.where(get("@id").startswith(prefix)).select(
        get("@id").alias("uri"),
        text(get("rdfs:label")).alias("label"),
        F.substring(text(get("rdfs:comment")), 1, 500).alias("description"),
        F.when(kinds.contains("rdfs:Class"), "class").when(kinds.contains("rdf:Property"), "property").alias("term_type"),
        first3("schema:domainIncludes").alias("domain"),
        first3("schema:rangeIncludes").alias("range"),
        ids(get("rdfs:subClassOf"))[0].alias("parent"),
    ).where("term_type is not null")


def signed_cells(cells: DataFrame, by: list[str], kind: str) -> DataFrame:
    """cells: by, cell_idx, cell_type, source. Markdown cells that a raw cell signs as `kind`: by, cell_idx, source, sig.

    Both layouts of signatures count; a raw cell that isn't JSON signs nothing. The header cell has no signature.
    """
    w = Window.partitionBy(*by).orderBy("cell_idx")
    x = cells.select(*by, "cell_idx", "cell_type", "source", F.lead("cell_type").over(w).alias("next"), F.lead("source").over(w).alias("raw"))
    x = x.where("cell_type = 'markdown' and next = 'raw' and cell_idx > 0").withColumn("sig", F.try_parse_json("raw"))
    get = lambda p: F.try_variant_get("sig", p, "string")
    return x.where(F.coalesce(get("$._type"), get("$.type")) == kind).select(*by, "cell_idx", "source", "sig")


def head_value(source: Column, name: str) -> Column:
    """The text after **name:** at the start of a line; null where there is none."""
    return F.nullif(F.regexp_extract(source, rf"(?m)^\*\*{name}:\*\*[ \t]*(.*)$", 1), F.lit(""))


def cell_body(source: Column) -> Column:
    """What follows the first line ---, trimmed; empty where there is none."""
    return strip(F.regexp_extract(source, r"(?s)(?:^|\n)---(?:\n(.*))?$", 1))


def chunk_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, chunk_num (from 0), section_context, text, cid of chunk cells."""
    n = F.regexp_extract(head_value(F.col("source"), "Chunk"), r"^(\d+)", 1).try_cast("int")
    own = F.coalesce(F.try_variant_get("sig", '$["dcterms:identifier"]', "string"), F.try_variant_get("sig", "$.cid", "string"))
    cid = F.coalesce(F.nullif(own, F.lit("")), content_id(F.col("source")))
    x = signed_cells(cells, by, "chunk")
    return x.select(*by, (F.coalesce(n, F.lit(1)) - 1).alias("chunk_num"), F.coalesce(head_value(F.col("source"), "Context"), F.lit("")).alias("section_context"), cell_body(F.col("source")).alias("text"), cid.alias("cid"))


def statement_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, chunk_num (from 1), section_context, statements of statement cells; statements are numbered lines."""
    lines = F.filter(F.transform(F.split(cell_body(F.col("source")), "\n"), strip), lambda x: x.rlike(r"^\d"))
    n = F.regexp_extract(head_value(F.col("source"), "Chunk"), r"^(\d+)", 1).try_cast("int")
    x = signed_cells(cells, by, "statements")
    return x.select(*by, n.alias("chunk_num"), F.coalesce(head_value(F.col("source"), "Context"), F.lit("")).alias("section_context"), F.transform(lines, lambda s: F.regexp_replace(s, r"^\d.*?\. ", "")).alias("statements"))


def _pairs(cells: DataFrame, by: list[str]) -> DataFrame:
    """Each cell with the type (next) and source (raw) of the one after it."""
    w = Window.partitionBy(*by).orderBy("cell_idx")
    return cells.select(*by, "cell_idx", "cell_type", "source", F.lead("cell_type").over(w).alias("next"), F.lead("source").over(w).alias("raw"))


def sample_pages(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, title, views of sampled pages: pairs of raw cells from the second cell on; views default to 0, bad JSON is passed over."""
    x = _pairs(cells, by).where("cell_type = 'raw' and next = 'raw' and cell_idx % 2 = 1")
    v, s = F.try_parse_json("source"), F.try_parse_json("raw")
    x = x.select(*by, "cell_idx", F.try_variant_get(v, "$.title", "string").alias("title"), F.coalesce(F.try_variant_get(v, "$.views", "long"), F.lit(0)).alias("views"), F.try_variant_get(s, "$._type", "string").alias("kind"))
    return x.where("kind = 'sample_page' and title is not null").drop("kind")


def content_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """First layout of chunks and facts: markdown cells from the third on, with or without a signature.

    by, cell_num, content, text, breadcrumb, cid: number and id are the signature's, else the place among the
    notebook's content cells and the id of the content.
    """
    x = _pairs(cells, by).where("cell_type = 'markdown' and cell_idx >= 2").withColumn("sig", parse_signature(F.col("raw")))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("cell_idx"))
    found = F.regexp_extract("source", r"\*\*Context:\*\*\s*(.+)", 1)
    at = F.instr("source", "---\n")
    text = F.when(at > 0, strip(F.substring(F.col("source"), at + 4, F.length("source")))).otherwise(F.col("source"))
    return x.select(
        *by, F.coalesce("sig.cell", place).alias("cell_num"), F.col("source").alias("content"), text.alias("text"), F.coalesce(F.nullif(found, F.lit("")), F.lit("Unknown")).alias("breadcrumb"),
        F.coalesce("sig.cid", content_id(F.col("source"))).alias("cid"),
    )


def fact_sets(cells: DataFrame, by: list[str]) -> DataFrame:
    """Facts of the first layout: by, chunk_num, section_context, statements (lines after ---, marked by a dash), cid, from_cid.

    Cells without such a line are left out.
    """
    x = _pairs(cells, by).where("cell_type = 'markdown' and next = 'raw'").withColumn("v", F.try_parse_json("raw"))
    get = lambda p: F.try_variant_get("v", p, "string")
    lines = F.filter(F.split(cell_body(F.col("source")), "\n"), lambda s: s.startswith("- "))
    n = F.regexp_extract(head_value(F.col("source"), "Chunk"), r"(\d+) of \d+", 1).try_cast("int")
    x = x.where((get("$.type") == "facts") & F.col("source").contains("**Context:**"))
    out = x.select(*by, n.alias("chunk_num"), F.coalesce(strip(head_value(F.col("source"), "Context")), F.lit("")).alias("section_context"), F.transform(lines, lambda s: strip(F.substring(s, 3, 1 << 30))).alias("statements"), get("$.cid").alias("cid"), get("$.from_cid").alias("from_cid"))
    return out.where("size(statements) > 0")


CLASSIFICATION = "struct<index:long,statement:string,classification:string,reason:string>"


def classification_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, chunk_num, classifications, missing_facts, score, cid, from_cid: what the signatures of classification cells carry."""
    x = signed_cells(cells.where("cell_idx >= 1"), by, "classifications")
    get = lambda p, t: F.try_variant_get("sig", p, t)
    return x.select(
        *by, F.coalesce(get("$._chunk_num", "int"), F.lit(0)).alias("chunk_num"),
        F.coalesce(F.from_json(get("$._classification_data.classifications", "string"), f"array<{CLASSIFICATION}>"), F.array().cast(f"array<{CLASSIFICATION}>")).alias("classifications"),
        F.coalesce(get("$._classification_data.missing_facts", "string"), F.lit("")).alias("missing_facts"), F.coalesce(get("$._classification_data.score", "double"), F.lit(0.0)).alias("score"),
        get('$["dcterms:identifier"]', "string").alias("cid"), F.regexp_replace(F.coalesce(get('$["prov:wasDerivedFrom"]["@id"]', "string"), F.lit("")), "ipfs://", "").alias("from_cid"),
    )


def with_hints(terms: DataFrame, hints: DataFrame, label: str = "label") -> DataFrame:
    """terms with usage_hint: hints (label, hint) by label; null where there is none."""
    (h,) = fresh(terms, "_label")
    known = hints.select(F.col(label).alias(h), F.col("hint").alias("usage_hint"))
    return terms.join(known, F.col(label) == F.col(h), "left").drop(h)


def term_counts(terms: DataFrame) -> DataFrame:
    return terms.agg(F.count_if(F.col("term_type") == "class").alias("n_classes"), F.count_if(F.col("term_type") == "property").alias("n_properties"), F.count("*").alias("n_terms"))


def usable_facts(facts: DataFrame, text: str, statements: str) -> DataFrame:
    """Cells that hold no error and at least one statement."""
    return facts.where(~F.coalesce(F.col(text), F.lit("")).startswith("# Error:") & (F.size(statements) > 0))


def bad_classifications(found: DataFrame) -> DataFrame:
    """Rows of classification_cells(): the statements that are BAD, one a row."""
    rest = [c for c in found.columns if c != "classifications"]
    return found.select(*rest, F.inline("classifications")).where("classification = 'BAD'")


def with_missing_facts(found: DataFrame) -> DataFrame:
    return found.where("missing_facts <> '' and lower(missing_facts) <> 'none'")


def bootstrap_chunks(cells: DataFrame, by: list[str]) -> DataFrame:
    """The oldest layout: by, chunk_num (as written, or null), section_context, text, cid.

    A raw cell of type chunk takes the last cell with a context before it, whatever else stands between; any raw cell
    ends that, and one of the newer layout or that isn't JSON takes none. Lines --- and further context and number lines
    are no text; cells without a line after --- are passed over. Cells are read before the one shuffle, each once, and only
    raw cells and those with a context go into it; one window over each notebook's own cells.
    """
    is_context, is_number = (lambda x: x.startswith("**Context:**")), (lambda x: x.startswith("**Chunk:**"))
    last = lambda found: F.try_element_at(found, F.lit(-1))

    def chunk(lines: Column) -> Column:
        context = strip(F.replace(last(F.filter(lines, is_context)), F.lit("**Context:**"), F.lit("")))
        number = last(F.filter(F.transform(F.filter(lines, is_number), lambda x: F.regexp_extract(x, r"(\d+) of \d+", 1)), lambda x: x != "")).try_cast("int")
        after = F.slice(lines, F.array_position(lines, "---").cast("int") + 1, F.size(lines))
        text = F.filter(after, lambda x: ~is_context(x) & ~is_number(x) & (x != "---"))
        found = lambda t: F.when(F.size(t) > 0, F.struct(number.alias("chunk_num"), F.coalesce(context, F.lit("")).alias("section_context"), strip(F.array_join(t, "\n")).alias("text")))
        return F.when(F.array_position(lines, "---") > 0, let(text, found))

    is_raw = F.col("cell_type") == "raw"
    has_context = (F.col("cell_type") == "markdown") & F.col("source").contains("**Context:**")
    x = cells.where(is_raw | has_context).select(
        *by, "cell_idx", is_raw.alias("_raw"), F.when(has_context, let(F.split(strip(F.col("source")), "\n"), chunk)).alias("c"), F.when(is_raw, F.try_parse_json("source")).alias("_sig")
    )
    x = x.select(*by, "cell_idx", "_raw", "c", (F.try_variant_get("_sig", "$.type", "string") == "chunk").alias("_chunk"), F.try_variant_get("_sig", "$.cid", "string").alias("cid"))
    w = Window.partitionBy(*by).orderBy("cell_idx").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_last", F.last(F.when(F.col("_raw") | F.col("c").isNotNull(), F.struct("c")), ignorenulls=True).over(w))
    return x.where(F.col("_raw") & F.col("_chunk") & F.col("_last.c").isNotNull()).select(*by, "_last.c.*", "cid")


#: The address of the page views service.
PAGEVIEWS = "https://wikimedia.org/api/rest_v1/metrics/pageviews/top"


def pageviews_address(project: Column, access: Column, year: Column, month: Column) -> Column:
    """The address of a month's most viewed pages, which top_pages() reads the response of."""
    return F.concat_ws("/", F.lit(PAGEVIEWS), project, access, year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lit("all-days"))
