"""Texts that the pipeline hands on: cells, prompts, tool answers and Turtle files, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.cid import cid

#: Texts that consumers of these columns look for.
NO_ENTITIES = "# No entities registered yet"
NO_KNOWN = "None yet"
CONTEXT_HEADS = (("prefixes", "## Prefixes\n"), ("class_definitions", "## Classes\n"), ("property_definitions", "## Properties\n"), ("usage_examples", "## Examples\n"), ("custom_annotation_needs", "## Notes\n"))
GOOD_HEAD = "Good matches (score >= 0.5):"
CLASS_NONE = "No matches found. Use schema:Thing as a fallback or skip the type assertion."
CLASS_WARNING = "WARNING: No good matches found (all scores < 0.5).\nConsider using schema:Thing or skipping this type assertion."
CLASS_WEAK, CLASS_WEAK_NOTE = "\nWeak matches (not recommended):", " - LOW CONFIDENCE"
WIKI = "https://en.wikipedia.org"
REQUIRED = (
    ("statement_id", "statement_id is required (e.g., '1', '2')"),
    ("subject", "subject is required (e.g., '<#entity_id>' or 'schema:Person')"),
    ("predicate", "predicate is required (e.g., 'schema:birthDate' or 'rdf:type')"),
    ("object_value", "object_value is required (e.g., '\"value\"' or '<#uri>')"),
)


def given(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def after(head: str, c: Column) -> Column:
    """The head and the text; null where there is no text, so that joins of texts leave it out."""
    return F.concat(F.lit(head), given(c))


def short(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def term_text(label: Column, description: Column, domain: Column, range_: Column, keywords: Column) -> Column:
    """What a vocabulary term is searched by."""
    return F.concat_ws(" | ", label, given(description), after("applies to ", domain), after("value is ", range_), given(keywords))


def property_query(description: Column, subject_type: Column, object_type: Column) -> Column:
    return F.concat_ws(" | ", description, after("applies to ", subject_type), after("value is ", object_type))


def prompt_context(parts: dict[str, Column]) -> Column:
    """The sections that are there, each under its heading; an empty text for none."""
    return F.concat_ws("\n\n", *[after(head, parts[k]) for k, head in CONTEXT_HEADS if k in parts])


def registry_line(uri: Column, label: Column, kind: Column, wikidata: Column) -> Column:
    return F.concat(F.lit("<"), uri, F.lit("> # "), label, F.lit(" ("), kind, F.lit(")"), F.coalesce(F.concat(after(" (Wikidata: ", wikidata), F.lit(")")), F.lit("")))


def known_line(uri: Column, label: Column, kind: Column) -> Column:
    """Articles become relative links, other entities show their address."""
    inside = F.concat(F.lit("- ["), label, F.lit("]("), F.replace(uri, F.lit(WIKI), F.lit("")), F.lit(") ("), kind, F.lit(")"))
    return F.when(uri.startswith(WIKI + "/wiki/"), inside).otherwise(F.concat(F.lit("- "), label, F.lit(" ("), kind, F.lit(") - URI: "), uri))


def in_order(order: Column, line: Column, sep: str = "\n") -> Column:
    """An aggregate: lines that aren't null, by order and text, joined; an empty text for none."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(order.alias("o"), line.alias("l"))))), lambda x: x["l"]), sep)


def classification_cell(context: Column, chunk: Column, total: Column, found: Column, missing: Column, score: Column) -> Column:
    """found: array of (index, statement, classification, reason)."""
    good = F.size(F.filter(found, lambda c: c["classification"] == "GOOD")).cast("string")
    mark = lambda c: F.when(c["classification"] == "GOOD", "✅ ").otherwise("❌ ")
    row = lambda c: F.concat(
        F.lit("| "), c["index"].cast("string"), F.lit(" | "), mark(c), c["classification"], F.lit(" | "),
        F.replace(short(c["statement"], 60), F.lit("|"), F.lit("\\|")), F.lit(" | "), short(c["reason"], 40), F.lit(" |"),
    )
    return F.concat(
        F.lit("**Context:** "), context, F.lit("\n**Chunk:** "), chunk.cast("string"), F.lit(" of "), total.cast("string"),
        F.lit("\n**Score:** "), F.format_string("%.1f", F.bround(score * 100, 1)), F.lit("% ("), good, F.lit("/"), F.size(found).cast("string"), F.lit(" GOOD)\n\n---\n\n"),
        F.lit("| # | Classification | Statement | Reason |\n|---|----------------|-----------|--------|\n"),
        F.array_join(F.transform(found, row), "\n"), F.lit("\n\n**Missing facts:** "), F.coalesce(given(missing), F.lit("none")), F.lit("\n"),
    )


def class_answer(matches: Column) -> Column:
    """matches: array of (prefix, score, uri, description, hint, parent), best first. What the class search tells its caller."""
    points = lambda r: F.concat(r["prefix"], F.lit(" ("), F.format_string("%.2f", r["score"]), F.lit(")"))
    good = F.filter(matches, lambda r: r["score"] >= 0.5)
    weak = F.slice(F.filter(matches, lambda r: r["score"] < 0.5), 1, 2)
    entry = lambda r: F.concat_ws(
        "\n", F.concat(F.lit("\n  "), points(r)), F.concat(F.lit("    URI: "), r["uri"]), after("    Description: ", F.left(r["description"], F.lit(200))),
        after("    HOW TO USE: ", r["hint"]), after("    Parent class: schema:", r["parent"]),
    )
    strong = F.concat_ws("\n", F.lit(GOOD_HEAD), F.array_join(F.transform(good, entry), "\n"))
    poor = F.concat_ws("\n", F.lit(CLASS_WARNING), F.lit(CLASS_WEAK), F.array_join(F.transform(weak, lambda r: F.concat(F.lit("  "), points(r), F.lit(CLASS_WEAK_NOTE))), "\n"))
    return F.when(F.coalesce(F.size(matches), F.lit(0)) <= 0, CLASS_NONE).when(F.size(good) > 0, strong).otherwise(poor)


def emit_error(fields: dict[str, Column]) -> Column:
    """What a triple lacks, as one error text; null where it lacks nothing."""
    issues = F.array_compact(F.array(*[F.when(given(fields[k]).isNull(), F.lit(text)) for k, text in REQUIRED]))
    return F.when(F.size(issues) > 0, F.concat(F.lit("ERROR: "), F.array_join(issues, "; ")))


#: The tools that emit triples, and how many of their calls a cell shows and how much of each.
EMITTERS, CALLS_SHOWN, ARGS_SHOWN = ("emit_triple", "emit_triples"), 5, 200


def rdf_cell(chunk: Column, stmt: Column, statement: Column, block: Column, calls: Column | None = None) -> Column:
    """A statement's cell: its triples or, where there are none, a note and the emitting calls of its chunk.

    calls: array of (name, args), args as JSON text, in the order they were made; null entries, null and empty arrays
    and other tools' calls show nothing, a call without args shows its name only.
    """
    head = F.concat(F.lit("# Statement ["), chunk.cast("string"), F.lit("."), stmt.cast("string"), F.lit("]: "), statement)
    none = F.lit("# No triples emitted for this statement")
    if calls is not None:
        emits = F.filter(calls, lambda c: c["name"].isin(*EMITTERS))
        line = lambda c: F.concat(F.lit("#   "), c["name"], F.lit(": "), F.left(F.coalesce(c["args"], F.lit("")), F.lit(ARGS_SHOWN)))
        count = F.concat(F.lit("# Debug: "), F.size(emits).cast("string"), F.lit(" emit tool calls made for chunk"))
        shown = F.concat_ws("\n", count, F.array_join(F.transform(F.slice(emits, 1, CALLS_SHOWN), line), "\n"))
        none = F.concat_ws("\n", none, F.when(F.size(emits) > 0, shown))
    return F.concat_ws("\n", head, F.coalesce(given(block), none))


def has_triples(cell: Column) -> Column:
    """Whether a cell goes to the Turtle file: no signature, no error, and a line that is no comment."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    signature = text.startswith("{") & (text.contains('"cid"') | text.contains('"@id"'))
    lines = F.exists(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    return ~signature & ~text.startswith("# Error:") & lines


def baseline_input(config: Column, devset: Column, size: Column, extractor: Column | None = None) -> Column:
    """Content id of what a baseline was measured on: JSON with sorted keys; ids and numbers need no escapes."""
    pair = lambda k, v: F.concat(F.lit(f'"{k}": '), v)
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    parts = [pair("config_cid", quoted(config)), pair("devset_cid", quoted(devset)), pair("eval_size", size.cast("string"))]
    if extractor is not None:
        parts.append(pair("extractor_cid", quoted(given(extractor))))
    return cid(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))


def improvement(optimized: Column, baseline: Column) -> Column:
    """Null where there is no baseline, or one of zero."""
    return F.when(baseline != 0, optimized - baseline)


#: Texts of the property search and of prompts that consumers look for.
PROPERTY_NONE = "No matches found. DO NOT emit a made-up triple. Skip this statement or use rdfs:comment to preserve the information as text."
PROPERTY_WARNING = "WARNING: No good matches found (all scores < 0.5).\nDO NOT emit a random/unrelated triple.\nOptions: 1) Skip this statement, 2) Use rdfs:comment to store as text"
PROPERTY_WEAK, PROPERTY_WEAK_NOTE = "\nWeak matches (DO NOT USE):", " - TOO LOW, DO NOT USE"
NO_CLASSES, NO_PROPERTIES, NO_EXAMPLES = "No specific classes needed.", "No specific properties needed.", "Use standard RDF patterns."


def property_answer(matches: Column) -> Column:
    """matches: array of (prefix, score, uri, domain, range, description, hint), best first. What the property search tells its caller."""
    points = lambda r: F.concat(r["prefix"], F.lit(" ("), F.format_string("%.2f", r["score"]), F.lit(")"))
    good = F.filter(matches, lambda r: r["score"] >= 0.5)
    weak = F.slice(F.filter(matches, lambda r: r["score"] < 0.5), 1, 2)
    entry = lambda r: F.concat_ws(
        "\n", F.concat(F.lit("\n  "), points(r)), F.concat(F.lit("    URI: "), r["uri"]), after("    Domain (subject type): ", r["domain"]), after("    Range (object type): ", r["range"]),
        after("    Description: ", F.left(r["description"], F.lit(150))), after("    HOW TO USE: ", r["hint"]),
    )
    strong = F.concat_ws("\n", F.lit(GOOD_HEAD), F.array_join(F.transform(good, entry), "\n"))
    poor = F.concat_ws("\n", F.lit(PROPERTY_WARNING), F.lit(PROPERTY_WEAK), F.array_join(F.transform(weak, lambda r: F.concat(F.lit("  "), points(r), F.lit(PROPERTY_WEAK_NOTE))), "\n"))
    return F.when(F.coalesce(F.size(matches), F.lit(0)) <= 0, PROPERTY_NONE).when(F.size(good) > 0, strong).otherwise(poor)


def class_line(uri: Column, label: Column, description: Column) -> Column:
    name = F.coalesce(label, F.element_at(F.split(uri, "/"), -1))
    return F.concat(F.lit("- "), name, F.lit(" ("), uri, F.lit("): "), F.coalesce(description, F.lit("No description")))


def property_lines(uri: Column, label: Column, description: Column, domain: Column, range_: Column) -> Column:
    name = F.coalesce(label, F.element_at(F.split(uri, "/"), -1))
    kinds = F.concat(F.lit("  Domain: "), F.coalesce(domain, F.lit("Any")), F.lit(", Range: "), F.coalesce(range_, F.lit("Any")))
    return F.concat_ws("\n", F.concat(F.lit("- "), name, F.lit(" ("), uri, F.lit(")")), after("  Description: ", description), kinds)


def examples_text(examples: Column, most: int = 5) -> Column:
    """examples: an array. The first ones as Turtle blocks."""
    blocks = F.transform(F.slice(examples, 1, most), lambda x: F.concat(F.lit("```turtle\n"), x, F.lit("\n```")))
    return F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, F.array_join(blocks, "\n")).otherwise(NO_EXAMPLES)


def numbered(statements: Column, form: str = "list") -> Column:
    """Statements as lines: `1. x` (list), `[1] x` (ids) or `0: x` (index)."""
    made = {
        "list": lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s),
        "ids": lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s),
        "index": lambda s, i: F.concat(i.cast("string"), F.lit(": "), s),
    }
    return F.array_join(F.transform(statements, made[form]), "\n")


def chunk_cell(context: Column, number: Column, total: Column, text: Column) -> Column:
    """number: from 1."""
    return F.concat(F.lit("**Context:** "), context, F.lit("\n**Chunk:** "), number.cast("string"), F.lit(" of "), total.cast("string"), F.lit("\n\n---\n\n"), text, F.lit("\n"))


def statements_cell(context: Column, number: Column, total: Column, statements: Column) -> Column:
    head = F.concat(F.lit("**Context:** "), context, F.lit("\n**Chunk:** "), number.cast("string"), F.lit(" of "), total.cast("string"), F.lit("\n**Statements:** "), F.size(statements).cast("string"))
    return F.concat(head, F.lit("\n\n---\n\n"), numbered(statements), F.lit("\n"))


def sample_cell(title: Column, views: Column, index: Column, total: Column) -> Column:
    """JSON of a sampled page, indented by two."""
    object_ = F.to_json(F.struct(title.alias("title")))
    first = F.substring(object_, F.lit(2), F.length(object_) - 2)
    first = F.concat(F.lit('"title": '), F.substring(first, F.lit(9), F.length(first)))
    pair = lambda k, v: F.concat(F.lit(f'"{k}": '), v.cast("string"))
    return F.concat(F.lit("{\n  "), F.concat_ws(",\n  ", first, pair("views", views), pair("index", index), pair("total", total)), F.lit("\n}"))


def emit_many(triples: Column) -> Column:
    """triples: array of (statement_id, subject, predicate, object). (valid triples, issues, answer) of a call that emits several.

    Without a subject, predicate or object a triple is an issue; of equal ones the first counts.
    """
    lacks = lambda t: F.array_compact(F.array(*[F.when(given(t[c]).isNull(), F.lit(f"'{c}'")) for c in ("subject", "predicate", "object")]))
    numbered_ = F.transform(triples, lambda t, i: F.struct(t.alias("t"), lacks(t).alias("lacks"), i.alias("i")))
    issues = F.transform(F.filter(numbered_, lambda x: F.size(x["lacks"]) > 0), lambda x: F.concat(F.lit("item "), x["i"].cast("string"), F.lit(": missing ["), F.array_join(x["lacks"], ", "), F.lit("]")))
    valid = F.transform(F.filter(numbered_, lambda x: F.size(x["lacks"]) == 0), lambda x: x["t"])
    kept = F.array_distinct(valid)
    lines = F.array_join(F.transform(kept, lambda t: F.concat_ws(" ", t["subject"], t["predicate"], t["object"], F.lit("."))), "\n")
    answer = F.when((F.size(kept) == 0) & (F.size(issues) > 0), F.concat(F.lit("ERROR: "), F.array_join(F.slice(issues, 1, 5), "; "))).when(F.size(issues) > 0, F.concat(lines, F.lit("\n("), F.size(issues).cast("string"), F.lit(" errors skipped)"))).otherwise(lines)
    return F.struct(kept.alias("triples"), issues.alias("issues"), answer.alias("answer"))
