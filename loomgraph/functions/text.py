"""Scalar text functions as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, what (?U)\s matches.
BLANK = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: English month names.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def strip(c: Column) -> Column:
    """Trims all Unicode white space."""
    return F.btrim(c, F.lit(BLANK))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: an expression that a lambda names is else computed again for each entry."""
    return F.transform(F.array(value), body)[0]


def entity_key(label: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), F.lit("_"))


def entity_id(kind: Column, label: Column) -> Column:
    return F.concat_ws("_", F.lower(kind), entity_key(label))


def entity_uri(source_url: Column, kind: Column, label: Column) -> Column:
    return F.concat(source_url, F.lit("#"), entity_id(kind, label))


def slug(title: Column) -> Column:
    return F.translate(F.lower(title), " /", "__")


def _quote(c: Column) -> Column:
    """Percent-encoded as in a path: slashes and tildes stay."""
    x = F.url_encode(c)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def wiki_url(title: Column, base: str) -> Column:
    """Blanks of the page's name become underscores; a section after # is kept and encoded by itself."""
    at = F.instr(title, "#")
    page, section = F.left(title, at - 1), F.substring(title, at + 1, F.length(title))
    whole = F.concat(F.lit(base), _quote(F.translate(title, " ", "_")))
    return F.when(at > 0, F.concat(F.lit(base), _quote(F.translate(page, " ", "_")), F.lit("#"), _quote(section))).otherwise(whole)


def month_name(s: Column) -> Column:
    """Name of a month number; anything else is echoed."""
    n = s.try_cast("int")
    return F.when(n.between(1, 12), F.element_at(F.array(*map(F.lit, MONTHS)), n)).otherwise(s)


def statements_v1(text: Column) -> Column:
    """Marked lines only. A bullet loses one character; a single digit and its point lose two, or all up to the first space."""
    lines = F.transform(F.split(text, "\n"), strip)
    marked = F.filter(lines, lambda x: x.rlike(r"^[-*•]|^[0-9][.):]"))
    body = lambda x: F.when(x.rlike("^[0-9]"), F.when(F.instr(x, " ") > 0, F.substring(x, F.instr(x, " ") + 1, F.length(x))).otherwise(F.substring(x, F.lit(3), F.length(x)))).otherwise(F.substring(x, F.lit(2), F.length(x)))
    return F.filter(F.transform(marked, lambda x: strip(body(x))), lambda x: x != "")


def statements_v2(text: Column) -> Column:
    """All lines, without their markers."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.filter(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"^(?:[-*]\s+|\d+\.\s*)", ""))), lambda x: x != "")


def statement_id(c: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(c, F.lit("[]()\"' ")), F.lit("")), F.lit("unknown"))


def score(c: Column) -> Column:
    """A number held to [0, 1]; 0.5 where there is none."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.trim(c).try_cast("double"), F.lit(0.5))))


def truth(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "yes", "1", "valid"), F.lit(False))


def weighted(scores: list[Column], weights: list[float]) -> Column:
    out = scores[0] * weights[0]
    for s, w in zip(scores[1:], weights[1:], strict=True):
        out = out + s * w
    return out


def links(text: Column) -> Column:
    """Markdown links: an array of (label, href), in order."""
    pattern = r"\[([^\]]+)\]\(([^)]+)\)"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("label"), F.regexp_extract(m, pattern, 2).alias("href")))


def article_links(text: Column, base: str) -> Column:
    """Markdown links to articles only (/wiki/...), as an array of (label, href), in order; base is put before the addresses."""
    found = F.filter(links(text), lambda x: x["href"].startswith("/wiki/") & (F.length(x["href"]) > 6))
    return F.transform(found, lambda x: F.struct(x["label"].alias("label"), F.concat(F.lit(base), x["href"]).alias("href")))


def one_of_each(links: Column, last: bool = False) -> Column:
    """links: array of (label, href). The first link of each label, or the last, in the order of the links; one sort, no nested search."""
    placed = F.transform(links, lambda x, i: F.struct(x["label"].alias("label"), (-i if last else i).alias("i"), x["href"].alias("href")))
    pairs = F.array_sort(placed)
    kept = F.filter(F.transform(pairs, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.get(pairs["label"], i - 1).eqNullSafe(x["label"]) & (i > 0), F.lit(False)).alias("again"))), lambda r: ~r["again"])
    back = F.array_sort(F.transform(kept, lambda r: F.struct(F.abs(r["x"]["i"]).alias("i"), r["x"]["label"].alias("label"), r["x"]["href"].alias("href"))))
    return F.transform(back, lambda r: F.struct(r["label"].alias("label"), r["href"].alias("href")))


def link_map(links: Column) -> Column:
    """links: array of (label, href). Label to address; the last link of a label wins."""
    return F.map_from_entries(one_of_each(links, last=True))


def first_given(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def anchors(html: Column) -> Column:
    """HTML anchors: an array of (label, href), in order."""
    pattern = '<a href="([^"]*)">([^<]*)</a>'
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, pattern, 2).alias("label"), F.regexp_extract(m, pattern, 1).alias("href")))


_HEADER = r"(?m)^(={2,6})[ \t]*(.+?)[ \t]*\1[ \t]*$"


def sections(text: str, title: str) -> Column:
    """text, title: column names. Headers of levels 2 to 6 as an array of (level, title, start_pos, breadcrumb), positions in code points.

    A breadcrumb is the title and the headers above, each of a lower level than the next.
    """
    found = f"""aggregate(regexp_extract_all({text}, r'{_HEADER}', 0),
      named_struct('pos', 0, 'out', cast(array() as array<struct<level:int,title:string,start_pos:int>>)),
      (a, m) -> named_struct('pos', locate(m, {text}, a.pos + 1) - 1 + length(m), 'out', array_append(a.out,
        named_struct('level', length(regexp_extract(m, r'{_HEADER}', 1)), 'title', regexp_extract(m, r'{_HEADER}', 2), 'start_pos', locate(m, {text}, a.pos + 1) - 1))),
      a -> a.out)"""
    return F.expr(f"""transform({found}, (s, i) -> struct(s.level, s.title, s.start_pos, i as n))""")


def breadcrumbs(headers: str, title: str) -> Column:
    """headers: name of a column made by sections(). Adds each header's breadcrumb."""
    above = f"""aggregate(slice({headers}, 1, s.n + 1), cast(array() as array<struct<level:int,title:string>>),
      (a, x) -> concat(filter(a, y -> y.level < x.level), array(named_struct('level', x.level, 'title', x.title))))"""
    return F.expr(f"transform({headers}, s -> struct(s.level, s.title, s.start_pos, concat_ws(' > ', {title}, transform({above}, y -> y.title)) as breadcrumb))")


def mock_embedding(text: Column, dims: int = 384) -> Column:
    """A stand-in for an embedding: bytes of the SHA-256, over and over, scaled to [-1, 1)."""
    h = F.sha2(text.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is all zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Texts that consumers of these columns look for.
UNCLASSIFIED = "Not explicitly classified by judge"
NO_LINKS = "No linked entities in this chunk."
LINKS_HEAD = "Linked entities (use these Wikipedia URLs as entity URIs):"


def classifications(raw: Column, statements: Column) -> Column:
    """A judge's lines ("0: GOOD - reason") as an array of (index, statement, classification, reason), by index.

    Other lines are passed over. Statements without a line are BAD; an index beyond the statements keeps an
    empty statement, and one beyond a long is passed over. Null texts have no lines, null arrays no statements.
    """
    pattern = r"(?i)^(\d+):\s*(GOOD|BAD)\s*[-–:]\s*(.+)"
    part = lambda x, n: F.regexp_extract(x, pattern, n)
    read = lambda x: F.struct(part(x, 1).try_cast("long").alias("index"), F.upper(part(x, 2)).alias("classification"), strip(part(x, 3)).alias("reason"))
    lines = F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), strip)
    said = F.filter(F.transform(lines, read), lambda r: r["index"].isNotNull())

    def merged(given: Column, said: Column) -> Column:
        entry = lambda index, place, statement, classification, reason: F.struct(index.alias("index"), place.alias("place"), statement.alias("statement"), classification.alias("classification"), reason.alias("reason"))
        text = lambda i: F.coalesce(F.get(given, F.least(i, F.size(given)).cast("int")), F.lit(""))
        full = F.transform(said, lambda r, k: entry(r["index"], k, text(r["index"]), r["classification"], r["reason"]))
        every = F.when(F.size(given) > 0, F.sequence(F.lit(0).cast("long"), F.size(given).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
        rest = F.transform(F.array_except(every, said["index"]), lambda i: entry(i, F.lit(0), F.get(given, i.cast("int")), F.lit("BAD"), F.lit(UNCLASSIFIED)))
        # lines of equal index stay in their order
        return F.transform(F.sort_array(F.concat(full, rest)), lambda r: F.struct(*[r[c].alias(c) for c in ("index", "statement", "classification", "reason")]))

    return let(F.coalesce(statements, F.array().cast("array<string>")), lambda g: let(said, lambda s: merged(g, s)))


def good_share(found: Column, statements: Column) -> Column:
    """GOOD classifications for each statement; 0 where there is no statement."""
    return F.coalesce(F.try_divide(F.size(F.filter(found, lambda r: r["classification"] == "GOOD")), F.greatest(F.size(statements), F.lit(0))), F.lit(0.0))


def entity_context(links: Column) -> Column:
    """links: array of (label, href). A line for each label, the first link of a label wins."""
    lines = F.transform(one_of_each(links), lambda x: F.concat(F.lit("  - ["), x["label"], F.lit("]("), x["href"], F.lit(")")))
    return F.when(F.size(links) > 0, F.concat_ws("\n", F.lit(LINKS_HEAD), F.array_join(lines, "\n"))).otherwise(F.lit(NO_LINKS))
