"""Wikitext articles: markdown, links, categories and infobox, from a tree of each text's links and templates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import MONTHS

#: Namespaces whose links aren't links to articles; infobox values know the first five only.
NAMESPACES = ("file", "image", "category", "wikipedia", "template", "help", "portal", "special", "talk", "user")
#: Infobox fields about pictures and layout.
SKIPPED_FIELDS = ("image", "image_size", "image_upright", "imagesize", "image_caption", "caption", "alt", "module", "embed", "signature", "footer")
#: Names of templates, by what becomes of them.
LISTS = ("plainlist", "flatlist", "unbulleted list", "ubl", "hlist", "cslist", "indented plainlist", "collapsible list")
LIST_LAYOUT = ("title", "class", "style")
DATES = ("birth date", "death date", "birth date and age", "death date and age")
LANGUAGES = ("lang", "transl", "transliteration")
VALUE_LANGUAGES = (*LANGUAGES, "lang-de", "lang-la")
VALUE_TEXTS = {"ndash": "–", "en dash": "–", "snd": "–", "spnd": "–", "sndash": "–", "mdash": "—", "em dash": "—"}
SECTION_TEXTS = {"nbsp": " – ", "snd": " – ", "spnd": " – ", "sndash": " – ", "spndash": " – ", "ndash": "–", "en dash": "–", "mdash": "—", "em dash": "—"}
#: What is replaced in a section's text and in an infobox value, in this order, and where a rule can apply
#: at all: a text that its matches hold, or "" where there is none.
SECTION_CLEANUP = (
    ("<ref", re.compile(r"<ref[^>]*>.*?</ref>", re.S), ""),
    ("<ref", re.compile(r"<ref[^>]*/>"), ""),
    ("<", re.compile(r"</?(?:small|big|sub|sup|span|div)[^>]*>"), ""),
    ("<!--", re.compile(r"<!--.*?-->", re.S), ""),
    ("'''", re.compile(r"'''([^']+)'''"), r"**\1**"),
    ("''", re.compile(r"''([^']+)''"), r"*\1*"),
    ("", re.compile(r"[ \t]+"), " "),
    ("\n\n\n", re.compile(r"\n{3,}"), "\n\n"),
)
VALUE_CLEANUP = (
    ("{{", re.compile(r"\{\{[^}]*\}\}"), ""),
    ("", re.compile(r"\s+"), " "),
    ("<", re.compile(r"<[^>]+>"), ""),
    ("*", re.compile(r"\*\s*,"), ","),
    (",", re.compile(r",\s*,"), ","),
    ("", re.compile(r"^\s*[,*]\s*"), ""),
    ("", re.compile(r"\s*[,*]\s*$"), ""),
)
PLAIN_CLEANUP = (("[[", re.compile(r"\[\[([^|\]]+\|)?([^\]]+)\]\]"), r"\2"), ("{{", re.compile(r"\{\{[^}]+\}\}"), ""))

HEADING = re.compile(r"^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", re.M)
TOKEN = re.compile(r"<!--.*?-->|<nowiki>.*?</nowiki>|\{\{|\}\}|\[\[|\]\]|\|", re.S)
OPEN, CLOSE = {"{{": "template", "[[": "link"}, {"}}": "template", "]]": "link"}
MARKS = {"template": ("{{", "}}"), "link": ("[[", "]]")}
#: Brackets nested deeper than this are text.
DEEPEST = 40
#: Templates within templates of an infobox value are expanded to this depth.
EXPANDED = 5


@dataclass(slots=True)
class Node:
    """A link or a template: its fields, divided by bars, each a list of texts and nodes."""

    kind: str
    fields: list[list] = field(default_factory=lambda: [[]])

    def source(self) -> str:
        a, b = MARKS[self.kind]
        return a + "|".join(map(source, self.fields)) + b


def source(parts: list) -> str:
    if len(parts) == 1 and isinstance(parts[0], str):
        return parts[0]
    return "".join([p if isinstance(p, str) else p.source() for p in parts])


def parse(text: str) -> list:
    """Texts and nodes. Brackets without a partner are text."""
    root = Node("root")
    stack, at = [root], 0

    def loosen() -> None:
        """The top node has no end: its mark and fields go to the node around it."""
        top = stack.pop()
        out = stack[-1].fields[-1]
        out.append(MARKS[top.kind][0])
        for i, parts in enumerate(top.fields):
            out += ["|", *parts] if i else parts

    for m in TOKEN.finditer(text):
        start, end = m.span()
        if start > at:
            stack[-1].fields[-1].append(text[at:start])
        at, token = end, m[0]
        if token in OPEN and len(stack) <= DEEPEST:
            stack.append(Node(OPEN[token]))
        elif token == "|" and len(stack) > 1:
            stack[-1].fields.append([])
        elif token in CLOSE and (stack[-1].kind == CLOSE[token] or any(n.kind == CLOSE[token] for n in stack)):
            while stack[-1].kind != CLOSE[token]:
                loosen()
            done = stack.pop()
            stack[-1].fields[-1].append(done)
        else:
            stack[-1].fields[-1].append(token)
    while len(stack) > 1:
        loosen()
    return [*root.fields[0], text[at:]]


def walk(parts: list, kind: str) -> Iterator[Node]:
    """Nodes of a kind, the outer one first."""
    for p in parts:
        if not isinstance(p, str):
            if p.kind == kind:
                yield p
            for inner in p.fields:
                yield from walk(inner, kind)


def name_of(template: Node) -> str:
    return source(template.fields[0]).strip()


def arguments(template: Node) -> Iterator[tuple[str | None, list]]:
    """Name, or None where an argument goes by its place, and value."""
    for parts in template.fields[1:]:
        for i, p in enumerate(parts):
            if isinstance(p, str) and "=" in p:
                before, after = p.split("=", 1)
                yield source([*parts[:i], before]).strip(), [after, *parts[i + 1 :]]
                break
        else:
            yield None, parts


def target_and_label(link: Node) -> tuple[str, str]:
    target = source(link.fields[0])
    return target, "|".join(map(source, link.fields[1:])) or target


def elsewhere(target: str, namespaces: tuple[str, ...] = NAMESPACES) -> bool:
    return ":" in target and target.split(":")[0].lower() in namespaces


def path(page: str) -> str:
    return "/wiki/" + quote(page.replace(" ", "_"))


def markdown_link(link: Node, namespaces: tuple[str, ...], local: Callable[[str, str], str]) -> str:
    """local: what a link to a section of the same article becomes, given its label and section."""
    target, label = target_and_label(link)
    if elsewhere(target, namespaces):
        return ""
    page, mark, section = target.partition("#")
    return local(label, section) if mark and not page else f"[{label}]({path(page)})"


def clean(text: str, rules: tuple) -> str:
    for held, pattern, by in rules:
        if held in text:
            text = pattern.sub(by, text)
    return text.strip()


def section_text(tree: list) -> str:
    """tree: a section, parsed. Links become markdown; of templates, languages leave their first argument, formulas and dashes their text."""

    def template(t: Node) -> str:
        name = name_of(t).lower()
        if name not in LANGUAGES and name != "math":
            return SECTION_TEXTS.get(name, "")
        first = next((source(v).strip() for k, v in arguments(t) if k is None), None)
        if name == "math":
            return f"${first}$" if first is not None else ""
        return first or ""

    anchor = lambda label, section: f"[{label}](#{section.replace(' ', '_')})"
    parts = [p if isinstance(p, str) else template(p) if p.kind == "template" else markdown_link(p, NAMESPACES, anchor) for p in tree]
    return clean("".join(parts), SECTION_CLEANUP)


def value_text(parts: list) -> str:
    """An infobox value as markdown. Marriages and templates that aren't known leave nothing."""

    def text(parts: list, depth: int) -> str:
        return "".join(p if isinstance(p, str) else template(p, depth) if p.kind == "template" else markdown_link(p, NAMESPACES[:5], lambda label, _: label) for p in parts)

    def template(t: Node, depth: int) -> str:
        name = name_of(t).lower()
        if name in VALUE_TEXTS:
            return VALUE_TEXTS[name]
        if depth > EXPANDED:
            return ""
        if name in LISTS:
            items = [text(v, depth + 1).strip() for k, v in arguments(t) if k is None or k.lower() not in LIST_LAYOUT]
            return ", ".join(filter(None, items))
        if name in DATES:
            n = [s for _, v in arguments(t) if (s := source(v).strip()).isdigit()]
            return f"{n[2]} {month(n[1])} {n[0]}" if len(n) >= 3 else ""
        if name in VALUE_LANGUAGES:
            return next((s for _, v in reversed(list(arguments(t))) if (s := text(v, depth + 1).strip())), "")
        return ""

    return clean(text(parts, 0), VALUE_CLEANUP)


def month(digits: str) -> str:
    n = int(digits)
    return "" if n == 0 else MONTHS[n - 1] if n <= len(MONTHS) else digits


def infobox(tree: list) -> tuple[dict[str, str], str]:
    """Plain values by field, and a markdown block, of the first template that calls itself an infobox."""
    box = next((t for t in walk(tree, "template") if "infobox" in name_of(t).lower()), None)
    if box is None:
        return {}, ""
    kind = name_of(box).replace("Infobox ", "").replace("infobox ", "")
    plain, lines = {}, [f"=== Infobox: {kind} ===\n"]
    for key, value in arguments(box):
        raw = source(value).strip()
        if not key or key.isdigit() or not raw or key.lower() in SKIPPED_FIELDS:
            continue
        if p := clean(raw, PLAIN_CLEANUP):
            plain[key] = p
        if md := value_text(value):
            lines.append(f"**{key}**: {md}\n")
    return plain, "\n".join(lines)


def markdown(text: str, tree: list | None = None) -> str:
    """tree: the text, if it is parsed already. Each section's heading and own text."""
    lead, *rest = HEADING.split(text)
    lines = [s for s in [section_text(parse(lead) if rest or tree is None else tree)] if s]
    for level, title, content in zip(rest[::3], rest[1::3], rest[2::3], strict=True):
        lines.append(f"\n{level} {title.strip()} {level}\n")
        lines += [s for s in [section_text(parse(content))] if s]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def article(title: str, text: str, base: str, most: int) -> dict:
    tree = parse(text)
    links, categories = {}, []
    for link in walk(tree, "link"):
        target, label = target_and_label(link)
        if target.startswith("Category:"):
            categories.append(target[len("Category:") :])
        if not elsewhere(target):
            links[label] = base + path(target.partition("#")[0] or title)
    plain, block = infobox(tree)
    content = markdown(text, tree)
    content = f"{block}\n\n{content}" if block else content
    return {"title": title, "url": base + path(title), "content": content[:most], "links": list(links.items()), "categories": categories, "infobox": list(plain.items())}


KIND = pa.schema(
    [
        ("title", pa.string()),
        ("url", pa.string()),
        ("content", pa.string()),
        ("links", pa.map_(pa.string(), pa.string())),
        ("categories", pa.list_(pa.string())),
        ("infobox", pa.map_(pa.string(), pa.string())),
    ]
)
SCHEMA = "key long, title string, url string, content string, links map<string,string>, categories array<string>, infobox map<string,string>"


def articles(rows: DataFrame, key: str, title: str, text: str, base: str = "https://en.wikipedia.org", most: int = 100_000) -> DataFrame:
    """One row for each article, in tasks that hold one batch at a time; null titles and texts are empty.

    links: address by label, the last one wins; categories in order, repeats kept; content is cut to `most` code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [article(t or "", x or "", base, most) for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = [pa.array([a[f.name] for a in found], f.type) for f in KIND]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["key", *KIND.names])

    return rows.select(F.col(key).cast("long").alias("key"), F.col(title).cast("string"), F.col(text)).mapInArrow(run, SCHEMA)
