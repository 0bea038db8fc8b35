"""Structured answers of models: entities and relations out of JSON, with what is wrong in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.names import fresh
from loomgraph.functions.text import let

#: The fields of an answer's lists: name -> whether it must be there.
ENTITY = {"id": True, "label": True, "type": True, "description": False}
RELATION = {"source": True, "target": True, "type": True, "description": False}


def _is_object(v: Column) -> Column:
    """Null variants are none; no schema of the whole is made up."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def json_of(answer: Column) -> Column:
    """The JSON in an answer: what stands in its first code fence, else the whole answer; null where that is no object."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*\n(.*?)```", 1)
    given = let(fenced, lambda f: F.when(f != "", f).otherwise(answer))
    return let(F.try_parse_json(given), lambda v: F.when(_is_object(v), v))


def _entry(item: Column, fields: dict[str, bool], at: Column, name: str) -> Column:
    """errors: what an entry lacks or has of a wrong kind, as texts; its fields as texts. Null entries of the array are no objects."""
    where = F.concat(F.lit(f"{name}["), at.cast("string"), F.lit("]"))

    def one(field: str, needed: bool, of: Column, text: Column) -> Column:
        missing = of.isNull() | (of == "VOID")
        said = lambda t: F.concat(where, F.lit(f".{field}: {t}"))
        wrong = F.when(of != "STRING", F.concat(said("a text expected, not "), F.lower(F.regexp_extract(of, r"^\w+", 0))))
        return F.when(missing, said("missing") if needed else F.lit(None).cast("string")).otherwise(F.coalesce(wrong, F.when((F.trim(text) == "") & F.lit(needed), said("empty"))))

    def read(kinds: Column, texts: Column) -> Column:
        each = F.array_compact(F.array(*[one(f, n, kinds[i], texts[i]) for i, (f, n) in enumerate(fields.items())]))
        errors = F.when(_is_object(item), each).otherwise(F.array(F.concat(where, F.lit(": an object expected"))))
        return F.struct(errors.alias("errors"), *[texts[i].alias(f) for i, f in enumerate(fields)])

    # an entry's fields are looked up once: what lambdas name is computed again wherever it stands
    kinds = F.array(*[F.schema_of_variant(F.try_variant_get(item, f"$.{f}", "variant")) for f in fields])
    texts = F.array(*[F.try_variant_get(item, f"$.{f}", "string") for f in fields])
    return let(kinds, lambda k: let(texts, lambda t: read(k, t)))


def parse(answers: DataFrame, answer: str) -> DataFrame:
    """Adds entities, relations (arrays of structs), errors (array of texts) and corrupt (the answer, if it holds no object).

    An entry with an error is left out of its list and named in errors by its place; unknown fields are passed over, a
    missing or null list is empty and no error, a list that is none is an error. A null answer is corrupt, with a null text.
    """
    v, e, r, errors, corrupt = fresh(answers, "_v", "entities", "relations", "errors", "corrupt")
    x = answers.withColumn(v, json_of(F.col(f"`{answer}`")))

    def entries(key: str, fields: dict[str, bool]) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
        no_list = F.when(kind != "VOID", F.array(F.lit(f"{key}: a list expected")))
        read = lambda items: F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda i, n: _entry(i, fields, n, key))
        return let(F.try_variant_get(v, f"$.{key}", "array<variant>"), lambda items: F.struct(read(items).alias("all"), F.when(items.isNull(), no_list).alias("no_list")))

    def good(found: str, fields: dict[str, bool]) -> Column:
        return F.transform(F.filter(F.col(f"{found}.all"), lambda i: F.size(i["errors"]) == 0), lambda i: F.struct(*[i[f].alias(f) for f in fields]))

    wrong = lambda found: F.coalesce(F.col(f"{found}.no_list"), F.flatten(F.transform(F.col(f"{found}.all"), lambda i: i["errors"])))
    a, b = fresh(x, "_entities", "_relations")
    x = x.withColumns({a: entries("entities", ENTITY), b: entries("relations", RELATION)})
    return x.select(*[F.col(f"`{c}`") for c in answers.columns], good(a, ENTITY).alias(e), good(b, RELATION).alias(r), F.concat(wrong(a), wrong(b)).alias(errors), F.when(F.col(v).isNull(), F.col(f"`{answer}`")).alias(corrupt))
