"""Configurations as VARIANT values, flattened to a row for each path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import bound

LEAF = "path string, kind string, value string, number double, v variant"


def _kind(v: Column) -> Column:
    """object, array, number, string, boolean or null."""
    names = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    shape = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(shape, F.substring_index(F.schema_of_variant(v), "<", 1)), F.lit("number"))


def _leaf(path: Column, v: Column) -> Column:
    """struct(path, kind, value, number, v); `v` is null unless it is an object."""

    def told(kind: Column) -> Column:
        value = F.when(~kind.isin("object", "null"), F.try_variant_get(v, "$", "string"))
        number = F.when(kind == "number", F.try_variant_get(v, "$", "double"))
        return F.struct(path.alias("path"), kind.alias("kind"), value.alias("value"), number.alias("number"), F.when(kind == "object", v).alias("v"))

    return bound(_kind(v), told)


def _depth(configs: DataFrame, text: str) -> int:
    """No less than the levels of objects in the deepest document; braces inside strings don't count."""
    bare = F.col(text)
    for gone in (r"(?s)\\.", '"[^"]*"', "[^{}]+"):
        bare = F.regexp_replace(bare, gone, "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, c: Column) -> Column:
        now = at["now"] + F.when(c == "{", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    deepest = F.aggregate(F.filter(F.split("_b", ""), lambda c: c != ""), start, step, lambda at: at["most"])
    shapes = configs.where(F.try_parse_json(F.col(text)).isNotNull()).select(bare.alias("_b")).distinct()
    return shapes.agg(F.max(deepest)).first()[0] or 0


def folded(configs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, leaves): the rows of `leaves` of each JSON document as one array, with no shuffle of documents; `v` is an object's own value."""
    v, malformed = F.col("_v"), f"array(named_struct('path', '$', 'kind', 'malformed', 'value', string(null), 'number', double(null), 'v', _v))"
    whole = F.when(v.isNull(), F.expr(malformed)).otherwise(F.array(_leaf(F.lit("$"), v)))
    now = configs.select(key, F.try_parse_json(F.col(text)).alias("_v")).select(key, whole.alias("_met")).withColumn("leaves", F.array().cast(f"array<struct<{LEAF}>>"))
    add = F.concat("leaves", "_met").alias("leaves")
    for _ in range(_depth(configs, text)):
        below = lambda o, e: _leaf(F.when(o["path"] == "$", e["key"]).otherwise(F.concat(o["path"], F.lit("."), e["key"])), e["value"])
        members = lambda o: F.transform(F.map_entries(F.try_variant_get(o["v"], "$", "map<string,variant>")), lambda e: below(o, e))
        met = F.flatten(F.transform(F.filter("_met", lambda m: m["kind"] == "object"), members))
        now = now.select(key, met.alias("_met"), add)
    return now.select(key, add)


def leaves(configs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, path, kind, value, number) of each JSON document: `a.b.c` for every member of every object.

    Objects have a row of their own with null value, then one for each member; an array is one row
    with its JSON as value; `number` is a number's double. The document itself has path `$`. A
    document that is no JSON, or null, is one row of kind `malformed`. Members are taken
    level by level, as deep as the deepest document goes.
    """
    return folded(configs, key, text).select(key, F.inline("leaves")).drop("v")


def together(found: DataFrame, key: str) -> DataFrame:
    """Rows (key, leaves) of rows of `leaves`."""
    return found.groupBy(key).agg(F.collect_list(F.struct("path", "kind", "value", "number")).alias("leaves"))


def schema_problems(found: DataFrame, key: str, schema: Sequence[tuple]) -> DataFrame:
    """`schema_problems_in` for rows of `leaves`."""
    return schema_problems_in(together(found, key), key, schema)


def schema_problems_in(documents: DataFrame, key: str, schema: Sequence[tuple]) -> DataFrame:
    """Rows (key, path, problem) where documents (key, leaves) break a closed schema, each judged in its own row.

    `schema` has (path, kinds, required, low, high, choices) for every path that may be there: kinds joined by |,
    `integer` among them for whole numbers; limits and choices (as text, | between) may be null. Problems:
    malformed, unknown, missing (of an object that is there, or of the document), kind, range, choice.
    """
    texts = lambda x: F.lit(None).cast("array<string>") if x is None else F.array(*[F.lit(t) for t in x.split("|")])
    limit = lambda x: F.lit(x).cast("double")
    rule = {path: F.struct(texts(kinds).alias("kinds"), limit(low).alias("low"), limit(high).alias("high"), texts(choices).alias("choices")) for path, kinds, _, low, high, choices in schema}
    rules = F.create_map(*[x for path, r in rule.items() for x in (F.lit(path), r)])
    needed = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(p.rpartition(".")[0] or "$").alias("at")) for p, _, required, *_ in schema if required])

    def judged(leaf: Column, r: Column) -> Column:
        kind, number = leaf["kind"], leaf["number"]
        whole = F.array_contains(r["kinds"], "integer") & (kind == "number") & (number == F.floor(number))
        typed = F.array_contains(r["kinds"], kind) | F.coalesce(whole, F.lit(False))
        beyond = (number < r["low"]) | (number > r["high"])
        other = r["choices"].isNotNull() & (kind != "null") & ~F.array_contains(r["choices"], leaf["value"])
        problem = F.when(r.isNull(), "unknown").when(~typed, "kind").when(beyond, "range").when(other, "choice")
        return F.struct(leaf["path"].alias("path"), problem.alias("problem"))

    as_problem = lambda x, name: F.struct(x["path"].alias("path"), F.lit(name).alias("problem"))
    members = F.filter("leaves", lambda x: x["path"] != "$")
    wrong = F.filter(F.transform(members, lambda x: bound(F.try_element_at(rules, x["path"]), lambda r: judged(x, r))), lambda x: x["problem"].isNotNull())
    malformed = F.transform(F.filter("leaves", lambda x: (x["kind"] == "malformed") | ((x["path"] == "$") & (x["kind"] != "object"))), lambda x: as_problem(x, "malformed"))
    objects = F.transform(F.filter("leaves", lambda x: x["kind"] == "object"), lambda x: x["path"])
    seen = documents.select(key, "leaves", objects.alias("_objects"), F.transform("leaves", lambda x: x["path"]).alias("_paths"))
    owed = F.filter(needed, lambda n: F.array_contains("_objects", n["at"]) & ~F.array_contains("_paths", n["path"]))
    return seen.select(key, F.inline(F.concat(wrong, F.transform(owed, lambda n: as_problem(n, "missing")), malformed)))
