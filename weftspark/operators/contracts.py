"""JSON columns against a schema of required keys, types and allowed values: violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a schema may say of a value: type (object, array, string, integer, number, boolean), required, properties, items,
#: enum, min_length, min_items, minimum; objects take no other keys.
Schema = dict[str, object]
_MOST_ITEMS_DEPTH = 3


def _kind(json: Column) -> Column:
    first = F.substring(F.trim(json), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(json.isin("true", "false"), "boolean").when(json == "null", "null").when(json.rlike(r"^-?\d+$"), "integer").otherwise("number")


def _raw(json: Column, key: str) -> Column:
    """The value of a key as JSON text, strings in quotes; null if the key is missing."""
    return F.to_json(F.try_variant_get(F.try_parse_json(json), f'$["{key}"]', "variant"))


def checks(json: Column, schema: Schema, path: str, depth: int = 0) -> list[Column]:
    """For each rule of a schema what is wrong with a JSON text, null where it is kept."""
    kind = schema["type"]
    wrong = _kind(json) != kind if kind != "number" else ~_kind(json).isin("number", "integer")
    out = [F.when(wrong, F.lit(f"{path}: {kind} expected"))]
    sound = ~wrong
    plain = F.regexp_replace(json, r'^"|"$', "")
    if "enum" in schema:
        out.append(F.when(sound & ~plain.isin(*[str(v) for v in schema["enum"]]), F.lit(f"{path}: value not allowed")))
    if "min_length" in schema:
        out.append(F.when(sound & (F.length(plain) < schema["min_length"]), F.lit(f"{path}: too short")))
    if "minimum" in schema:
        out.append(F.when(sound & (json.cast("double") < schema["minimum"]), F.lit(f"{path}: too small")))
    if kind == "object":
        own, wanted = schema.get("properties", {}), schema.get("required", ())
        keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
        for key in wanted:
            out.append(F.when(sound & ~F.array_contains(keys, key), F.lit(f"{path}.{key}: missing")))
        extra = F.array_except(keys, F.array(*[F.lit(k) for k in own]) if own else F.array().cast("array<string>"))
        out.append(F.when(sound & (F.size(extra) > 0), F.concat(F.lit(f"{path}: unknown keys "), F.array_join(F.array_sort(extra), ","))))
        for key, part in own.items():
            value = _raw(json, key)
            out += [F.when(sound & value.isNotNull(), c) for c in checks(value, part, f"{path}.{key}", depth)]
    if kind == "array":
        items = F.transform(F.try_variant_get(F.try_parse_json(json), "$", "array<variant>"), lambda v: F.to_json(v))
        if "min_items" in schema:
            out.append(F.when(sound & (F.size(items) < schema["min_items"]), F.lit(f"{path}: too few items")))
        if "items" in schema and depth < _MOST_ITEMS_DEPTH:
            found = F.flatten(F.transform(items, lambda v: F.array_compact(F.array(*checks(v, schema["items"], f"{path}[]", depth + 1)))))
            out.append(F.when(sound, F.get(found, F.lit(0))))
    return out


def violations(df: DataFrame, key: list[str], column: str, schema: Schema) -> DataFrame:
    """One row per broken rule: the key columns and what is wrong where; of an array's items the first breach is named."""
    json = F.col(column)
    valid = F.try_parse_json(json).isNotNull()
    wrong = F.when(~valid | json.isNull(), F.array(F.lit("$: no JSON"))).otherwise(F.array_compact(F.array(*checks(json, schema, "$"))))
    return df.select(*key, F.explode(wrong).alias("violation"))


def broken(df: DataFrame, key: list[str], rules: dict[str, Column], name: str = "rule") -> DataFrame:
    """One row per row and rule that holds for it: the key columns and the rule's name."""
    return df.select(*key, F.explode(F.array_compact(F.array(*[F.when(holds, rule) for rule, holds in rules.items()]))).alias(name))


def safe_diagnostic(stage: Column, category: Column, path: Column, stages: tuple[str, ...], categories: tuple[str, ...]) -> Column:
    """What may be told of a failure: names of known stages and categories, and a path without contents."""
    clean = F.regexp_replace(path, r"\[\d+\]", "[]")
    return F.struct(
        F.when(stage.isin(*stages), stage).otherwise("unknown").alias("stage"),
        F.when(category.isin(*categories), category).otherwise("unknown").alias("category"),
        F.when(clean.rlike(r"^\$(\.[A-Za-z_]+|\[\])*$"), clean).otherwise("$").alias("path"),
    )
