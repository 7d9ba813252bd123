"""Contracts of JSON documents, checked as a column expression over Spark's VARIANT type.

A contract is the part of JSON Schema that is used here: const, enum, type (one or several), required, properties, items.
Other fields are always allowed; where a type is wrong nothing below it is checked.  A missing field is not a null.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The contract of a summary.
SUMMARY: dict[str, Any] = {
    "type": "object",
    "required": ["title", "abstract", "bullets", "open_questions", "confidence"],
    "properties": {
        "title": {"type": "string"},
        "abstract": {"type": "string"},
        "bullets": {"type": "array", "items": {"type": "string"}},
        "open_questions": {"type": "array", "items": {"type": "string"}},
        "confidence": {"type": "string", "enum": ["low", "medium", "high"]},
    },
}
# How VARIANT names the types of JSON.
_NAMES = {"object": "OBJECT%", "array": "ARRAY%", "string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT", "number": "DECIMAL%|DOUBLE|BIGINT|FLOAT", "null": "VOID"}


def _is(kind: Column, names: str | list[str]) -> Column:
    wanted = [n for t in ([names] if isinstance(names, str) else names) for n in _NAMES[t].split("|")]
    return reduce(lambda a, b: a | b, [kind.like(n) for n in wanted])


def _text(v: Column) -> Column:
    return F.to_json(v)


def _json(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _check(v: Column, contract: dict[str, Any], path: Column) -> Column:
    none = F.array().cast("array<string>")
    kind = F.schema_of_variant(v)
    say = lambda what: F.array(F.concat(path, F.lit(": " + what)))
    found, below = [none], [none]
    if "const" in contract:
        found.append(F.when(_text(v) != _json(contract["const"]), say(f"must be {_json(contract['const'])}")).otherwise(none))
    if "enum" in contract:
        found.append(F.when(~_text(v).isin(*map(_json, contract["enum"])), say("is not an allowed value")).otherwise(none))
    for name in contract.get("required", []):
        below.append(F.when(kind.like("OBJECT%") & F.try_variant_get(v, f"$.{name}", "variant").isNull(), say(f"lacks {name}")).otherwise(none))
    for name, part in contract.get("properties", {}).items():
        inner = F.try_variant_get(v, f"$.{name}", "variant")
        below.append(F.when(kind.like("OBJECT%") & inner.isNotNull(), _check(inner, part, F.concat(path, F.lit("." + name)))).otherwise(none))
    if "items" in contract:
        each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _check(x, contract["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        below.append(F.when(kind.like("ARRAY%"), F.flatten(each)).otherwise(none))
    rest = F.concat(*below)
    if "type" in contract:
        names = contract["type"] if isinstance(contract["type"], str) else " or ".join(contract["type"])
        rest = F.when(~_is(kind, contract["type"]), say(f"must be {names}")).otherwise(rest)
    return F.concat(*found, rest)


def violations(document: Column, contract: dict[str, Any]) -> Column:
    """Errors of a JSON document (a string column) as array<string>, each with its path from $, in the order of the contract:
    of a value its constant, its allowed values and its type; only where the type is right, what is below.  A document that is
    null or no JSON has the one error `$: is not JSON`."""
    v = F.try_parse_json(document)
    return F.when(v.isNull(), F.array(F.lit("$: is not JSON"))).otherwise(_check(v, contract, F.lit("$")))


def shape(document: Column, rules: dict[str, list[str]]) -> Column:
    """The one contract name whose marking keys a document all has; null if none or several fit."""
    keys = F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))
    fits = F.array_compact(F.array(*[F.when(F.size(F.array_except(F.array(*map(F.lit, need)), keys)) == 0, F.lit(name)) for name, need in rules.items()]))
    return F.when(F.size(fits) == 1, F.element_at(fits, 1))
