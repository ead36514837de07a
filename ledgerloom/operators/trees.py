"""Dynamic JSON trees: pointers, changed leaves, merge patches, sorted digests and closed-world schema checks.

Each works on one document at a time in Arrow batches; nothing is gathered across documents. Unparsable JSON gives null.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MISSING:
    """Stands for an absent value. A class, since it keeps its identity when functions are shipped to the executors."""



def load(text: str | None) -> object:
    if text is None:
        return MISSING
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return MISSING


def resolve(tree: object, pointer: str) -> object:
    """The value at an RFC 6901 pointer, or MISSING; a null there is a value."""
    if pointer == "":
        return tree
    for step in pointer.split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(tree, dict) and step in tree:
            tree = tree[step]
        elif isinstance(tree, list) and step.isdigit() and int(step) < len(tree):
            tree = tree[int(step)]
        else:
            return MISSING
    return tree


def changed_leaves(before: object, after: object, at: str = "") -> Iterator[str]:
    """Pointers of leaves that differ, in order of the keys; arrays are compared whole."""
    if isinstance(before, dict) and isinstance(after, dict):
        for key in sorted({*before, *after}):
            yield from changed_leaves(before.get(key, MISSING), after.get(key, MISSING), f"{at}/{key.replace('~', '~0').replace('/', '~1')}")
    elif before is MISSING and isinstance(after, dict) and after:
        yield from changed_leaves({}, after, at)
    elif after is MISSING and isinstance(before, dict) and before:
        yield from changed_leaves(before, {}, at)
    elif type(before) is not type(after) or before != after:
        yield at


def merge_patch(target: object, patch: object) -> object:
    """RFC 7396: nulls delete, objects merge, all else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = merge_patch(out.get(key), value)
    return out


def patch_leaves(patch: object, at: str = "") -> Iterator[str]:
    if isinstance(patch, dict) and patch:
        for key, value in patch.items():
            yield from patch_leaves(value, f"{at}/{key.replace('~', '~0').replace('/', '~1')}")
    else:
        yield at


def schema_errors(value: object, schema: dict, at: str = "") -> Iterator[tuple[str, str]]:
    """(pointer, keyword) of every violation. Keywords: type, enum, pattern, lengths, minimum, items, required, closed objects."""
    kinds = schema.get("type")
    names = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    if kinds:
        options = [kinds] if isinstance(kinds, str) else kinds

        def fits(kind: str) -> bool:
            if kind in ("integer", "number"):
                return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
            return isinstance(value, names[kind])

        if not any(map(fits, options)):
            yield at, "type"
            return
    if "enum" in schema and value not in schema["enum"]:
        yield at, "enum"
    if isinstance(value, str):
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield at, "pattern"
        if len(value) < schema.get("minLength", 0):
            yield at, "minLength"
        if len(value) > schema.get("maxLength", len(value)):
            yield at, "maxLength"
    elif isinstance(value, dict):
        properties = schema.get("properties", {})
        for key in schema.get("required", []):
            if key not in value:
                yield f"{at}/{key}", "required"
        for key, x in value.items():
            if key in properties:
                yield from schema_errors(x, properties[key], f"{at}/{key}")
            elif schema.get("additionalProperties") is False:
                yield f"{at}/{key}", "additionalProperties"
    elif isinstance(value, list):
        if len(value) > schema.get("maxItems", len(value)):
            yield at, "maxItems"
        if "items" in schema:
            for i, x in enumerate(value):
                yield from schema_errors(x, schema["items"], f"{at}/{i}")
    elif isinstance(value, (int, float)) and not isinstance(value, bool) and value < schema.get("minimum", value):
        yield at, "minimum"


@F.pandas_udf(T.StringType())
def json_pointer(text: pd.Series, pointer: pd.Series) -> pd.Series:
    """JSON text of the value at the pointer; null if it is missing (a null value is the text 'null')."""
    return pd.Series([None if (v := resolve(load(t), p)) is MISSING else json.dumps(v, ensure_ascii=False) for t, p in zip(text, pointer, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def changed_pointers(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([list(changed_leaves(load(a), load(b))) for a, b in zip(before, after, strict=True)])


@F.pandas_udf(T.StringType())
def patched(target: pd.Series, patch: pd.Series, allowed: pd.Series) -> pd.Series:
    """The patched document; null if the patch is empty or touches a leaf that is not allowed."""

    def one(t: str, p: str, ok: object) -> str | None:
        tree, change = load(t), load(p)
        if tree is MISSING or not isinstance(change, dict) or not change or not set(patch_leaves(change)) <= set(ok):
            return None
        return json.dumps(merge_patch(tree, change), ensure_ascii=False)

    return pd.Series([one(*x) for x in zip(target, patch, allowed, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def sorted_digest(text: pd.Series) -> pd.Series:
    """SHA-256 of the document with sorted keys and no white space: equal for documents that differ only in form."""
    dump = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return pd.Series([None if (v := load(t)) is MISSING else hashlib.sha256(dump(v).encode("utf-8", "replace")).hexdigest() for t in text], dtype=object)


def schema_check(schema: dict):
    """A column function: array of (pointer, keyword) of a JSON text; one ('', 'json') if it cannot be read."""

    @F.pandas_udf("array<struct<pointer:string,keyword:string>>")
    def check(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            tree = load(t)
            found = [("", "json")] if tree is MISSING else schema_errors(tree, schema)
            return [{"pointer": p, "keyword": k} for p, k in found]

        return text.map(one)

    return check
