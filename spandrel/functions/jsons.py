"""JSON functions over JSON text.

Reading uses Spark's JSON expressions. Only edits of a nested value (set, insert,
strip) have no such expression; they run as Arrow-batched pandas functions.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spandrel.functions.registry import FUNCTIONS, col, scalar


def _path(keys) -> str:
    return "$" + "".join(f"[{k}]" if str(k).lstrip("-").isdigit() else f"['{k}']" for k in keys)


def braces(path: str) -> list[str]:
    """Keys of a ``{a,b}`` path."""
    inner = path.strip().removeprefix("{").removesuffix("}")
    return [k.strip() for k in inner.split(",")] if inner.strip() else []


@scalar("jsonb_extract_path_text")
def json_extract_path_text(j, *keys) -> Column:
    """Text of a nested value, unquoted."""
    return F.get_json_object(col(j), _path(keys))


@scalar("jsonb_extract_path")
def json_extract_path(j, *keys) -> Column:
    """JSON text of a nested value."""
    return F.to_json(F.try_variant_get(F.try_parse_json(col(j)), _path(keys), "variant"))


@scalar("#>")
def json_extract_path_op(j, path: str) -> Column:
    return json_extract_path(j, *braces(path))


@scalar("#>>")
def json_extract_path_text_op(j, path: str) -> Column:
    return json_extract_path_text(j, *braces(path))


@scalar("jsonb_build_object")
def json_build_object(*pairs) -> Column:
    """Keys and values in turn; NULL values are kept."""
    fields = [col(v).alias(k) for k, v in zip(pairs[::2], pairs[1::2])]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


@scalar("jsonb_build_array")
def json_build_array(*values) -> Column:
    """Elements may have different types."""
    parts = [F.coalesce(F.to_json(F.to_variant_object(F.array(col(v)))).substr(F.lit(2), F.length(F.to_json(F.to_variant_object(F.array(col(v))))) - 2), F.lit("null")) for v in values]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def _keys(j) -> Column:
    return F.json_object_keys(col(j))


@scalar("jsonb_object_keys")
def json_object_keys(j) -> Column:
    return _keys(j)


@scalar("?")
def json_contains_key(j, key) -> Column:
    return F.coalesce(F.array_contains(_keys(j), F.lit(key)), F.lit(False))


@scalar("?|")
def json_contains_any_key(j, keys: list) -> Column:
    return F.coalesce(F.arrays_overlap(_keys(j), F.array(*map(F.lit, keys))), F.lit(False))


@scalar("?&")
def json_contains_all_keys(j, keys: list) -> Column:
    return F.coalesce(F.forall(F.array(*map(F.lit, keys)), lambda k: F.array_contains(_keys(j), k)), F.lit(False))


@scalar("jsonb_each")
def json_each(j) -> Column:
    """Array of (key, JSON text)."""
    return F.transform(F.map_entries(F.from_json(col(j), "map<string,variant>")), lambda e: F.struct(e.key.alias("key"), F.to_json(e.value).alias("value")))


@scalar("jsonb_each_text")
def json_each_text(j) -> Column:
    """Array of (key, unquoted text)."""
    return F.transform(F.map_entries(F.from_json(col(j), "map<string,string>")), lambda e: F.struct(e.key.alias("key"), e.value.alias("value")))


@scalar("jsonb_array_elements")
def json_array_elements(j) -> Column:
    return F.transform(F.from_json(col(j), "array<variant>"), lambda v: F.to_json(v))


@scalar("jsonb_array_elements_text")
def json_array_elements_text(j) -> Column:
    return F.from_json(col(j), "array<string>")


@scalar()
def jsonb_path_exists(j, path: str) -> Column:
    return F.get_json_object(col(j), path).isNotNull()


@scalar()
def jsonb_path_query(j, path: str) -> Column:
    return F.get_json_object(col(j), path)


@scalar()
def jsonb_path_query_array(j, path: str) -> Column:
    """All matches as JSON array text."""
    found = F.get_json_object(col(j), path)
    return found if "[*]" in path else F.concat(F.lit("["), json_extract_path(j, *_steps(path)), F.lit("]"))


@scalar()
def jsonb_path_query_first(j, path: str) -> Column:
    found = F.get_json_object(col(j), path)
    return F.get(F.from_json(found, "array<string>"), F.lit(0)) if "[*]" in path else found


def _steps(path: str) -> list[str]:
    return [s for s in path.removeprefix("$").replace("[", ".").replace("]", "").split(".") if s]


def _edit(change):
    """A pandas function of JSON text; text that is no JSON gives NULL."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(value):
            if value is None:
                return None
            try:
                tree = json.loads(value)
            except ValueError:
                return None
            return json.dumps(change(tree), ensure_ascii=False, separators=(",", ":"))

        return values.map(one, na_action="ignore")

    return run


def _place(tree, keys: list[str], put):
    """The container of the last key and that key, or None if the way there is missing."""
    for key in keys[:-1]:
        if isinstance(tree, dict) and key in tree:
            tree = tree[key]
        elif isinstance(tree, list) and key.lstrip("-").isdigit() and -len(tree) <= int(key) < len(tree):
            tree = tree[int(key)]
        else:
            return
    put(tree, keys[-1])


@scalar()
def jsonb_set(j, path: str, value: str, create: bool = True) -> Column:
    """Sets the value (JSON text) at ``{a,b}``; a missing last key is made if ``create``."""
    keys, new = braces(path), json.loads(value)

    def change(tree):
        def put(box, key):
            if isinstance(box, dict) and (create or key in box):
                box[key] = new
            elif isinstance(box, list) and key.lstrip("-").isdigit():
                at = int(key)
                if -len(box) <= at < len(box):
                    box[at] = new
                elif create:
                    box.insert(len(box) if at > 0 else 0, new)

        if keys:
            _place(tree, keys, put)
        return tree

    return _edit(change)(col(j))


@scalar()
def jsonb_insert(j, path: str, value: str, after: bool = False) -> Column:
    """Adds the value at ``{a,b}``: a new key, or before (after) a list place; existing keys stay."""
    keys, new = braces(path), json.loads(value)

    def change(tree):
        def put(box, key):
            if isinstance(box, dict):
                box.setdefault(key, new)
            elif isinstance(box, list) and key.lstrip("-").isdigit():
                at = int(key)
                at = at + len(box) if at < 0 else at
                box.insert(at + after, new)

        if keys:
            _place(tree, keys, put)
        return tree

    return _edit(change)(col(j))


def _strip(tree):
    if isinstance(tree, dict):
        return {k: _strip(v) for k, v in tree.items() if v is not None}
    return [_strip(v) for v in tree] if isinstance(tree, list) else tree


@scalar()
def jsonb_strip_nulls(j) -> Column:
    """Drops NULL fields of objects at any depth; list elements stay."""
    return _edit(_strip)(col(j))


FUNCTIONS["json_get"] = json_extract_path
