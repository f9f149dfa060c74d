"""JSON functions of both dialects, over JSON kept as text."""

from __future__ import annotations

import json as stdlib_json
import re
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import JSONS, TEXTS, Expr, expr, made, require


def _doc(value: Any, what: str) -> Expr:
    e = expr(value)
    require(e, (*JSONS, *TEXTS), what)
    return e


def _path(path: str) -> str:
    """'$.a', 'a' and PostgreSQL's '{a,0}' are one path."""
    if path.startswith("{"):
        steps = [s.strip().strip('"') for s in path.strip("{}").split(",") if s.strip()]
        return "$" + "".join(f"[{s}]" if re.fullmatch(r"\d+", s) else f".{s}" for s in steps)
    return path if path.startswith("$") else f"$.{path}"


def _variant(c: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(c), path, "variant")


def _json(c: Column, path: str) -> Column:
    return F.to_json(_variant(c, path))


def _text(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def json(value: Any) -> Expr:
    """The document without insignificant white space; malformed text is an error."""
    e = _doc(value, "json")
    return made([e], F.to_json(F.parse_json(e.column)), "json")


def jsonb(value: Any) -> Expr:
    e = _doc(value, "jsonb")
    return made([e], F.to_json(F.parse_json(e.column)), "jsonb")


def _shown(v: Any) -> Column:
    e = expr(v)
    return e.column.cast("string")


def json_eq(value: Any, field: str, v: Any) -> Expr:
    e = _doc(value, "json_eq")
    return made([e], _text(e.column, _path(field)) == _shown(v), "bool", True)


def json_ne(value: Any, field: str, v: Any) -> Expr:
    e = _doc(value, "json_ne")
    return made([e], _text(e.column, _path(field)) != _shown(v), "bool", True)


json_contains = json_eq


def json_exists(value: Any, path: str) -> Expr:
    """A JSON null counts as present."""
    e = _doc(value, "json_exists")
    return made([e], _variant(e.column, _path(path)).isNotNull(), "bool", False)


def json_not_exists(value: Any, path: str) -> Expr:
    e = json_exists(value, path)
    return made([e], ~e.column, "bool", False)


def json_array_contains(value: Any, path: str, v: Any) -> Expr:
    e, item = _doc(value, "json_array_contains"), expr(v)
    kind = {"text": "string", "bool": "boolean", "float8": "double"}.get(item.type, "bigint")
    items = F.from_json(_text(e.column, _path(path)), f"array<{kind}>")
    return made([e], F.coalesce(F.array_contains(items, item.column.cast(kind)), F.lit(False)), "bool", False)


def _keys(c: Column, path: str = "$") -> Column:
    return F.json_object_keys(c if path == "$" else _json(c, path))


def json_object_contains_key(value: Any, path: str, key: str) -> Expr:
    e = _doc(value, "json_object_contains_key")
    return made([e], F.coalesce(F.array_contains(_keys(e.column, _path(path) if path != "$" else "$"), key), F.lit(False)), "bool", False)


def json_text_contains(value: Any, path: str, v: str) -> Expr:
    e = _doc(value, "json_text_contains")
    return made([e], F.contains(F.lower(_text(e.column, _path(path))), F.lower(_shown(v))), "bool", True)


def json_gt(value: Any, path: str, v: Any) -> Expr:
    e = _doc(value, "json_gt")
    return made([e], _text(e.column, _path(path)).try_cast("double") > expr(v).column, "bool", True)


def json_extract(value: Any, path: str) -> Expr:
    """->> : text."""
    e = _doc(value, "json_extract")
    return made([e], _text(e.column, _path(path)), "text", True)


def json_extract_text(value: Any, path: str) -> Expr:
    """-> : JSON, as in the dialect's own operator of this name."""
    e = _doc(value, "json_extract_text")
    return made([e], _json(e.column, _path(path)), "json", True)


def json_get(value: Any, key: str) -> Expr:
    e = _doc(value, "json_get")
    return made([e], _json(e.column, f"$.{key}"), e.type, True)


def _index(c: Column, i: int) -> Column:
    """An element as JSON; negative numbers count from the end."""
    items = F.from_json(c, "array<variant>")
    return F.to_json(F.try_element_at(items, F.lit(i + 1 if i >= 0 else i)))


def json_get_idx(value: Any, i: int) -> Expr:
    e = _doc(value, "json_get_idx")
    return made([e], _index(e.column, i), e.type, True)


def json_get_text(value: Any, key: str) -> Expr:
    e = _doc(value, "json_get_text")
    return made([e], _text(e.column, f"$.{key}"), "text", True)


def json_get_text_idx(value: Any, i: int) -> Expr:
    e = _doc(value, "json_get_text_idx")
    got = _text(e.column, f"$[{i}]") if i >= 0 else F.get_json_object(F.concat(F.lit("["), _index(e.column, i), F.lit("]")), "$[0]")
    return made([e], got, "text", True)


def json_get_path(value: Any, path: str) -> Expr:
    e = _doc(value, "json_get_path")
    return made([e], _json(e.column, _path(path)), e.type, True)


def json_get_path_text(value: Any, path: str) -> Expr:
    e = _doc(value, "json_get_path_text")
    return made([e], _text(e.column, _path(path)), "text", True)


def contains(left: Any, right: Any, top: bool = True) -> bool:
    """Whether the JSON value left contains right: objects by keys, arrays as
    sets; at the top an array contains a plain value that is an element."""
    if isinstance(left, dict) and isinstance(right, dict):
        return all(k in left and contains(left[k], v, False) for k, v in right.items())
    if isinstance(left, list):
        if isinstance(right, list):
            return all(any(contains(x, y, False) for x in left) for y in right)
        return top and not isinstance(right, dict) and any(contains(x, right, False) for x in left)
    return type(left) is type(right) and left == right or isinstance(left, (int, float)) and isinstance(right, (int, float)) and not isinstance(left, bool) and not isinstance(right, bool) and left == right


def _containment():
    @F.pandas_udf("boolean")
    def f(l: pd.Series, r: pd.Series) -> pd.Series:  # noqa: E741
        return pd.Series([None if a is None or b is None else contains(stdlib_json.loads(a), stdlib_json.loads(b)) for a, b in zip(l, r)], dtype=object)

    return f


def jsonb_contains(left: Any, right: Any) -> Expr:
    """@> : no built-in compares JSON by containment, so Arrow batches go to Python."""
    a, b = _doc(left, "jsonb_contains"), _doc(right, "jsonb_contains")
    return made([a, b], _containment()(a.column, b.column), "bool")


def jsonb_contained(left: Any, right: Any) -> Expr:
    return jsonb_contains(right, left)


def jsonb_exists_key(value: Any, key: str) -> Expr:
    e = _doc(value, "jsonb_exists_key")
    return made([e], F.coalesce(F.array_contains(_keys(e.column), key), F.lit(False)), "bool", False)


def jsonb_exists_any(value: Any, keys: Sequence[str]) -> Expr:
    e = _doc(value, "jsonb_exists_any")
    return made([e], F.coalesce(F.arrays_overlap(_keys(e.column), F.array(*[F.lit(k) for k in keys])), F.lit(False)), "bool", False)


def jsonb_exists_all(value: Any, keys: Sequence[str]) -> Expr:
    e = _doc(value, "jsonb_exists_all")
    wanted = F.array(*[F.lit(k) for k in keys])
    return made([e], F.coalesce(F.size(F.array_except(wanted, _keys(e.column))) == 0, F.lit(False)), "bool", False)
