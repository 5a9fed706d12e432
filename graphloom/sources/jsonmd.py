"""Nested JSON as Markdown. Keys keep their order, which no JSON type of Spark does, so this is a Python function of the text."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scalar(x) -> str:
    if x is None:
        return "*null*"
    if isinstance(x, bool):
        return str(x).lower()
    return x.replace("*", "-") if isinstance(x, str) else str(x)


def _nested(x) -> bool:
    return isinstance(x, dict | list)


def _listed(x: list, level: int, depth: int) -> list[str]:
    if not x:
        return ["*Empty list*\n\n"]
    if not any(map(_nested, x)):
        return [*(f"- {_scalar(v)}\n" for v in x), "\n"]
    out = []
    for i, v in enumerate(x, 1):
        if isinstance(v, dict) and len(x) > 1:
            out.append(f"{'#' * (level + 1)} Item {i}\n\n")
        out.append(_body(v, depth + 1))  # a scalar among nested values gives nothing
    return out


def _body(x, depth: int, out: list[str] | None = None) -> str:
    out = [] if out is None else out
    if isinstance(x, list) and x:
        out += _listed(x, depth, depth)
    elif isinstance(x, dict):
        plain = {k: v for k, v in x.items() if not _nested(v)}
        out += [f"**{k}**: {_scalar(v)}\n" for k, v in plain.items()] + ["\n"] * bool(plain)
        for k in (k for k in x if k not in plain):
            if depth == 1 and out and out[-1][-2:] != "\n\n":
                out.append("\n")
            out.append(f"{'#' * (depth + 1)} {k}\n")
            out += _listed(x[k], depth + 1, depth) if isinstance(x[k], list) else [_body(x[k], depth + 1)]
    return "".join(out)


def markdown(data, title: str | None = "JSON Data") -> str:
    """Scalars first, as bold keys with values; then each nested key under a heading. Nothing for an empty value."""
    return _body(data, 1, [f"# {title}\n\n"] if title else []) if data else ""


def of_json(text: Column) -> Column:
    """Markdown of a JSON column; null where it can't be read."""

    def f(t: str | None) -> str | None:
        try:
            return None if t is None else markdown(json.loads(t))
        except ValueError:
            return None

    return F.udf(f, "string", useArrow=True)(text)


def text_of(json_text: Column, least_keys: int = 2) -> Column:
    """The text of a JSON document: its field text, or if it has more than least_keys keys all of it as Markdown, else null."""
    own = F.get_json_object(json_text, "$.text")
    return F.when(own.isNotNull(), own).when(F.size(F.json_object_keys(json_text)) > least_keys, of_json(json_text))
