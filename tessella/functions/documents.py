"""Nested document trees (ADF) as text.  The tree is recursive, which no column type is, hence an Arrow function."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def adf_text(tree: str | None) -> str:
    """Plain text of a JSON document tree; null, malformed and non-object input gives an empty text."""
    try:
        root = json.loads(tree) if tree else None
    except ValueError:
        root = None
    if not isinstance(root, dict):
        return ""
    out: list[str] = []
    # A stack of nodes to visit and strings to emit, so that depth is no limit.
    todo: list = [root.get("content", [])]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif isinstance(node, list):
            todo += reversed([x for x in node if isinstance(x, (dict, list))])
        else:
            kind, inner = node.get("type", ""), node.get("content", [])
            if kind == "text":
                out.append(str(node.get("text", "")))
            elif kind == "hardBreak":
                out.append("\n")
            elif kind in ("heading", "paragraph"):
                todo += ["\n", inner]
            elif kind == "bulletList":
                for item in reversed(inner if isinstance(inner, list) else []):
                    todo += [item.get("content", []) if isinstance(item, dict) else [], "- "]
            elif kind == "codeBlock":
                todo += ["\n```\n", inner, "```\n"]
            elif isinstance(inner, (list, dict)):
                todo.append(inner)
    return "".join(out).strip()


@F.pandas_udf(StringType())
def adf_to_text(trees: pd.Series) -> pd.Series:
    return trees.map(adf_text)
