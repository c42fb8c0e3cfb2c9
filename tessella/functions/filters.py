"""Typed metadata filters: parsed once, then compiled to a column predicate."""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import text_value

CORE = ("id", "source", "title", "content")


def _scalar(text: str) -> Any:
    low = text.lower()
    if low in ("true", "false"):
        return low == "true"
    if re.fullmatch(r"-?(?:0|[1-9]\d*)", text):
        return int(text)
    if re.fullmatch(r"-?(?:0|[1-9]\d*)\.\d+", text):
        return float(text)
    return text


def validate(conditions: Any) -> dict:
    """`conditions` if it is a filter: named scalars, and `$or` with a list of filters."""
    if not isinstance(conditions, dict):
        raise ValueError(f"Invalid filter: {conditions!r} (expected an object)")
    for key, value in conditions.items():
        if not isinstance(key, str) or not key:
            raise ValueError(f"Invalid filter key: {key!r}")
        if key == "$or":
            if not isinstance(value, list):
                raise ValueError("Invalid filter: $or takes a list of objects")
            for option in value:
                validate(option)
        elif value is None or isinstance(value, (dict, list)):
            raise ValueError(f"Invalid filter value of {key!r}: {value!r}")
    return conditions


def parse_filters(raw: list[str] | None) -> dict:
    """A filter of `key=value` texts (the last of a repeated key holds), or of one JSON object."""
    raw = [r for r in raw or [] if r.strip()]
    if len(raw) == 1 and raw[0].lstrip().startswith("{"):
        try:
            return validate(json.loads(raw[0]))
        except json.JSONDecodeError as e:
            raise ValueError(f"Invalid filter JSON: {e}") from e
    out = {}
    for r in raw:
        key, eq, value = r.partition("=")
        if not eq or not key.strip():
            raise ValueError(f"Invalid filter: {r!r} (expected key=value or JSON object)")
        out[key.strip()] = _scalar(value.strip())
    return validate(out)


def _equal(field: Column, value: Any) -> Column:
    """Equality of numbers and truth values as numbers, or of case-folded texts; a missing field never matches."""
    same = field["cf"] == str(value).casefold()
    if isinstance(value, (bool, int, float)):
        same = same | (F.coalesce(field["kind"], F.lit("")) != "str") & (field["d"] == float(value))
    return F.coalesce(same, F.lit(False))


def compile_filter(conditions: dict | None, metadata: Column, core: bool = False) -> Column:
    """Predicate over a metadata map; with `core` the names id, source, title and content mean the columns."""
    def field(key: str) -> Column:
        return text_value(F.col(key)) if core and key in CORE else F.try_element_at(metadata, F.lit(key))

    def one(c: dict) -> Column:
        terms = [reduce(lambda a, b: a | b, (one(o) for o in v), F.lit(False)) if k == "$or" else _equal(field(k), v) for k, v in c.items()]
        return reduce(lambda a, b: a & b, terms, F.lit(True))

    return one(validate(conditions or {}))


def date_range(metadata: Column, after: str | None = None, before: str | None = None) -> Column:
    """after <= date < before on the first ten characters of the metadata's date; without a date, false."""
    if not after and not before:
        return F.lit(True)
    d = F.substring(F.try_element_at(metadata, F.lit("date"))["s"], 1, 10)
    keep = F.length(d) >= 10
    if after:
        keep = keep & (d >= after)
    if before:
        keep = keep & (d < before)
    return F.coalesce(keep, F.lit(False))
