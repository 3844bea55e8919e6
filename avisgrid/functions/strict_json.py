"""Strict JSON reading with built-in functions.

``from_json`` reads the first value of a text and ignores what follows.  Wrapping the
text into an array with an end marker makes trailing content visible: the text is one
valid JSON value only if the array has two elements and the second is the marker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

END = "\ue000end"  # a private-use character keeps it apart from real content

STRICT = {"allowSingleQuotes": "false"}


def wrapped(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit(f',"{END}"]'))


def strict_value(text: Column) -> Column:
    """The text itself when it is exactly one JSON value, else NULL."""
    parts = F.from_json(wrapped(text), "array<string>", STRICT)
    ok = (F.size(parts) == 2) & (F.element_at(parts, -1) == END)
    return F.when(ok, parts[0])


def strict_object(text: Column, fields: str) -> Column:
    """Read a JSON object with the given fields; NULL unless the text is one value.

    One parse: object and end marker share an array of structs.
    """
    schema = f"array<struct<{fields}, `{END}`: int>>"
    tail = F.lit(f',{{"{END}":1}}]')
    parts = F.from_json(F.concat(F.lit("["), text, tail), schema, STRICT)
    ok = (F.size(parts) == 2) & (parts[1][END] == 1)
    return F.when(ok, parts[0])
