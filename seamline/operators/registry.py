"""User-defined detectors: a condition on a segment, or a function from the segment table to occurrences.

A registered detector takes part in ``occurrences``, the distinct counts and the reports like the
built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline import schema
from seamline.operators.detectors import DIR_KEY, PLACE, TEXT_FIELDS, Found


@dataclass(frozen=True)
class Detector:
    found: Callable[[DataFrame], DataFrame] | Column
    key_columns: list[str]
    code: str
    label: str
    fields: dict[str, Column]


_DETECTORS: dict[str, Detector] = {}


def register_detector(name: str, found: Callable[[DataFrame], DataFrame] | Column, key_columns: list[str],
                      code: str, label: str, fields: dict[str, Column] | None = None) -> None:
    """Add a detector.

    ``found`` is a condition on the columns of a segment, with ``fields`` for the occurrence columns it
    sets; all such detectors share the one pass of the built-in ones. Or it is a function that gets the
    segments with their calls and declarations and returns the rows found, for detectors with windows
    or joins of their own. Where there is one of these, the segments are settled once and all detectors read
    them: hashed by module, version and path, so that windows by file need no exchange, and with the columns
    ``operators.segments.segments`` lists. Missing occurrence columns are filled in: the path, the line of the call, and empty text.
    ``key_columns`` are the occurrence columns that tell two occurrences apart.
    """
    if name in schema.VECTOR_NAMES:
        raise ValueError(f"{name} is a built-in vector")
    _DETECTORS[name] = Detector(found, list(key_columns), code, label, dict(fields or {}))


def unregister_detector(name: str) -> None:
    _DETECTORS.pop(name, None)


def names() -> list[str]:
    return list(_DETECTORS)


def key_columns() -> dict[str, list[str]]:
    return {name: d.key_columns for name, d in _DETECTORS.items()}


def vector_rows() -> list[tuple]:
    """Rows that extend the dimension of vectors, after the built-in ones."""
    first = len(schema.VECTORS) + 1
    return [(name, d.code, d.label, d.label, first + i, "custom")
            for i, (name, d) in enumerate(_DETECTORS.items())]


def conditions(wanted: list[str]) -> dict[str, Found]:
    """The wanted detectors that are conditions."""
    return {n: Found(d.found, d.fields) for n, d in _DETECTORS.items() if n in wanted and isinstance(d.found, Column)}


def run(name: str, rows: DataFrame) -> DataFrame:
    """Occurrences that the detector function finds in the segments."""
    found = _DETECTORS[name].found(rows)
    defaults = {
        "file_path": F.col("path"),
        "line_number": F.col("start_line"),
        **{c: F.lit("") for c in TEXT_FIELDS},
    }
    missing = [default.alias(c) for c, default in defaults.items() if c not in found.columns]
    return found.select("*", *missing, F.lit(name).alias("vector")).select(
        *DIR_KEY, *PLACE, "vector", "file_path", "line_number", *TEXT_FIELDS)
