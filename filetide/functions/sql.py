"""The path, name, format, rights and link expressions as temporary SQL functions.

Expressions with bound variables (families, excerpts, entities) have no SQL text and
stay with the DataFrame API.

``register(spark)`` creates one SQL function for each entry of ``FUNCTIONS``, from
the same expression the DataFrame API uses: no second definition, and no Python
when a query runs, since Catalyst puts the body in place of the call.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import formats, linktext, naming, paths, rights


@dataclass(frozen=True)
class SqlFunction:
    """Parameters as ``(name, type)``, and the expression over columns of those names."""

    parameters: Sequence[tuple[str, str]]
    body: Callable[..., Column]


_TEXT, _BITS = "string", "int"
FUNCTIONS: dict[str, SqlFunction] = {
    # paths
    "canonical_path": SqlFunction([("path", _TEXT)], paths.canonical_path),
    "path_key": SqlFunction([("path", _TEXT)], paths.path_key),
    "parent_key": SqlFunction([("key", _TEXT)], paths.parent_key),
    "path_leaf": SqlFunction([("key", _TEXT)], paths.leaf),
    "path_extension": SqlFunction([("name", _TEXT)], paths.extension),
    "path_components": SqlFunction([("key", _TEXT)], paths.components),
    "volume_root": SqlFunction([("path", _TEXT)], paths.volume_root),
    "is_network_path": SqlFunction([("path", _TEXT)], paths.is_network_path),
    "is_below": SqlFunction([("key", _TEXT), ("root", _TEXT)], paths.is_below),
    # names
    "has_copy_word": SqlFunction([("name", _TEXT)], naming.has_copy_word),
    "has_graveyard_word": SqlFunction([("name", _TEXT)], naming.has_graveyard_word),
    "is_long_path": SqlFunction([("path", _TEXT)], naming.is_long_path),
    "archive_base": SqlFunction([("name", _TEXT)], naming.archive_base),
    # formats
    "format_bytes": SqlFunction([("size", "bigint")], formats.format_bytes),
    "format_duration": SqlFunction([("seconds", "double")], formats.format_duration),
    "format_count": SqlFunction([("count", "bigint")], formats.format_count),
    # rights
    "without_synchronize": SqlFunction([("rights", _BITS)], rights.without_synchronize),
    "rights_level": SqlFunction([("rights", _BITS)], rights.level),
    "rights_friendly": SqlFunction([("rights", _BITS)], rights.friendly),
    "rights_applies_to": SqlFunction([("inherit", _BITS), ("propagate", _BITS)], rights.applies_to),
    "rights_delta": SqlFunction([("before", _BITS), ("after", _BITS)], rights.delta),
    # links
    "is_external_link": SqlFunction([("kind", _TEXT), ("target", _TEXT)], linktext.is_external),
}


def text_of(spark: SparkSession, function: SqlFunction) -> tuple[str, str]:
    """The expression as SQL text, and its type."""
    names = [n for n, _ in function.parameters]
    typed = spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in function.parameters])
    framed = typed.select(function.body(*[F.col(n) for n in names]).alias("result"))
    # The analysed expression prints as SQL that parses to the same; only its qualifiers have to go.
    analysed = framed._jdf.queryExecution().analyzed().expressions().head().child()
    return analysed.sql(), framed.schema["result"].dataType.simpleString()


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions in the session, each name after ``prefix``; returns the names."""
    for name, function in FUNCTIONS.items():
        body, kind = text_of(spark, function)
        takes = ", ".join(f"{n} {k}" for n, k in function.parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({takes}) RETURNS {kind} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
