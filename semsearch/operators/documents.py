"""Texts of items for embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as T


def _section(label: str, value: Column, shown: Column) -> Column:
    return F.when(shown, F.concat(F.lit(label), value))


def metadata_lines(metadata: Column, separator: str) -> Column:
    """``name: value`` of every entry that is not blank, by name."""
    entries = F.array_sort(F.map_entries(F.map_filter(metadata, lambda k, v: ~T.is_blank(v))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), separator)


def build_documents(items: DataFrame, layout: str = "block", config: Config = DEFAULT, out: str = "content") -> DataFrame:
    """``items`` with their text.

    ``block`` always has a title line, metadata one a line, and the URL last, so that
    its sections can be extracted again.  ``inline`` has the configured fields
    that are not blank, metadata on one line, other fields as ``NAME: value``.
    """
    title, description, metadata = F.col("title"), F.col("description"), F.col("metadata")
    if layout == "block":
        lines = metadata_lines(metadata, "\n")
        parts = [
            F.concat(F.lit(f"{T.TITLE} "), F.coalesce(title, F.lit(""))),
            _section(f"{T.DESCRIPTION} ", T.strip_tags(description), ~T.is_blank(description)),
            _section(f"{T.METADATA}\n", lines, lines != ""),
            F.concat(F.lit(f"{T.URL} "), F.coalesce("url", F.lit(""))),
        ]
    elif layout == "inline":
        lines = metadata_lines(metadata, ", ")
        known = {
            "title": _section(f"{T.TITLE} ", title, ~T.is_blank(title)),
            "description": _section(f"{T.DESCRIPTION} ", T.strip_tags(description), ~T.is_blank(description)),
            "metadata": _section(f"{T.METADATA} ", lines, lines != ""),
        }
        custom = [f for f in config.index_fields if f not in known]
        parts = [c for f, c in known.items() if f in config.index_fields]
        parts += [_section(f"{f.upper()}: ", F.col(f).cast("string"), ~T.is_blank(F.col(f).cast("string"))) for f in custom]
    else:
        raise ValueError(f"unknown layout {layout!r}")
    return items.withColumn(out, F.concat_ws("\n\n", *parts))


def truncated(documents: DataFrame, config: Config = DEFAULT, column: str = "content") -> DataFrame:
    return documents.withColumn(column, T.truncate_text(F.col(column), config.chunk_size * config.chars_per_token))


def sections(documents: DataFrame, column: str = "content") -> DataFrame:
    """Title, description and metadata extracted again."""
    c = F.col(column)
    return documents.withColumns({"x_title": T.extract_title(c), "x_description": T.extract_description(c), "x_metadata": T.extract_metadata(c)})
