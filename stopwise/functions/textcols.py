"""Column functions on texts and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns and separators of the feeds
STOP_ID_PATTERN = r"^(-?[0-9]+)-([0-9]+)-([0-9]+)$"
CODE_PATTERN = r".*\(([A-Z\s]+)\)"
ATTRIBUTE_PATTERN = r'([a-z-]+)="([^"]*)"'


def parse_path(text: Column) -> Column:
    """Station names parted by a pipe to an array; null or empty gives null."""
    return F.split(F.nullif(text, F.lit("")), r"\|")


def split_stop_id(stop_id: Column) -> dict[str, Column]:
    """Three parts of an id, read from the right so the first may be negative."""
    part = lambda i: F.nullif(F.regexp_extract(stop_id, STOP_ID_PATTERN, i), F.lit(""))
    return {"dayly_id": part(1).cast("bigint"), "date_text": part(2), "stop_id": part(3).cast("int")}


def extract_code(name: Column) -> Column:
    """The code in brackets at the end of a name; null where there is none."""
    return F.nullif(F.regexp_extract(name, CODE_PATTERN, 1), F.lit(""))


def normalize_name(name: Column) -> Column:
    """Lower case without blanks, brackets, ``gl.`` and the marks . - _ /"""
    lowered = F.lower(name)
    return F.regexp_replace(F.regexp_replace(lowered, r"[ ()]|gl\.", ""), r"[.\-_/]", "")


def decimal_comma(text: Column) -> Column:
    """Number with a decimal comma; bad text gives null."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def split_edge_name(name: Column) -> dict[str, Column]:
    """``'A - B'`` to both ends; a text without the separator has no target."""
    parts = F.split(name, " - ")
    return {"source": F.get(parts, F.lit(0)), "target": F.get(parts, F.lit(1))}


def array_text_items(text: Column) -> Column:
    """Items of ``{a,"b,c"}``; quoted items may hold commas and lose their quotes."""
    items = F.regexp_extract_all(text, F.lit(r'("[^"]*"|[^,{}"]+)'), F.lit(1))
    return F.transform(items, lambda x: F.regexp_replace(x, '"', ""))


def int_items(text: Column) -> Column:
    """Numbers parted by a pipe to an array."""
    return F.transform(parse_path(text), lambda x: x.cast("bigint"))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    starts = F.sequence(F.lit(1), F.length(text) - 1)
    pairs = F.transform(starts, lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) >= 2, F.array_distinct(pairs)).otherwise(F.array(text))


def html_attribute(html: Column, name: str, pattern: str = ATTRIBUTE_PATTERN) -> Column:
    """Value of the last attribute called ``name``; null when there is none."""
    names = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    pairs = F.filter(F.arrays_zip(names.alias("name"), values.alias("value")), lambda p: p["name"] == name)
    return F.try_element_at(pairs, F.lit(-1))["value"]
