"""Column functions over text and values, all built from Spark's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "<redacted>"


def basename(path: Column) -> Column:
    """The last segment of a path without its last extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]+$", "")


def sanitise(text: Column) -> Column:
    """The text without white space and control characters at either end (a byte order mark included)."""
    return F.regexp_replace(text, r"^[\s\p{C}]+|[\s\p{C}]+$", "")


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def table_cell(text: Column) -> Column:
    """Text that keeps to its cell of a Markdown table."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def attribute(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit("&quot;"))


def title(*parts: Column, default: str = "") -> Column:
    """The first parts that are there, in one line."""
    joined = F.concat_ws(" ", *parts)
    return F.when(joined == "", F.lit(default)).otherwise(joined)


def first_rule(value: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The result of the first (substring, result) whose substring the lower-cased value holds."""
    out = F.lit(default)
    for part, result in reversed(rules):
        out = F.when(F.contains(F.lower(value), F.lit(part)), result).otherwise(out)
    return out


def array_text(values: Column, most: int = 8) -> Column:
    """Arrays of a few items in full, longer ones by their count."""
    return F.when(F.size(values) > most, F.concat(F.lit("["), F.size(values).cast("string"), F.lit(" items]"))).otherwise(F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: x.cast("string")), ", "), F.lit("]")))


def epoch_or_iso(text: Column) -> Column:
    """A time from epoch milliseconds or an ISO 8601 date and time with its zone; null if it is neither or lies outside the years 1 to 9999."""
    number = text.try_cast("long")
    millis = F.when(number.between(-62_135_596_800_000, 253_402_300_799_999), number)
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)$"), text.try_cast("timestamp"))
    return F.coalesce(F.timestamp_millis(millis), iso)


def graphemes(text: Column) -> Column:
    """The length of a text in the characters that a reader sees: marks and joined signs count with what they stand on."""
    return F.regexp_count(text, F.lit("\\X"))


def matches(query: str, *fields: Column) -> Column:
    """Whether one of the fields holds the query, whatever the case; an empty query is held by all."""
    if not query:
        return F.lit(True)
    found = F.lit(False)
    for f in fields:
        found = found | F.coalesce(F.contains(F.lower(f), F.lit(query.lower())), F.lit(False))
    return found


def hex_id(number: Column) -> Column:
    """A number as an object id's 24 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(number.cast("long"))), 24, "0")
