"""Value classes: boolean, number, date, string (and null / mixed for whole columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
SLASH_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})(?:[ T,]+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)? *([AaPp][Mm])?)?$"
ZONE = r"(Z|[+-]\d{2}:?\d{2})$"
DECIMAL_NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)$"
HEX_NUMBER = r"^0[xX][0-9a-fA-F]+$"


def at_utc(local: Column) -> Column:
    """The instant at which UTC clocks show what the session's clocks show at ``local``."""
    return F.from_utc_timestamp(local, F.current_timezone())


def parse_date(text: Column) -> Column:
    """Timestamp of an ISO date / date-time or of ``M/d/y`` with or without a time; null otherwise.

    Without a zone the time is UTC, whatever the session's zone.
    """
    iso = F.when(text.rlike(ISO_DATE), text.try_cast("timestamp"))
    iso = F.when(text.rlike(ZONE), iso).otherwise(at_utc(iso))

    def part(group: int) -> Column:
        return F.regexp_extract(text, SLASH_DATE, group)

    year = part(3).try_cast("int")
    full_year = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
    hour = F.coalesce(part(4).try_cast("int"), F.lit(0))
    half = F.lower(part(7))
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    day = F.concat_ws(
        "-", F.lpad(full_year.cast("string"), 4, "0"), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")
    )
    clock = F.concat_ws(
        ":", F.lpad(hour.cast("string"), 2, "0"), F.lpad(part(5), 2, "0"), F.lpad(part(6), 2, "0")
    )
    slash = F.when(text.rlike(SLASH_DATE), F.concat_ws(" ", day, clock).try_cast("timestamp"))
    return F.coalesce(iso, at_utc(slash))


def _hexadecimal(digits: Column) -> Column:
    """Value of a run of hexadecimal digits of any length."""
    each = F.regexp_extract_all(F.lower(digits), F.lit("([0-9a-f])"))
    return F.aggregate(each, F.lit(0.0), lambda total, d: total * 16 + F.instr(F.lit("0123456789abcdef"), d) - 1)


def parse_number(text: Column) -> Column:
    """Double of a numeric string; words such as ``NaN`` and suffixes such as ``1d`` are not numbers."""
    trimmed = F.btrim(text, F.lit(" \t\n\r"))
    return F.when(trimmed.rlike(DECIMAL_NUMBER), trimmed.try_cast("double")).when(
        trimmed.rlike(HEX_NUMBER), _hexadecimal(F.substr(trimmed, F.lit(3)))
    )


def text_kind(text: Column) -> Column:
    """Class of one text value. Dates win over numbers; empty text counts as null."""
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(parse_date(text).isNotNull(), "date")
        .when(parse_number(text).isNotNull(), "number")
        .otherwise("string")
    )


def native_kind(data_type: T.DataType) -> str | None:
    """Class that a Spark type implies, or None where each value has to be looked at."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(data_type, (T.StringType, T.NullType)):
        return None
    return "string"


def column_kind(kinds: Column) -> Column:
    """Class of a column from the set of classes of its values."""
    return (
        F.when(F.size(kinds) == 0, "null").when(F.size(kinds) == 1, F.element_at(kinds, 1)).otherwise("mixed")
    )
