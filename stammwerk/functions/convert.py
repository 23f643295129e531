"""Conversions of delivered text: the only place where cell values are interpreted. All are Column expressions.

Null stays null; blank text is null unless told otherwise; text that cannot be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dates that mean "none" and "unlimited", and the accepted layouts in order.
ZERO_DATES = ["00000000", "0000-00-00", "00.00.0000", "00/00/0000"]
HIGH_DATES = ["99991231", "9999-12-31", "31.12.9999"]
DATE_LAYOUTS = ["yyyyMMdd", "yyyy-MM-dd", "d.M.yyyy", "yyyy/M/d", "d/M/yyyy"]


def conv_text(c: Column, trim: bool = True, blank_to_null: bool = True) -> Column:
    value = F.trim(c) if trim else c
    return F.when(F.trim(c) != "", value) if blank_to_null else value


def conv_alpha(c: Column, length: int) -> Column:
    """Digits only and not too long: filled with zeros on the left; anything else unchanged, never cut."""
    value = conv_text(c)
    return F.when(value.rlike(r"^[0-9]+\z") & (F.length(value) <= length), F.lpad(value, length, "0")).otherwise(value)


def conv_date(c: Column, keep_unlimited: bool = True, zero_to_null: bool = True) -> Column:
    value = conv_text(c)
    read = F.coalesce(*(F.try_to_date(value, layout) for layout in DATE_LAYOUTS))
    shaped = value.rlike(r"^(?:[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\z")
    zero = F.lit(None).cast("date") if zero_to_null else F.lit("1900-01-01").cast("date")
    high = F.lit("9999-12-31").cast("date") if keep_unlimited else F.lit(None).cast("date")
    return F.when(value.isin(ZERO_DATES), zero).when(value.isin(HIGH_DATES), high).when(shaped, read)


def conv_time(c: Column) -> Column:
    """HHMMSS or HH:MM:SS as HH:mm:ss text; 24:00:00 and other impossible times are null."""
    digits = F.regexp_replace(conv_text(c), ":", "")
    good = conv_text(c).rlike(r"^(?:[01][0-9]|2[0-3]):?[0-5][0-9]:?[0-5][0-9]\z")
    return F.when(good, F.concat_ws(":", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 2)))


def conv_amount(c: Column, comma: bool) -> Column:
    """Sign before or after, blanks dropped; comma: points group and the comma is the decimal mark, else the other way round."""
    text = F.regexp_replace(c, r"\s", "")
    negative = F.startswith(text, F.lit("-")) | F.endswith(text, F.lit("-"))
    body = F.regexp_replace(F.regexp_replace(text, r"[+-]\z", ""), r"^[+-]", "")
    plain = F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if comma else F.replace(body, F.lit(","), F.lit(""))
    number = F.when(plain.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), plain.try_cast("double"))
    return F.when(negative, -number).otherwise(number)


def comma_votes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: per column whether the comma is its decimal mark, voted by all values in which the last mark decides."""

    def vote(name: str) -> Column:
        text = F.regexp_replace(F.col(f"`{name}`"), r"\s", "")
        for_comma = F.count_if(text.rlike(r"^[+-]?[0-9.]*,[0-9]*[+-]?\z"))
        for_point = F.count_if(text.rlike(r"^[+-]?[0-9]*(?:,[0-9]*)+\.[0-9]*[+-]?\z"))
        return (for_comma > for_point).alias(name)

    return df.agg(*(vote(c) for c in columns))


def convert(c: Column, kind: str, alpha: int | None = None, comma: bool = False) -> Column:
    """By field type: alpha before date, time, number, text."""
    if alpha:
        return conv_alpha(c, alpha)
    if kind == "dats":
        return conv_date(c)
    if kind == "tims":
        return conv_time(c)
    if kind in ("curr", "quan", "dec", "int"):
        return conv_amount(c, comma)
    return conv_text(c)


def typed_to_text(df: DataFrame) -> DataFrame:
    """Typed columns as canonical text: dates yyyyMMdd, times HHmmss, whole numbers without a point, true as X, false empty."""

    def as_text(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == "date":
            return F.date_format(c, "yyyyMMdd")
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyyMMdd")
        if kind == "boolean":
            return F.when(c, "X").when(~c, "")
        if kind in ("double", "float"):
            return F.when((c % 1 == 0) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).when((F.abs(c) >= 1e-3) & (F.abs(c) < 1e7), c.cast("string")).otherwise(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"0+\z", ""))
        if kind.startswith("decimal"):
            return F.when(c % 1 == 0, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
        return c.cast("string")

    return df.select(*(as_text(n, k).alias(n) for n, k in df.dtypes))
