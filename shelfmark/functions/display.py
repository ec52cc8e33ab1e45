"""Values as a listing shows them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark.functions.text import strip_space

# Month names, independent of any locale.
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def _scaled(size: Column, unit: int, digits: int) -> Column:
    """``size / unit`` with fixed digits, exact ties to even, in whole-number arithmetic."""
    scale = 10**digits
    whole = F.floor(size * scale / F.lit(unit)).cast("bigint")
    rest = size * scale - whole * unit
    up = F.when(rest * 2 > unit, 1).when(rest * 2 == unit, F.pmod(whole, F.lit(2))).otherwise(0)
    value = whole + up
    return F.concat(
        F.floor(value / scale).cast("string"),
        F.lit("."),
        F.lpad(F.pmod(value, F.lit(scale)).cast("string"), digits, "0"),
    )


def format_size(size: Column) -> Column:
    big = size.cast("bigint")
    return (
        F.when(big >= 1024 * 1024, F.concat(_scaled(big, 1024 * 1024, 2), F.lit(" MB")))
        .when(big >= 1024, F.concat(_scaled(big, 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(big.cast("string"), F.lit(" B")))
    )


def format_published_date(value: Column) -> Column:
    """A year, ``Month year`` or ``day Month year``; anything else as it is, blank as empty."""
    raw = strip_space(value)
    day = F.when(raw.contains("T"), F.split_part(raw, F.lit("T"), F.lit(1))).otherwise(
        F.split_part(raw, F.lit(" "), F.lit(1))
    )
    year = F.substring(day, 1, 4)
    month = F.substring(day, 6, 2).try_cast("int")
    months = F.array(*[F.lit(name) for name in MONTHS])
    named = F.concat(F.try_element_at(months, F.greatest(month, F.lit(1))), F.lit(" "), year)
    real_year = year != "0000"
    return (
        F.when(value.isNull() | (raw == ""), F.lit(""))
        .when(raw.rlike(r"\A\d{4}\z"), raw)
        .when(day.rlike(r"\A\d{4}-\d{2}\z") & month.between(1, 12) & real_year, named)
        .when(
            day.rlike(r"\A\d{4}-\d{2}-\d{2}\z")
            & real_year
            & F.try_to_date(F.when(day.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), day), "yyyy-MM-dd").isNotNull(),
            F.concat(F.substring(day, 9, 2).try_cast("int").cast("string"), F.lit(" "), named),
        )
        .otherwise(raw)
    )


def short_number(c: Column) -> Column:
    """A number in the general format with six significant digits, without trailing zeros."""
    shown = F.format_string("%.5e", c)
    exponent = F.regexp_extract(shown, r"e(.*)\z", 1).try_cast("int")
    sign = F.when(shown.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_extract(shown, r"\A-?([^e]*)e", 1), r"\.", "")
    whole = F.when(exponent >= 0, F.substring(digits, F.lit(1), exponent + 1)).otherwise("0")
    zeros = F.repeat(F.lit("0"), F.greatest(-exponent - 1, F.lit(0)))
    rest = F.when(exponent >= 0, F.substring(digits, exponent + 2, F.lit(6))).otherwise(F.concat(zeros, digits))
    plain = F.regexp_replace(F.concat(whole, F.lit("."), rest), r"\.?0*\z", "")
    mantissa = F.regexp_replace(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5)), r"\.?0*\z", "")
    power = F.regexp_extract(shown, r"(e.*)\z", 1)
    fixed = exponent.between(-4, 5)
    return F.when(c.isNotNull() & exponent.isNotNull(), F.concat(sign, F.when(fixed, plain).otherwise(F.concat(mantissa, power))))


def display_card(book: dict[str, Column]) -> Column:
    """What a book card shows, as a struct."""
    some = lambda c: F.nullif(c, F.lit(""))
    series = F.concat(
        some(book["series"]),
        F.coalesce(F.concat(F.lit(" #"), short_number(book["series_index"])), F.lit("")),
    )
    return F.struct(
        F.coalesce(some(book["title"]), book["file_name"]).alias("card_title"),
        F.coalesce(some(book["authors"]), F.lit("Unknown author")).alias("card_author"),
        F.coalesce(series, F.lit("")).alias("card_series"),
        F.upper(book["format"]).alias("card_format"),
        format_size(book["file_size"]).alias("card_size"),
    )
