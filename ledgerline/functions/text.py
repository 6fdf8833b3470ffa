"""Column expressions for printed identifiers, amounts and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flat(c: Column) -> Column:
    """Upper case, letters A-Z and digits only; null is ''. '' stands for no identifier and equals nothing."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^0-9A-Z]", "")


def same_id(a: Column, b: Column) -> Column:
    return (flat(a) != "") & (flat(a) == flat(b))


def _number(kept: Column) -> Column:
    marks, digits = F.translate(kept, "0123456789", ""), F.translate(kept, ".,", "")
    both = F.contains(marks, F.lit(".")) & F.contains(marks, F.lit(","))
    tail = F.length(F.substring_index(F.translate(kept, ",", "."), ".", -1))
    thousands = ~both & ((F.length(marks) > 1) | (tail == 3))
    decimals = F.when((F.length(marks) == 0) | thousands, 0).otherwise(tail)
    return F.when(digits == "", None).otherwise(F.try_divide(digits.try_cast("double"), F.pow(F.lit(10.0), decimals)))


def amount(text: Column) -> Column:
    """The number in a printed amount. With both marks the last is the decimal mark; a single kind of mark
    separates thousands if it occurs more than once or has exactly three digits behind it. The text is cleaned once, not for each use."""
    kept = F.btrim(F.regexp_replace(text, "[^0-9.,]", ""), F.lit(".,"))
    return F.get(F.transform(F.array(kept), _number), F.lit(0))


def to_hundredth(number: Column) -> Column:
    """A number of at least 0 as text with two decimals, halves up. What a decimal can't hold is formatted by pattern, which is slower and says the same."""
    return F.when(number < 1e15, number.cast("decimal(18,2)").cast("string")).otherwise(F.format_string("%.2f", number))


def hundredth(number: Column) -> Column:
    """A number of at least 0 to the hundredth, as SQL rounds floats: the nearest whole number of hundredths of the number times 100, halves up. 76942.885 times 100 lies under the half, so it is 76942.88."""
    times = number * 100
    whole = F.floor(times)
    cents = F.when(times - whole >= 0.5, whole + 1).otherwise(whole)
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(18,2)")


def ean_check_digit(twelve: Column) -> Column:
    """The 13th digit of an EAN-13 whose first twelve are given as text."""
    at = lambda i: F.substring(twelve, i, 1).cast("int")
    total = sum(((at(i) * (3 if i % 2 == 0 else 1)) for i in range(2, 13)), at(1))
    return (10 - total % 10) % 10


def dots(number: Column) -> Column:
    """1234567.8 as 1.234.567,80: dots for thousands and a decimal comma."""
    return F.translate(F.format_number(number, 2), ",.", ".,")


#: Month names as printed.
MONTHS = ["Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember"]


def long_date(day: Column) -> Column:
    """17 Agustus 1995."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), month, F.year(day).cast("string"))


def day_of(text: Column) -> Column:
    """The day in a printed date of a four-figure year, year or day first, with / . or - between; others: null."""
    year_first, day_first = r"^\s*([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})\s*$", r"^\s*([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})\s*$"
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    iso = F.when(F.rlike(text, F.lit(year_first)), F.concat_ws("-", *(part(year_first, i) for i in (1, 2, 3))))
    return iso.when(F.rlike(text, F.lit(day_first)), F.concat_ws("-", *(part(day_first, i) for i in (3, 2, 1)))).try_cast("date")
