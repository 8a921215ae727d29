"""Column functions of spreadsheets: references, numerals and number formats. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _letter(n: Column) -> Column:
    return F.char(n.cast("int") + 65)


def column_letters(n: Column) -> Column:
    """A column's letters by its number from 1: A, Z, AA, ... XFD."""
    k = n - 1
    two, three = k - 26, k - 26 - 676
    return (
        F.when(n < 1, None).when(k < 26, _letter(k)).when(two < 676, F.concat(_letter(F.floor(two / 26)), _letter(two % 26)))
        .otherwise(F.concat(_letter(F.floor(three / 676)), _letter(F.floor(three / 26) % 26), _letter(three % 26)))
    )


def column_number(letters: Column) -> Column:
    """A column's number by its letters, in any case."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("bigint"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def reference(row: Column, column: Column) -> Column:
    return F.concat(column_letters(column), row.cast("string"))


def row_of(ref: Column) -> Column:
    return F.regexp_extract(ref, r"\$?([0-9]+)$", 1).try_cast("bigint")


def column_of(ref: Column) -> Column:
    return column_number(F.regexp_extract(ref, r"^\$?([A-Za-z]+)", 1))


_ROMAN = [["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "M", "MM", "MMM"]]


def roman(n: Column) -> Column:
    """A Roman numeral from 1 to 3999; null beyond."""
    digit = lambda k: F.element_at(F.array(*[F.lit(x) for x in _ROMAN[k]]), (F.floor(n / 10**k) % 10 + 1).cast("int"))
    return F.when((n >= 1) & (n <= 3999), F.concat(digit(3), digit(2), digit(1), digit(0)))


def grouped(units: Column) -> Column:
    """An integer with commas between thousands."""
    return F.reverse(F.regexp_replace(F.reverse(F.abs(units).cast("string")), r"([0-9]{3})(?=[0-9])", "$1,"))


def fixed(value: Column, places: int, commas: bool = False) -> Column:
    """A number with so many decimals, halves away from zero as spreadsheets show them. What doesn't fit
    64 bits so, and has no decimals to speak of, comes by its digits, without commas."""
    units = F.round(F.abs(value) * 10**places).try_cast("bigint")
    whole = F.floor(units / 10**places).cast("bigint")
    text = grouped(whole) if commas else whole.cast("string")
    if places:
        text = F.concat(text, F.lit("."), F.lpad((units % 10**places).cast("string"), places, "0"))
    shown = F.when((value < 0) & (units > 0), F.concat(F.lit("-"), text)).otherwise(text)
    return F.coalesce(shown, value.try_cast("decimal(38,0)").cast("string"), value.cast("string"))


def currency(value: Column, sign: str = "$") -> Column:
    """$#,##0.00 with negatives in parentheses."""
    text = F.concat(F.lit(sign), fixed(F.abs(value), 2, True))
    return F.when(value < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def serial_date(serial: Column) -> Column:
    """yyyy-mm-dd of a day number counted from 1899-12-30."""
    return F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")), "yyyy-MM-dd")


def clock(serial: Column) -> Column:
    """hh:mm:ss of the day's fraction."""
    s = F.round((serial - F.floor(serial)) * 86400).cast("bigint") % 86400
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", part(F.floor(s / 3600)), part(F.floor(s / 60) % 60), part(s % 60))


def duration(serial: Column) -> Column:
    """[h]:mm:ss, signed, hours without end."""
    s = F.round(F.abs(serial) * 86400).cast("bigint")
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.when(serial < 0, "-").otherwise(""), F.floor(s / 3600).cast("string"), F.lit(":"), part(F.floor(s / 60) % 60), F.lit(":"), part(s % 60))
