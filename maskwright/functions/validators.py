"""Checksums and formats, as Python predicates and as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the check digits.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12A = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12B = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
SNILS = (9, 8, 7, 6, 5, 4, 3, 2, 1)
DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
#: The year that passport series are judged by; a parameter, so that results don't change by themselves.
AS_OF_YEAR = 2025


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _weighted(d: str, weights: tuple[int, ...]) -> int:
    return sum(w * int(c) for w, c in zip(weights, d, strict=False))


def luhn(d: str) -> bool:
    d = digits(d)
    twice = [sum(divmod(2 * int(c), 10)) for c in d[-2::-2]]
    return 13 <= len(d) <= 19 and (sum(map(int, d[-1::-2])) + sum(twice)) % 10 == 0


def inn(d: str) -> bool | None:
    """None: neither 10 nor 12 digits."""
    d = digits(d)
    if len(d) == 10:
        return _weighted(d, INN10) % 11 % 10 == int(d[9])
    if len(d) == 12:
        return _weighted(d, INN12A) % 11 % 10 == int(d[10]) and _weighted(d, INN12B) % 11 % 10 == int(d[11])
    return None


def snils(d: str) -> bool | None:
    d = digits(d)
    return _weighted(d, SNILS) % 101 % 100 == int(d[9:]) if len(d) == 11 else None


def _is_day(year: int, month: int, day: int) -> bool:
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    return 1 <= month <= 12 and 1 <= day <= DAYS[month - 1] + (month == 2 and leap)


def parse_date(text: str) -> tuple[int, int, int] | None:
    """(year, month, day) of three numbers: year first if the first exceeds 31, else last; either order of the others."""
    n = [int(x) for x in re.findall("[0-9]+", text)]
    if len(n) != 3:
        return None
    year, rest = (n[0], (n[1], n[2])) if n[0] > 31 else (n[2] if n[2] > 100 else 2000 + n[2], (n[1], n[0]))
    if not 1900 <= year <= 2100:
        return None
    return next(((year, a, b) for a, b in (rest, rest[::-1]) if _is_day(year, a, b)), None)


def passport_series(d: str, as_of: int = AS_OF_YEAR) -> bool:
    d = digits(d)
    return len(d) == 4 and d[:2] != "00" and (int(d[2:]) >= 97 or int(d[2:]) <= (as_of % 100 + 1) % 100)


def parse_numerals(words: list[str], values: dict[str, int]) -> int | None:
    """The number that Russian numerals say; None if a word is none."""
    total = current = 0
    if not words or not all(w in values for w in words):
        return None
    for v in map(values.__getitem__, words):
        if v >= 1000:
            total, current = total + (current or 1) * v, 0
        elif v >= 100:
            current = (current or 1) * v
        else:
            current += v
    return total + current


def digits_col(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _sum_col(d: Column, weights: tuple[int, ...]) -> Column:
    out = F.lit(0)
    for i, w in enumerate(weights):
        out = out + F.substring(d, i + 1, 1).cast("int") * w
    return out


def luhn_col(c: Column) -> Column:
    d = digits_col(c)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def inn_col(c: Column) -> Column:
    d = digits_col(c)
    at = lambda i: F.substring(d, i, 1).cast("int")
    ten = (_sum_col(d, INN10) % 11) % 10 == at(10)
    twelve = ((_sum_col(d, INN12A) % 11) % 10 == at(11)) & ((_sum_col(d, INN12B) % 11) % 10 == at(12))
    return F.when(F.length(d) == 10, ten).when(F.length(d) == 12, twelve)


def snils_col(c: Column) -> Column:
    d = digits_col(c)
    return F.when(F.length(d) == 11, (_sum_col(d, SNILS) % 101) % 100 == F.substring(d, 10, 2).cast("int"))


def date_col(c: Column) -> Column:
    """Whether parse_date() finds a date; arithmetic only, so that nothing raises under ANSI."""
    n = F.filter(F.split(c, "[^0-9]+"), lambda x: x != "")
    a, b, d = (F.get(n, i).try_cast("int") for i in range(3))
    first = a > 31
    year = F.when(first, a).otherwise(F.when(d > 100, d).otherwise(2000 + d))
    x, y = b, F.when(first, d).otherwise(a)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)

    def is_day(month: Column, day: Column) -> Column:
        most = F.when((month == 2) & leap, 29).otherwise(F.get(F.array(*map(F.lit, DAYS)), month - 1))
        return month.between(1, 12) & (day >= 1) & (day <= most)

    return F.coalesce((F.size(n) == 3) & year.between(1900, 2100) & (is_day(x, y) | is_day(y, x)), F.lit(False))


def passport_series_col(c: Column, as_of: int = AS_OF_YEAR) -> Column:
    d = digits_col(c)
    s2 = F.substring(d, 3, 2).cast("int")
    return F.when(F.length(d) == 4, (F.substring(d, 1, 2) != "00") & ((s2 >= 97) | (s2 <= (as_of % 100 + 1) % 100))).otherwise(F.lit(False))


VALIDATORS = {"luhn": luhn, "inn": lambda d: bool(inn(d)), "snils": lambda d: bool(snils(d)), "date": lambda d: parse_date(d) is not None, "passport_series": passport_series}
COLUMNS = {"luhn": luhn_col, "inn": inn_col, "snils": snils_col, "date": date_col, "passport_series": passport_series_col}
