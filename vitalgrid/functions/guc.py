"""Typed readings of server setting texts, as Column expressions.

A value that does not parse, or does not fit, is NULL: one odd setting must not stop a fleet job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalgrid.functions.numbers import col

# Time and memory units of the server's settings.
MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
MEMORY = {"": 1, "b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3, "tb": 1024**4}

_UNITS = "us|ms|s|min|h|d"
_TOKEN = rf"(\d+)({_UNITS})?"
_WHOLE = rf"^[+-]?(?:\d{{1,18}}(?:{_UNITS})?[ \t]*)+$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lookup(key: Column, table: dict[str, int]) -> Column:
    out = None
    for unit, factor in table.items():
        hit = key == unit
        out = F.when(hit, F.lit(factor).cast("long")) if out is None else out.when(hit, F.lit(factor).cast("long"))
    return out


def duration_micros(text: Column | str, base: str) -> Column:
    """Sum of ``<number><unit>`` tokens in microseconds; NULL when it does not parse.

    ``base`` is the unit of a bare number, which the server defines per setting.
    """
    s = _strip(col(text))
    numbers = F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(1))
    units = F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(2))
    parts = F.zip_with(numbers, units, lambda n, u: F.try_multiply(n.try_cast("long"), F.coalesce(
        _lookup(u, MICROS), F.lit(MICROS[base]).cast("long"))))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: F.try_add(acc, x))
    return F.when(s.rlike(_WHOLE), F.when(s.startswith("-"), -total).otherwise(total))


def memory_bytes(text: Column | str) -> Column:
    s = _strip(col(text))
    n = F.regexp_extract(s, r"^([+-]?\d{1,18})\s*([A-Za-z]*)$", 1).try_cast("long")
    unit = F.lower(F.regexp_extract(s, r"^([+-]?\d{1,18})\s*([A-Za-z]*)$", 2))
    return F.try_multiply(n, _lookup(unit, MEMORY))


def switched_off(text: Column | str) -> Column:
    """A boolean storage option explicitly turned off."""
    return F.coalesce(F.lower(_strip(col(text))).isin("false", "off", "0", "no"), F.lit(False))


def required_standbys(text: Column | str) -> Column:
    """How many synchronous standbys a ``synchronous_standby_names`` value asks for."""
    s = _strip(F.coalesce(col(text), F.lit("")))
    words = F.split(s, r"\s+")
    keyword = F.upper(words[0]).isin("ANY", "FIRST")
    counted = F.when(keyword, F.get(words, F.lit(1))).otherwise(words[0])
    n = F.regexp_extract(F.coalesce(counted, F.lit("")), r"^(\d{1,9})", 1).try_cast("long")
    return F.when(s == "", F.lit(0)).otherwise(F.when(n > 0, n).otherwise(F.lit(1))).cast("long")


def number(text: Column | str) -> Column:
    return col(text).try_cast("double")
