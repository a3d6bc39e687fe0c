"""Regular-expression matches with offsets as Columns, so that whole tables stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(norm: Column, regex: str) -> Column:
    """array<struct<at int, value string>> of all matches; at: characters before. The regex never matches nothing."""
    found, between = F.regexp_extract_all(norm, F.lit(regex), F.lit(0)), F.split(norm, regex, -1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    return F.transform(found, lambda x, i: F.struct((total(F.slice(between, 1, i + 1)) + total(F.slice(found, 1, i))).alias("at"), x.alias("value")))


def at_boundary(norm: Column, m: Column) -> Column:
    before = F.substring(norm, m["at"], F.lit(1))
    after = F.substring(norm, m["at"] + F.length(m["value"]) + 1, F.lit(1))
    return ~F.when(m["at"] > 0, before.rlike("[0-9A-Za-z]")).otherwise(F.lit(False)) & ~after.rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")


def found_in(norm: Column, regex: str, gate: str, keep=None) -> Column:
    """array<struct<start long, end long, value string>> in UTF-8 bytes of bounded matches that keep(value) holds for."""
    good = F.filter(matches(norm, regex), lambda m: at_boundary(norm, m) & (keep(m["value"]) if keep else F.lit(True)))
    start = lambda m: F.octet_length(F.substring(norm, F.lit(1), m["at"])).cast("long")
    spans = F.transform(good, lambda m: F.struct(start(m).alias("start"), (start(m) + F.octet_length(m["value"])).alias("end"), m["value"].alias("value")))
    return F.when(norm.rlike(gate), spans).otherwise(F.array().cast("array<struct<start:long,end:long,value:string>>"))
