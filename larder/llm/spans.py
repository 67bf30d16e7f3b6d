"""Places of pattern matches in texts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.llm.quality_rules import let

#: Values whose running sum is made in one piece; longer arrays are summed piece by piece.
_PIECE = 256


def running(values: Column) -> Column:
    """Running sums of an array of numbers, in time that grows little faster than its length."""

    def sums(part: Column, start: Column) -> Column:
        first = F.struct(start.cast("long").alias("sum"), F.array().cast("array<long>").alias("all"))
        add = lambda x, v: F.struct((x["sum"] + v).alias("sum"), F.array_append(x["all"], x["sum"] + v).alias("all"))
        return F.aggregate(part, first, add, lambda x: x["all"])

    def pieces(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _PIECE).cast("int")), lambda i: F.slice(v, i * _PIECE + 1, F.lit(_PIECE)))
        total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + b)
        together = lambda p: let(sums(F.transform(p, total), F.lit(0)), lambda t: F.flatten(F.transform(p, lambda part, i: sums(part, F.when(i == 0, 0).otherwise(F.get(t, i - 1))))))
        return let(parts, together)

    return F.when(F.size(values) == 0, F.array().cast("array<long>")).otherwise(let(values.cast("array<long>"), pieces))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, start, end, found, before) for each match, left to right; code points, end exclusive.

    ``before``: the text between the match and the one before it.
    """
    empty = F.array().cast("array<struct<kind:string,start:long,end:long,found:string,before:string>>")

    def placed(found: Column, between: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.when(i == 0, 0).otherwise(F.length(F.get(found, i - 1))))
        entry = lambda s: F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), F.get(s, i).alias("start"), (F.get(s, i) + F.length(m)).alias("end"), m.alias("found"), F.get(between, i).alias("before")))
        return let(running(steps), entry)

    some = lambda found: F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, pattern, -1), lambda between: placed(found, between)))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)
