"""Joins, de-duplication and set operations with explicit, null-safe keys and total orders.

Join sides carry no broadcast hints: table statistics and adaptive execution pick broadcast joins where a
side is measured to be small, and split skewed partitions where it is not.  Groups that were counted before
are the exception (:func:`brought`): their statistics are those of the rows they were made from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows up to which groups are brought to the tasks instead of shuffling what they are joined to.
BROADCAST_ROWS = 200_000


def brought(groups: DataFrame, at_most: int) -> DataFrame:
    """Groups for a join, broadcast when there are ``at_most`` a bounded number of them; else the join shuffles."""
    return F.broadcast(groups) if at_most <= BROADCAST_ROWS else groups


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join where NULL keys match NULL keys, as data-frame libraries do; keys appear once."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def evaluated_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose expressions run once a row.

    Filters and projections behind them read the values; behind ``withColumns`` they may each get a copy of the expression.
    """
    kept = [c for c in df.columns if c not in columns]
    once = df.select(*kept, F.inline(F.array(F.struct(*[v.alias(c) for c, v in columns.items()]))))
    return once.select(*dict.fromkeys([*df.columns, *columns]))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in an explicit total order.

    The rank filter is evaluated before the shuffle as well, so a key that holds a third of all rows
    sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def keep_unrepeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key occurs exactly once, as one combined aggregation."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(F.struct(*rest)).alias("__row"))
    return grouped.where("__n = 1").select(*keys, "__row.*").select(*df.columns)


def prefer_filled(df: DataFrame, keys: list[str], filled: str, order: list[Column]) -> DataFrame:
    """One row per key, rows with a value in ``filled`` first."""
    return keep_first(df, keys, [F.col(filled).isNull(), *order])


def union_first_wins(sources: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Stack sources by name; an earlier source wins over a later one, then the given order."""
    ranked = [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return keep_first(stacked, keys, [F.col("__source"), *order]).drop("__source")


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace every row of ``old`` with the same key."""
    return _semi_or_anti(old, new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def semi(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose (multi-column, null-safe) key occurs in ``other``."""
    return _semi_or_anti(df, other, keys, "left_semi")


def anti(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose (multi-column, null-safe) key does not occur in ``other``."""
    return _semi_or_anti(df, other, keys, "left_anti")


def _semi_or_anti(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    distinct = other.select(*[F.col(k).alias(f"__r_{k}") for k in keys]).distinct()
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return df.join(distinct, cond, how)


def drop_products_with(df: DataFrame, keys: list[str], bad: Column) -> DataFrame:
    """Leave out every row of a product that has any row where ``bad`` holds."""
    return anti(df, df.where(bad), keys)


def fill_from(df: DataFrame, dim: DataFrame, keys: list[str], column: str, default) -> DataFrame:
    """Left join a factor table and use ``default`` where it has no entry."""
    return df.join(dim, keys, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def in_two_roles(df: DataFrame, dim: DataFrame, key: str, roles: dict[str, str], columns: list[str]) -> DataFrame:
    """Join one dimension once per role; ``roles`` maps the fact column to the output prefix."""
    for column, prefix in roles.items():
        side = dim.select(F.col(key).alias(column), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
        df = df.join(side, column, "left")
    return df


def minimum_frequency(df: DataFrame, keys: list[str], more_than: int) -> DataFrame:
    """Rows whose key occurs more than ``more_than`` times."""
    frequent = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > more_than)
    return semi(df, brought(frequent, frequent.limit(BROADCAST_ROWS + 1).count()), keys)


def first_filled(df: DataFrame, tables: list[tuple[DataFrame, list[str]]], column: str) -> DataFrame:
    """Hierarchical fallback: the first table, finest first, that has a value for the row's key."""
    tried = [F.col(column)] if column in df.columns else []
    for i, (t, keys) in enumerate(tables):
        name = f"__level{i}"
        df = join_null_safe(df, t.select(*keys, F.col(column).alias(name)), keys)
        tried.append(F.col(name))
    return df.withColumn(column, F.coalesce(*tried)).drop(*[f"__level{i}" for i in range(len(tables))])


def with_totals(df: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """Attach group totals to rows.

    The totals are combined before the shuffle and joined back, so no task ever holds a whole group.
    """
    sums = df.groupBy(*keys).agg(*[v.alias(k) for k, v in totals.items()])
    return join_null_safe(df, sums, keys)


def copy_rows(df: DataFrame, column: str, copies: dict[str, list[str]]) -> DataFrame:
    """Add a copy of each row under every other name that ``copies`` lists for its own."""
    names = F.array(F.col(column))
    for old, new in copies.items():
        names = F.when(F.col(column) == old, F.array(F.col(column), *[F.lit(n) for n in new])).otherwise(names)
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(names).alias(column)).select(*df.columns)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a small dimension for use as literals; refuses a table that is not small."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows and cannot be used as a small dimension")
    return rows
