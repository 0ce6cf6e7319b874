"""Top rows, last states, duplicates and diffs: operators that any table can take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark keeps no more of a key before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def numbered(df: DataFrame, keys: list[str], order: list[Column], to: str) -> DataFrame:
    """Adds the place of each row among those of its key, from 1."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def share(df: DataFrame, value: str, to: str, digits: int = 1) -> DataFrame:
    """Adds each row's share of the total, in per cent; for tables of few rows, as after a group-by."""
    total = F.sum(value).over(Window.partitionBy())
    return df.withColumn(to, F.coalesce(F.round(F.try_divide(100.0 * F.col(value), total), digits), F.lit(0.0)))


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, status: unchanged, changed, added or removed."""
    a, b = before.select(key, F.col(value).alias("_a")), after.select(key, F.col(value).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def missing(df: DataFrame, seen: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key the other table does not have."""
    return df.join(seen, on, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; columns that the new row has (not null) win, others survive."""
    o, n = old.alias("o"), new.alias("n")
    columns = [key, *(c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key)]

    def pick(c: str) -> Column:
        sides = [F.col(f"{side}.{c}") for side, frame in (("n", new), ("o", old)) if c in frame.columns]
        return F.coalesce(*sides).alias(c)

    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*(pick(c) for c in columns))


def last_known(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """For each key the last value of each column that is not null: a fold of updates."""
    return df.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values))


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value is another than in the row before of the same key; the first row counts."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")


def clusters(df: DataFrame, key: str, member: str, least: int = 2, show: int = 6) -> DataFrame:
    """key, size, similarity, members (the first `show`, joined): groups of rows with one fingerprint."""
    first = top_per_key(df, [key], [F.col(member)], show).groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(member)), ",").alias("members"))
    sizes = df.groupBy(key).agg(F.count("*").alias("size")).where(F.col("size") >= least)
    alike = 0.72 + F.least(F.lit(0.25), 0.03 * F.col("size"))
    return sizes.join(first, key).select(key, "size", F.round(alike, 4).alias("similarity"), "members")


def sorted_text(column: Column, separator: str = ",") -> Column:
    """Distinct values of a group in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)
