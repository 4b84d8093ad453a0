"""Relational operators over append logs: latest per key, keyed scans, anti joins, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the greatest order value of each key; rows with a null key
    are left out. All other columns of the row come along as one struct, so the
    partial aggregate runs before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    known = log.filter(" and ".join(f"`{k}` is not null" for k in keys))
    best = known.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(order)).alias("_row"))
    return best.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest])


def keyed_scan(table: DataFrame, **equal: object) -> DataFrame:
    """Rows that equal every value given; None asks for nothing. Reaches the scan as pushed filters."""
    for column, value in equal.items():
        if value is not None:
            table = table.filter(F.col(column) == F.lit(value))
    return table


def without(table: DataFrame, key: Column, listed: DataFrame, listed_key: Column) -> DataFrame:
    """Rows whose key is not listed (a null key is kept). The list is
    de-duplicated; whether it is broadcast is left to its measured size."""
    keys = listed.select(listed_key.alias("_listed")).filter(F.col("_listed").isNotNull()).distinct()
    return table.withColumn("_key", key).join(keys, F.col("_key") == F.col("_listed"), "left_anti").drop("_key")


def top_rows(table: DataFrame, group: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first k rows of each group; Spark cuts each partition to k before the shuffle."""
    return table.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(place) <= k)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def last_known(log: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Of each key the last non-null value of every column, each taken for itself."""
    return log.filter(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def first_with_word(rows: DataFrame, group: list[str], text: str, word: str, order: str) -> DataFrame:
    """Of each group the first row whose text holds the word, else its first row; the row's order value and whether it holds the word."""
    holds = F.coalesce(F.lower(text).contains(word), F.lit(False))
    best = F.min(F.struct((~holds).alias("lacks"), F.col(order)))
    return rows.groupBy(*group).agg(best.alias("_b")).select(*group, F.col(f"_b.{order}").alias(order), (~F.col("_b.lacks")).alias("holds"))
