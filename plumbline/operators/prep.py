"""Preparation: split, standardise, encode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], key: str, width: int = 1_000_000, name: str = "rank") -> DataFrame:
    """Exact 1-based rank by ``key`` (a unique integer) within ``by``, and the group's size ``group_n``.

    Ranks are counted within key ranges of ``width`` and offset by the counts of the ranges before, so that no
    group is sorted in one task; the table of counts has one row a group and range.
    """
    cut = df.withColumn("__r", F.floor(F.col(key) / width))
    counts = cut.groupBy(*by, "__r").agg(F.count("*").alias("__c"))
    offsets = counts.select(
        *by, "__r", (F.sum("__c").over(Window.partitionBy(*by).orderBy("__r")) - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy(*by)).alias("group_n")
    )
    inside = cut.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__r").orderBy(key)))
    return inside.join(offsets, [*by, "__r"]).withColumn(name, F.col("__before") + F.col("__k")).drop("__r", "__k", "__before")


def stratified_split(df: DataFrame, label: str, key: str, every: int = 5) -> DataFrame:
    """``is_test`` for every fifth row of each label in key order."""
    return ranked(df, [label], key).withColumn("is_test", F.col("rank") % every == 0).drop("rank", "group_n")


def standardised(df: DataFrame, columns: list[str], fit_on: Column | None = None, of: DataFrame | None = None) -> DataFrame:
    """Population z-scores with statistics of the rows ``fit_on`` of ``of`` (``df`` itself unless given); a zero
    deviation counts as 1."""
    rows = df if of is None else of
    rows = rows if fit_on is None else rows.where(fit_on)
    stats = rows.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    safe = {c: F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}
    joined = df.crossJoin(F.broadcast(stats))  # one row of statistics
    return joined.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / safe[c] for c in columns}).drop(*stats.columns)


def sign(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(-1.0)


def one_vs_rest(df: DataFrame, label: str, classes: int) -> DataFrame:
    """Every row once a class, with ``class_idx`` and ``y``."""
    return df.withColumn("class_idx", F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))).withColumn("y", sign(F.col(label) == F.col("class_idx")))


def one_vs_rest_binary_aware(df: DataFrame, label: str) -> DataFrame:
    """Two labels: one problem with the greater as +1; more: one problem a label, in label order."""
    labels = df.agg(F.array_sort(F.collect_set(label)).alias("__l"))  # one row, as many entries as classes
    joined = df.crossJoin(F.broadcast(labels))
    picked = F.when(F.size("__l") == 2, F.slice("__l", 2, 1)).otherwise(F.col("__l"))
    return joined.select(*df.columns, F.posexplode(picked).alias("class_idx", "__c")).withColumn("y", sign(F.col(label) == F.col("__c"))).drop("__c")
