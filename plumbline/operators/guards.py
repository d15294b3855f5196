"""Preconditions of a run: sizes that fit, artifacts that may be reused, folders that must be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the "128" security level (a fixed value).
SECURE_SLOTS = 32


def least_clients(max_train: Column, slots: int = SECURE_SLOTS) -> Column:
    """The fewest clients whose rows and bias fit the slots."""
    return F.ceil(max_train / F.lit(slots - 1)).cast("long")


def slots_problem(security: Column, max_client_n: Column, max_feat_dim: Column, max_train: Column, slots: int = SECURE_SLOTS) -> Column:
    """What does not fit, clients before features; null if all fits or the level has no limit."""
    rows = F.concat(F.lit("client rows exceed the slots; use at least "), least_clients(max_train, slots).cast("string"), F.lit(" clients"))
    return F.when(security == "128", F.when(max_client_n > slots, rows).when(max_feat_dim > slots, F.lit("features exceed the slots")))


def check_slots(spark: SparkSession, security: str, max_client_n: int, max_feat_dim: int, max_train: int) -> None:
    problem = spark.range(1).select(slots_problem(F.lit(security), F.lit(max_client_n), F.lit(max_feat_dim), F.lit(max_train))).first()[0]
    if problem:
        raise ValueError(problem)


def reusable_context(contexts: DataFrame, required_depth: int, security: str) -> DataFrame:
    """The first class (at most one row) whose context is complete, deep enough and of the same security.
    ``contexts``: class_idx, complete, depth, security."""
    return contexts.where(F.col("complete") & (F.col("depth") >= required_depth) & (F.col("security") == security)).orderBy("class_idx").limit(1)


def refuse_stale(spark: SparkSession, root: str) -> None:
    """Raises if any artifact lies under ``root``: a new context would make it unreadable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return
    found = fs.listFiles(path, True)
    if found.hasNext():
        raise ValueError(f"artifacts of an earlier run are there, for one {found.next().getPath()}; remove them first")
