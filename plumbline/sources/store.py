"""Model store: client models as partitioned tables, resumable tasks, one global model a class."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def save_client_models(models: DataFrame, root: str) -> None:
    """One partition a class and client; those written replace their old partitions, others stay."""
    models.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("class_idx", "client_id").parquet(f"{root}/clients")


def usable(models: DataFrame, weights: list[str]) -> DataFrame:
    """Models whose numbers are all finite."""
    good = F.lit(True)
    for c in ["b", *weights]:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return models.where(good)


def open_tasks(tasks: DataFrame, models: DataFrame, weights: list[str]) -> DataFrame:
    """Tasks (class_idx, client_id) without a usable model."""
    return tasks.join(usable(models, weights).select("class_idx", "client_id"), ["class_idx", "client_id"], "left_anti")


def save_global_model(model: DataFrame, root: str, mode: str, solver: str, security: str = "notset") -> None:
    """The averaged model of each class with its feature mode; metadata is one JSON line, keys sorted."""
    model.withColumn("mode", F.lit(mode)).withColumn("security", F.lit(security)).coalesce(1).write.mode("overwrite").parquet(f"{root}/global")
    meta = json.dumps({"schema_version": SCHEMA_VERSION, "solver": solver, "mode": mode, "security": security}, sort_keys=True)
    model.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/metadata")


def load_global_model(spark: SparkSession, root: str, solver: str | None = None) -> DataFrame:
    """The stored model; a newer schema or another solver raises."""
    meta = json.loads(spark.read.text(f"{root}/metadata").first()["value"])
    if meta["schema_version"] > SCHEMA_VERSION:
        raise ValueError(f"schema {meta['schema_version']} is newer than {SCHEMA_VERSION}")
    if solver is not None and meta["solver"] != solver:
        raise ValueError(f"the model is of solver {meta['solver']!r}, not {solver!r}")
    return spark.read.parquet(f"{root}/global")


def save_model_state(state: DataFrame, root: str) -> None:
    """class_idx, phi_mean (array) and threshold of each class, beside the model."""
    state.select("class_idx", "phi_mean", "threshold").coalesce(1).write.mode("overwrite").parquet(f"{root}/state")


def load_model_with_state(spark: SparkSession, root: str, solver: str | None = None) -> DataFrame:
    """The stored model with phi_mean (null: not centred) and threshold (0 where none is stored)."""
    model = load_global_model(spark, root, solver)
    return model.join(spark.read.parquet(f"{root}/state"), "class_idx", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))


def predict_stored(rows: DataFrame, model: DataFrame, phi: list[str]) -> DataFrame:
    """``rows`` once a class with ``score`` and ``pred``: features less phi_mean, sign of the score less the
    threshold. ``model`` has one row a class."""
    score = F.col("b")
    for i, c in enumerate(phi):
        score = score + F.col(f"w{i}") * (F.col(c) - F.coalesce(F.get("phi_mean", F.lit(i)), F.lit(0.0)))
    scored = rows.crossJoin(F.broadcast(model.select("class_idx", "b", *[f"w{i}" for i in range(len(phi))], "phi_mean", "threshold"))).withColumn("score", score)
    return scored.withColumn("pred", F.when(F.col("score") >= F.col("threshold"), 1.0).otherwise(-1.0)).select(*rows.columns, "class_idx", "score", "pred")


def append_metrics(rows: DataFrame, root: str) -> None:
    """Adds to the metric history; earlier runs stay."""
    rows.write.mode("append").parquet(f"{root}/metrics")
