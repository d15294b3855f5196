"""Readers: tables as classification problems, model side files, samples, manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.prep import standardised

FEATURES = {"lineitem": ["x0", "x1", "x2", "x3"], "documents": ["x0", "x1", "x2", "x3", "x4"]}


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four features, three classes, ten clients; read with the columns it needs only."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("x1"), F.col("l_discount").alias("x2"), F.col("l_tax").alias("x3"), label.alias("label"), (F.col("l_suppkey") % 10).cast("int").alias("client_id"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five text statistics of labelled documents; the minority, low quality, is +1."""
    d, l = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    share = lambda p: (F.length("text") - F.length(F.regexp_replace("text", p, ""))) / F.greatest(F.length("text"), F.lit(1))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    joined = d.select("doc_id", "text", "n_chars").join(l, "doc_id").withColumn("w", words)
    n = F.greatest(F.size("w"), F.lit(1))
    return joined.select("doc_id", F.log1p("n_chars").alias("x0"), share("[0-9]").alias("x1"), share("[#*$%&|<>]").alias("x2"), (F.length(F.array_join("w", "")) / n).alias("x3"), (F.size(F.array_distinct("w")) / n).alias("x4"), F.when(F.col("quality") == 0, 1.0).otherwise(-1.0).alias("y"))


DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"lineitem": lineitem, "documents": documents}


def dataset(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(DATASETS)}")
    return DATASETS[name](spark, sf_dir)


def scaled_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardised(lineitem(spark, sf_dir), FEATURES["lineitem"])


#: Kernel of each class of lineitem; classes that are not listed are linear.
KERNELS = {1: "poly", 2: "poly"}
#: Regularisation of each kernel where none is tuned.
GAMMAS = {"linear": 1.1, "poly": 3.9, "homo_poly": 3.9}


def kernel_of(class_idx: Column) -> Column:
    """The kernel of a class; linear where none is listed."""
    listed = F.create_map(*[F.lit(x) for pair in KERNELS.items() for x in pair])
    return F.coalesce(F.try_element_at(listed, class_idx), F.lit("linear"))


def parsed_sample(text: Column) -> Column:
    """'5.1,3.5' as an array of doubles; a bad number raises."""
    return F.transform(F.split(text, ","), lambda s: F.trim(s).cast("double"))


def marker_depth(text: Column) -> Column:
    """``depth=N`` of a marker, or of an older JSON one; null if there is none."""
    plain = F.regexp_extract(text, r"(?m)^depth=(\d+)\s*$", 1).try_cast("int")
    return F.coalesce(plain, F.get_json_object(text, "$.depth").try_cast("int"))


def security_marker(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("notset"))


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """path, length of model files; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def compared_scheme(spark: SparkSession) -> DataFrame:
    """Parameters of a published scheme used for comparison, with two readings of its depth (fixed values)."""
    row = spark.createDataFrame([(1200, 25, 101, 16, 10)], "log_ql int, log_p int, col_subciphertexts int, submatrix_blocks int, gd_iterations int")
    return row.withColumn("depth_naive", F.floor(F.col("log_ql") / F.col("log_p"))).withColumn("depth_first_modulus", F.floor((F.col("log_ql") - 60) / F.col("log_p")))


def synthetic(spark: SparkSession, m: int, n: int, seed: int = 42) -> DataFrame:
    """An m x n matrix uniform on [0.01, 10], one row a line."""
    return spark.range(m).select(F.col("id").alias("i"), F.array(*[F.rand(seed + j) * 9.99 + 0.01 for j in range(n)]).alias("row"))
