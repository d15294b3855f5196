"""The whole path of a run: split, scale on the training rows, map each class by its kernel, train its clients, average,
calibrate, and judge the test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import features as ff
from plumbline.operators import clients, prep, training
from plumbline.sources import readers, store

X = readers.FEATURES["lineitem"]
CLASSES = 3


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with ``key``, ``is_test`` and features scaled by the training rows. Order lines can repeat, so every
    fifth key of a label is tested with all its rows."""
    rows = readers.lineitem(spark, sf_dir).withColumn("key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    split = prep.stratified_split(rows.select("label", "key").distinct(), "label", "key")
    return prep.standardised(rows.join(split, ["label", "key"]), X, ~F.col("is_test"))


def kernel_features(rows: DataFrame, kernel: str, prefix: str = "f") -> tuple[DataFrame, list[str], list[str]]:
    """``rows`` with the mapped features, less their means over the training rows, divided by the row's norm; the
    names of the features and of the columns that hold those means."""
    mapped = ff.kernel_columns([F.col(x) for x in X], kernel)
    phi = [f"{prefix}{i}" for i in range(len(mapped))]
    means = [f"__u_{c}" for c in phi]
    wide = rows.withColumns(dict(zip(phi, mapped)))
    mean = wide.where("not is_test").agg(*[F.avg(c).alias(u) for c, u in zip(phi, means)])
    less = wide.crossJoin(F.broadcast(mean)).withColumns({c: F.col(c) - F.col(u) for c, u in zip(phi, means)})  # one row of means
    return less.withColumns(dict(zip(phi, ff.l2_normalised([F.col(c) for c in phi])))), phi, means


def client_models(featured: DataFrame, phi: list[str], classes: list[int], gamma: float) -> DataFrame:
    """class_idx, client_id, n, b, w0.. of the classes of one kernel, on the training rows."""
    m = training.one_vs_rest_moments(featured.where("not is_test"), ["client_id"], phi, "label", CLASSES)
    return training.solved(m.where(F.col("class_idx").isin(classes)), ["class_idx", "client_id"], len(phi), gamma)


def judged(featured: DataFrame, model: DataFrame, phi: list[str], classes: list[int]) -> tuple[DataFrame, DataFrame]:
    """(key, is_test, class_idx, y, score) of the classes, and their thresholds over the training rows."""
    rows = prep.one_vs_rest(featured, "label", CLASSES).where(F.col("class_idx").isin(classes))
    scored = training.with_scores(rows, model, phi).select("key", "is_test", "class_idx", "y", "score")
    return scored, training.threshold(scored.where("not is_test"), ["class_idx"])


def class_pipeline(spark: SparkSession, sf_dir: str, kernels: dict[int, str] | None = None, gammas: dict[str, float] | None = None) -> DataFrame:
    """One row a class: class_idx, kernel, n_features, threshold and the counts tp, fp, fn, tn over the test rows."""
    kernels = readers.KERNELS if kernels is None else kernels
    gammas = gammas or readers.GAMMAS
    rows, out = split_rows(spark, sf_dir), None
    of = {c: kernels.get(c, "linear") for c in range(CLASSES)}
    for kernel in sorted(set(of.values())):
        classes = [c for c in of if of[c] == kernel]
        featured, phi, _ = kernel_features(rows, kernel)
        model = training.averaged(client_models(featured, phi, classes, gammas[kernel]), len(phi))
        scored, cut = judged(featured, model, phi, classes)
        signed = scored.where("is_test").join(F.broadcast(cut), "class_idx").withColumn("pred", training.predicted_sign(F.col("score") - F.col("threshold")))  # one row a class
        counts = training.confusion(signed, ["class_idx"]).join(F.broadcast(cut), "class_idx")
        part = counts.select("class_idx", F.lit(kernel).alias("kernel"), F.lit(len(phi)).alias("n_features"), "threshold", "tp", "fp", "fn", "tn")
        out = part if out is None else out.unionByName(part)
    return out


def run_open_tasks(spark: SparkSession, sf_dir: str, root: str, kernel: str, classes: list[int]) -> DataFrame:
    """Solves and saves the clients of ``classes`` that have no usable model under ``root``, and returns all of them;
    a run that was cut short goes on where it stopped."""
    featured, phi, _ = kernel_features(split_rows(spark, sf_dir), kernel)
    weights = [f"w{i}" for i in range(len(phi))]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/clients")
    wanted = featured.select("client_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in classes], "class_idx int")))
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        wanted = store.open_tasks(wanted, spark.read.parquet(f"{root}/clients"), weights)
    todo = [tuple(r) for r in wanted.select("class_idx", "client_id").collect()]  # some classes times clients
    if todo:
        open_rows = F.broadcast(spark.createDataFrame(todo, "class_idx int, client_id int"))
        needed = featured.join(open_rows.select("client_id").distinct(), "client_id", "left_semi")
        models = client_models(needed, phi, classes, readers.GAMMAS[kernel]).join(open_rows, ["class_idx", "client_id"], "left_semi")
        store.save_client_models(models, root)
    return spark.read.parquet(f"{root}/clients")


def partitioned_sizes(spark: SparkSession, sf_dir: str, k: int, partition: str, shares: list[list[float]] | None = None) -> DataFrame:
    """client_id and n of the training rows dealt by name, or by given shares of each label."""
    train = split_rows(spark, sf_dir).where("not is_test").select("key", "label")
    if shares is None:
        dealt = clients.partition_all(train, "label", "key", k, partition)
    else:
        dealt = clients.backfilled(clients.capped(clients.by_shares(train, "label", "key", shares), "key", k), "key", k)
    return clients.spine(dealt, k)
