"""Queries over the star-schema tables, each with the same result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import features as ff
from plumbline.operators import clients, emulator, prep, runlog, solvers, training
from plumbline.plans import federated
from plumbline.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
X = readers.FEATURES["lineitem"]


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


RAW = """raw AS (SELECT l_orderkey, l_linenumber, l_quantity AS r0, l_extendedprice AS r1, l_discount AS r2, l_tax AS r3,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, (l_suppkey % 10)::INT AS client_id FROM lineitem)"""
Z = f"""WITH {RAW},
st AS (SELECT {', '.join(f'avg(r{i}) AS m{i}, stddev_pop(r{i}) AS d{i}' for i in range(4))} FROM raw),
z AS (SELECT raw.*, {', '.join(f'(r{i} - m{i}) / CASE WHEN d{i} = 0 THEN 1 ELSE d{i} END AS x{i}' for i in range(4))} FROM raw, st)"""
OVR = f"""{Z},
ovr AS (SELECT z.*, c AS class_idx, CASE WHEN label = c THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM z, (SELECT unnest(range(0, 3))::INT AS c) k)"""
UP = training.upper(4)
MOMENTS = f"""{OVR},
m AS (SELECT class_idx, client_id, count(*) AS n, sum(y) AS sy, {', '.join(f'sum(x{i}) AS s{i}, sum(x{i} * y) AS p{i}' for i in range(4))},
  {', '.join(f'sum(x{i} * x{j}) AS g{i}_{j}' for i, j in UP)} FROM ovr GROUP BY ALL)"""


def elimination_sql(source: str, keys: str, d: int, gamma: float, name: str) -> str:
    """CTEs that solve the primal system of each row of ``source``; the last is ``name``."""
    size = d + 1
    cells = ["n::DOUBLE AS a0_0", *(f"p{j} AS a0_{j + 1}" for j in range(d)), *(f"g{i}_{j}{f' + 1 / {gamma}' if i == j else ''} AS a{i + 1}_{j + 1}" for i, j in training.upper(d))]
    rhs = ["sy::DOUBLE AS r0", *(f"s{i} AS r{i + 1}" for i in range(d))]
    parts = [f"{name}_0 AS (SELECT {keys}, n, {', '.join(cells + rhs)} FROM {source})"]
    for k in range(d):
        new = [f"a{i}_{j} - a{k}_{i} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" for i in range(k + 1, size) for j in range(i, size)] + [f"r{i} - a{k}_{i} / a{k}_{k} * r{k} AS r{i}" for i in range(k + 1, size)]
        parts.append(f"{name}_{k + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM {name}_{k})")
    at = f"{name}_{d}"
    for i in range(size - 1, -1, -1):
        left = f"r{i}" + "".join(f" - a{i}_{j} * v{j}" for j in range(i + 1, size))
        parts.append(f"{name}_v{i} AS (SELECT *, ({left}) / a{i}_{i} AS v{i} FROM {at})")
        at = f"{name}_v{i}"
    parts.append(f"{name} AS (SELECT {keys}, n, v0 AS b, {', '.join(f'v{i + 1} AS w{i}' for i in range(d))} FROM {at})")
    return ",\n".join(parts)


W4 = [f"w{i}" for i in range(4)]
MODELS = f"{MOMENTS},\n{elimination_sql('m', 'class_idx, client_id', 4, 1.1, 'models')}"
FED = f"{MODELS},\nfed AS (SELECT class_idx, avg(b) AS b, {', '.join(f'avg({w}) AS {w}' for w in W4)} FROM models GROUP BY class_idx)"
SCORED = f"{FED},\nscored AS (SELECT ovr.*, b + {' + '.join(f'w{i} * x{i}' for i in range(4))} AS score FROM ovr JOIN fed USING (class_idx))"
FULL = f"""{OVR},
mf AS (SELECT class_idx, count(*) AS n, sum(y) AS sy, {', '.join(f'sum(x{i}) AS s{i}, sum(x{i} * y) AS p{i}' for i in range(4))},
  {', '.join(f'sum(x{i} * x{j}) AS g{i}_{j}' for i, j in UP)} FROM ovr GROUP BY ALL),
{elimination_sql('mf', 'class_idx', 4, 1.1, 'whole')}"""
R = lambda names, digits=6: ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def scaled_ovr(spark: SparkSession, sf: str) -> DataFrame:
    return prep.one_vs_rest(readers.scaled_lineitem(spark, sf), "label", 3)


@query(f"{Z} SELECT l_orderkey, l_linenumber, {R(X)} FROM z")
def q_standardise(spark, sf):
    return readers.scaled_lineitem(spark, sf).select("l_orderkey", "l_linenumber", *[rounded(c).alias(c) for c in X])


@query("SELECT s_suppkey, 0.0::DOUBLE AS constant, round((s_acctbal - m) / d, 6) + 0.0 AS x FROM supplier, (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS d FROM supplier)")
def q_zero_variance_scale(spark, sf):
    t = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", F.col("s_acctbal").alias("x"), F.lit(5.0).alias("constant"))
    return prep.standardised(t, ["x", "constant"]).select("s_suppkey", rounded("constant").alias("constant"), rounded("x").alias("x"))


@query(f"{OVR} SELECT class_idx, label, y, count(*) AS n FROM ovr GROUP BY ALL")
def q_ovr_labels(spark, sf):
    return prep.one_vs_rest(readers.lineitem(spark, sf), "label", 3).groupBy("class_idx", "label", "y").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM labels")
def q_binary_labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", prep.sign(F.col("quality") == 0).alias("y"))


@query("SELECT doc_id, 0 AS class_idx, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM labels")
def q_dataset_ovr(spark, sf):
    t = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    return prep.one_vs_rest_binary_aware(t, "quality").select("doc_id", "class_idx", "y")


@query("SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) % 5 = 0 AS is_test FROM orders")
def q_strat_split(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
    return prep.stratified_split(t, "o_orderstatus", "o_orderkey").select("o_orderkey", "o_orderstatus", "is_test")


def _map_sql(d: int, degree: int, c: float | None) -> list[str]:
    return [" * ".join([repr(ff.scale(p, degree, c)), *(f"x{i}" for i, k in enumerate(p) for _ in range(k))]) for p in ff.monomials(d, degree, c is None)]


def _map_query(name: str, degree: int, c: float | None) -> None:
    n = ff.width(4, degree, c is None)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        z = readers.scaled_lineitem(spark, sf)
        phi = ff.kernel_map([F.col(x) for x in X], degree, c)
        return z.select("l_orderkey", "l_linenumber", *[rounded(v).alias(f"f{i}") for i, v in enumerate(phi)])

    run.__name__ = name
    query(f"{Z} SELECT l_orderkey, l_linenumber, {', '.join(f'round({v}, 6) + 0.0 AS f{i}' for i, v in enumerate(_map_sql(4, degree, c)))} FROM z")(run)
    assert n == len(ff.monomials(4, degree, c is None))


_map_query("q_poly2_map", 2, 1.0)
_map_query("q_homo2_map", 2, None)
_map_query("q_poly3_map", 3, 0.5)

PHI = [f"f{i}" for i in range(15)]
MAPPED = f"{Z}, f AS (SELECT l_orderkey, l_linenumber, label, client_id, {', '.join(f'{v} AS f{i}' for i, v in enumerate(_map_sql(4, 2, 1.0)))} FROM z), mu AS (SELECT {', '.join(f'avg(f{i}) AS u{i}' for i in range(15))} FROM f), cen AS (SELECT l_orderkey, l_linenumber, label, client_id, {', '.join(f'f{i} - u{i} AS f{i}' for i in range(15))} FROM f, mu)"
PIPED = f"{MAPPED}, piped AS (SELECT l_orderkey, l_linenumber, label, client_id, {', '.join(f'f{i} / CASE WHEN nrm < 1e-12 THEN 1 ELSE nrm END AS f{i}' for i in range(15))} FROM (SELECT *, sqrt({' + '.join(f'f{i} * f{i}' for i in range(15))}) AS nrm FROM cen))"


@query(f"{MAPPED} SELECT l_orderkey, l_linenumber, {R(PHI)} FROM cen")
def q_center(spark, sf):
    return federated.centred(federated.mapped(readers.scaled_lineitem(spark, sf), X), PHI).select("l_orderkey", "l_linenumber", *[rounded(c).alias(c) for c in PHI])


@query(f"{Z} SELECT l_orderkey, l_linenumber, {', '.join(f'round(x{i} / nrm, 6) + 0.0 AS x{i}' for i in range(4))} FROM (SELECT *, CASE WHEN sqrt(x0*x0+x1*x1+x2*x2+x3*x3) < 1e-12 THEN 1 ELSE sqrt(x0*x0+x1*x1+x2*x2+x3*x3) END AS nrm FROM z)")
def q_l2norm(spark, sf):
    z = readers.scaled_lineitem(spark, sf)
    return z.select("l_orderkey", "l_linenumber", *[rounded(v).alias(c) for c, v in zip(X, ff.l2_normalised([F.col(c) for c in X]))])


@query(f"{PIPED} SELECT l_orderkey, l_linenumber, {R(PHI)} FROM piped")
def q_feature_pipeline(spark, sf):
    return federated.piped(readers.scaled_lineitem(spark, sf), X).select("l_orderkey", "l_linenumber", *[rounded(c).alias(c) for c in PHI])


MODE_ROWS = [(0, "primal:linear"), (1, "primal:poly:degree=3:c=0.5"), (2, "primal:homo_poly"), (3, "primal:poly:c=2.0"), (4, "primal:rbf:degree=2")]


@query(
    f"""WITH t(id, mode) AS (VALUES {', '.join(f"({i}, '{m}')" for i, m in MODE_ROWS)}), k AS (SELECT *, split_part(mode, ':', 2) AS kind FROM t)
SELECT id, CASE WHEN ok THEN kind END AS map, CASE WHEN ok THEN coalesce(TRY_CAST(nullif(regexp_extract(mode, 'degree=([^:]*)', 1), '') AS INT), 2) END AS degree,
  CASE WHEN ok THEN coalesce(TRY_CAST(nullif(regexp_extract(mode, ':c=([^:]*)', 1), '') AS DOUBLE), 1.0) END AS c FROM (SELECT *, kind IN ('linear', 'poly', 'homo_poly') AS ok FROM k)"""
)
def q_mode_parse(spark, sf):
    return spark.createDataFrame(MODE_ROWS, "id int, mode string").withColumn("p", ff.parsed_mode(F.col("mode"))).select("id", "p.map", "p.degree", "p.c")


GRAM = "WITH s AS (SELECT n_nationkey::BIGINT AS id, n_nationkey / 25.0::DOUBLE AS a, n_regionkey / 5.0::DOUBLE AS b, CASE WHEN n_regionkey < 2 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM nation), k AS (SELECT p.id AS i, q.id AS j, p.y * q.y AS yy, p.a * q.a + p.b * q.b AS k FROM s p, s q)"


def small_points(spark: SparkSession, sf: str) -> DataFrame:
    """The nations: a kernel matrix is only ever built for a table whose size does not grow."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") / 25.0).alias("a"), (F.col("n_regionkey") / 5.0).alias("b"), prep.sign(F.col("n_regionkey") < 2).alias("y"))


def _gram(name: str, spark_value: Callable[[Column], Column], sql_value: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return solvers.pair_products(small_points(spark, sf), "id", ["a", "b"]).select("i", "j", rounded(spark_value(F.col("k"))).alias("k"))

    run.__name__ = name
    query(f"{GRAM} SELECT i, j, round({sql_value}, 6) + 0.0 AS k FROM k")(run)


_gram("q_kernel_gram_linear", lambda k: k, "k")
_gram("q_kernel_gram_poly", lambda k: (k + 1) * (k + 1), "(k + 1) * (k + 1)")
_gram("q_kernel_gram_homo", lambda k: k * k, "k * k")


@query(f"{GRAM} SELECT i, j, round(yy * k, 6) + 0.0 AS omega FROM k")
def q_omega(spark, sf):
    pts = small_points(spark, sf)
    k = solvers.pair_products(pts, "id", ["a", "b"])
    y = pts.select("id", "y")
    return k.join(y.select(F.col("id").alias("i"), F.col("y").alias("yi")), "i").join(y.select(F.col("id").alias("j"), F.col("y").alias("yj")), "j").select("i", "j", rounded(F.col("yi") * F.col("k") * F.col("yj")).alias("omega"))


@query(f"{GRAM}, h AS (SELECT i, j, yy * k + CASE WHEN i = j THEN 1 / 1.1 ELSE 0 END AS v FROM k UNION ALL SELECT -1, id, 1.0 FROM s UNION ALL SELECT id, -1, 1.0 FROM s UNION ALL SELECT -1, -1, 0.0) SELECT i, j, round(v, 6) + 0.0 AS v FROM h")
def q_kkt_dense(spark, sf):
    pts = small_points(spark, sf).withColumns({"sa": F.col("y") * F.col("a"), "sb": F.col("y") * F.col("b")})
    inner = solvers.pair_products(pts, "id", ["sa", "sb"]).select("i", "j", (F.col("k") + F.when(F.col("i") == F.col("j"), 1 / 1.1).otherwise(0.0)).alias("v"))
    edge, one = F.lit(-1).cast("long"), F.lit(1.0)
    border = pts.select(edge.alias("i"), F.col("id").alias("j"), one.alias("v")).union(pts.select("id", edge, one)).union(spark.range(1).select(edge, edge, F.lit(0.0)))
    return inner.union(border).select("i", "j", rounded("v").alias("v"))


M_COLUMNS = ["sy", *[f"{k}{i}" for k in "sp" for i in range(4)], *[f"g{i}_{j}" for i, j in UP]]


@query(f"{MOMENTS} SELECT class_idx, client_id, n, {R(M_COLUMNS, 5)} FROM m")
def q_moments(spark, sf):
    m = training.one_vs_rest_moments(readers.scaled_lineitem(spark, sf), ["client_id"], X, "label", 3)
    return m.select("class_idx", "client_id", "n", *[rounded(c, 5).alias(c) for c in M_COLUMNS])


@query(f"{MODELS} SELECT class_idx, client_id, n, {R(['b', *W4])} FROM models")
def q_client_solve(spark, sf):
    return federated.client_models(spark, sf).select("class_idx", "client_id", F.col("n").cast("long").alias("n"), *[rounded(c).alias(c) for c in ["b", *W4]])


@query(f"{FED} SELECT class_idx, {R(['b', *W4])} FROM fed")
def q_fedavg(spark, sf):
    return federated.global_model(spark, sf).select("class_idx", *[rounded(c).alias(c) for c in ["b", *W4]])


@query(f"{FULL} SELECT class_idx, n, {R(['b', *W4])} FROM whole")
def q_full_data_solve(spark, sf):
    return federated.full_model(spark, sf).select("class_idx", "n", *[rounded(c).alias(c) for c in ["b", *W4]])


ALPHA = f"{FULL}, al AS (SELECT ovr.class_idx, ovr.l_orderkey, y * 1.1 * (1 - b * y - ({' + '.join(f'w{i} * x{i}' for i in range(4))})) AS alpha FROM ovr JOIN whole USING (class_idx))"


def _alpha(spark: SparkSession, sf: str) -> DataFrame:
    model = federated.full_model(spark, sf).drop("n")
    rows = scaled_ovr(spark, sf)
    scored = training.with_scores(rows, model, X).join(F.broadcast(model.select("class_idx", "b")), "class_idx")
    return scored.withColumn("alpha", training.recovered_alpha(F.col("y"), F.col("b"), F.col("score"), 1.1))


@query(f"{ALPHA} SELECT class_idx, count(*) AS n, round(sum(alpha), 3) + 0.0 AS total, round(sum(alpha * alpha), 3) AS squares FROM al GROUP BY class_idx")
def q_alpha_recovery(spark, sf):
    return _alpha(spark, sf).groupBy("class_idx").agg(F.count("*").alias("n"), rounded(F.sum("alpha"), 3).alias("total"), F.round(F.sum(F.col("alpha") * F.col("alpha")), 3).alias("squares"))


@query(f"{ALPHA} SELECT class_idx, count(*) FILTER (abs(alpha) > 1e-6) AS support_vectors FROM al GROUP BY class_idx")
def q_support_vectors(spark, sf):
    return _alpha(spark, sf).groupBy("class_idx").agg(F.count_if(F.abs("alpha") > 1e-6).alias("support_vectors"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return training.with_scores(scaled_ovr(spark, sf), federated.global_model(spark, sf), X)


THRESHOLD = f"{SCORED}, th AS (SELECT class_idx, coalesce(0.5 * (avg(score) FILTER (y = 1) + avg(score) FILTER (y = -1)), 0.0) AS threshold FROM scored GROUP BY class_idx)"


@query(f"{THRESHOLD} SELECT class_idx, {R(['threshold'])} FROM th")
def q_threshold(spark, sf):
    return training.threshold(scored(spark, sf), ["class_idx"]).select("class_idx", rounded("threshold").alias("threshold"))


@query(f"{SCORED} SELECT class_idx, l_orderkey, l_linenumber, round(score, 5) + 0.0 AS score FROM scored")
def q_scores(spark, sf):
    return scored(spark, sf).select("class_idx", "l_orderkey", "l_linenumber", rounded("score", 5).alias("score"))


@query(f"{THRESHOLD}, p AS (SELECT class_idx, y, CASE WHEN score - threshold >= 0 THEN 1 ELSE -1 END AS pred FROM scored JOIN th USING (class_idx)) SELECT class_idx, count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = -1) AS fp, count(*) FILTER (pred = -1 AND y = 1) AS fn, count(*) FILTER (pred = -1 AND y = -1) AS tn FROM p GROUP BY class_idx")
def q_confusion(spark, sf):
    return federated.confusions(spark, sf)


CONF = ORACLES["q_confusion"]
PRF = f"WITH cf AS ({CONF}), s AS (SELECT class_idx, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM cf)"


@query(f"{PRF} SELECT class_idx, {R(['precision', 'recall', 'accuracy'])}, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) + 0.0 AS f1 FROM s")
def q_prf1(spark, sf):
    t = training.precision_recall_f1(federated.confusions(spark, sf))
    return t.select("class_idx", *[rounded(c).alias(c) for c in ("precision", "recall", "accuracy", "f1")])


@query(f"{PRF} SELECT class_idx, round(100 * precision, 4) + 0.0 AS precision, round(100 * recall, 4) + 0.0 AS recall, round(100 * accuracy, 4) + 0.0 AS accuracy, round(coalesce(200 * precision * recall / nullif(precision + recall, 0), 0), 4) + 0.0 AS f1 FROM s")
def q_prf1_pct(spark, sf):
    t = training.precision_recall_f1(federated.confusions(spark, sf), percent=True)
    return t.select("class_idx", *[rounded(c, 4).alias(c) for c in ("precision", "recall", "accuracy", "f1")])


SIGNS = "(VALUES (0, 1.5::DOUBLE), (1, 0.0::DOUBLE), (2, -0.25::DOUBLE)) t(id, score)"
SIGN_ROWS = [(0, 1.5), (1, 0.0), (2, -0.25)]


@query(f"SELECT id, CASE WHEN score >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS pred FROM {SIGNS}")
def q_pred_sign(spark, sf):
    return spark.createDataFrame(SIGN_ROWS, "id int, score double").select("id", training.predicted_sign(F.col("score")).alias("pred"))


@query(f"SELECT id, score > 0 AS positive FROM {SIGNS}")
def q_pred_strict(spark, sf):
    return spark.createDataFrame(SIGN_ROWS, "id int, score double").select("id", (F.col("score") > 0).alias("positive"))


ARGMAX = f"{SCORED}, best AS (SELECT l_orderkey, l_linenumber, x0, x1, x2, x3, client_id, label, class_idx, score, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, r0, r1, r2, r3, client_id, label ORDER BY round(score, 9) DESC, class_idx) AS k FROM scored)"


@query(f"{ARGMAX} SELECT class_idx AS pred_class, label, count(*) AS n FROM best WHERE k = 1 GROUP BY ALL")
def q_ovr_argmax(spark, sf):
    return federated.class_predictions(spark, sf).groupBy("pred_class", "label").agg(F.count("*").alias("n"))


@query(f"{ARGMAX} SELECT round(100 * avg((class_idx = label)::INT), 4) AS accuracy_pct FROM best WHERE k = 1")
def q_accuracy_ovr(spark, sf):
    return federated.accuracy(spark, sf).select(F.round("accuracy_pct", 4).alias("accuracy_pct"))


MATCH = f"{FED},\n{FULL.split(OVR + ',')[1].strip()}, pm AS (SELECT class_idx, fed.b + {' + '.join(f'fed.w{i} * x{i}' for i in range(4))} AS a, whole.b + {' + '.join(f'whole.w{i} * x{i}' for i in range(4))} AS c FROM ovr JOIN fed USING (class_idx) JOIN whole USING (class_idx))"


@query(f"{MATCH} SELECT class_idx, round(100 * avg(((a >= 0) = (c >= 0))::INT), 4) AS match_pct FROM pm GROUP BY class_idx")
def q_pred_match(spark, sf):
    whole = federated.full_model(spark, sf).drop("n")
    both = training.with_scores(training.with_scores(scaled_ovr(spark, sf), federated.global_model(spark, sf), X).withColumnRenamed("score", "a"), whole, X)
    return both.groupBy("class_idx").agg(F.round(100 * F.avg(((F.col("a") >= 0) == (F.col("score") >= 0)).cast("int")), 4).alias("match_pct"))


@query(f"{MATCH} SELECT class_idx, round(sqrt({' + '.join(f'(fed.w{i} - whole.w{i})**2' for i in range(4))}) / sqrt({' + '.join(f'whole.w{i}**2' for i in range(4))}), 4) AS w_err FROM fed JOIN whole USING (class_idx)")
def q_weight_rel_err(spark, sf):
    a = federated.global_model(spark, sf)
    b = federated.full_model(spark, sf).select("class_idx", *[F.col(w).alias(f"v{w}") for w in W4])
    return a.join(b, "class_idx").select("class_idx", F.round(training.relative_error([F.col(w) for w in W4], [F.col(f"v{w}") for w in W4]), 4).alias("w_err"))


@query()
def q_text_quality(spark, sf):
    """Whole run on documents: scaled statistics, ten clients, average, threshold, test metrics."""
    return federated.text_quality(spark, sf)


@query()
def q_embeddings_ovr(spark, sf):
    """64 features, ten classes, four clients; the solve is a numpy batch over gathered moments."""
    return federated.embedding_models(spark, sf)


PART = "SELECT o_orderkey, o_orderstatus, (ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1)::INT AS client_id FROM orders"


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")


@query(PART)
def q_iid_partition(spark, sf):
    return clients.iid(order_rows(spark, sf), ["o_orderstatus"], "o_orderkey", 7).select("o_orderkey", "o_orderstatus", "client_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 25")
def q_subsample(spark, sf):
    return clients.subsampled(order_rows(spark, sf), ["o_orderstatus"], "o_orderkey", 25).select("o_orderkey", "o_orderstatus")


SHARES = [[0.5, 0.05, 0.25, 0.2], [0.1, 0.6, 0.0, 0.3]]
CUTS = ", ".join(f"({g}, {c}, {float(v)!r})" for g, s in enumerate(SHARES) for c, v in enumerate(np.cumsum(s)[:-1]))
DIRICHLET = f"""cuts(g, c, p) AS (VALUES {CUTS}), r AS (SELECT o_orderkey, (o_custkey % 3 = 0)::INT AS g FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o_orderkey) AS rk, count(*) OVER (PARTITION BY g) AS n FROM r),
parted AS (SELECT o_orderkey, k.g, (SELECT count(*) FROM cuts WHERE cuts.g = k.g AND floor(p::DOUBLE * n) < rk)::INT AS client_id FROM k)"""


def shared_orders(spark: SparkSession, sf: str, shares: list[list[float]] = SHARES) -> DataFrame:
    t = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 3 == 0).cast("int").alias("g"))
    return clients.by_shares(t, "g", "o_orderkey", shares).select("o_orderkey", "g", "client_id")


@query(f"WITH {DIRICHLET} SELECT o_orderkey, g, client_id FROM parted")
def q_dirichlet_partition(spark, sf):
    return shared_orders(spark, sf)


@query()
def q_dirichlet_drawn(spark, sf):
    return shared_orders(spark, sf, clients.dirichlet_shares(6, 0.5, 2)).groupBy("g", "client_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {DIRICHLET}, t AS (SELECT greatest(4, ceil(count(*) / 4))::BIGINT AS cap FROM parted), q AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY o_orderkey) AS rk FROM parted),
o AS (SELECT o_orderkey, g, row_number() OVER (ORDER BY o_orderkey) AS turn FROM q, t WHERE rk > cap),
c AS (SELECT i::INT AS client_id, (SELECT count(*) FROM parted WHERE parted.client_id = i) AS n FROM range(0, 4) s(i)),
f AS (SELECT client_id, row_number() OVER (ORDER BY slot, client_id) AS turn FROM (SELECT client_id, unnest(range(n + 1, cap + 1)) AS slot FROM c, t WHERE n < cap))
SELECT o_orderkey, g, client_id FROM q, t WHERE rk <= cap UNION ALL SELECT o_orderkey, g, client_id FROM o JOIN f USING (turn)"""
)
def q_cap_clients(spark, sf):
    return clients.capped(shared_orders(spark, sf), "o_orderkey", 4)


@query()
def q_backfill(spark, sf):
    return clients.backfilled(shared_orders(spark, sf, [[0.7, 0.0, 0.3, 0.0], [0.5, 0.0, 0.5, 0.0]]), "o_orderkey", 4)


@query("SELECT (o_custkey % 40)::INT AS client_id FROM orders GROUP BY 1 HAVING max(CASE WHEN o_totalprice > 495000 THEN 1 ELSE -1 END) < 0")
def q_zero_pos_clients(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 40).cast("int").alias("client_id"), prep.sign(F.col("o_totalprice") > 495000).alias("y"))
    return clients.without_positive(t)


@query(f"WITH {DIRICHLET} SELECT i::INT AS client_id, (SELECT count(*) FROM parted WHERE client_id = i) AS n FROM range(0, 6) s(i)")
def q_client_spine(spark, sf):
    return clients.spine(shared_orders(spark, sf), 6)


@query(f"WITH {DIRICHLET} SELECT greatest(max(n) + 1, 5) AS max_client_n FROM (SELECT count(*) AS n FROM parted GROUP BY client_id)")
def q_max_client_n(spark, sf):
    return shared_orders(spark, sf).groupBy("client_id").count().agg(F.greatest(F.max("count") + 1, F.lit(5)).alias("max_client_n"))


TASKS = "tasks AS (SELECT c::INT AS class_idx, v AS client FROM range(0, 3) a(c), (SELECT i::VARCHAR AS v FROM range(0, 12) b(i) UNION ALL SELECT 'baseline'))"


@query(f"WITH {TASKS} SELECT class_idx, client FROM tasks")
def q_task_list(spark, sf):
    return clients.tasks(spark, 3, 12)


@query(f"WITH {TASKS} SELECT class_idx, client, ((row_number() OVER (ORDER BY class_idx, client = 'baseline', length(client), client) - 1) % 5)::INT AS shard FROM tasks")
def q_shards(spark, sf):
    return clients.sharded(clients.tasks(spark, 3, 12), 5)


@query(f"WITH {TASKS} SELECT class_idx, client FROM tasks WHERE NOT (class_idx = 1 AND client IN ('0', '3')) ")
def q_resume_antijoin(spark, sf):
    done = spark.createDataFrame([(1, "0", [0.5, 1.0]), (1, "3", [2.0]), (2, "4", [float("nan")])], "class_idx int, client string, w array<double>")
    finite = done.where(F.forall("w", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return clients.tasks(spark, 3, 12).join(finite, ["class_idx", "client"], "left_anti")


DEPTH_ROWS = [(5, 5, 8, 8, 8, 1.2), (7, 7, 64, 64, 64, 1.15), (2, 2, 2, 2, 2, 1.0)]
DEPTHS = f"(VALUES {', '.join(map(str, DEPTH_ROWS))}) t(m, n, ds, di, db, sf)"


@query(f"SELECT m, n, ds, greatest(ceil((least(m, n) * (2 * ceil(log2(ds + 1)) + 2 * ceil(log2(di + 1)) + 1) + n * (2 * ceil(log2(db + 1)) + 1) + 8) * sf::DOUBLE), 30)::BIGINT AS depth FROM {DEPTHS}")
def q_depth_estimate(spark, sf):
    t = spark.createDataFrame(DEPTH_ROWS, "m int, n int, ds int, di int, db int, sf double")
    return t.select("m", "n", "ds", emulator.solver_depth(*[F.col(c) for c in t.columns]).alias("depth"))


@query("SELECT unnest(list_sort(list_distinct(list_concat(range(1, 6), list_transform(range(1, 9), lambda x: -x), [1, 2, 4, -1, -2, -4], [1, 2, 4, 8])))) AS k")
def q_rotation_keys(spark, sf):
    return spark.range(1).select(F.explode(emulator.rotation_keys(6, 9, 15).cast("array<bigint>")).alias("k"))


@query("SELECT d::BIGINT AS depth, greatest(1024, pow(2, ceil(log2(2.0 * (60 + 50 * d)))))::BIGINT AS ring FROM (VALUES (3), (30), (124), (172)) t(d)")
def q_ring_dim(spark, sf):
    return spark.createDataFrame([(3,), (30,), (124,), (172,)], "depth long").withColumn("ring", emulator.ring_dimension(F.col("depth")))


@query("WITH t(n, g) AS (VALUES (6, 4.2::DOUBLE), (40, 1.1::DOUBLE), (227, 1.1::DOUBLE)), b AS (SELECT n, g, 1 / (2 * g + 2 * sqrt(g / n) + 1 / n) / 1.1::DOUBLE AS lo, (n + 1 / g) * 1.1::DOUBLE AS hi FROM t) SELECT n, round(lo, 8) AS sqrt_low, round(hi, 8) AS sqrt_high, round(4 * hi, 8) AS vtv_high, round(-sqrt(hi), 8) AS diag_low, round(-sqrt(lo), 8) AS diag_high FROM b")
def q_analytic_bounds(spark, sf):
    t = spark.createDataFrame([(6, 4.2), (40, 1.1), (227, 1.1)], "n int, g double")
    return t.select("n", *[F.round(v, 8).alias(k) for k, v in emulator.primal_bounds(F.col("n"), F.col("g")).items()])


SLOTS = 8


def slot_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/supplier.parquet")
    return t.select("s_suppkey", emulator.packed(F.array((F.col("s_acctbal") / 1000), F.col("s_nationkey").cast("double"), F.lit(1.0)), SLOTS).alias("v"))


SLOT = "WITH s AS (SELECT s_suppkey, [s_acctbal / 1000, s_nationkey::DOUBLE, 1.0::DOUBLE, 0.0, 0.0, 0.0, 0.0, 0.0] AS v FROM supplier)"


@query(f"{SLOT} SELECT s_suppkey, round(v[4], 6) + 0.0 AS a, round(v[3], 6) + 0.0 AS b, round(v[1], 6) + 0.0 AS c FROM s")
def q_slot_rotate(spark, sf):
    r = slot_rows(spark, sf).withColumn("l", emulator.rotated(F.col("v"), 3, SLOTS)).withColumn("r", emulator.rotated(F.col("v"), -6, SLOTS))
    return r.select("s_suppkey", rounded(F.col("l")[0]).alias("a"), rounded(F.col("r")[0]).alias("b"), rounded(F.col("l")[5]).alias("c"))


@query(f"{SLOT} SELECT s_suppkey, round(v[1] + v[2] + v[3], 6) + 0.0 AS total FROM s")
def q_slot_sum(spark, sf):
    return slot_rows(spark, sf).select("s_suppkey", rounded(emulator.sum_slots(F.col("v"), 3, SLOTS)[0]).alias("total"))


@query(f"{SLOT} SELECT s_suppkey, round(4 * v[1], 6) + 0.0 AS total, 0.0::DOUBLE AS beyond FROM s")
def q_slot_replicate(spark, sf):
    only = F.concat(F.slice("v", 1, 1), F.array_repeat(F.lit(0.0), SLOTS - 1))
    r = slot_rows(spark, sf).withColumn("r", emulator.replicate_first(only, 3, SLOTS))
    total = F.aggregate(F.slice("r", 1, 4), F.lit(0.0), lambda a, x: a + x)
    return r.select("s_suppkey", rounded(total).alias("total"), rounded(F.col("r")[4]).alias("beyond"))


def _chebyshev(name: str, f: Callable[[float], float], degree: int) -> None:
    c = emulator.chebyshev(f, 0.5, 2.0, degree)
    powers = np.polynomial.chebyshev.cheb2poly(c)
    sql = " + ".join(f"({float(a)!r}) * pow(t, {i})" for i, a in enumerate(powers))

    def run(spark: SparkSession, sf: str) -> DataFrame:
        t = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", (0.5 + 1.5 * (F.col("s_suppkey") % 100) / 100).alias("x"))
        return t.select("s_suppkey", rounded(emulator.clenshaw(F.col("x"), c, 0.5, 2.0)).alias("value"))

    run.__name__ = name
    query(f"SELECT s_suppkey, round({sql}, 6) + 0.0 AS value FROM (SELECT s_suppkey, (2 * (0.5 + 1.5 * (s_suppkey % 100) / 100) - 2.5) / 1.5 AS t FROM supplier)")(run)


_chebyshev("q_cheby_inv", lambda x: 1 / x, 8)
_chebyshev("q_cheby_sqrt", lambda x: x**0.5, 8)


@query(f"{FED} SELECT class_idx, {R(W4)} FROM fed")
def q_emul_fedavg(spark, sf):
    m = federated.client_models(spark, sf).select("class_idx", emulator.packed(F.array(*W4), SLOTS).alias("v"))
    summed = m.select("class_idx", F.posexplode("v").alias("slot", "x")).groupBy("class_idx", "slot").agg((F.sum("x") * F.lit(0.1)).alias("x"))
    return summed.groupBy("class_idx").agg(*[rounded(F.max(F.when(F.col("slot") == i, F.col("x")))).alias(w) for i, w in enumerate(W4)])


@query(f"{SCORED} SELECT class_idx, count(*) AS n, round(sum(score), 3) + 0.0 AS total FROM scored GROUP BY class_idx")
def q_emul_score_batched(spark, sf):
    m = federated.global_model(spark, sf).select("class_idx", "b", emulator.packed(F.array(*W4), SLOTS).alias("w"))
    rows = scaled_ovr(spark, sf).select("class_idx", emulator.packed(F.array(*X), SLOTS).alias("v"))
    product = emulator.slotwise(lambda a, v: a * v, F.col("w"), F.col("v"))
    scores = rows.join(F.broadcast(m), "class_idx").select("class_idx", (F.col("b") + emulator.sum_slots(product, 4, SLOTS)[0]).alias("score"))
    return scores.groupBy("class_idx").agg(F.count("*").alias("n"), rounded(F.sum("score"), 3).alias("total"))


def small_clients(spark: SparkSession, sf: str) -> DataFrame:
    """All suppliers, forty a client: dense solvers see one client's rows at a time."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    return s.select(F.floor((F.col("s_suppkey") - 1) / 40).cast("int").alias("client_id"), ((F.col("s_acctbal") - 5000) / 3000).alias("x0"), ((F.col("s_suppkey") % 11) / 11 - 0.5).alias("x1"), prep.sign(F.col("s_suppkey") % 3 == 0).alias("y"))


SMALL = f"""WITH rows_ AS (SELECT floor((s_suppkey - 1) / 40)::INT AS client_id, (s_acctbal - 5000) / 3000 AS x0, (s_suppkey % 11) / 11 - 0.5::DOUBLE AS x1, CASE WHEN s_suppkey % 3 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM supplier),
ms AS (SELECT client_id, count(*) AS n, sum(y) AS sy, {', '.join(f'sum(x{i}) AS s{i}, sum(x{i} * y) AS p{i}' for i in range(2))}, {', '.join(f'sum(x{i} * x{j}) AS g{i}_{j}' for i, j in training.upper(2))} FROM rows_ GROUP BY client_id),
{elimination_sql('ms', 'client_id', 2, 1.1, 'models')}"""


def _dense(name: str, backend: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return solvers.client_models(small_clients(spark, sf), ["client_id"], ["x0", "x1"], 1.1, backend).select("client_id", "n", *[rounded(c, 5).alias(c) for c in ("b", "w0", "w1")])

    run.__name__ = name
    query(f"{SMALL} SELECT client_id, n, {R(['b', 'w0', 'w1'], 5)} FROM models")(run)


_dense("q_qr_solver", "qr")
_dense("q_cg_solver", "cg")


@query()
def q_gcv(spark, sf):
    return federated.tuned_gammas(spark, sf)


LOG_LINES = ["[worker 1/4] Context loaded in 152.3s", "  [worker 1/4 class 0 client 1] Resuming from checkpoint a/b", "  [worker 1/4 class 1 client 9] FHE solve: 551.2s", "  [worker 1/4 class 2 baseline] FHE solve: 700.0s", "[worker 1/4] DONE: 2 solved, 1 resumed, 21.0min total", "[worker 1/4] PEAK RSS: 812.5 MiB"]


@query("SELECT * FROM (VALUES (0, '1', NULL::DOUBLE), (1, '9', 551.2::DOUBLE), (2, 'baseline', 700.0::DOUBLE)) t(class_idx, client, seconds)")
def q_log_parse(spark, sf):
    lines = spark.createDataFrame([("worker_1.log", i, x) for i, x in enumerate(LOG_LINES)], "file string, line_no int, line string")
    return runlog.worker_tasks(lines).drop("file")


@query("SELECT * FROM (VALUES (0, '0', 397.6::DOUBLE, 'finalize'), (0, '1', NULL, 'worker_1'), (1, '9', 560.0, 'worker_1'), (2, 'baseline', 700.0, 'worker_2')) t(class_idx, client, seconds, worker)")
def q_times_merge(spark, sf):
    w = spark.createDataFrame([("worker_1", 0, "1", None), ("worker_1", 1, "9", 551.2), ("worker_2", 2, "baseline", 700.0), ("worker_2", 1, "9", None)], "file string, class_idx int, client string, seconds double")
    f = spark.createDataFrame([(0, "0", 397.6), (0, "1", None), (1, "9", 560.0)], "class_idx int, client string, seconds double")
    return runlog.merged_times(w, f)


@query("SELECT 2::BIGINT AS n_clients, 1000::BIGINT AS total_bytes, 500.0::DOUBLE AS mean_bytes, 1 AS rounds")
def q_comm_bytes(spark, sf):
    rows = [(f"m/class_0/client_{c}/{f}", n) for c in ("0", "1") for f, n in (("weights.bin", 400), ("bias.bin", 100))] + [("m/class_0/baseline/weights.bin", 9999), ("m/class_0/client_0/other.txt", 7)]
    return runlog.communication(spark.createDataFrame(rows, "path string, length long"))


@query("SELECT * FROM (VALUES (0, '2', 0), (0, '10', 1), (0, '12345', 2), (0, 'baseline', 3), (1, '1', 4)) t(class_idx, client, position)")
def q_report_order(spark, sf):
    rows = spark.createDataFrame([(1, "1"), (0, "baseline"), (0, "10"), (0, "2"), (0, "12345")], "class_idx int, client string")
    ordered = runlog.report_order(rows).withColumn("position", F.row_number().over(Window.orderBy("class_idx", F.col("client") == "baseline", F.when(F.length("client") < 4, F.lpad("client", 4, "0")).otherwise(F.col("client")))) - 1)
    return ordered


@query("SELECT * FROM (VALUES ('k40', 'iid', NULL::DOUBLE, 0, 96.67::DOUBLE), ('k40d', 'dirichlet', 0.5, 0, 93.33), ('k40d', 'dirichlet', 0.5, 1, 90.0)) t(config, partition, alpha, class, accuracy_pct)")
def q_campaign_union(spark, sf):
    schema = "class int, accuracy_pct double"
    runs = [("k40", "iid", None, [(0, 96.67)]), ("k40d", "dirichlet", 0.5, [(0, 93.33), (1, 90.0)])]
    out = None
    for config, partition, alpha, rows in runs:
        part = spark.createDataFrame(rows, schema).select(F.lit(config).alias("config"), F.lit(partition).alias("partition"), F.lit(alpha).cast("double").alias("alpha"), "class", "accuracy_pct")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT * FROM (VALUES (0, 124), (1, 44), (2, NULL::INT), (3, NULL::INT)) t(id, depth)")
def q_marker_depth(spark, sf):
    t = spark.createDataFrame([(0, "schema_version=1\ndepth=124\n"), (1, '{"depth": 44}'), (2, "{}"), (3, None)], "id int, marker string")
    return t.select("id", readers.marker_depth(F.col("marker")).alias("depth"))


@query("SELECT 48::BIGINT AS depth_naive, 45::BIGINT AS depth_first_modulus")
def q_compared_scheme(spark, sf):
    return readers.compared_scheme(spark).select("depth_naive", "depth_first_modulus")


@query("SELECT * FROM (VALUES (0, 5.1::DOUBLE, 0.2::DOUBLE, 4)) t(id, first, last, n)")
def q_sample_parse(spark, sf):
    t = spark.createDataFrame([(0, "5.1,3.5, 1.4,0.2")], "id int, sample string").withColumn("x", readers.parsed_sample(F.col("sample")))
    return t.select("id", F.get("x", F.lit(0)).alias("first"), F.element_at("x", -1).alias("last"), F.size("x").alias("n"))
