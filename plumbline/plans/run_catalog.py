"""Queries over whole runs: training by class, partition dispatch, guards, depth, reports. They join the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import features as ff
from plumbline.operators import clients, emulator, guards, prep, runlog, solvers, training
from plumbline.plans import training_path
from plumbline.plans.catalog import LOG_LINES, RAW, _map_sql, elimination_sql, query, rounded
from plumbline.sources import readers

SPLIT = f"""WITH {RAW},
keyed AS (SELECT *, l_orderkey * 8 + l_linenumber AS key FROM raw),
cut AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY key) % 5 = 0 AS is_test FROM keyed),
st AS (SELECT {', '.join(f'avg(r{i}) AS m{i}, stddev_pop(r{i}) AS d{i}' for i in range(4))} FROM cut WHERE NOT is_test),
z AS MATERIALIZED (SELECT key, label, client_id, is_test, {', '.join(f'(r{i} - m{i}) / CASE WHEN d{i} = 0 THEN 1 ELSE d{i} END AS x{i}' for i in range(4))} FROM cut, st)"""


def kernel_sql(kernel: str, classes: str) -> str:
    """CTEs of the path of one kernel; the last is ``<kernel>_out``."""
    degree, homogeneous = ff.KERNEL_MAPS[kernel]
    terms = _map_sql(4, degree, None if homogeneous else 1.0)
    d, k = len(terms), kernel
    norm = f"sqrt({' + '.join(f'c{i} * c{i}' for i in range(d))})"
    gamma = readers.GAMMAS[kernel]
    return f"""{k}_f AS (SELECT *, {', '.join(f'{t} AS t{i}' for i, t in enumerate(terms))} FROM z),
{k}_u AS (SELECT {', '.join(f'avg(t{i}) AS u{i}' for i in range(d))} FROM {k}_f WHERE NOT is_test),
{k}_c AS (SELECT key, label, client_id, is_test, {', '.join(f't{i} - u{i} AS c{i}' for i in range(d))} FROM {k}_f, {k}_u),
{k}_n AS (SELECT *, CASE WHEN {norm} < 1e-12 THEN 1 ELSE {norm} END AS nn FROM {k}_c),
{k}_p AS MATERIALIZED (SELECT key, client_id, is_test, c AS class_idx, CASE WHEN label = c THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, {', '.join(f'c{i} / nn AS x{i}' for i in range(d))}
  FROM {k}_n, (SELECT unnest([{classes}])::INT AS c) q),
{k}_m AS MATERIALIZED (SELECT class_idx, client_id, count(*) AS n, sum(y) AS sy, {', '.join(f'sum(x{i}) AS s{i}, sum(x{i} * y) AS p{i}' for i in range(d))},
  {', '.join(f'sum(x{i} * x{j}) AS g{i}_{j}' for i, j in training.upper(d))} FROM {k}_p WHERE NOT is_test GROUP BY ALL),
{elimination_sql(f'{k}_m', 'class_idx, client_id', d, gamma, f'{k}_models').replace(' AS (', ' AS MATERIALIZED (')},
{k}_fed AS (SELECT class_idx, avg(b) AS b, {', '.join(f'avg(w{i}) AS w{i}' for i in range(d))} FROM {k}_models GROUP BY class_idx),
{k}_s AS MATERIALIZED (SELECT is_test, class_idx, y, b + {' + '.join(f'w{i} * x{i}' for i in range(d))} AS score FROM {k}_p JOIN {k}_fed USING (class_idx)),
{k}_t AS (SELECT class_idx, coalesce(0.5 * (avg(score) FILTER (y = 1) + avg(score) FILTER (y = -1)), 0) AS threshold FROM {k}_s WHERE NOT is_test GROUP BY class_idx),
{k}_out AS (SELECT class_idx, '{kernel}' AS kernel, {d} AS n_features, round(threshold, 5) + 0.0 AS threshold,
  count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = -1) AS fp,
  count(*) FILTER (score < threshold AND y = 1) AS fn, count(*) FILTER (score < threshold AND y = -1) AS tn
  FROM {k}_s JOIN {k}_t USING (class_idx) WHERE is_test GROUP BY class_idx, threshold)"""


@query(f"{SPLIT},\n{kernel_sql('linear', '0')},\n{kernel_sql('poly', '1, 2')}\nSELECT * FROM linear_out UNION ALL SELECT * FROM poly_out")
def q_class_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return training_path.class_pipeline(spark, sf).withColumn("threshold", rounded("threshold", 5))


@query("SELECT c::INT AS class_idx, CASE WHEN c IN (1, 2) THEN 'poly' ELSE 'linear' END AS kernel, CASE WHEN c IN (1, 2) THEN 15 ELSE 4 END AS n_features, 15 AS max_features FROM range(0, 4) t(c)")
def q_kernel_dims(spark: SparkSession, sf: str) -> DataFrame:
    classes = spark.range(4).select(F.col("id").cast("int").alias("class_idx")).withColumn("kernel", readers.kernel_of(F.col("class_idx")))
    widths = {k: ff.width(4, *m) for k, m in ff.KERNEL_MAPS.items()}
    known = F.create_map(*[F.lit(x) for pair in widths.items() for x in pair])
    return classes.withColumn("n_features", known[F.col("kernel")]).withColumn("max_features", F.lit(ff.max_width(4, ["linear", "poly"])))


@query(f"{SPLIT}, tile AS (SELECT label, ntile(40) OVER (PARTITION BY label ORDER BY key) - 1 AS c FROM z WHERE NOT is_test) SELECT c::INT AS client_id, count(*) AS n FROM tile GROUP BY c")
def q_partition_all(spark: SparkSession, sf: str) -> DataFrame:
    return training_path.partitioned_sizes(spark, sf, 40, "iid")


DIMS = [("128", 30, 15, 900), ("128", 40, 15, 1300), ("128", 20, 45, 600), ("notset", 400, 400, 9000)]


@query(f"SELECT security, max_client_n, CASE WHEN security <> '128' THEN NULL WHEN max_client_n > 32 THEN 'client rows exceed the slots; use at least ' || ceil(max_train / 31.0)::BIGINT || ' clients' WHEN max_feat_dim > 32 THEN 'features exceed the slots' END AS problem FROM (VALUES {', '.join(map(str, DIMS))}) t(security, max_client_n, max_feat_dim, max_train)")
def q_slots_guard(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.createDataFrame(DIMS, "security string, max_client_n int, max_feat_dim int, max_train int")
    return t.select("security", "max_client_n", guards.slots_problem(*[F.col(c) for c in ("security", "max_client_n", "max_feat_dim", "max_train")]).alias("problem"))


CONTEXTS = [(2, True, 200, "notset"), (0, False, 300, "notset"), (1, True, 150, "notset"), (3, True, 300, "128"), (4, True, 400, "notset")]


@query(f"SELECT class_idx, depth FROM (VALUES {', '.join(map(str, CONTEXTS))}) t(class_idx, complete, depth, security) WHERE complete AND depth >= 172 AND security = 'notset' ORDER BY class_idx LIMIT 1")
def q_context_reuse(spark: SparkSession, sf: str) -> DataFrame:
    return guards.reusable_context(spark.createDataFrame(CONTEXTS, "class_idx int, complete boolean, depth int, security string"), 172, "notset").select("class_idx", "depth")


LEVELS = [(0, 40, "notset"), (31, 172, "notset"), (86, 172, "notset"), (172, 172, "128")]
LEVEL_SQL = f"(VALUES {', '.join(map(str, LEVELS))}) t(level, estimate, security)"


@query(f"""SELECT level, budget, level AS consumed, budget - level AS remaining, round(100.0::DOUBLE * level / budget, 1) AS percent,
  repeat('#', floor(20 * least(level / budget, 1))::INT) || repeat('.', 20 - floor(20 * least(level / budget, 1))::INT) AS bar,
  CASE WHEN level >= 40 THEN 4 ELSE level END AS refreshed, CASE WHEN security = '128' THEN 32 ELSE ring // 2 END AS slots, 60 + 50 * budget AS modulus_bits
FROM (SELECT *, greatest(1024, pow(2, ceil(log2(2.0 * (60 + 50 * budget)))))::BIGINT AS ring FROM (SELECT *, CASE WHEN security = '128' THEN 25 ELSE estimate + 6 END::BIGINT AS budget FROM {LEVEL_SQL}))""")
def q_depth_report(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.createDataFrame(LEVELS, "level int, estimate int, security string")
    t = t.withColumn("budget", emulator.context_depth(F.col("estimate"), F.col("security")).cast("long"))
    return t.select("level", "budget", *[c.alias(n) for n, c in emulator.depth_report(F.col("level"), F.col("budget")).items()], emulator.refreshed(F.col("level"), 40, 4).alias("refreshed"), emulator.slot_count(F.col("budget"), F.col("security")).alias("slots"), emulator.modulus_bits(F.col("budget")).alias("modulus_bits"))


@query("SELECT s_suppkey, ((row_number() OVER (ORDER BY s_suppkey) - 1) // 7)::BIGINT AS chunk, ((row_number() OVER (ORDER BY s_suppkey) - 1) % 7)::BIGINT AS slot FROM supplier")
def q_test_chunks(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey")
    return clients.test_chunks(t, "s_suppkey", 7).select("s_suppkey", F.col("chunk").cast("long").alias("chunk"), F.col("slot").cast("long").alias("slot"))


@query("SELECT (s_nationkey % 3)::INT AS class_idx, round(sum(a * y * s_acctbal / 1000), 6) + 0.0 AS w0, round(sum(a * y * s_nationkey), 6) + 0.0 AS w1 FROM (SELECT *, 1.0::DOUBLE / (1 + s_suppkey) AS a, CASE WHEN s_acctbal > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM supplier) GROUP BY 1")
def q_primal_weights(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/supplier.parquet")
    rows = t.select((F.col("s_nationkey") % 3).cast("int").alias("class_idx"), (1.0 / (1 + F.col("s_suppkey"))).alias("alpha"), prep.sign(F.col("s_acctbal") > 0).alias("y"), (F.col("s_acctbal") / 1000).alias("x0"), F.col("s_nationkey").cast("double").alias("x1"))
    return training.primal_weights(rows, ["class_idx"], ["x0", "x1"]).select("class_idx", rounded("w0").alias("w0"), rounded("w1").alias("w1"))


GRID = [0.001, 0.1, 1.1, 30.0]


@query(f"""WITH {RAW},
st AS (SELECT avg(r0) AS m0, stddev_pop(r0) AS d0, avg(r2) AS m2, stddev_pop(r2) AS d2 FROM raw),
o AS (SELECT (r0 - m0) / d0 AS x, (r2 - m2) / d2 AS z, c AS class_idx, CASE WHEN label = c THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM raw, st, (SELECT unnest(range(0, 3))::INT AS c)),
m AS (SELECT class_idx, count(*) AS n, sum(x * y) AS p, sum(z * y) AS q, sum(x * x) AS a, sum(x * z) AS b, sum(z * z) AS c FROM o GROUP BY class_idx),
s AS (SELECT *, 1.0 / gamma AS l, (a + 1.0 / gamma) * (c + 1.0 / gamma) - b * b AS det FROM m, (SELECT unnest({GRID}::DOUBLE[]) AS gamma)),
w AS (SELECT *, ((c + l) * p - b * q) / det AS u, ((a + l) * q - b * p) / det AS v, ((c + l) * a + (a + l) * c - 2 * b * b) / det AS tr FROM s)
SELECT class_idx, gamma, round((n - 2 * (u * p + v * q) + u * u * a + 2 * u * v * b + v * v * c) / n / pow(1 - tr / n, 2), 8) AS gcv FROM w""")
def q_gcv_curve(spark: SparkSession, sf: str) -> DataFrame:
    """From one row of moments a class; the residual by eigenvalues equals the closed form of the 2 x 2 solve."""
    rows = training.one_vs_rest_moments(readers.scaled_lineitem(spark, sf), [], ["x0", "x2"], "label", 3).collect()
    out = [(r["class_idx"], g, round(v, 8)) for r in rows for g, v in zip(GRID, solvers.gcv_curve(r.asDict(), 2, float(r["n"]), GRID))]
    return spark.createDataFrame(out, "class_idx int, gamma double, gcv double")


@query("SELECT count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM (SELECT s_suppkey % 5 <> 0 AND s_acctbal > 3000 AS p, s_nationkey < 12 AS t FROM supplier)")
def q_confusion_nan(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/supplier.parquet")
    pred = F.when(F.col("s_suppkey") % 5 == 0, F.lit(float("nan"))).when(F.col("s_acctbal") > 3000, 1.0).otherwise(-1.0)
    return training.confusion_of_all(t.select(pred.alias("pred"), prep.sign(F.col("s_nationkey") < 12).alias("y")), [])


TIMES = [(0, "0", 10.0), (0, "1", 30.5), (0, "2", None), (0, "baseline", 100.0), (1, "0", None), (1, "baseline", None)]


@query("""SELECT class_idx, min(seconds) FILTER (client <> 'baseline') AS min_s, avg(seconds) FILTER (client <> 'baseline') AS avg_s, max(seconds) FILTER (client <> 'baseline') AS max_s, nullif(coalesce(sum(seconds), 0), 0) AS total_s
FROM (VALUES (0, '0', 10.0::DOUBLE), (0, '1', 30.5), (0, '2', NULL), (0, 'baseline', 100.0), (1, '0', NULL), (1, 'baseline', NULL)) t(class_idx, client, seconds) GROUP BY class_idx""")
def q_solve_times(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.solve_totals(spark.createDataFrame(TIMES, "class_idx int, client string, seconds double"))


RESULT_LINES = [*LOG_LINES, "--- Class 1 (b vs rest) ---", "FHE fed weights vs plaintext fed weights: 1.5e-07", "Multiclass Accuracy (Federated):  93.33%", "Multiclass Accuracy (Baseline): 96.67%", "Multiclass Accuracy (Federated): 95.00%"]
RESULT_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(RESULT_LINES)) + ") t(i, line))"


@query(f"SELECT approach, arg_max(pct, i) AS accuracy_pct FROM (SELECT i, regexp_extract(line, 'Accuracy [(](.+?)[)]', 1) AS approach, regexp_extract(line, ': +([0-9.]+)%', 1)::DOUBLE AS pct FROM {RESULT_SQL} WHERE line LIKE 'Multiclass%') GROUP BY approach")
def q_multiclass_lines(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.multiclass_accuracies(spark.createDataFrame([("finalize.log", i, x) for i, x in enumerate(RESULT_LINES)], "file string, line_no int, line string"))


@query(f"SELECT 1 AS class_idx, regexp_extract(line, ': ([0-9.eE+-]+)', 1)::DOUBLE AS rel_err FROM {RESULT_SQL} WHERE line LIKE '%plaintext fed weights%'")
def q_weight_error_lines(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.weight_errors(spark.createDataFrame([("finalize.log", i, x) for i, x in enumerate(RESULT_LINES)], "file string, line_no int, line string"))
