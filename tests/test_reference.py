"""Federated least squares: catalog against DuckDB, invariants, and the dense dual solve as an oracle."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import features as ff
from plumbline.operators import clients, emulator, guards, prep, runlog, solvers, training
from plumbline.plans import catalog, federated, run_catalog, training_path
from plumbline.sources import readers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, duck, name, tmp_path):
    catalog.QUERIES[name](spark, SF).write.parquet(f"file://{tmp_path}/out")
    duck.sql(f"CREATE OR REPLACE VIEW got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    if name in catalog.ORACLES:
        duck.sql(f"CREATE OR REPLACE TABLE want AS {catalog.ORACLES[name]}")
        columns = ", ".join(f'"{r[0]}"' for r in duck.sql("DESCRIBE want").fetchall())
        assert {r[0] for r in duck.sql("DESCRIBE got").fetchall()} == {r[0] for r in duck.sql("DESCRIBE want").fetchall()}
        for a, b in (("got", "want"), ("want", "got")):
            assert not duck.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall()[:3]
    else:
        assert duck.sql("SELECT count(*) FROM got").fetchall()[0][0]


def dual(phi, y, gamma):
    h, rhs = solvers.kkt(phi, y, gamma)
    x = np.linalg.solve(h, rhs)
    return x[0], phi.T @ (x[1:] * y), x[1:]


def frame_of(spark, phi, y, client):
    d = phi.shape[1]
    return spark.createDataFrame([(int(c), *map(float, p), float(t)) for c, p, t in zip(client, phi, y)], "client_id int, " + ", ".join(f"x{i} double" for i in range(d)) + ", y double")


@pytest.mark.parametrize("seed,gamma", [(s, g) for s in (0, 1, 7, 42) for g in (1.1, 3.9, 0.5)])
def test_primal_sums_equal_the_dual_solve(spark, seed, gamma):
    rng = np.random.default_rng(seed)
    phi, y = rng.standard_normal((43, 6)), np.where(rng.random(43) < 0.3, 1.0, -1.0)
    client = np.r_[np.zeros(20), np.ones(19), np.full(3, 2), 3].astype(int)
    y[42] = -1.0  # one row, one class
    df = frame_of(spark, phi, y, client).repartition(3)
    got = training.solved(training.moments(df, ["client_id"], [f"x{i}" for i in range(6)]), ["client_id"], 6, gamma).collect()
    assert len(got) == 4
    for r in got:
        at = client == r["client_id"]
        b, w, alpha = dual(phi[at], y[at], gamma)
        assert abs(r["b"] - b) < 1e-10 and np.allclose([r[f"w{i}"] for i in range(6)], w, atol=1e-10)
        score = phi[at] @ w + b
        assert np.allclose(y[at] * gamma * (1 - b * y[at] - (score - b)), alpha, atol=1e-9)
    with pytest.raises(ValueError):
        training.solved(df, [], 6, 0.0)


def test_backends_agree(spark):
    rng = np.random.default_rng(3)
    phi, y = rng.standard_normal((40, 3)), np.where(rng.random(40) < 0.4, 1.0, -1.0)
    df = frame_of(spark, phi, y, np.arange(40) % 2)
    for backend in ("qr", "cg"):
        for r in solvers.client_models(df, ["client_id"], ["x0", "x1", "x2"], 1.1, backend).collect():
            at = np.arange(40) % 2 == r["client_id"]
            b, w, _ = dual(phi[at], y[at], 1.1)
            assert np.allclose([r["b"], r["w0"], r["w1"], r["w2"]], [b, *w], atol=1e-6)


def test_householder_sign_avoids_cancellation():
    a = np.array([[-1.0, 2.0, 0.5], [1e-3, 1.0, 0.2], [1e-3, 0.3, 2.0]])
    q, r = solvers.householder_qr(a)
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(3)) and np.allclose(np.tril(r, -1), 0, atol=1e-14)
    assert solvers.back_substituted(np.array([[1.0, 1.0], [0.0, 1e-12]]), np.array([2.0, 3.0])).tolist() == [2.0, 0.0]


@pytest.mark.parametrize("degree,c", [(2, 1.0), (3, 0.5), (2, None), (3, None)])
def test_kernel_maps_reproduce_kernels(spark, degree, c):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((5, 3))
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    rows = np.array([list(r) for r in df.select(*ff.kernel_map([F.col(v) for v in "abc"], degree, c)).collect()])
    assert rows.shape[1] == ff.width(3, degree, c is None)
    assert np.allclose(rows @ rows.T, (x @ x.T + (c or 0)) ** degree)


def test_gcv_from_moments_equals_the_hat_matrix():
    rng = np.random.default_rng(2)
    phi, y = rng.standard_normal((30, 4)), np.sign(rng.standard_normal(30))
    g, p = phi.T @ phi, phi.T @ y
    e, u = np.linalg.eigh(g)
    for gamma in (0.1, 1.0, 20.0):
        hat = phi @ np.linalg.solve(g + np.eye(4) / gamma, phi.T)
        want = np.sum((y - hat @ y) ** 2) / 30 / (1 - np.trace(hat) / 30) ** 2
        assert math.isclose(solvers.gcv(gamma, e, (u.T @ p) ** 2 / e, float(y @ y), 30), want, rel_tol=1e-9)
    row = {"n": 30, **{f"p{i}": p[i] for i in range(4)}, **{f"g{i}_{j}": g[i, j] for i in range(4) for j in range(i, 4)}}
    best, value = solvers.best_gamma(row, 4, float(y @ y))
    assert all(value <= solvers.gcv(t, e, (u.T @ p) ** 2 / e, float(y @ y), 30) + 1e-9 for t in np.geomspace(1e-6, 1e3, 200))
    assert 1e-6 <= best <= 1e3


@pytest.mark.parametrize("rows,k", [((40, 40), 5), ((30, 30), 7), ((6, 60), 8), ((3, 2), 5)])
def test_partitions_are_complete_and_capped(spark, rows, k):
    labels = [1] * rows[0] + [0] * rows[1]
    df = spark.createDataFrame(list(enumerate(labels)), "id long, g int")
    iid = clients.iid(df, ["g"], "id", k)
    for g in (0, 1):
        sizes = {r["client_id"]: r["count"] for r in iid.where(F.col("g") == g).groupBy("client_id").count().collect()}
        assert [sizes.get(c, 0) for c in range(k)] == [len(x) for x in np.array_split(np.arange(labels.count(g)), k)]
    skewed = clients.by_shares(df, "g", "id", clients.dirichlet_shares(k, 0.1, 2))
    capped = clients.capped(skewed, "id", k)
    filled = clients.backfilled(capped, "id", k)
    for part in (skewed, capped, filled):
        assert sorted(r["id"] for r in part.collect()) == list(range(len(labels)))
    cap = max(4, -(-len(labels) // k))
    assert capped.groupBy("client_id").count().agg(F.max("count")).first()[0] <= cap
    assert filled.select("client_id").distinct().count() == k
    with pytest.raises(ValueError):
        clients.backfill_moves([1, 0, 0])


def test_threshold_and_signs(spark):
    s = spark.createDataFrame([(0, 1.0, 2.0), (0, 1.0, 4.0), (0, -1.0, -1.0), (1, 1.0, 5.0)], "class_idx int, y double, score double")
    assert {r["class_idx"]: r["threshold"] for r in training.threshold(s, ["class_idx"]).collect()} == {0: 1.0, 1: 0.0}
    v = spark.createDataFrame([(0.0,), (-1.0,), (float("nan"),)], "s double").select(training.predicted_sign(F.col("s"))).collect()
    assert v[0][0] == 1 and v[1][0] == -1 and math.isnan(v[2][0])
    none = training.precision_recall_f1(spark.createDataFrame([(0, 0, 0, 3)], "tp long, fp long, fn long, tn long")).first()
    assert (none["precision"], none["recall"], none["f1"], none["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_first_class_wins_ties(spark):
    model = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 0.0)], "class_idx int, b double, w0 double")
    assert training.with_class_scores(spark.createDataFrame([(3.0,)], "x double"), model, ["x"]).first()["pred_class"] == 0


def test_scores_tie_to_nine_digits(spark):
    model = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0 + 4e-10, 0.0), (2, 1.0 + 4e-10, 1.0)], "class_idx int, b double, w0 double")
    rows = spark.createDataFrame([(0.0,), (1e-8,), (-1.0,), (None,), (float("nan"),)], "x double")
    assert [r["pred_class"] for r in training.with_class_scores(rows, model, ["x"]).collect()] == [0, 2, 0, 0, 0]


@pytest.mark.parametrize("name", ["q_ovr_argmax", "q_accuracy_ovr"])
def test_equal_rows_and_rows_without_features_match_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * FROM '{SF}/lineitem.parquet' UNION ALL SELECT * FROM '{SF}/lineitem.parquet' WHERE l_suppkey % 3 = 0 UNION ALL SELECT * REPLACE (NULL::DOUBLE AS l_tax, 9000000 + l_orderkey AS l_orderkey) FROM '{SF}/lineitem.parquet' WHERE l_quantity = 7) TO '{tmp_path}/lineitem.parquet'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_text_statistics_find_low_quality(spark):
    row = federated.text_quality(spark, "/root/testdata/sf0.01").first()
    assert row["accuracy"] > 0.9


def test_logs_and_markers(spark, tmp_path):
    (tmp_path / "worker_1.log").write_text("\n".join(catalog.LOG_LINES))
    final = ["--- Class 0 (setosa vs rest) [kernel=linear] ---", "  [client 0] FHE solve: 397.6s", "  [client 1] Resuming from checkpoint x", "  --- Class 0 (setosa vs rest) comparison (k=40) ---", "  Approach   | Accuracy  | Precision | F1", "  Federated (40 clients avg.)  | 100.00% |  99.50% | 98.00%"]
    (tmp_path / "finalize.log").write_text("\n".join(final))
    lines = runlog.numbered_lines(spark, f"file://{tmp_path}/*.log").cache()
    assert {r["line_no"] for r in lines.where("file = 'finalize.log'").collect()} == set(range(len(final)))
    worker, done = lines.where("file like 'worker%'"), lines.where("file = 'finalize.log'")
    total = runlog.worker_totals(worker).first()
    assert (total["context_s"], total["peak_rss_mib"], total["solved"], total["resumed"]) == (152.3, 812.5, 2, 1)
    assert [tuple(r) for r in runlog.finalize_metrics(done).collect()] == [(0, "Federated (40 clients avg.)", 100.0, 99.5, 98.0)]
    merged = {(r["class_idx"], r["client"]): (r["seconds"], r["worker"]) for r in runlog.merged_times(runlog.worker_tasks(worker), runlog.finalize_times(done)).collect()}
    assert merged == {(0, "0"): (397.6, "finalize"), (0, "1"): (None, "worker_1.log"), (1, "9"): (551.2, "worker_1.log"), (2, "baseline"): (700.0, "worker_1.log")}
    for d, n in (("class_0/client_0", 400), ("class_0/baseline", 9)):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "weights.bin").write_bytes(b"x" * n)
    assert tuple(runlog.communication(readers.file_sizes(spark, f"file://{tmp_path}/class_0")).first()) == (1, 400, 400.0, 1)


def test_slot_emulator(spark):
    v = spark.createDataFrame([([1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0],)], "v array<double>")
    assert v.select(emulator.rotated(F.col("v"), -1, 8)).first()[0][1] == 1.0
    for f, degree, bound in ((lambda x: 1 / x, 8, 1e-3), (math.sqrt, 8, 1e-4)):
        c = emulator.chebyshev(f, 0.5, 2.0, degree)
        xs = spark.createDataFrame([(float(x),) for x in np.linspace(0.5, 2, 40)], "x double")
        assert all(abs(r[1] - f(r[0])) < bound * f(r[0]) for r in xs.select("x", emulator.clenshaw(F.col("x"), c, 0.5, 2.0)).collect())


def test_unknown_dataset(spark):
    with pytest.raises(ValueError):
        readers.dataset(spark, "nothing", SF)


def test_ranks_do_not_depend_on_ranges(spark):
    df = spark.createDataFrame([(i * 7 % 101, i % 3) for i in range(101)], "id long, g int")
    for width in (1, 10, 10**6):
        got = {(r["g"], r["id"]): (r["rank"], r["group_n"]) for r in prep.ranked(df, ["g"], "id", width).collect()}
        for g in range(3):
            ids = sorted(i for gg, i in got if gg == g)
            assert all(got[g, i] == (k + 1, len(ids)) for k, i in enumerate(ids))


def test_store_resumes_and_validates(spark, tmp_path):
    from plumbline.sources import store

    root = f"file://{tmp_path}"
    models = spark.createDataFrame([(0, 0, 1.0, 2.0), (0, 1, float("nan"), 1.0), (1, 0, 0.5, 0.5)], "class_idx int, client_id int, b double, w0 double")
    store.save_client_models(models, root)
    store.save_client_models(models.where("class_idx = 1"), root)
    saved = spark.read.parquet(f"{root}/clients")
    assert saved.count() == 3
    tasks = spark.range(4).selectExpr("cast(id / 2 as int) class_idx", "cast(id % 2 as int) client_id")
    assert sorted(map(tuple, store.open_tasks(tasks, saved, ["w0"]).collect())) == [(0, 1), (1, 1)]
    store.save_global_model(training.averaged(models.where("class_idx = 1"), 1), root, "primal:linear", "moments")
    assert store.load_global_model(spark, root, "moments").first()["w0"] == 0.5
    with pytest.raises(ValueError):
        store.load_global_model(spark, root, "qr")
    for _ in range(2):
        store.append_metrics(models, root)
    assert spark.read.parquet(f"{root}/metrics").count() == 6


def test_stream_gives_the_batch_models(spark, tmp_path):
    from plumbline.streaming import incremental

    rng = np.random.default_rng(9)
    df = frame_of(spark, rng.standard_normal((60, 2)), np.sign(rng.standard_normal(60)), np.arange(60) % 3)
    df.repartition(4).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"file://{tmp_path}/in")
    sums = incremental.streaming_moments(stream, ["client_id"], ["x0", "x1"])
    incremental.write_models(sums, ["client_id"], 2, 1.1, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination(120)
    last = spark.read.parquet(f"file://{tmp_path}/out").withColumn("k", F.row_number().over(Window.partitionBy("client_id").orderBy(F.desc("batch")))).where("k = 1")
    want = {r["client_id"]: r for r in training.solved(training.moments(df, ["client_id"], ["x0", "x1"]), ["client_id"], 2, 1.1).collect()}
    for r in last.collect():
        w = want[r["client_id"]]
        assert np.allclose([r["b"], r["w0"], r["w1"]], [w["b"], w["w0"], w["w1"]])


def test_partition_dispatch(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, label int")
    for args in (("iid",), ("dirichlet", 0.3)):
        sizes = clients.partition_all(df, "label", "id", 8, *args).groupBy("client_id").count().collect()
        assert len(sizes) == 8 and sum(r["count"] for r in sizes) == 60
    for args in (("dirichlet",), ("other", 1.0)):
        with pytest.raises(ValueError):
            clients.partition_all(df, "label", "id", 8, *args)


def test_guards(spark, tmp_path):
    guards.check_slots(spark, "notset", 10**6, 10**6, 10**6)
    with pytest.raises(ValueError, match="at least 42 clients"):
        guards.check_slots(spark, "128", 40, 15, 1300)
    with pytest.raises(ValueError, match="features"):
        guards.check_slots(spark, "128", 20, 45, 600)
    guards.refuse_stale(spark, f"file://{tmp_path}/none")
    (tmp_path / "k=4").mkdir()
    guards.refuse_stale(spark, f"file://{tmp_path}")
    (tmp_path / "k=4" / "bias.bin").write_text("x")
    with pytest.raises(ValueError, match="bias.bin"):
        guards.refuse_stale(spark, f"file://{tmp_path}")


def test_ill_conditioned_clients_fail_no_other(spark):
    rng = np.random.default_rng(4)
    df = frame_of(spark, np.r_[rng.standard_normal((10, 2)), np.full((6, 2), 1e9)], np.r_[np.sign(rng.standard_normal(10)), np.ones(6)], np.repeat([0, 1], [10, 6]))
    got = {r["client_id"]: r for r in training.solved(training.moments(df, ["client_id"], ["x0", "x1"]), ["client_id"], 2, 1.1).collect()}
    assert all(math.isfinite(got[c][v]) for c in (0, 1) for v in ("b", "w0", "w1"))
    nan = training.moments(df.withColumn("x0", F.when(F.col("client_id") == 1, float("nan")).otherwise(F.col("x0"))), ["client_id"], ["x0", "x1"])
    again = {r["client_id"]: r for r in training.solved(nan, ["client_id"], 2, 1.1).collect()}
    assert again[1]["w0"] is None and abs(again[0]["w0"] - got[0]["w0"]) < 1e-9


def test_runs_resume_and_models_keep_their_state(spark, tmp_path):
    from plumbline.sources import store

    root = f"file://{tmp_path}/run"
    first = training_path.run_open_tasks(spark, SF, root, "poly", [1]).collect()
    stamp = sorted(p.name for p in tmp_path.rglob("*.parquet"))
    assert len(first) == 10 and training_path.run_open_tasks(spark, SF, root, "poly", [1]).count() == 10
    assert sorted(p.name for p in tmp_path.rglob("*.parquet")) == stamp  # nothing was solved again
    assert training_path.run_open_tasks(spark, SF, root, "poly", [1, 2]).count() == 20
    model = spark.createDataFrame([(0, 0.5, 2.0), (1, 0.0, 1.0)], "class_idx int, b double, w0 double")
    store.save_global_model(model, f"{root}/g", "primal:linear", "moments")
    store.save_model_state(spark.createDataFrame([(0, [1.0], None)], "class_idx int, phi_mean array<double>, threshold double"), f"{root}/g")
    loaded = store.load_model_with_state(spark, f"{root}/g")
    rows = spark.createDataFrame([(3.0,), (-1.0,)], "x double")
    got = {(r["x"], r["class_idx"]): (r["score"], r["pred"]) for r in store.predict_stored(rows, loaded, ["x"]).collect()}
    assert got == {(3.0, 0): (4.5, 1.0), (-1.0, 0): (-3.5, -1.0), (3.0, 1): (3.0, 1.0), (-1.0, 1): (-1.0, -1.0)}


def test_report_grows_under_one_title(spark, tmp_path):
    times = spark.createDataFrame(run_catalog.TIMES, "class_idx int, client string, seconds double")
    for stamp in ("2026-01-01", "2026-01-02"):
        runlog.append_report(times, f"file://{tmp_path}/report.md", stamp)
    text = (tmp_path / "report.md").read_text()
    assert text.count("# Runs") == 1 and text.count("## Run 2026") == 2 and "| 0 | 1 | 0.5 |" in text and "| 0 | 2 | n/a |" in text


def test_qr_residuals_and_bounds():
    a = np.random.default_rng(6).standard_normal((6, 4))
    q, r = solvers.householder_qr(a)
    assert all(v < 1e-12 for v in solvers.qr_residuals(a, q, r).values())
    low, high = solvers.diagonal_bounds(np.diag([-2.0, -1.0]))
    assert np.allclose([low, high], [-2.2, -0.9])
    assert np.allclose(solvers.diagonal_bounds(np.diag([0.0, 3.0])), (1e-15, 3.3))
    with pytest.raises(ValueError):
        ff.kernel_columns([F.lit(1.0)], "cubic")


def test_bounds_need_positive_gamma(spark):
    rows = spark.createDataFrame([(5, 0.0)], "n int, gamma double")
    with pytest.raises(Exception, match="gamma must be positive"):
        rows.select(*[c.alias(k) for k, c in emulator.primal_bounds(F.col("n"), F.col("gamma")).items()]).collect()
