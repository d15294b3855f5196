"""Assignment of rows to simulated clients. All rules are by key order or by a given key hash: deterministic,
and computed from ranks and counts rather than by shuffling rows in one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.prep import ranked


def iid(df: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """``client_id``: k chunks of each group in key order, the first n % k one row longer (as ntile gives)."""
    r = ranked(df, by, key)
    small, longer = F.floor(F.col("group_n") / k), F.col("group_n") % k
    head = longer * (small + 1)
    at = F.col("rank") - 1
    chunk = F.when(at < head, F.floor(at / (small + 1))).otherwise(longer + F.floor((at - head) / F.greatest(small, F.lit(1))))
    return r.withColumn("client_id", chunk.cast("int")).drop("rank", "group_n")


def subsampled(df: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group in key order; fewer where it is short."""
    return ranked(df, by, key).where(F.col("rank") <= n).drop("rank", "group_n")


def dirichlet_shares(k: int, alpha: float, groups: int, seed: int = 42) -> list[list[float]]:
    """One draw of k shares for each group."""
    rng = np.random.default_rng(seed)
    return [rng.dirichlet([alpha] * k).tolist() for _ in range(groups)]


def by_shares(df: DataFrame, group: str, key: str, shares: list[list[float]]) -> DataFrame:
    """``client_id`` by cut points floor(cumulative share * n) of each group (0, 1, ..); chunks may be empty."""
    r = ranked(df, [group], key)
    cumulative = F.array(*[F.array(*[F.lit(float(v)) for v in np.cumsum(s)]) for s in shares])
    mine = F.get(cumulative, F.col(group))
    last = len(shares[0]) - 1
    cuts = F.transform(F.slice(mine, 1, last), lambda p: F.floor(p * F.col("group_n")))
    return r.withColumn("client_id", F.size(F.filter(cuts, lambda c: c < F.col("rank"))).cast("int")).drop("rank", "group_n")


def capped(assigned: DataFrame, key: str, k: int) -> DataFrame:
    """At most ``max(4, ceil(total / k))`` rows a client: what is over goes, in key order, to free places dealt one
    per client and round."""
    counts = spine(assigned, k)
    total = assigned.count()
    cap = max(4, -(-total // k))
    placed = ranked(assigned, ["client_id"], key).drop("group_n")
    over = ranked(placed.where(F.col("rank") > cap).withColumn("__all", F.lit(0)), ["__all"], key, name="turn").drop("group_n", "__all", "client_id")
    free = counts.where(F.col("n") < cap).select("client_id", F.explode(F.sequence((F.col("n") + 1).cast("int"), F.lit(cap))).alias("round"))
    seats = ranked(free.withColumn("seat", F.col("round").cast("long") * k + F.col("client_id")).withColumn("__all", F.lit(0)), ["__all"], "seat", name="turn").select("turn", "client_id")
    columns = assigned.columns
    return placed.where(F.col("rank") <= cap).select(columns).unionByName(over.join(seats, "turn").select(columns))


def spine(assigned: DataFrame, k: int) -> DataFrame:
    """Rows of every client 0..k-1, empty ones included."""
    everyone = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("client_id"))
    return everyone.join(assigned.groupBy("client_id").agg(F.count("*").alias("n")), "client_id", "left").fillna(0, ["n"])


def backfill_moves(counts: list[int]) -> list[tuple[int, int]]:
    """(donor, empty client) in order: every empty client takes one row of the largest client at that time, the
    first of equal ones. Needs as many rows as clients."""
    if sum(counts) < len(counts):
        raise ValueError("fewer rows than clients")
    now, moves = list(counts), []
    for c in [i for i, n in enumerate(counts) if n == 0]:
        donor = max(range(len(now)), key=lambda i: (now[i], -i))
        now[donor] -= 1
        now[c] += 1
        moves.append((donor, c))
    return moves


def backfilled(assigned: DataFrame, key: str, k: int) -> DataFrame:
    """No client stays empty: donors give their last rows in key order. The counts (k rows) go to the driver."""
    counts = [r["n"] for r in spine(assigned, k).orderBy("client_id").collect()]
    moves = backfill_moves(counts)
    if not moves:
        return assigned
    given: dict[int, int] = {}
    rows = []
    for donor, to in moves:
        given[donor] = given.get(donor, 0) + 1
        rows.append((donor, counts[donor] - given[donor] + 1, to))
    spark: SparkSession = assigned.sparkSession
    table = F.broadcast(spark.createDataFrame(rows, "client_id int, rank long, __to int"))  # fewer than k rows
    r = ranked(assigned, ["client_id"], key).drop("group_n")
    return r.join(table, ["client_id", "rank"], "left").withColumn("client_id", F.coalesce("__to", "client_id")).select(assigned.columns)


def partition_all(df: DataFrame, label: str, key: str, k: int, partition: str = "iid", alpha: float | None = None, seed: int = 42) -> DataFrame:
    """``client_id`` by partition name: 'iid' chunks of each label, or 'dirichlet' shares of each label (0, 1, ..)
    under the cap. No client stays empty."""
    if partition == "iid":
        return backfilled(iid(df, [label], key, k), key, k)
    if partition != "dirichlet":
        raise ValueError(f"unknown partition {partition!r}; known: ['dirichlet', 'iid']")
    if alpha is None or alpha <= 0:
        raise ValueError("a dirichlet partition needs a positive alpha")
    groups = int(df.agg(F.max(label)).first()[0]) + 1
    return backfilled(capped(by_shares(df, label, key, dirichlet_shares(k, alpha, groups, seed)), key, k), key, k)


def test_chunks(df: DataFrame, key: str, slots: int) -> DataFrame:
    """``chunk`` and ``slot`` of each row: consecutive rows in key order fill chunks of ``slots``."""
    r = ranked(df.withColumn("__all", F.lit(0)), ["__all"], key)
    at = F.col("rank") - 1
    return r.withColumn("chunk", F.floor(at / slots)).withColumn("slot", F.pmod(at, F.lit(slots))).drop("__all", "rank", "group_n")


def without_positive(df: DataFrame, by: str = "client_id") -> DataFrame:
    return df.groupBy(by).agg(F.max("y").alias("__m")).where("__m < 0").select(by)


def tasks(spark: SparkSession, classes: int, k: int) -> DataFrame:
    """Every class with every client and its baseline."""
    clients = [str(c) for c in range(k)] + ["baseline"]
    rows = spark.range(classes).select(F.col("id").cast("int").alias("class_idx"))
    return rows.withColumn("client", F.explode(F.array(*[F.lit(c) for c in clients])))


def sharded(task_rows: DataFrame, shards: int) -> DataFrame:
    """Tasks dealt in turn; their number is classes x clients, so one ordering is small."""
    order = Window.orderBy("class_idx", F.col("client") == "baseline", F.length("client"), "client")
    return task_rows.withColumn("shard", F.pmod(F.row_number().over(order) - 1, F.lit(shards)).cast("int"))
