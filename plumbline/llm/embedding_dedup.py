"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are normalised; then a cosine of at least t is a distance of at most r = sqrt(2 - 2t). Every table takes
``k`` Gaussian projections, shifted and cut into steps of ``w = 10 r``, as its bucket; two vectors at distance r
share one projection with probability 0.920 and random directions with 0.486. ``k`` grows with the logarithm of
the largest label so that few strangers meet, and the number of tables is set so that a pair at just the
threshold misses all tables with probability 1e-4; closer pairs miss far less. Pairs that share a bucket are
checked by exact cosines in double precision.

Scale: exact copies become one weighted node first. Only bucket keys are shuffled for all vectors; vectors
travel only to buckets that two nodes share, in block pairs of a bounded size, and a task sends out link counts
and a spanning star a group, never the pairs. A pair is counted in the first table that it shares.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, or whose label is
null, link with nothing (n_links 0, a component of their own); vectors of different length never link; exact
copies link with each other; repeated rows count as vectors of their own; a null vec_id never names a component
unless all its vectors lack one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.blocks import block_pairs, contiguous_groups
from plumbline.llm.common import materialize, table
from plumbline.llm.components import connected_components

BLOCK = 512


def same_step(ratio: float) -> float:
    """Probability that two points fall into one step of ``ratio`` times their distance."""
    tail = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-(ratio**2) / 2))


def parameters(largest_label: int, threshold: float, miss: float = 1e-4) -> tuple[int, int, float]:
    """Projections a table, tables, and step width."""
    distance = math.sqrt(2 - 2 * threshold)
    width = 10 * distance
    near, far = same_step(10.0), same_step(width / math.sqrt(2))
    k = max(4, math.ceil(math.log(2 * max(largest_label, 1)) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log1p(-(near**k))), width


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Tables:
    """Bucket keys of unit vectors; the projections follow from the seed and the dimension alone."""

    def __init__(self, dimension: int, k: int, tables: int, width: float, seed: int = 20):
        rng = np.random.default_rng([seed, dimension])
        self.k, self.tables, self.width = k, tables, width
        self.a = rng.standard_normal((dimension, tables * k))
        self.b = rng.uniform(0, width, tables * k)
        self.mix = rng.integers(1, 2**63, k, np.int64).astype(np.uint64) | np.uint64(1)

    def keys(self, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        steps = np.floor((x @ self.a + self.b) / self.width).astype(np.int64).astype(np.uint64).reshape(len(x), self.tables, self.k)
        with np.errstate(over="ignore"):
            h = (steps * self.mix).sum(axis=2, dtype=np.uint64) + labels.astype(np.int64).astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
            h += np.arange(1, self.tables + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(x.shape[1])
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(29))).astype(np.int64)


def hashed_vectors(vectors: DataFrame, k: int, tables: int, width: float) -> DataFrame:
    """(node, vec_id, vector, keys) of the valid vectors; ``node`` is a digest of label and components."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Tables] = {}
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), np.int64)
            listed = batch.column(2)
            lengths = np.array([len(v) for v in listed], np.int64)
            for d in np.unique(lengths):
                at = np.nonzero(lengths == d)[0]
                for part in np.array_split(at, -(-len(at) // 2000)):
                    x = np.array([listed[i].values.to_numpy() for i in part], np.float64)
                    hashing = known.setdefault(int(d), Tables(int(d), k, tables, width))
                    x += 0.0  # -0.0 becomes 0.0
                    nodes = [hashlib.md5(v.tobytes() + lab.tobytes()).digest() for v, lab in zip(x, labels[part])]
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column(0).take(pa.array(part)), pa.array(list(x), pa.list_(pa.float64())), pa.array(list(hashing.keys(unit(x), labels[part])), pa.list_(pa.int64()))], names=["node", "vec_id", "vector", "keys"])

    return vectors.select("vec_id", F.col("label").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, f"node binary, vec_id {id_type}, vector array<double>, keys array<long>")


def _group_links(group: pa.RecordBatch, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block pair (columns t, key, a, b, blk, node, weight, vector, keys): links newly counted for each
    row, and the star edges (row, root)."""
    n = group.num_rows
    none = np.zeros(0, np.int64)
    if n < 2:
        return np.zeros(n, np.int64), none, none
    t, a, b = (group.column(i)[0].as_py() for i in (0, 2, 3))
    blk = group.column(4).to_numpy()
    weight = group.column(6).to_numpy()
    x = unit(group.column(7).flatten().to_numpy().reshape(n, -1))
    keys = group.column(8).flatten().to_numpy().reshape(n, -1)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    if a != b:
        linked &= blk[:, None] != blk[None, :]
    i, j = np.nonzero(np.triu(linked))
    links = np.zeros(n, np.int64)
    for part in np.array_split(np.arange(len(i)), -(-len(i) // 100_000)) if len(i) else ():
        new = part[~(keys[i[part], :t] == keys[j[part], :t]).any(axis=1)]
        links += np.bincount(i[new], weight[j[new]], n).astype(np.int64) + np.bincount(j[new], weight[i[new]], n).astype(np.int64)
    root = np.arange(n)
    while len(i):
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            break
        root = least
    tied = np.nonzero(root != np.arange(n))[0]
    return links, tied, root[tied]


def links_and_edges(nodes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Rows ``(u, links, v)``: counts of direct links for ``u`` (v null), or an edge (links null)."""
    exploded = nodes.select("node", F.posexplode("keys").alias("t", "key"))
    shared = exploded.groupBy("t", "key").count().where("count > 1")
    members = exploded.join(shared, ["t", "key"])
    placed = block_pairs(members, F.col("count"), "node", block).select("node", "t", "key", "a", "b", "blk")
    rows = placed.join(nodes, "node").select("t", "key", "a", "b", "blk", "node", "weight", "vector", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in contiguous_groups(batches, 4):
            links, tied, root = _group_links(group, threshold)
            at = np.nonzero(links)[0]
            if len(at) or len(tied):
                node = group.column(5)
                u = pa.concat_arrays([node.take(pa.array(at)), node.take(pa.array(tied))])
                v = pa.concat_arrays([pa.nulls(len(at), pa.binary()), node.take(pa.array(root))])
                yield pa.RecordBatch.from_arrays([u, pa.array([*links[at].tolist(), *[None] * len(tied)], pa.int64()), v], names=["u", "links", "v"])

    keyed = rows.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b", "node")
    return keyed.mapInArrow(run, "u binary, links long, v binary")


def deduplicate_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    given = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    marked = given.withColumn("valid", valid)
    largest = given.where("label is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables, width = parameters(largest, threshold)
    hashed = materialize(hashed_vectors(marked.where("valid"), k, tables, width), "vectors")
    nodes = materialize(
        hashed.groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"), F.first("keys").alias("keys")), "vector-nodes"
    )
    found = materialize(links_and_edges(nodes, threshold, block), "vector-links")
    links = found.where("links is not null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("v is not null").select("u", "v"))
    named = roots.join(nodes.select("node", "least"), "node")
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = roots.join(component, "root").select("node", "component_id")
    facts = (
        nodes.select("node", "weight", "least")
        .join(links, "node", "left")
        .join(placed, "node", "left")
        .select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    good = hashed.select("node", "vec_id").join(facts, "node").select("vec_id", "n_links", "component_id")
    alone = marked.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(u, v) AS (SELECT u, v FROM p UNION SELECT r.u, p.v FROM reach r JOIN p ON r.v = p.u),
c AS (SELECT u, least(u, min(v)) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id
"""
