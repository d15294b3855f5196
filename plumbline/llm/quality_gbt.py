"""Quality classifier: gradient-boosted trees on histograms of document statistics.

The statistics of a bounded, documented sample of labelled documents (``sample_rows``, chosen by a hash of the
id among rows that may be learned from) are collected, cut into quantile bins, and boosted with logistic loss;
the trees grow level by level on gradient histograms. The model is a few flat arrays that every task gets, and
a batch of documents walks all trees at once by array indexing.

Defined cases: a null text counts as empty and is scored like any other; without usable labels every score is
0.5, with labels of one class it is their smoothed share; repeated rows are each scored; repeated ids in the
documents may each bring a row to the sample, which then takes the first by the order of that hash; an empty table
gives an empty result; a kept column named like a result (``score``, ``statistics``) gives way to it; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import held_out, spread, table, training_labels

STATISTICS = ["words", "word_length", "symbols", "exclamations", "capitals", "digits", "line_copies", "distinct", "windows", "stops", "commas", "wide", "lines", "longest", "space", "controls"]


def statistics(text: str) -> list[float]:
    """STATISTICS of a whole text, shares mostly, so that length alone says little."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = int(counts.sum())
    wide = int(counts[128:].sum())
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    symbols = int(counts[[35, 36, 37, 38, 42, 60, 62, 124]].sum())
    per_word, per_byte = 1 / max(n, 1), 1 / max(size, 1)
    return [
        np.log1p(n),
        sum(map(len, words)) * per_word,
        symbols * per_word,
        int(counts[33]) * per_word,
        int(counts[65:91].sum()) / letters,
        int(counts[48:58].sum()) * per_byte,
        1 - len(set(lines)) / max(len(lines), 1),
        len(set(words)) * per_word,
        len(set(zip(words, words[1:], words[2:]))) / max(n - 2, 1),
        int(counts[46]) * per_word,
        int(counts[44]) * per_word,
        wide * per_byte,
        len(lines) * per_word,
        np.log1p(max(map(len, words), default=0)),
        int(counts[32]) * per_byte,
        int(counts[:9].sum() + counts[14:32].sum()) * per_byte,
    ]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in flat arrays: node i of a level has children 2i + 1 and 2i + 2."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # goes right where the feature exceeds it
    leaf: np.ndarray  # (trees, 2**depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature):
            tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            depth = int(np.log2(self.leaf.shape[1]))
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            total += self.leaf[tree, node - (self.leaf.shape[1] - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees for labels 0/1. ``least``: smallest sum of Hessians in a child."""
    none = Trees(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    if not len(y):
        return none
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Trees(base, none.feature, none.threshold, none.leaf)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(d)]
    binned = np.stack([np.searchsorted(cuts[k], x[:, k], side="left") for k in range(d)], axis=1)  # bin > b exactly where x > cuts[b]
    offset = (np.arange(d) * bins)[None, :]
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (d * bins) + offset + binned).ravel()
            g, h = (np.bincount(at, np.repeat(v, d), width * d * bins).reshape(width, d, bins).cumsum(axis=2) for v in (grad, hess))
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < least) | (ht - h < least)] = -1
            for k in range(d):
                gain[:, k, len(cuts[k]) :] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            won = gain.reshape(width, -1).max(axis=1) > 1e-6
            for i in np.nonzero(won)[0]:
                k, b = divmod(int(best[i]), bins)
                feature[t, first + i], threshold[t, first + i] = k, cuts[k][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        slot = node - inner
        leaf[t] = -rate * np.bincount(slot, grad, leaves) / (np.bincount(slot, hess, leaves) + ridge)
        total += leaf[t, slot]
    return Trees(base, feature, threshold, leaf)


def document_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``statistics`` (array<double> in the order of STATISTICS)."""
    keep = [k for k in keep if k.lower() != "statistics"]
    types = [to_arrow_type(docs.schema[k].dataType) for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t or "") for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(t) for i, t in enumerate(types)), pa.array(values, pa.list_(pa.float64()))], names=[*keep, "statistics"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, f"{schema}, statistics array<double>")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **options: float) -> Trees:
    """Learns from at most ``sample_rows`` labelled documents."""
    chosen = F.broadcast(training_labels(labels, "quality", sample_rows))  # at most `sample_rows` ids
    rows = document_statistics(docs.select("doc_id", "text").join(chosen, "doc_id"), ["doc_id", "y"])
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "statistics").limit(sample_rows).collect()  # at most `sample_rows` rows
    return fit(np.array([r["statistics"] for r in sample]), np.array([r["y"] for r in sample], float), **options)


def score_documents(docs: DataFrame, model: Trees, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` of every document."""
    keep = [k for k in keep if k.lower() != "score"]
    types = [to_arrow_type(docs.schema[k].dataType) for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                x = np.array([statistics(t or "") for t in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(k).cast(t) for k, t in enumerate(types)), pa.array(model.score(x), pa.float64())], names=[*keep, "score"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return spread(docs.select(*keep, F.col("text").alias("__text"))).mapInArrow(run, f"{schema}, score double")


def predicted(threshold: float) -> Column:
    return (F.col("score") >= threshold).cast("int").alias("predicted")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted(0.7))
