"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between them of a whole text, lower-cased,
each hashed into ``2**BITS`` slots. A bounded, documented sample of labelled documents (``sample_rows``, in the
order of a hash of the id) is written once; each of ``passes`` jobs sends the whole of it, in that order, through
follow-the-regularised-leader updates in one task, which holds one batch and the state of the slots. So neither
the batches nor the layout of the input change the weights, and a lost executor costs one pass. Every coordinate
has its own rate, and L1 keeps all but some hundred weights at zero. The driver gets the state, ``2**BITS`` pairs
of numbers, after each pass; every scoring task gets the weights that are not zero.

Defined cases: a null text counts as empty and scores the bias; without usable labels every score is 0.5;
repeated rows are each scored; an empty table gives an empty result; a kept column named ``score`` gives way to
the result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import discard, held_out, materialize, spread, table, training_labels

BITS = 18
_WORD = re.compile(r"\w+")
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Hasher:
    """Slots of a text's features, with a bounded cache of word hashes."""

    def __init__(self, max_entries: int = 300_000):
        self.seen: dict[str, int] = {}
        self.max_entries = max_entries

    def slots(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        if not words:
            return np.zeros(0, np.int64)
        if len(self.seen) > self.max_entries:
            self.seen.clear()
        seen = self.seen
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            pairs = (h[:-1] * _P) ^ (h[1:] * _Q)
            skips = (h[:-2] * _P) ^ (h[2:] * _R)
            mixed = np.concatenate([h, pairs, skips]) * _Q
        return np.unique((mixed >> np.uint64(64 - BITS)).astype(np.int64))


class Ftrl:
    """Weights of ``2**BITS`` slots and a bias (last), updated one example at a time."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
        self.penalty = np.full(2**BITS + 1, l1)
        self.penalty[-1] = 0.0

    def weights(self, slots: np.ndarray | slice) -> np.ndarray:
        z, n, l1 = self.z[slots], self.n[slots], self.penalty[slots]
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, slots: np.ndarray, y: float) -> None:
        at = np.append(slots, 2**BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, passes: int = 4) -> np.ndarray:
    """Dense weights (bias last) learned from at most ``sample_rows`` labelled documents in ``passes`` passes."""
    chosen = F.broadcast(training_labels(labels, "toxic", sample_rows))  # at most `sample_rows` ids

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            slots = [hasher.slots(t or "").astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.int32()))], names=["doc_id", "y", "slots"])

    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "y", "text")
    rows = sample.mapInArrow(hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, slots array<int>")
    order = [F.xxhash64("doc_id"), "doc_id", "y", "slots"]
    kept = materialize(rows.orderBy(*order).limit(sample_rows), "ftrl-sample")
    streamed = kept.coalesce(1).sortWithinPartitions(*order).select("y", "slots")
    model = Ftrl()

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, slots = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            for y, begin, end in zip(batch.column(0).to_pylist(), ends, ends[1:]):
                model.learn(slots[begin:end], float(y))
        yield pa.RecordBatch.from_arrays([pa.array([model.z.tobytes()]), pa.array([model.n.tobytes()])], names=["z", "n"])

    for _ in range(passes):
        for state in streamed.mapInArrow(learned, "z binary, n binary").collect():  # one row, or none of an empty sample
            model.z, model.n = (np.frombuffer(bytes(state[k])).copy() for k in ("z", "n"))
    discard(kept)
    return model.weights(slice(None))


def score_documents(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score`` of every document."""
    keep = [k for k in keep if k.lower() != "score"]
    types = [to_arrow_type(docs.schema[k].dataType) for k in keep]
    slot = np.nonzero(weights)[0]
    value = weights[slot]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(2**BITS + 1)
        dense[slot] = value
        hasher = Hasher()
        for batch in batches:
            total = np.array([dense[hasher.slots(t or "")].sum() for t in batch.column(len(keep)).to_pylist()], float) + dense[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(t) for k, t in enumerate(types)), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64())], names=[*keep, "score"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return spread(docs.select(*keep, F.col("text").alias("__text"))).mapInArrow(run, f"{schema}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, weights, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
