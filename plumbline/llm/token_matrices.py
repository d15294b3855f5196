"""Packed token-id matrices with segment lengths and position resets.

Documents are encoded, closed by an end id, and cut into pieces of at most ``capacity`` ids without loss. Within
a window of pieces (some millions of ids, so memory is bounded) they are packed best-fit decreasing: a
segment tree over remaining capacities finds the fullest sequence that still fits. Windows follow the input's
partitions, so nothing is shuffled and no task depends on another; sequences
left open at the end of a window or partition stay so. No ids are lost, but the number of sequences depends on the
file layout: the fewer documents a partition holds, the more padding there is.

Each sequence is a row of the id matrix: ``capacity`` little-endian ids (uint16 where the vocabulary allows,
else uint32), padded at the end. ``cu_seqlens`` holds the cumulative lengths of its segments from 0, and
``position_ids`` restarts from 0 in every segment (little-endian uint16, 0 in the padding).

Defined cases: a null text is empty and gives its end id alone; repeated rows are packed each; keys may be null
or repeat; the string of a special token in a text is that token, unless ``special_as_text``; an empty table gives
no sequences; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.chunked_text import runs, vocabulary_size
from plumbline.llm.common import spread, table, temporary_path
from plumbline.llm.document_pieces import END_ID, binaries, cut, encoded_documents

CAPACITY, PAD_ID = 1024, 0
WINDOW_IDS, WINDOW_PIECES = 3_000_000, 30_000


class CapacityTree:
    """Open sequences by remaining capacity 1..capacity; finds the smallest that is at least a length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.bins[room].append(sequence)
        i = self.leaves + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns (room, sequence) of the fullest sequence with at least ``length`` free."""
        count, i = self.count, self.leaves + length
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        sequence = self.bins[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, sequence


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces of each sequence, in the order in which they lie there."""
    tree, out = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        found = tree.take(n)
        if found is None:
            room, at = capacity, len(out)
            out.append([])
        else:
            room, at = found
        out[at].append(i)
        if room > n:
            tree.add(room - n, at)
    return out


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, key: str = "doc_id", special_as_text: bool = False) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids, cu_seqlens, position_ids, doc_ids, pieces, starts."""
    if capacity > 65_535:
        raise ValueError("positions are 16-bit")
    key_type = to_arrow_type(docs.schema[key].dataType)
    schema = f"sequence_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{docs.schema[key].dataType.simpleString()}>, pieces array<int>, starts array<long>"
    names = ["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "pieces", "starts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype("<u2" if max(vocabulary_size(tokenizer_path), END_ID + 1) <= 65_536 else "<u4")
        made = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []  # keys, piece, start, length, ids of a part of the window

        def flush() -> pa.RecordBatch:
            nonlocal made
            keys = pa.concat_arrays([w[0] for w in waiting])
            piece, start, length, ids = (np.concatenate([w[k] for w in waiting]) for k in range(1, 5))
            waiting.clear()
            members = best_fit_decreasing(length.tolist(), capacity)
            sizes = np.array([len(m) for m in members])
            order = np.fromiter((i for m in members for i in m), np.int64, len(length))  # pieces as they lie in the rows
            row, placed = np.repeat(np.arange(len(members)), sizes), length[order]
            ends = np.cumsum(placed)
            tokens = np.bincount(row, placed, len(members)).astype(np.int64)
            inside = ends - placed - np.repeat(np.cumsum(tokens) - tokens, sizes)  # offset of a piece in its row
            to = runs(row * capacity + inside, placed)
            matrix, positions = np.full(len(members) * capacity, PAD_ID, dtype), np.zeros(len(members) * capacity, "<u2")
            matrix[to] = ids[runs((np.cumsum(length) - length)[order], placed)]
            positions[to] = runs(np.zeros(len(order), np.int64), placed)
            lists = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            borders = np.insert(inside + placed, np.cumsum(sizes) - sizes, 0)
            full = np.full(len(members), capacity)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(made + np.arange(len(members)), pa.int64()),
                    pa.array(tokens, pa.int32()),
                    binaries(matrix, full),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes + 1)]), pa.int32()), pa.array(borders, pa.int32())),
                    binaries(positions, full),
                    pa.ListArray.from_arrays(lists, keys.take(pa.array(order))),
                    pa.ListArray.from_arrays(lists, pa.array(piece[order], pa.int32())),
                    pa.ListArray.from_arrays(lists, pa.array(start[order], pa.int64())),
                ],
                names=names,
            )
            made += len(members)
            return out

        for keys, ids, counts in encoded_documents(batches, tokenizer_path, special_as_text=special_as_text):
            document, piece, start, length = cut(counts, capacity)
            named, begin, ids = pa.array(keys, key_type).take(pa.array(document)), np.cumsum(length) - length, ids.astype(dtype)
            for i in range(0, len(length), WINDOW_PIECES):
                at = slice(i, i + WINDOW_PIECES)
                waiting.append((named[at], piece[at], start[at], length[at], ids[begin[i] : begin[i] + int(length[at].sum())]))
                if sum(len(w[4]) for w in waiting) >= WINDOW_IDS or sum(len(w[3]) for w in waiting) >= WINDOW_PIECES:
                    yield flush()
        if waiting:
            yield flush()

    return spread(docs.select(F.col(key), F.col("text"))).mapInArrow(run, schema)


def write_token_matrices(docs: DataFrame, path: str, tokenizer_path: str, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Writes :func:`packed_sequences` under ``path`` and returns the table as read from there."""
    packed_sequences(docs, tokenizer_path, capacity, key).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op4_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = temporary_path(spark, "token-matrices")
    written = write_token_matrices(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return written.select(
        "sequence_id",
        "n_tokens",
        "doc_ids",
        "pieces",
        "starts",
        "cu_seqlens",
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("position_ids").alias("positions_crc32"),
    )
