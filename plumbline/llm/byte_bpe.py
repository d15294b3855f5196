"""Byte-level BPE encoding and decoding from a rank file.

Pre-tokens that have not been seen before are merged together: their bytes form one linked list with gaps
between pre-tokens. Every adjacent pair that has a merge rank is queued in the bucket of its rank, as the position
of its left part; a hierarchical bitmap of 64-bit words marks the buckets in use, so that finding the lowest rank
takes one find-first-set a level. A bucket is taken out whole: entries whose pair has changed since are stale and
skipped, of overlapping pairs the leftmost goes first, and all the rest are merged at once by array operations,
which queue the new pairs. A bucket never comes back, because in a vocabulary whose tokens are the results of
their own merges a merge only makes pairs of higher rank; should a rank file make a lower one, that pre-token is
merged again by itself, one entry at a time through the same queue. Each merge queues two pairs at most, so very
long pre-tokens take n log n steps. Pre-tokens that are a token already map to it, as in the tiktoken library.

Defined cases: a null text is empty and has no ids; texts of any length are encoded whole; repeated rows are
encoded each; an empty table gives an empty result. Named columns of the input come through, others are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.chunked_text import ChunkEncoder, PretokenEncoder, text_batches
from plumbline.llm.common import spread, table
from plumbline.llm.document_pieces import binaries


#: Rows that are turned into Python objects at a time: texts, and their ids.
TEXT_ROWS, ROWS = 1500, 500


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Buckets by rank below 64**3, with a three-level bitmap over the buckets in use."""

    def __init__(self) -> None:
        self.top = 0
        self.mid = [0] * 64
        self.low = [0] * 4096
        self.buckets: dict[int, list] = {}

    def push(self, rank: int, item: object) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(item)
            return
        self.buckets[rank] = [item]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def lowest(self) -> int:
        """The lowest rank in use; -1 if none."""
        if not self.top:
            return -1
        i = (self.top & -self.top).bit_length() - 1
        word = self.mid[i]
        j = i << 6 | (word & -word).bit_length() - 1
        word = self.low[j]
        return j << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list:
        """Removes and returns the bucket of the lowest rank."""
        j, i = rank >> 6, rank >> 12
        self.low[j] &= self.low[j] - 1
        if not self.low[j]:
            self.mid[i] &= self.mid[i] - 1
            if not self.mid[i]:
                self.top &= self.top - 1
        return self.buckets.pop(rank)


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= 64**3:
            raise ValueError("ranks must lie below 64**3")
        self.ranks = ranks
        self.gap = max(ranks.values()) + 1  # stands for "no token"
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((ranks[t[:k]] * (self.gap + 1) + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pairs, self.pair_rank = (np.array([*x, end], np.int64) for x, end in zip(zip(*pairs), ((self.gap + 1) ** 2, -1)))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; -1: they do not merge."""
        key = left * (self.gap + 1) + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_rank[at], -1)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens (none empty) in order, and the number of ids of each."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, first = len(data), np.cumsum(sizes) - sizes
        token = np.append(self.of_byte[data], self.gap)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # next and previous parts; n: none
        after[first + sizes - 1], before[first] = n, n
        rank = np.append(self._rank(token[:n], token[after[:n]]), -1)  # of each part with the next
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        known = whole >= 0
        rank[:n][np.repeat(known, sizes)] = -1
        alive = np.ones(n, bool)
        again: set[int] = set()
        queue = RankQueue()

        def push(at: np.ndarray) -> None:
            of = rank[at]
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(at)]
            for r, i, j in zip(of[cuts[:-1]].tolist(), cuts, cuts[1:]):
                queue.push(r, at[i:j])

        if (at := np.flatnonzero(rank >= 0)).size:
            push(at)
        while (r := queue.lowest()) >= 0:
            entries = queue.take(r)
            at = entries[0] if len(entries) == 1 else np.concatenate(entries)
            at = np.sort(at[rank[at] == r])  # the others are stale
            if not at.size:
                continue
            if (touch := after[at[:-1]] == at[1:]).any():  # of overlapping pairs every second one, from the left
                i = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.concatenate([[True], ~touch]), i, 0))
                at = at[(i - run) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            if (beside := follow[:-1] == at[1:]).any():  # pairs that last until the next merge only
                of = self._rank(np.full(int(beside.sum()), r), token[at[1:][beside]])
                if ((of >= 0) & (of < r)).any():
                    again.update(np.searchsorted(first, at[:-1][beside][(of >= 0) & (of < r)], side="right") - 1)
            token[at], after[at], before[follow] = r, follow, at
            rank[gone], alive[gone], rank[at] = -1, False, -2
            left = before[at]
            fresh = np.concatenate([at, left[(left < n) & (rank[left] != -2)]])
            rank[fresh] = of = self._rank(token[fresh], token[after[fresh]])
            if ((of >= 0) & (of <= r)).any():
                again.update(np.searchsorted(first, fresh[(of >= 0) & (of <= r)], side="right") - 1)
            if (at := fresh[of > r]).size:
                push(at)
        ids, counts = token[:n][alive], np.add.reduceat(alive, first, dtype=np.int64)
        if known.any() or again:
            ids, counts = self._exchange(ids, counts, {**{int(k): [int(whole[k])] for k in np.flatnonzero(known)}, **{int(k): self.merge(pieces[k]) for k in again}})
        return ids.astype(np.uint32), counts

    @staticmethod
    def _exchange(ids: np.ndarray, counts: np.ndarray, other: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` with those of some pre-tokens put in place of their own."""
        at = np.array(sorted(other))
        stays = np.ones(len(counts), bool)
        stays[at] = False
        ids, begin = ids[np.repeat(stays, counts)], np.cumsum(np.where(stays, counts, 0))
        size = np.array([len(other[k]) for k in at.tolist()])
        counts = counts.copy()
        counts[at] = size
        return np.insert(ids, np.repeat(begin[at], size), [x for k in at.tolist() for x in other[k]]), counts

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token, one queue entry at a time."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        rank_of, queue, n = self.ranks.get, RankQueue(), len(piece)
        after = list(range(1, n + 1))  # where the next part starts; n: none
        before = list(range(-1, n - 1))
        pair: list[int | None] = [rank_of(piece[i : i + 2]) for i in range(n - 1)] + [None]  # rank of part i with the next
        for i, r in enumerate(pair):
            if r is not None:
                queue.push(r, i)
        while (rank := queue.lowest()) >= 0:
            entries = sorted(queue.take(rank))
            for k, i in enumerate(entries):
                if pair[i] != rank:
                    continue
                gone = after[i]
                follow = after[gone]
                after[i], pair[gone], pair[i] = follow, None, None
                if follow < n:
                    before[follow] = i
                    pair[i] = r = rank_of(piece[i : after[follow]])
                    if r is not None:
                        queue.push(r, i)
                left = before[i]
                if left >= 0:
                    pair[left] = r = rank_of(piece[left:follow])
                    if r is not None:
                        queue.push(r, left)
                if 0 <= queue.lowest() < rank:
                    for rest in entries[k + 1 :]:
                        queue.push(rank, rest)
                    break
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids


@functools.lru_cache(maxsize=2)
def bpe_chunks(rank_path: str, pattern: str) -> ChunkEncoder:
    """Encoder of whole texts, kept for the life of the process."""
    bpe = Bpe(load_ranks(rank_path))
    pretokens = PretokenEncoder(pattern, lambda strings: bpe.merge_all([x.encode() for x in strings]), 200_000)
    return ChunkEncoder(pretokens.encode, max_entries=300_000)


@functools.lru_cache(maxsize=2)
def _tokens(rank_path: str) -> tuple[dict[int, bytes], dict[int, str]]:
    token_of = {rank: token for token, rank in load_ranks(rank_path).items()}
    return token_of, {rank: str(rank) for rank in token_of}


def _encoded(batches: Iterator[pa.RecordBatch], rank_path: str, pattern: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Keys, ids and numbers of ids of whole texts (column 0: the key, column 1: the text)."""
    encoder = bpe_chunks(rank_path, pattern)
    for batch in batches:
        for i in range(0, batch.num_rows, TEXT_ROWS):
            part = batch.slice(i, TEXT_ROWS)
            for (keys,), texts in text_batches([part.column(0).to_pylist()], part.column(1).to_pylist()):
                yield keys, *encoder.encode(texts)


def _decoded(ids: list[list[int]], rank_path: str) -> list[pa.Array]:
    """The decimal ids joined by a space, and the bytes of the tokens."""
    token_of, decimal = _tokens(rank_path)
    return [pa.array([" ".join(map(decimal.__getitem__, x)) for x in ids], pa.string()), pa.array([b"".join(map(token_of.__getitem__, x)) for x in ids], pa.binary())]


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """Rows ``key``, ``n_tokens`` and ``ids`` (little-endian uint32) of the whole texts."""
    key_type = to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, counts in _encoded(batches, rank_path, pattern):
            yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(counts, pa.int64()), binaries(ids.astype("<u4"), counts)], names=[key, "n_tokens", "ids"])

    return spread(docs.select(F.col(key), F.col("text"))).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, rank_path: str, key: str = "doc_id") -> DataFrame:
    """Rows ``key``, ``n_tokens``, ``ids_text`` (decimal ids joined by a space) and ``decoded`` (the bytes)."""
    key_type = to_arrow_type(encoded.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids = [np.frombuffer(x, dtype="<u4").tolist() for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(key_type), part.column(1), *_decoded(ids, rank_path)], names=[key, "n_tokens", "ids_text", "decoded"])

    return encoded.select(key, "n_tokens", "ids").mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, n_tokens long, ids_text string, decoded binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """:func:`decode_ids` of :func:`encode_texts` in one pass: the ids stay in the worker that made them."""
    key_type = to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, counts in _encoded(batches, rank_path, pattern):
            ends = np.cumsum(counts)
            for i in range(0, len(keys), ROWS):
                part = [ids[e - n : e].tolist() for e, n in zip(ends[i : i + ROWS], counts[i : i + ROWS])]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + ROWS], key_type), pa.array(counts[i : i + ROWS], pa.int64()), *_decoded(part, rank_path)], names=[key, "n_tokens", "ids_text", "decoded"])

    return spread(docs.select(F.col(key), F.col("text"))).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_text string, decoded binary")


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).select("doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
