"""Near-duplicate texts by Order MinHash with banded alignment.

A text's words give its k-mers (five words), each labelled with its occurrence number. For each of ``SKETCHES``
hash functions the ``PICKED`` least labelled k-mers are taken and kept in text order; the hash of that tuple is
one bucket key, so that keys agree where texts share k-mers in the same order. Texts that share a key are
candidates. They are near duplicates if their edit similarity over words, the longest common subsequence over
the longer length, is at least ``threshold`` (0.8); it is found by a bit-parallel alignment that holds only the band
of offsets which such a similarity leaves open. Classes are the connected components.

Recall: one sketch agrees with about J^PICKED, J the overlap of the labelled k-mer sets, so a pair is missed with
about (1 - J^PICKED)^SKETCHES. Scattered edits of a fifth of the words leave few k-mers of five words whole, hence
two of them a sketch and many sketches; the README has measured figures. Pairs that share no key are not compared,
so texts of a few words, of which one edit breaks every k-mer, meet their exact copies only.

Scale: exact copies become one node first (by a 128-bit digest). In every bucket the members are first aligned
with one leader of their block only, so a group of m near copies costs m alignments. Buckets whose members then lie
in different classes are settled exactly: members outside the bucket's largest class meet all others in block
pairs of a bounded size, in the first bucket they share, skipping pairs that are linked already and those whose
bags of words have too little in common (counted for a text and all others at once).

Defined cases: a null text is empty; texts without words are their own class only with their exact copies; texts
of fewer than five words have one k-mer; repeated rows are copies; a null doc_id never names a class unless the
whole class lacks one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.blocks import contiguous_groups
from plumbline.llm.common import discard, materialize, spread, table, text_or_empty
from plumbline.llm.components import connected_components

WORDS, SKETCHES, PICKED = 5, 80, 2
THRESHOLD = 0.8
LEADER_BLOCK, BLOCK_WORDS = 4096, 1_000_000
#: Texts of up to so many words have the places of every word as one integer (2 MB in all).
SHORT_WORDS = 4096
_SEEDS = np.random.default_rng(8).integers(1, 2**63, (SKETCHES, 2), np.int64).astype(np.uint64) | np.uint64(1)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def kmers(words: list[str], seen: dict[str, int], k: int = WORDS) -> np.ndarray:
    """64-bit hashes of the k-mers of words, in text order; fewer than k words are one k-mer."""
    for w in set(words).difference(seen):
        seen[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        out = np.zeros(max(len(h) - k + 1, 1), np.uint64)
        for i in range(min(k, len(h))):
            out = (out * _P) ^ (out >> np.uint64(29)) ^ h[i : i + len(out)]
        return (out ^ (out >> np.uint64(32))) * _Q


def order_minhash(h: np.ndarray) -> np.ndarray:
    """SKETCHES bucket keys of the k-mers ``h``."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = (np.arange(len(h)) - start).astype(np.uint64)
    take = min(PICKED, len(h))
    keys = np.zeros(SKETCHES, np.uint64)
    step = max(1, 4_000_000 // len(h))
    with np.errstate(over="ignore"):
        labelled = h + occurrence * _P
        for s in range(0, SKETCHES, step):
            seeds = _SEEDS[s : s + step]
            v = (labelled[None, :] ^ seeds[:, :1]) * seeds[:, 1:]
            v = (v ^ (v >> np.uint64(32))) * _Q
            at = np.sort(np.argpartition(v, take - 1, axis=1)[:, :take] if take < len(h) else np.tile(np.arange(take), (len(seeds), 1)), axis=1)
            key = seeds[:, 0].copy()
            for i in range(take):
                key = (key * _P) ^ (key >> np.uint64(31)) ^ h[at[:, i]]
            keys[s : s + step] = (key ^ (key >> np.uint64(33))) * _Q
    return keys.astype(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n_words, keys): ``node`` is the digest of the text, ``keys`` null without words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            nodes, counts, keys = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                words = text.split()
                if len(seen) > 300_000:
                    seen.clear()
                nodes.append(hashlib.md5(text.encode()).digest())
                counts.append(len(words))
                keys.append(order_minhash(kmers(words, seen)) if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(counts, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "n_words", "keys"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {id_type}, node binary, n_words int, keys array<long>")


def similar(a: list, b: list, threshold: float = THRESHOLD) -> bool:
    """Whether the longest common subsequence of words is at least ``threshold`` of the longer text.

    Words that both ends share are matched at once; a bag of words bounds the rest from above; what remains is
    aligned in the band of offsets that an alignment good enough can have.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    need = -int(-threshold * n // 1)
    if n and m < need:
        return False
    lead = 0
    while lead < m and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < m - lead and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    need -= lead + tail
    if need <= 0:
        return True
    a, b = a[lead : n - tail], b[lead : m - tail]
    if min(len(a), len(b)) < need or sum((Counter(a) & Counter(b)).values()) < need:
        return False
    return _banded_common(a, b, max(len(a), len(b)) - need) >= need


def _banded_common(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence whose partners lie at most ``band`` places apart.

    One integer holds the 2 band + 1 places of ``a`` around the diagonal, a zero bit being a matched place; it moves
    on by one place a word of ``b``, and places that leave it are counted. Words that make up more than a 256th
    of a long text have their places as one integer, 256 such words at most; the others have a list, of which the
    part in the band is used. So memory is proportional to the text.
    """
    n, wide = len(a), 2 * band + 1
    lists: dict[Hashable, list[int]] = {}
    for i, w in enumerate(a):
        lists.setdefault(w, []).append(i)
    least = 0 if n <= SHORT_WORDS else n // 256
    bits = {w: _bits(at, 0, n) for w, at in lists.items() if len(at) > least}
    free = full = (1 << wide) - 1
    top, matched = 1 << wide - 1, 0
    for j, w in enumerate(b):
        low = j - band
        at = bits.get(w)
        if at is not None:
            hit = free & (at >> low if low >= 0 else at << -low)
        elif w in lists:
            at = lists[w]
            hit = free & _bits(at[bisect_left(at, low) : bisect_right(at, j + band)], low, wide)
        else:
            hit = 0
        if hit:
            free = (free + hit | free - hit) & full
        if not free & 1:
            matched += 1
        free = free >> 1 | top
    return matched + wide - free.bit_count()


def _bits(places: list[int], low: int, wide: int) -> int:
    """The integer whose bits ``place - low`` are set."""
    if len(places) < 8:
        return sum(1 << p - low for p in places)
    flags = np.zeros(wide, np.uint8)
    flags[np.array(places) - low] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row (node, text) for each wanted node."""
    named = docs.select(F.unhex(F.md5(text_or_empty().cast("binary"))).alias("node"), text_or_empty().alias("text"))
    return named.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def _aligned(pairs: DataFrame, threshold: float) -> DataFrame:
    """The rows (u, v) of ``pairs`` (u, v, text_u, text_v) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, []
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if b != last:
                    last, words = b, b.split()
                if similar(a.split(), words, threshold):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (0, 1)], names=["u", "v"])

    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(run, "u binary, v binary")


def _common_words(texts: list[list[int]]) -> Callable[[int], np.ndarray]:
    """A function of ``i``: how many words text ``i`` has in common with each text, as bags. No common subsequence
    is longer. The n-th occurrences of a word are one entry of an index, which has a place for every word of the texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.fromiter(chain.from_iterable(texts), np.int64, sizes.sum())
    owner = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((owner, words))
    changed = np.ones(len(words), bool)
    changed[1:] = (np.diff(words[order]) != 0) | (np.diff(owner[order]) != 0)
    places = np.arange(len(words))
    occurrence = places - np.maximum.accumulate(np.where(changed, places, 0))
    entry = np.empty(len(words), np.int64)
    entry[order] = words[order] * (occurrence.max(initial=0) + 1) + occurrence
    _, entry, count = np.unique(entry, return_inverse=True, return_counts=True)
    owners = owner[np.argsort(entry, kind="stable")].astype(np.int32)
    end, last = np.cumsum(count), np.cumsum(sizes)

    def common(i: int) -> np.ndarray:
        mine = entry[last[i] - sizes[i] : last[i]]
        found = [owners[x:y] for x, y in zip((end[mine] - count[mine]).tolist(), end[mine].tolist())]
        return np.bincount(np.concatenate(found), minlength=len(texts)) if found else np.zeros(len(texts), np.int64)

    return common


def _settle(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) inside block pairs. Columns: key, a, b, outside, blk, node, comp, n_words, keys, text; pairs
    have one row of block ``a`` outside the largest class, at least, and lie in different classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in contiguous_groups(batches, 3):
            key, a, b = (group.column(i)[0].as_py() for i in range(3))
            outside, blk = group.column(3).to_pylist(), group.column(4).to_pylist()
            node, comp = group.column(5).to_pylist(), group.column(6).to_pylist()
            size = group.column(7).to_numpy()
            keys = group.column(8).flatten().to_numpy().reshape(len(node), -1)
            ids: dict[str, int] = {}  # words are numbers here: a block holds far fewer distinct ones
            text = [[ids.setdefault(w, len(ids)) for w in t.split()] for t in group.column(9).to_pylist()]
            common = None  # indexed when first needed
            first_block, is_out, place = np.array(blk) == a, np.array(outside), np.arange(len(node))
            parent: dict = {}

            def find(x):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            links = []
            for i in np.nonzero(is_out & first_block)[0].tolist():
                longer = np.maximum(size, size[i])
                ok = np.minimum(size, size[i]) >= threshold * longer
                ok &= ~is_out | (place > i if a == b else ~first_block)  # pairs outside the class are met once
                at = np.nonzero(ok)[0]
                at = at[keys[at, (keys[at] == keys[i]).argmax(axis=1)] == key]
                if len(at):
                    common = common or _common_words(text)
                    at = at[common(i)[at] >= -np.floor(-threshold * longer[at])]
                for j in at.tolist():
                    x, y = find(comp[i]), find(comp[j])
                    if x != y and similar(text[i], text[j], threshold):
                        parent[max(x, y)] = min(x, y)
                        links.append((node[i], node[j]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links)], names=["u", "v"])

    return rows.select("key", "a", "b", "outside", "blk", "node", "comp", "n_words", "keys", "text").mapInArrow(run, "u binary, v binary")


def _pairs_of_blocks(members: DataFrame, block: int) -> DataFrame:
    """Rows of mixed buckets, for each block pair they are needed in: (a, b) with ``a`` a block outside the
    largest class, ``b`` another of those (b >= a) or, shifted by the number of those, one of the largest class.
    Blocks hold about ``block`` words, so that a task's memory is bounded whatever the length of the texts. A bucket
    with no more words than a pair of blocks is one block, and each of its rows is needed once."""
    of: Callable = lambda n: F.greatest(F.ceil(n / F.lit(block)).cast("int"), F.lit(1))
    whole = F.col("words_out") + F.col("words_in") <= 2 * block
    sized = members.withColumn("ob", F.when(whole, 1).otherwise(of(F.col("words_out")))).withColumn("ib", F.when(whole, 0).otherwise(of(F.col("words_in"))))
    spread = F.pmod(F.xxhash64(F.lit(5), F.col("node")), F.when(F.col("outside"), F.col("ob")).otherwise(F.greatest("ib", F.lit(1)))).cast("int")
    placed = sized.withColumn("blk", F.when(F.col("outside"), spread).when(F.col("ib") == 0, 0).otherwise(F.col("ob") + spread))
    every: Column = F.sequence(F.lit(0), F.col("ob") - 1)
    mine = F.when(
        F.col("outside"),
        F.concat(
            F.transform(every, lambda o: F.struct(F.least(o, F.col("blk")).alias("a"), F.greatest(o, F.col("blk")).alias("b"))),
            F.transform(F.slice(F.sequence(F.col("ob"), F.col("ob") + F.col("ib")), 1, F.col("ib")), lambda i: F.struct(F.col("blk").alias("a"), i.alias("b"))),
        ),
    ).otherwise(F.transform(every, lambda o: F.struct(o.alias("a"), F.col("blk").alias("b"))))
    return placed.withColumn("__p", F.explode(mine)).select("key", F.col("__p.a").alias("a"), F.col("__p.b").alias("b"), "outside", "blk", "node", "comp", "n_words")


def _classified(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Sketches of ``docs`` and their nodes: (node, least, copies, root)."""
    docs = docs.select("doc_id", "text")
    sketched = materialize(sketches(docs), "sketches")
    nodes = materialize(sketched.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys")), "sketch-nodes")
    exploded = nodes.where("keys is not null").select("node", "n_words", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").count().where("count > 1")
    members = materialize(exploded.join(shared, "key"), "buckets")

    # One leader for each block of each bucket; the blocks of a large bucket differ from key to key.
    block = F.pmod(F.xxhash64("key", "node"), F.greatest(F.ceil(F.col("count") / F.lit(LEADER_BLOCK)), F.lit(1)).cast("long"))
    placed = members.withColumn("blk", block)
    leaders = placed.groupBy("key", "blk").agg(F.min("node").alias("v"))
    stars = materialize(placed.join(leaders, ["key", "blk"]).where("node <> v").select(F.col("node").alias("u"), "v").distinct(), "stars")
    wanted = members.select("node").distinct()
    texts = materialize(_texts(docs, wanted), "bucket-texts")
    pairs = stars.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    links = materialize(_aligned(pairs, threshold), "links")
    discard(stars)
    roots = connected_components(links)
    discard(links)

    # Buckets of three or more texts that still lie in different classes.
    classed = members.where("count > 2").join(roots, "node", "left").select("key", "node", "n_words", F.coalesce("root", "node").alias("comp"))
    sizes = classed.groupBy("key", "comp").agg(F.sum("n_words").alias("words"))
    largest = sizes.groupBy("key").agg(F.count("*").alias("classes"), F.sum("words").alias("words"), F.max(F.struct("words", "comp")).alias("top")).where("classes > 1")
    mixed = classed.join(largest, "key").select("key", "node", "n_words", "comp", (F.col("comp") != F.col("top.comp")).alias("outside"), (F.col("words") - F.col("top.words")).alias("words_out"), F.col("top.words").alias("words_in"))
    rows = _pairs_of_blocks(mixed, BLOCK_WORDS).join(nodes.select("node", "keys").join(texts, "node"), "node")
    more = materialize(_settle(rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "node"), threshold), "links")
    discard(members)
    discard(texts)
    named = nodes.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if not more.isEmpty():  # these few links join classes, not texts
        at = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        between = more.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
        merged = connected_components(between).select(F.col("node").alias("root"), F.col("root").alias("__root"))
        named = named.join(merged, "root", "left").withColumn("root", F.coalesce("__root", "root")).drop("__root")
    discard(more)

    return sketched, named


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), kept (doc_id = class_id), n_class."""
    sketched, named = _classified(docs, threshold)
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("n_class"))
    of_node = named.select("node", "root").join(classes, "root").select("node", "class_id", "n_class")
    return sketched.select("doc_id", "node").join(of_node, "node").select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_class")


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each class: that of the least doc_id, nulls last, then of the least digest."""
    _, named = _classified(docs, threshold)
    first = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("unnamed"), "least", "node")).alias("first"))
    chosen = first.select(F.col("first.least").alias("__least"), F.col("first.node").alias("__node"))
    digest = docs.withColumn("__digest", F.unhex(F.md5(text_or_empty().cast("binary"))))
    same = (F.col("__digest") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__least"))
    return digest.join(chosen, same, "left_semi").dropDuplicates(["__digest"]).drop("__digest")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
