"""Best-fit packing after Martello-Toth dominance reduction, planned on the histogram of lengths.

Pieces of one length are interchangeable, so the instance is its histogram: at most ``capacity`` counts, however
many documents there are. The driver reduces it (sets that dominate every other way to fill the sequence of an
item are fixed for good, in rounds until no length has one), packs the rest best-fit decreasing, and gets groups of equal sequences. Pieces find
their place by their rank among the pieces of their length: ranks are counted in hash buckets, offset by the
counts of the buckets before, so that no length's pieces are ever gathered in one task.

Defined cases: a null text is empty and packs as its end id alone; repeated rows are packed each; an empty
table packs into nothing; a key may be null or repeat; the string of a special token in a text is that token,
unless ``special_as_text``; extra columns of the documents are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, table
from plumbline.llm.document_pieces import token_pieces

CAPACITY = 1024
#: Ranks are counted in buckets of about this many pieces.
BUCKET_ROWS = 200_000
#: Placement rows up to which they are broadcast: six numbers each, some ten MB at most.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Group:
    """``bins`` sequences, each holding ``count`` pieces of ``length`` for every (length, count) of the pattern."""

    pattern: tuple[tuple[int, int], ...]
    bins: int


class _Pool:
    """Counts of the lengths still to be placed."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.n = [0] * (capacity + 1)
        for length, count in histogram.items():
            self.n[length] += count

    def take(self, *lengths: int, times: int = 1) -> None:
        for x in lengths:
            self.n[x] -= times

    def largest(self, most: int, without: tuple[int, ...]) -> int:
        """The largest length up to ``most`` that is there beside ``without``; 0 if none."""
        for x in range(most, 0, -1):
            if self.n[x] > without.count(x):
                return x
        return 0

    def smallest(self, k: int, without: int) -> list[int]:
        """The ``k`` smallest pieces beside one of length ``without``."""
        out: list[int] = []
        for x, c in enumerate(self.n):
            out += [x] * min(k - len(out), max(0, c - (x == without)))
            if len(out) == k:
                break
        return out

    def lower_of_best_pair(self, room: int, without: int) -> tuple[int, int]:
        """Over pairs that fit ``room``: the largest lower member, and the largest sum."""
        lower = best = 0
        for d in range(room // 2, 0, -1):
            if self.n[d] > (d == without) and (c := self.largest(room - d, (without, d))) >= d:
                lower, best = lower or d, max(best, c + d)
        return lower, best


def reduce_by_dominance(histogram: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """Fixed sequences and the histogram of what is left.

    For an open length j, the largest first, with room R beside it, and k the largest piece that fits R, a set S with j
    dominates when every feasible set beside j can be exchanged for S piece by piece: {j} if nothing fits; {j, k}
    if k fills R, if no two pieces fit R, or if at most two do and no pair exceeds k; {j, k, b} if at most two
    fit, b is the largest that fits beside k, and no pair has a lower member above b.
    """
    pool, fixed = _Pool(histogram, capacity), []

    def fix(j: int, *partners: int) -> None:
        chosen = (j, *partners)
        times = min(pool.n[x] // chosen.count(x) for x in chosen)
        pool.take(*chosen, times=times)
        fixed.append(Group(tuple((x, chosen.count(x)) for x in sorted(set(chosen), reverse=True)), times))

    def dominating(j: int) -> tuple[int, ...] | None:
        """The partners of a set with ``j`` that dominates; None if none is known."""
        room = capacity - j
        k = pool.largest(room, (j,))
        if not k:
            return ()
        small = pool.smallest(3, j)
        if k == room or len(small) < 2 or small[0] + small[1] > room:
            return (k,)
        if len(small) == 3 and sum(small) <= room:
            return None
        lower, best = pool.lower_of_best_pair(room, j)
        if best <= k:
            return (k,)
        b = pool.largest(room - k, (j, k))
        return (k, b) if b and b >= lower else None

    more = True
    while more:  # sets that were fixed late can open the way for lengths that were passed over
        before = len(fixed)
        for j in range(capacity, 0, -1):
            while pool.n[j] and (partners := dominating(j)) is not None:
                fix(j, *partners)
        more = len(fixed) > before
    return fixed, {x: c for x, c in enumerate(pool.n) if c}


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Best fit over lengths in decreasing order, on groups of equal sequences at once."""
    by_room: list[list[Group]] = [[] for _ in range(capacity + 1)]
    for s in sorted(histogram, reverse=True):
        left = histogram[s]
        room = s
        while left:
            while room < capacity and not by_room[room]:
                room += 1
            group = by_room[room].pop() if room < capacity else Group((), left)
            each = room // s
            full = min(group.bins, left // each)
            left -= full * each
            rest = group.bins - full
            if full:
                by_room[room - each * s].append(Group((*group.pattern, (s, each)), full))
            if left and rest:
                by_room[room - left * s].append(Group((*group.pattern, (s, left)), 1))
                rest, left = rest - 1, 0
            if rest and group.pattern:
                by_room[room].append(Group(group.pattern, rest))
            room = s
    return [g for groups in by_room for g in groups if g.pattern]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    fixed, rest = reduce_by_dominance(histogram, capacity)
    return fixed + best_fit_decreasing(rest, capacity)


def segments(groups: list[Group]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, pieces a sequence, offset of the first)."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for g in groups:
        offset = 0
        for length, each in g.pattern:
            first = rank.get(length, 0)
            rank[length] = first + g.bins * each
            out.append((length, first, rank[length], sequence, each, offset))
            offset += length * each
        sequence += g.bins
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (a materialised table with ``length``) with ``sequence_id`` and ``offset``.

    All columns of ``pieces`` come through; ``order`` names those that settle which of two equal lengths comes
    first. Lengths must lie in 1..capacity.
    """
    spark = pieces.sparkSession
    histogram = {int(r["length"]): r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ROWS))
    placed = pieces.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = placed.groupBy("length", "__b").count()
    before = counts.select("length", "__b", (F.sum("count").over(Window.partitionBy("length").orderBy("__b")) - F.col("count")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__b").orderBy(*order)) - 1
    ranked = placed.withColumn("__rank", rank).join(before, ["length", "__b"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    rows = segments(plan(histogram, capacity))
    found = spark.createDataFrame(rows, "length long, __first long, __after long, __sequence long, __each long, __offset long")
    found = F.broadcast(found) if len(rows) <= BROADCAST_ROWS else found.hint("merge")
    at = (F.col("__rank") - F.col("__first")).cast("long")
    return (
        ranked.join(found, (ranked["length"] == found["length"]) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__after")))
        .select(
            *[ranked[c] for c in pieces.columns],
            (F.col("__sequence") + F.floor(at / F.col("__each"))).cast("long").alias("sequence_id"),
            (F.col("__offset") + at % F.col("__each") * ranked["length"]).cast("long").alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer_path, capacity, special_as_text=special_as_text).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(materialize(pieces, "pieces"), capacity, ("doc_id", "piece", "start", "length", "ids_crc32"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
