"""Groups of a bounded size that stream through a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contiguous_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal values in the first ``n_keys`` columns (numbers without nulls)."""
    waiting: list[pa.RecordBatch] = []
    last: tuple | None = None

    def joined() -> pa.RecordBatch:
        if len(waiting) == 1:
            return waiting[0]
        return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
        for begin, end in zip(starts, starts[1:]):
            key = tuple(k[begin] for k in keys)
            if waiting and key != last:
                yield joined()
                waiting = []
            waiting.append(batch.slice(begin, end - begin))
            last = key
    if waiting:
        yield joined()


def block_pairs(members: DataFrame, size: Column, node: str, limit: int) -> DataFrame:
    """``members`` once for each pair of blocks they are in: columns ``a <= b`` name the pair, ``blk`` the row's block.

    ``size`` is the number of members of the row's bucket. Blocks hold about ``limit`` members, so that every
    pair of members meets in one group of at most about ``2 * limit`` rows.
    """
    n = F.greatest(F.ceil(size / F.lit(limit)).cast("int"), F.lit(1))
    placed = members.withColumn("__n", n).withColumn("blk", F.pmod(F.xxhash64(F.lit(7), F.col(node)), F.col("__n")).cast("int"))
    spread = placed.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return spread.withColumn("a", F.least("blk", "__o")).withColumn("b", F.greatest("blk", "__o")).drop("__n", "__o")
