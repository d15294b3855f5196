"""Documents as token pieces of bounded length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.chunked_text import hf_chunks, runs, text_batches
from plumbline.llm.common import spread

END_ID = 2


def cut(totals: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of ``totals`` ids (one at least): document, piece, start, length of each. All pieces
    are full except perhaps a document's first."""
    count = -(-totals // capacity)
    document = np.repeat(np.arange(len(totals)), count)
    piece = runs(np.zeros(len(totals), np.int64), count)
    head = (totals - (count - 1) * capacity)[document]
    start = np.where(piece == 0, 0, head + (piece - 1) * capacity)
    return document, piece, start, np.where(piece == 0, head, capacity)


def encoded_documents(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int = END_ID, special_as_text: bool = False) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Keys, ids and numbers of ids of whole documents (column 0: the key, column 1: the text), each closed by
    ``end_id``."""
    encoder = hf_chunks(tokenizer_path, special_as_text)
    for batch in batches:
        for (keys,), texts in text_batches([batch.column(0).to_pylist()], batch.column(1).to_pylist()):
            ids, counts = encoder.encode(texts)
            yield keys, np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array whose values are consecutive runs of ``data``, of ``lengths`` items each."""
    ends = np.concatenate([[0], np.cumsum(lengths)]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, key: str = "doc_id", end_id: int = END_ID, special_as_text: bool = False) -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length`` and ``ids`` (little-endian uint32).

    A document's ids end with ``end_id``; a null text is empty and so gives the one id ``end_id``. Only
    documents of more than ``capacity`` ids are cut, and the ids of the pieces in order are the document's.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids binary"
    key_type = to_arrow_type(docs.schema[key].dataType)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, counts in encoded_documents(batches, tokenizer_path, end_id, special_as_text):
            document, piece, start, length = cut(counts, capacity)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type).take(pa.array(document)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), binaries(ids.astype("<u4"), length)],
                names=[key, "piece", "start", "length", "ids"],
            )

    return spread(docs.select(F.col(key), F.col("text"))).mapInArrow(pieces, schema)
