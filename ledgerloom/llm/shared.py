"""How many documents hold a key, for keys too many to be rows.

Documents are dealt to batches by a hash of the id. Each batch turns its documents into 64-bit keys, sorts the distinct
48-bit ones and sends them, packed in binary columns and split by range, to that range's group, which counts documents
over all batches and sends back one byte a key: the bit length of the count (1: one document, 2: two or three, ...).
So a key costs five bytes one way and a compressed byte back, where a row would cost thirty and more; memory is bounded
by the size of a batch and of a range. A key of a third of all documents is one entry per batch.

48 bits of a key can agree by chance; a key then looks held by more documents than it is. Who uses the classes must be
right under any classes that are the same for all holders of a key.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema

#: Characters of text in a batch.
BATCH_CHARS = 4 << 20
KEY_BITS = 48


def batches_of(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """``docs`` with _batch, and the number of batches. Rows with one id share a batch."""
    total = docs.agg(F.sum(F.length(text_col) + F.lit(64).cast("long"))).first()[0] or 0
    count = max(1, -(-int(total) // BATCH_CHARS))
    return docs.withColumn("_batch", F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(count)).cast("int")), count


def distinct_keys(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 48-bit keys, for each key of all documents its place there, and documents by key. Keys of a document
    must differ."""
    every = np.concatenate(keys) >> np.uint64(64 - KEY_BITS) if keys else np.zeros(0, np.uint64)
    return np.unique(every, return_inverse=True, return_counts=True)


def classes_of(docs: DataFrame, count: int, keys_of: Callable[[pa.Table], list[np.ndarray]]) -> DataFrame:
    """_batch, _range, _classes for the distinct keys of each batch (ranges in order make up the batch's keys)."""
    ranges = max(8, min(16, (2 * count - 1).bit_length()))
    below = KEY_BITS - ranges  # at most 40 bits

    def split(table: pa.Table) -> pa.Table:
        keys, _, docs = distinct_keys(keys_of(table))
        cuts = np.searchsorted(keys >> np.uint64(below), np.arange((1 << ranges) + 1))
        rest = keys & np.uint64((1 << below) - 1)
        low, high = rest.astype(np.uint32), (rest >> np.uint64(32)).astype(np.uint8)
        out: dict[str, list] = {k: [] for k in ("_batch", "_range", "_low", "_high", "_many")}
        batch = table.column("_batch")[0].as_py()
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[r], cuts[r + 1]
            some = np.flatnonzero(docs[a:b] > 1)
            for k, v in zip(out, (batch, r, low[a:b].tobytes(), high[a:b].tobytes(), np.stack([some, docs[a:b][some]]).astype(np.uint32).tobytes()), strict=True):
                out[k].append(v)
        return pa.table(out, schema=packed)

    def count_range(table: pa.Table) -> pa.Table:
        low = [np.frombuffer(x, np.uint32) for x in table.column("_low").to_pylist()]
        key = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("_high").to_pylist()]).astype(np.uint64) << np.uint64(32) | np.concatenate(low)
        sizes = np.array([x.size for x in low])
        docs = np.ones(key.size, np.int64)
        for start, many in zip((np.cumsum(sizes) - sizes).tolist(), table.column("_many").to_pylist(), strict=True):
            place, held = np.frombuffer(many, np.uint32).reshape(2, -1)
            docs[start + place.astype(np.int64)] = held
        order = np.argsort(key, kind="stable")
        first = np.append(True, key[order][1:] != key[order][:-1])
        group = np.cumsum(first) - 1
        total = np.bincount(group, docs[order]).astype(np.int64)
        classes = np.empty(key.size, np.uint8)
        classes[order] = np.floor(np.log2(total)).astype(np.uint8)[group] + 1
        answers = [zlib.compress(x.tobytes(), 1) for x in np.split(classes, np.cumsum(sizes)[:-1])]
        return pa.table({"_batch": table.column("_batch"), "_range": table.column("_range"), "_classes": answers}, schema=answered)

    packed_schema = "_batch int, _range int, _low binary, _high binary, _many binary"
    answered_schema = "_batch int, _range int, _classes binary"
    packed, answered = arrow_schema(packed_schema), arrow_schema(answered_schema)
    return docs.groupBy("_batch").applyInArrow(split, packed_schema).groupBy("_range").applyInArrow(count_range, answered_schema)


def with_classes(docs: DataFrame, classes: DataFrame, rows_of: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``rows_of(documents of a batch, classes of its distinct keys in order)`` for every batch."""
    empty = arrow_schema(schema)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty.empty_table()
        order = np.argsort(answers.column("_range").to_numpy(), kind="stable")
        parts = answers.column("_classes").to_pylist()
        return rows_of(table, np.frombuffer(b"".join(zlib.decompress(parts[i]) for i in order), np.uint8))

    return docs.groupBy("_batch").cogroup(classes.groupBy("_batch")).applyInArrow(run, schema)
