"""Media columns: payload bytes kept as progressive JPEG files, and such files as RGB tensors.

``store_payload`` writes each text's UTF-8 bytes, filled with zeros to a positive multiple of 64, as the coefficients of
a file (see ``jpeg``); ``decode_media`` turns any column of progressive files into tensors; ``media_digest`` reads what
was stored back and says what it read. Each works on a batch of rows at a time, bounded by bytes.

Cases: a null text counts as empty (64 zero bytes); equal texts give equal files; a text too long for one picture
(over 1.5 GB) raises; in ``decode_media`` a null file gives null and a broken or not progressive file raises; null ids
stay null; repeated rows repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import keyed, map_arrow

UNIT = 64
BATCH_BYTES = 2 << 20


def _ranges(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, size in enumerate(sizes):
        total += size + 512
        if total >= BATCH_BYTES:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % UNIT if data else UNIT)


def store_payload(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: the text's bytes as a progressive JPEG file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in _ranges([len(x or "") for x in texts]):
                yield {"doc_id": ids[a:b], "n_bytes": [len((x or "").encode()) for x in texts[a:b]], "media": jpeg.store([padded(x) for x in texts[a:b]])}

    return map_arrow(keyed(df, id_col, text_col), rows, "doc_id long, n_bytes long, media binary")


def decode_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, width, height and rgb: the full-resolution tensor [height, width, 3] as bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, media = batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()
            for a, b in _ranges([len(x or b"") for x in media]):
                files = [jpeg.parse(x) for x in media[a:b] if x is not None]
                tensors = iter(jpeg.pictures(files, jpeg.coefficients_of(files)))
                own = [None if x is None else next(tensors) for x in media[a:b]]
                yield {
                    "doc_id": ids[a:b],
                    "width": [None if x is None else x.shape[1] for x in own],
                    "height": [None if x is None else x.shape[0] for x in own],
                    "rgb": [None if x is None else x.tobytes() for x in own],
                }

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return map_arrow(docs, rows, "doc_id long, width int, height int, rgb binary")


def feature(picture: np.ndarray) -> str:
    """Mean colours of a 4 x 4 grid, as hex."""
    high, wide = picture.shape[:2]
    rows, columns = (np.arange(4) * high) // 4, (np.arange(4) * wide) // 4
    sums = np.add.reduceat(np.add.reduceat(picture, rows, axis=0, dtype=np.int64), columns, axis=1)
    area = np.diff(np.append(rows, high))[:, None, None] * np.diff(np.append(columns, wide))[None, :, None]
    return (sums // area).astype(np.uint8).tobytes().hex()


def media_digest(stored: DataFrame) -> DataFrame:
    """What the files of ``store_payload`` hold when read back, and the feature of their picture."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            media = batch.column("media").to_pylist()
            for a, b in _ranges([len(x) for x in media]):
                files, coefficients, payloads = jpeg.load(media[a:b])
                yield {
                    "doc_id": batch.column("doc_id")[a:b],
                    "n_bytes": batch.column("n_bytes")[a:b],
                    "payload_bytes": [len(x) for x in payloads],
                    "payload_sha256": [hashlib.sha256(x).hexdigest() for x in payloads],
                    "tail_crc32": [zlib.crc32(x[-UNIT:]) for x in payloads],
                    "media_bytes": [len(x) for x in media[a:b]],
                    "media_sha256": [hashlib.sha256(x).hexdigest() for x in media[a:b]],
                    "feature": [feature(x) for x in jpeg.pictures(files, coefficients)],
                }

    return map_arrow(stored, rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
