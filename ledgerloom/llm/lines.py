"""Line deduplication by winnowing.

The lines of a document that are not blank, without white space at their ends, are hashed. A passage is the fewest
lines in a row, from a line on or back from it, that have ``LEAST_WORDS`` words: a long line is one alone. The hash of
every passage is a fingerprint. Winnowing guarantees a common run of window + gram - 1 units; the shortest run to be
found here is one passage, so the window is one and every minimum is selected. Each fingerprint is joined with its first
occurrence by (doc_id, line), and a passage that occurred before is deleted; passages of a run overlap or touch, so
deleting all of them extends a match both ways to the ends of the run.

What goes is exactly the lines of runs of ``LEAST_WORDS`` words and more that occurred before. Every line of such a run
lies in a passage inside the run: in the one from it on or the one back to it, or if both leave the run, in the last
passage that begins in the run before it. Passages depend on their own lines only, so they are the same in both places,
and it makes no difference which document was first with which part of a run. The first occurrence of a line is never
deleted: what goes always has an equal line before it.

A fingerprint of a third of all documents costs one partial aggregate and a join with one row for it; nothing is
gathered per fingerprint. What is gathered per document is bounded by its lines.

Cases: null and empty texts have no lines and stay as they are; blank lines between deleted lines go with them, others
stay; documents with one id are ordered by a hash of the text, and rows alike in id and text count as one document, so
they get the same result and don't delete each other; null ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow

LEAST_WORDS = 8
_LOWEST = -(1 << 63)


def line_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word counts of the lines that are not blank."""
    lines = [s for x in (text or "").split("\n") if (s := x.strip())]
    return np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64), np.array([len(x.split()) for x in lines], np.uint32)


def passages(hashes: np.ndarray, words: np.ndarray, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins, ends and fingerprints of the shortest runs of ``least_words`` words from each line on and back from it."""
    n, least = hashes.size, max(1, least_words)
    total = np.append(0, np.cumsum(words, dtype=np.int64))  # grows with every line
    on, back = np.searchsorted(total, total[:-1] + least), np.searchsorted(total, total[1:] - least, "right") - 1
    forward, backward = np.flatnonzero(on <= n), np.flatnonzero(back >= 0)
    spans = np.unique(np.append(forward * (n + 1) + on[forward], back[backward] * (n + 1) + backward + 1))
    begin, end = spans // (n + 1), spans % (n + 1)
    value = np.zeros(spans.size, np.uint64)
    for k in range(int((end - begin).max(initial=0))):
        inside = begin + k < end
        mixed = (value[inside] ^ hashes[begin[inside] + k]) * np.uint64(0x9E3779B97F4A7C15)
        value[inside] = mixed ^ (mixed >> np.uint64(29))
    return begin, end, value


def _identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.withColumns({"_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)), "_of": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})


def repeated_runs(df: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", copies: bool = True) -> DataFrame:
    """_doc, _of (what identifies a document) and _runs: its deleted passages, each as begin * 2^32 + end.
    Without ``copies`` a document of one line stays if the first with that line has only it, too."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("_at", "_print", "_all")}
            for text in batch.column("_text").to_pylist():
                hashes, words = line_hashes(text)
                begin, end, value = passages(hashes, words, least_words)
                out["_all"].append(hashes.size == 1)
                out["_at"].append(begin << 32 | end)
                out["_print"].append(value.view(np.int64))
            yield {"_doc": batch.column("_doc"), "_of": batch.column("_of")} | out

    texts = _identified(df, id_col, text_col).select("_doc", "_of", F.col(text_col).alias("_text"))
    lines = checkpointed(map_arrow(texts, hashed, "_doc long, _of long, _at array<long>, _print array<long>, _all boolean").where(F.size("_at") > 0))
    prints = lines.select("_doc", "_of", "_all", F.explode(F.arrays_zip("_at", "_print")).alias("_x")).select("_doc", "_of", "_all", F.col("_x._at").alias("_at"), F.col("_x._print").alias("_print"))
    place = F.struct("_doc", "_of", "_at", "_all")
    first = prints.groupBy("_print").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = prints.join(first, "_print").where(place > F.col("_first"))
    if not copies:
        later = later.where(~(F.col("_all") & F.col("_first._all")))
    return later.groupBy("_doc", "_of").agg(F.collect_set("_at").alias("_runs"))


def kept_text(text: str | None, runs: list[int] | None) -> tuple[str | None, int, int]:
    """The text without the runs (begin * 2^32 + end), its number of lines that are not blank, and how many of these were deleted."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    solid = [i for i, x in enumerate(lines) if x.strip()]
    if not runs:
        return text, len(solid), 0
    gone = np.zeros(len(solid), bool)
    for run in runs:
        gone[run >> 32 : run & 0xFFFFFFFF] = True
    drop = np.zeros(len(lines), bool)
    for k in np.flatnonzero(gone).tolist():
        drop[solid[k] : solid[k + 1] if k + 1 < len(solid) and gone[k + 1] else solid[k] + 1] = True
    return "\n".join(x for x, y in zip(lines, drop, strict=True) if not y), len(solid), int(gone.sum())


def dedup_lines(df: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", copies: bool = True) -> DataFrame:
    """The rows of ``df`` with the repeated runs cut from the text, and what was cut in two columns at the end,
    n_lines and n_removed (columns of these names in ``df`` are replaced). Without ``copies`` documents of one line
    that copy a whole document are left to who compares documents."""
    df = df.drop("n_lines", "n_removed")
    marked = _identified(df, id_col, text_col).join(repeated_runs(df, least_words, id_col, text_col, copies), ["_doc", "_of"], "left").drop("_doc", "_of")
    columns = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", n_lines long, n_removed long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            done = [kept_text(*x) for x in zip(batch.column(text_col).to_pylist(), batch.column("_runs").to_pylist(), strict=True)]
            yield {c: batch.column(c) for c in columns} | {text_col: [x[0] for x in done], "n_lines": [x[1] for x in done], "n_removed": [x[2] for x in done]}

    return map_arrow(marked, cut, schema)
