"""Best-fit packing with exact-complement hashing.

Pieces (documents cut at the sequence length) are packed by length, not one by one: a plan is made over the histogram
of lengths, whose size is bounded by the sequence length whatever the number of documents. The plan indexes the sums of
one, two and three available lengths; starting from the longest length left it takes a combination that fills the gap
exactly, as often as the availability counts allow, and only if there is none adds the longest length that fits (best
fit) and looks again. Each pattern leaves some length with fewer pieces than it takes of it, so the number of patterns is
a small multiple of that of lengths.

Pieces of one length are interchangeable, so a piece needs only its rank among them. Ranks come from counts per
(length, salt): a length that holds many pieces is spread over windows of about ``WINDOW_ROWS`` each, or larger ones
where that would be over ``WINDOWS``.

Cases: a null text is an empty document (one piece: the end token); an empty table gives no pieces; repeated rows and
null ids are packed as documents of their own; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, keyed, map_arrow
from .tokens import ChunkEncoder, by_bytes, encoded

END_ID = 0
#: Pieces of one length that are ranked in one window, and how many windows there may be besides one a length.
WINDOW_ROWS, WINDOWS = 50_000, 10_000


def pieces(df: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", ranks: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. Only documents over ``limit`` are cut; the first piece
    takes the remainder, so all others are full."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = ChunkEncoder.of(tokenizer_path, False, ranks)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for first, last in by_bytes(texts, 8 << 20):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for doc_id, code in zip(ids[first:last], encoded(texts[first:last], encoder), strict=True):
                    code += END_ID.to_bytes(4, "little")
                    n = len(code) // 4
                    starts = [0, *range(n % limit or limit, n, limit)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                        out["doc_id"].append(doc_id)
                        out["piece"].append(k)
                        out["start"].append(a)
                        out["length"].append(b - a)
                        out["ids_crc32"].append(zlib.crc32(code[4 * a : 4 * b]))
                yield out

    return map_arrow(keyed(df, id_col, text_col), rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _complement(have: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """The one, two or three available lengths that sum to ``gap``, fewest and longest first; None if there are none."""
    if gap < have.size and have[gap]:
        return (gap,)
    some = have > 0

    def pair(total: int, most: int) -> tuple[int, int] | None:
        high = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        good = high[some[high] & some[total - high] & ((high * 2 != total) | (have[high] > 1))] if high.size else high
        return (int(good[0]), total - int(good[0])) if good.size else None

    if found := pair(gap, gap):
        return found
    for a in np.flatnonzero(some[1:gap])[::-1] + 1:
        a = int(a)
        if 3 * a < gap:
            break
        have[a] -= 1
        some[a] = have[a] > 0
        rest = pair(gap - a, a)
        have[a] += 1
        some[a] = True
        if rest:
            return (a, *rest)
    return None


def plan(counts: np.ndarray, limit: int) -> list[tuple[list[int], int]]:
    """[(lengths of a sequence, number of such sequences)] that use up ``counts``, indexed by length."""
    have = np.zeros(limit + 1, np.int64)
    have[: counts.size] = counts
    made: list[tuple[list[int], int]] = []
    for longest in range(limit, 0, -1):
        while have[longest]:
            have[longest] -= 1  # the pattern under way holds one of each length it uses
            pattern, gap = [longest], limit - longest
            while gap:
                if exact := _complement(have, gap):
                    pattern += exact
                    have -= np.bincount(exact, minlength=limit + 1)
                    gap = 0
                elif (fit := np.flatnonzero(have[1 : gap + 1])).size:
                    pattern.append(int(fit[-1]) + 1)
                    have[pattern[-1]] -= 1
                    gap -= pattern[-1]
                else:
                    break
            use = np.bincount(pattern, minlength=limit + 1)
            more = int((have[use > 0] // use[use > 0]).min())
            have -= more * use
            made.append((pattern, 1 + more))
    return made


def _slots(made: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) of each slot; a slot holds consecutive ranks of its length."""
    out, used, sequence = [], {}, 0
    for pattern, times in made:
        offset = 0
        for length in pattern:
            out.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    return out


def pack(parts: DataFrame, limit: int = 2048) -> DataFrame:
    """``parts`` (with doc_id, piece, start and length up to ``limit``) with sequence_id and offset."""
    spark = parts.sparkSession
    sizes = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most limit
    most = max(WINDOW_ROWS, sum(sizes.values()) // WINDOWS)
    hot = {length: -(-n // most) for length, n in sizes.items() if n > most}
    salts = F.coalesce(F.create_map(*(F.lit(x).cast("long") for kv in hot.items() for x in kv))[F.col("length")], F.lit(1)) if hot else F.lit(1)
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), salts).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).collect()  # at most 2 x limit + WINDOWS
    counts = np.zeros(limit + 1, np.int64)
    base: dict[tuple[int, int], int] = {}
    for g in sorted(groups):
        base[g["length"], g["_salt"]] = int(counts[g["length"]])
        counts[g["length"]] += g["n"]
    slots = _slots(plan(counts, limit))
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for length, *slot in sorted(slots):
        by_length.setdefault(length, []).append(tuple(slot))
    tables = {k: np.array(v, np.int64).T for k, v in by_length.items()}
    sent = spark.sparkContext.broadcast((base, tables))  # bounded by the limit, not by the data
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order))
    kept = parts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        base, tables = sent.value
        for batch in batches:
            lengths, salts, ranks = (batch.column(c).to_numpy() for c in ("length", "_salt", "_rank"))
            sequence, offset = np.empty(lengths.size, np.int64), np.empty(lengths.size, np.int64)
            order = np.lexsort((salts, lengths))
            cuts = np.flatnonzero(np.diff(lengths[order]) | np.diff(salts[order])) + 1
            for own in np.split(order, cuts) if order.size else []:
                length = int(lengths[own[0]])
                first, begin, place = tables[length]
                rank = ranks[own] - 1 + base[length, int(salts[own[0]])]
                slot = np.searchsorted(first, rank, side="right") - 1
                sequence[own] = begin[slot] + rank - first[slot]
                offset[own] = place[slot]
            yield {c: batch.column(c) for c in kept} | {"sequence_id": sequence, "offset": offset}

    return map_arrow(ranked, rows, schema)


def packed_documents(df: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", ranks: tuple[str, str] | None = None) -> DataFrame:
    """Every piece of every document with its sequence and its place there. The pieces (five numbers each) are
    checkpointed, so the texts are encoded once."""
    return pack(checkpointed(pieces(df, tokenizer_path, limit, id_col, text_col, ranks)), limit)
