"""Lempel-Ziv phrase fingerprints (LZ78 phrases, minimum-hash signature).

A text is parsed into dictionary phrases: each phrase is the shortest run of code points not yet in the dictionary; what
is left at the end counts as a phrase of its own, closed by the end. The set of phrases is hashed and the ``SIGNATURE``
smallest hashes are the fingerprint, so texts that a dictionary coder would compress alike share phrases. The likeness
of two fingerprints is the Jaccard index of the two sets, exact for small sets and estimated from the smallest hashes of
the union otherwise. As in dictionary coders a full dictionary (``PHRASES``) is emptied and filled again, which bounds
the memory for texts of any length; the set takes in the phrases of all fillings.

The contract's edited text needs the next document by descending id. Documents are dealt to ranges of ids (bounds are
quantiles, as many as shuffle partitions); the first document of a range also goes, as a guest, to the end of the range
above it. Each range is then sorted and streamed once. The edited text shares a prefix with the text, which is parsed
once: each tail is parsed on top of the dictionary at the end of the prefix.

Cases: a null text counts as empty; an empty text has an empty fingerprint, and two empty ones are alike (1.0), an
empty and another are not (0.0); rows with one id follow each other by text, null ids come after all others; a single
document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, map_arrow, shuffle_width

SIGNATURE = 128
#: Phrases of a full dictionary.
PHRASES = 1 << 20
_MULTIPLIER, _MASK = 0x2545F4914F6CDD1D, (1 << 61) - 1
_LOWEST = -(1 << 63)
_END = 0x110000  # beyond all code points


class Parser:
    """The dictionary as one table from (node, code point) to node; a node's number is its place in ``hashes``."""

    def __init__(self):
        self.table: dict[int, int] = {}
        self.hashes = [1]
        self.node = 0
        self.found: list[int] = []

    def parse(self, text: str) -> None:
        """Goes on at the node that was reached."""
        table, hashes, node = self.table, self.hashes, self.node
        get = table.get
        for c in map(ord, text):
            key = node << 21 | c
            following = get(key)
            if following is not None:
                node = following
                continue
            table[key] = len(hashes)
            hashes.append((hashes[node] * _MULTIPLIER + c + 1) & _MASK)
            node = 0
            if len(hashes) > PHRASES:
                self._flush()
                table, hashes = self.table, self.hashes
                get = table.get
        self.node = node

    def _flush(self) -> None:
        """Keeps what can still be among the smallest hashes and empties the dictionary."""
        self.found = signature(self.found + self.hashes[1:], mixed=False).tolist()
        self.table, self.hashes = {}, [1]

    def phrases(self) -> list[int]:
        rest = [(self.hashes[self.node] * _MULTIPLIER + _END + 1) & _MASK] if self.node else []
        return self.found + self.hashes[1:] + rest

    def mark(self) -> tuple:
        return len(self.hashes), self.node, list(self.found)

    def back(self, mark: tuple) -> bool:
        """Takes out what came after ``mark``; impossible if the dictionary was emptied since."""
        size, node, found = mark
        if self.found != found or len(self.hashes) < size:
            return False
        while len(self.hashes) > size:  # entries stand in the order they were made in
            self.table.popitem()
            self.hashes.pop()
        self.node = node
        return True


def signature(phrases: list[int], size: int = SIGNATURE, mixed: bool = True) -> np.ndarray:
    """The smallest 48-bit hashes, ascending; or the phrases that have them, if not ``mixed``."""
    raw = np.array(phrases, np.uint64)
    x = (raw ^ (raw >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(31))) >> np.uint64(16)
    if not mixed:
        smallest = np.unique(x)[:size]
        return np.unique(raw[x <= smallest[-1]]) if smallest.size else raw
    if x.size > 8 * size:
        least = np.unique(np.partition(x, 2 * size)[: 2 * size])  # of phrases that two fillings share the hash is there twice
        if least.size >= size:
            return least[:size]
    return np.unique(x)[:size]


def as_text(values: np.ndarray) -> str:
    return "".join(f"{v:012x}" for v in values.tolist())


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIGNATURE) -> float:
    if not a.size or not b.size:
        return float(a.size == b.size)
    both = np.concatenate([a, b])
    both.sort()
    again = np.append(both[1:] == both[:-1], False)
    first = np.append(True, both[1:] != both[:-1])
    kept = np.flatnonzero(first)[:size]
    return float(again[kept].sum() / kept.size)


def fingerprint(text: str) -> np.ndarray:
    parser = Parser()
    parser.parse(text)
    return signature(parser.phrases())


def both_fingerprints(text: str, kept: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
    """Of ``text`` and of ``text[:kept] + tail``."""
    parser = Parser()
    parser.parse(text[:kept])
    mark = parser.mark()
    parser.parse(text[kept:])
    own = signature(parser.phrases())
    if not parser.back(mark):
        return own, fingerprint(text[:kept] + tail)
    parser.parse(tail)
    return own, signature(parser.phrases())


def _ranges(docs: DataFrame) -> DataFrame:
    """The documents dealt to ranges of ids: _range, _guest, _key, text; ranges in own partitions, sorted."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    docs = docs.withColumn("_key", F.coalesce("doc_id", F.lit(_LOWEST)))
    cuts = docs.agg(F.percentile_approx("_key", [i / width for i in range(1, width)] or [0.5], 20_000)).first()[0] or []
    bounds = sorted({float(x) for x in cuts})
    if bounds:  # binary search in the JVM; doubles may round ids, the order of ids stays
        split = Bucketizer(splits=[-np.inf, *bounds, np.inf], inputCol="_as_double", outputCol="_bucket")
        docs = split.transform(docs.withColumn("_as_double", F.col("_key").cast("double")))
    docs = docs.withColumn("_range", F.col("_bucket").cast("int") if bounds else F.lit(0))
    heads = sorted(docs.groupBy("_range").agg(F.max("_key").alias("_head")).collect())  # one row for each range
    guests = [(h["_head"], (heads[i + 1] if i + 1 < len(heads) else heads[0])["_range"]) for i, h in enumerate(heads)]
    places = F.array(F.struct(F.col("_range").alias("at"), F.lit(False).alias("guest")))
    if guests:
        table = F.broadcast(spark.createDataFrame(guests, "_head long, _above int"))  # as many rows as ranges
        docs = docs.join(table, docs["_key"] == table["_head"], "left")
        extra = F.array(F.struct(F.col("_above").alias("at"), F.lit(True).alias("guest")))
        places = F.when(F.col("_above").isNull(), places).otherwise(F.concat(places, extra))
    rows = docs.withColumn("_place", F.explode(places)).select("doc_id", "_key", "text", F.col("_place.at").alias("_range"), F.col("_place.guest").alias("_guest"))
    return rows.repartitionById(width, F.col("_range")).sortWithinPartitions("_range", "_guest", F.desc("_key"), "text")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (see the contract in the README), with their likeness and
    that to the next document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        waiting = None  # (range, doc_id, text) whose next document has not come yet
        pending = None  # the result that lacks the next document's fingerprint
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for place, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_range", "_guest", "doc_id", "text")), strict=True):
                text = text or ""
                if waiting and waiting[0] == place:
                    own_text = waiting[2]
                    kept = len(own_text) - len(own_text) // 3
                    tail = text[: len(own_text) - kept]
                    own, edited = both_fingerprints(own_text, kept, tail)
                    if pending:
                        _emit(out, pending, own)
                    sha = hashlib.sha256((own_text[:kept] + tail).encode()).hexdigest()
                    pending = (waiting[1], len(own_text), sha, own, edited)
                    if guest:
                        _emit(out, pending, fingerprint(text))
                        pending = None
                waiting = None if guest else (place, doc_id, text)
            yield out

    def _emit(out: dict[str, list], done: tuple, following: np.ndarray) -> None:
        doc_id, n_chars, sha, own, edited = done
        for k, v in zip(names, (doc_id, n_chars, sha, as_text(own), as_text(edited), likeness(own, edited), likeness(own, following)), strict=True):
            out[k].append(v)

    return map_arrow(_ranges(keyed(df, id_col, text_col)), rows, schema)
