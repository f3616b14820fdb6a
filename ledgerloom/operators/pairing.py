"""Pairing the records of two tables inside each entity.

``pair_records`` gives every record of both sides exactly once: as a pair, or alone. Inside an entity the pairing has
the highest total score; the smaller side is always fully paired; of equal pairings the first counts, in the order of
the smaller side's records, each taking the lowest partner that keeps the optimum. Order comes from ``seq``, never from
partitions.

Records are never gathered: what meets is found from the entity, ``seq`` and the scored columns alone. Entities with one
record on each side, or on one side only, are settled by an expression. The others stream in order through the task
that has the entity, which keeps a number and a class for each record and solves the entity over its classes
(``assignment``). The numbers of what meets are then joined to the records by ``seq``, so a record lies with no other of
its entity, however many there are.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assignment import assign

#: What job, type and start date are worth.
WORTH = (2, 1, 1)
#: Rows of an output batch.
BATCH = 10_000


def pair_score(job: tuple[Column, Column], kind: tuple[Column, Column], start: tuple[Column, Column]) -> Column:
    """2 for the job, 1 for the type, 1 for the start date; null equals null."""
    return F.when(job[0].eqNullSafe(job[1]), 2).otherwise(0) + F.when(kind[0].eqNullSafe(kind[1]), 1).otherwise(0) + F.when(start[0].eqNullSafe(start[1]), 1).otherwise(0)


class _Entity:
    """The records of an entity as they stream in: their numbers, and their scored columns, held once for each class."""

    def __init__(self, name: str):
        self.name, self.seq, self.classes, self.known = name, (array("q"), array("q")), ([], []), {}

    def add(self, side: int, seq: int, scored: tuple) -> None:
        self.seq[side].append(seq)
        self.classes[side].append(self.known.setdefault(scored, scored))

    def met(self) -> Iterator[tuple[str, int | None, int | None]]:
        short = int(len(self.seq[0]) > len(self.seq[1]))
        rows, columns = self.seq[short], self.seq[1 - short]
        chosen = assign(self.classes[short], self.classes[1 - short], WORTH) if rows else []
        turned = (lambda a, b: (self.name, b, a)) if short else lambda a, b: (self.name, a, b)
        yield from (turned(rows[i], columns[j]) for i, j in enumerate(chosen))
        taken = set(chosen)
        yield from (turned(None, x) for j, x in enumerate(columns) if j not in taken)


_MET = pa.schema([("entity", pa.string()), ("s_seq", pa.int64()), ("d_seq", pa.int64())])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (entity, side, seq, job, kind, start) in order: the numbers of what meets."""

    def solved() -> Iterator[tuple]:
        held = None
        for batch in batches:
            for entity, side, seq, *scored in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or entity != held.name:
                    if held:
                        yield from held.met()
                    held = _Entity(entity)
                held.add(side, seq, tuple(scored))
        if held:
            yield from held.met()

    out: list[tuple] = []
    for row in solved():
        out.append(row)
        if len(out) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MET)], schema=_MET)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MET)], schema=_MET)


def meetings(keys: DataFrame) -> DataFrame:
    """entity, s_seq, d_seq from one row for each record: entity, side (0 or 1), seq, job, kind, start."""
    whole = Window.partitionBy("entity")
    counted = keys.withColumns({f"_n{i}": F.sum(F.when(F.col("side") == i, 1).otherwise(0)).over(whole) for i in (0, 1)})
    few = (F.col("_n0") <= 1) & (F.col("_n1") <= 1)
    number = lambda i: F.max(F.when(F.col("side") == i, F.col("seq")))
    single = counted.where(few).groupBy("entity").agg(number(0).alias("s_seq"), number(1).alias("d_seq"))
    one_sided = (F.col("_n0") == 0) | (F.col("_n1") == 0)
    lone = counted.where(~few & one_sided).select("entity", F.when(F.col("side") == 0, F.col("seq")).alias("s_seq"), F.when(F.col("side") == 1, F.col("seq")).alias("d_seq"))
    several = counted.where(~few & ~one_sided).select("entity", "side", "seq", "job", "kind", "start").sortWithinPartitions("entity", "side", "seq")  # the window has dealt by entity
    return single.unionByName(lone).unionByName(several.mapInArrow(_solve, "entity string, s_seq long, d_seq long"))


def pair_records(source: DataFrame, target: DataFrame, entity: tuple[str, str], job: tuple[str, str], kind: tuple[str, str], start: tuple[str, str], seq: tuple[str, str]) -> DataFrame:
    """pair_id, entity, s and d (structs of the two records, null where there is none). ``seq`` is a unique long. Records
    without an entity stay alone."""
    keys, records, alone = [], [], []
    for i, df in enumerate((source, target)):
        name, number = F.col(entity[i]).cast("string"), F.col(seq[i]).cast("long")
        keys.append(df.where(name.isNotNull()).select(name.alias("entity"), F.lit(i).alias("side"), number.alias("seq"), *(F.col(c[i]).cast("string").alias(n) for c, n in ((job, "job"), (kind, "kind"), (start, "start")))))
        records.append(df.select(number.alias(f"_{i}"), F.lit(True).alias(f"_has{i}"), F.struct("*").alias("sd"[i])))
        alone.append(df.where(name.isNull()).select(F.lit(None).cast("string").alias("entity"), *((number if i == k else F.lit(None).cast("long")).alias(f"{x}_seq") for k, x in enumerate("sd"))))
    pairs = meetings(keys[0].unionByName(keys[1])).unionByName(alone[0]).unionByName(alone[1])
    for i, (mine, other) in enumerate((("s_seq", "d_seq"), ("d_seq", "s_seq"))):  # what has no record here is dealt by the other side's number
        met = (F.coalesce(mine, other) == F.col(f"_{i}")) & (F.col(mine).isNotNull() == F.col(f"_has{i}"))
        pairs = pairs.join(records[i], met, "left").drop(f"_{i}", f"_has{i}")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("x"))
    return pairs.select(F.concat_ws("-", number("s_seq"), number("d_seq")).alias("pair_id"), "entity", "s", "d")


def entity_counts(source: DataFrame, target: DataFrame, entity: str) -> DataFrame:
    """Records of each entity on both sides (full outer)."""
    a = source.groupBy(entity).agg(F.count("*").alias("n_source"))
    b = target.groupBy(entity).agg(F.count("*").alias("n_target"))
    return a.join(b, entity, "full_outer").na.fill(0, ["n_source", "n_target"])


def scored_candidates(source: DataFrame, target: DataFrame, entity: str, job: str, kind: str, start: str) -> DataFrame:
    """Every candidate pair of an entity with its score."""
    s, d = source.alias("s"), target.alias("d")
    both = s.join(d, F.col(f"s.{entity}") == F.col(f"d.{entity}"))
    return both.withColumn("score", pair_score(*((F.col(f"s.{c}"), F.col(f"d.{c}")) for c in (job, kind, start))))
