"""Overrides as a stream beside a stream of verdicts: what experts say corrects verdicts that came before, and meets those
that come later.

A row is given as it is when it comes. Both streams run as one; what they have brought so far is kept in tables, not in a
state: rows in the table of changes itself, overrides beside the stream's checkpoint. Each micro-batch joins its own rows
with all overrides so far, and, only if it brings overrides that are new, the rows so far with these. A row that is met is
given anew, with all of its overrides folded in the order of their ordinals and a higher ``version``. So any order of
micro-batches ends in the table of ``apply_overrides``: ``current`` reads it from the changes. A micro-batch writes parts
of its own, and writes them again if it is repeated, so changes are there once.

What people enter is small beside the rows, so Spark as a rule sends it to the tasks and rows are not shuffled. Where it is
not, rows of a signature are dealt to ``SALTS`` parts by their id and patterns go to all of them, so no task has all rows
of a hot signature. Cost: one reading of id, field and signature of the rows so far for each micro-batch with new overrides.

Cases: an override of a row that never comes gives nothing; the same override twice counts once, as it does in a fold;
rows alike in all columns count as one row, others of one id as rows of their own; an empty or null signature is no
pattern; a null id is named by no override of a row; nulls in any other column stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.overrides import SCHEMA, apply_overrides

SALTS = 16
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Columns of the table of changes that are no columns of a row.
_OWN = ("key", "version", "_batch", "_kind")


@dataclass
class Overridden:
    """``both``: a stream whose rows are either a row or an override (``row`` or ``said``, the other one null)."""

    both: DataFrame
    salts: int


def stream_overridden(rows: DataFrame, said: DataFrame, salts: int = SALTS) -> Overridden:
    """``rows`` (streaming; columns as for ``apply_overrides``) to be changed by ``said`` (streaming, the override log)."""
    row, entry = F.struct(*(f"`{c}`" for c in rows.columns)).alias("row"), F.struct("*").alias("said")
    own, entries = rows.select(row), said.select(*(x.split()[0] for x in SCHEMA.split(", "))).select(entry)
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    return Overridden(own.select("row", none(entries, "said")).unionByName(entries.select(none(own, "row"), "said")), salts)


def _met(rows: DataFrame, said: DataFrame, salts: int) -> DataFrame:
    """The rows that an override names, by their id or by field and signature."""
    ids = said.where("scope = 'row' and id is not null").select(F.col("id").alias("_id")).distinct()
    patterns = said.where("scope = 'pattern' and signature <> ''").select(F.col("field").alias("_field"), F.col("signature").alias("_signature")).distinct()
    dealt = patterns.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    part = F.pmod(F.xxhash64("id"), F.lit(salts)) == F.col("_part")
    named = rows.join(ids, F.col("id").cast("string") == F.col("_id"), "left")
    both = named.join(dealt, (F.col("field") == F.col("_field")) & (F.col("signature") == F.col("_signature")) & part, "left")
    return both.where("_id is not null or _signature is not null").select(*(f"`{c}`" for c in rows.columns))


def write_changes(changes: Overridden, path: str, checkpoint: str) -> None:
    """Appends what has arrived to a table, once, in as many micro-batches as the sources give: the columns of the rows,
    key (one for each row as it came), version, and the parts _batch and _kind. Overrides so far and the place in the
    sources are in ``checkpoint``, from which the next call goes on."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.both.schema["row"].dataType)
    names = [f"`{f.name}`" for f in changes.both.schema["row"].dataType]

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        part = lambda kind: f"{path}/_batch={n}/_kind={kind}"
        batch.where("said is not null").select("said.*").write.mode("overwrite").parquet(f"{checkpoint}/said/batch={n}")
        key = F.sha2(F.to_json("row", _JSON), 256).alias("key")
        batch.where("row is not null").select("row.*", key, F.lit(0).cast("long").alias("version")).write.mode("overwrite").parquet(part("came"))
        said = spark.read.schema(f"{SCHEMA}, batch int").parquet(f"{checkpoint}/said").where(F.col("batch") <= n)
        every, new = said.drop("batch").distinct(), said.where(F.col("batch") == n).drop("batch").subtract(said.where(F.col("batch") < n).drop("batch"))
        came = spark.read.schema(f"{fields}, key string, version long, _batch int, _kind string").parquet(path).where("_kind = 'came'")
        met = _met(came.where(F.col("_batch") == n), every, changes.salts)
        if not new.isEmpty():
            met = met.unionByName(_met(came.where(F.col("_batch") < n), new, changes.salts))
        apply_overrides(met, every).select(*names, "key", F.lit(n + 1).cast("long").alias("version")).write.mode("overwrite").parquet(part("changed"))

    run = changes.both.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def current(changes: DataFrame) -> DataFrame:
    """The table that changes, read as a table, have led to: the last version of each row. Rows that were never changed,
    nearly all, meet the keys of the others only; what is asked of them (a filter) is asked where they are read."""
    names = [c for c in changes.columns if c not in _OWN]
    quoted = [f"`{c}`" for c in names]
    later = changes.where("version > 0")
    last = later.groupBy("key").agg(F.max_by(F.struct(*quoted), "version").alias("_last"))
    as_came = changes.where("version = 0").join(later.select("key").distinct(), "key", "left_anti").select(*quoted).distinct()
    return as_came.unionByName(last.select(*(F.col("_last").getField(c).alias(c) for c in names)))
