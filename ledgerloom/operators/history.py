"""Effective-dated lookups: what holds at a date, since when, until when; one row per position, then plain joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarise(history: DataFrame, position: str, effective: str, unit: str, reference: date | str, order: list[str], last: dict[str, str] | None = None, current: dict[str, str] | None = None) -> DataFrame:
    """Per position: records, first_date, last_date, unit (of the last record at or before ``reference``, else of the
    first), unit_date (since when the unit holds), unit_end (the day before the next record, if that has another unit),
    and columns of the last (``last``: name to column) and the current record (``current``). ``order`` breaks ties of the
    date, then the unit and these columns do; null dates come first; records without a position are left out.

    No task needs all records of a position: three aggregates find the current record, then the last one before it with
    another unit and the next one after it, then the first since that other unit. Each combines before it shuffles, and
    between them the records meet one row of their position, so the records of a hot position stay in many tasks. A record
    carries only what is compared with it through the sorts, so what nothing is compared with is found last."""
    last, current = last or {}, current or {}
    name = {effective: "date"}  # a column stands once in the key, at its first place, which decides all comparisons
    for c in [*order, unit, *current.values()]:
        name.setdefault(c, f"k{len(name)}")
    u = name[unit]
    rows = history.where(F.col(position).isNotNull()).select(
        F.col(position).alias("position"), F.struct(*(F.col(c).alias(k) for c, k in name.items())).alias("_key"), F.struct(F.lit(0).alias("none"), *(F.col(c).alias(k) for k, c in last.items() if c not in name)).alias("_last"),
    )
    key, at = F.col("_key"), F.col("_now._at")
    whole = rows.groupBy("position").agg(F.coalesce(F.max(F.when(key.date <= F.lit(reference).cast("date"), key)), F.min(key)).alias("_at"))

    def again(found: DataFrame, *aggregates: Column) -> DataFrame:
        """``aggregates`` over the records of each position, which see what was found so far in _now. Grouping by the
        position itself would reuse the partitions of the join, and a join so reused is not split where it is skewed."""
        known = found.select(F.col("position").alias("_position"), F.struct(*(c for c in found.columns if c != "position")).alias("_now"))
        out = rows.join(known, F.col("position") == F.col("_position")).groupBy(F.struct("position").alias("_of")).agg(F.any_value("_now").alias("_now"), *aggregates)
        return out.select("_of.position", "_now.*", *out.columns[2:])

    around = again(
        whole, F.max(F.when((key < at) & ~key[u].eqNullSafe(at[u]), key)).alias("_other"), F.min(F.when(key > at, key)).alias("_next"),
        ((F.count_if(key == at) > 1) & ~F.coalesce(F.bool_or(at.date <= F.lit(reference).cast("date")), F.lit(False))).alias("_repeated"),
    )
    around = around.withColumn("_next", F.when(F.col("_next").isNotNull(), F.struct("_next.date", F.col(f"_next.{u}").alias(u))))  # records carry it
    since = again(
        around, F.min(F.when((key <= at) & (F.col("_now._other").isNull() | (key > F.col("_now._other"))), key)).alias("_since"),
        F.count("*").alias("records"), F.min(key.date).alias("first_date"), F.max(key.date).alias("last_date"), F.max(F.struct("_key", "_last")).alias("_end"),
    )
    moves = F.col("_next").isNotNull() & ~F.col("_repeated") & ~F.col(f"_next.{u}").eqNullSafe(F.col(f"_at.{u}"))
    return since.select(
        "position", "records", "first_date", "last_date", F.col(f"_at.{u}").alias("unit"), F.col("_since.date").alias("unit_date"), F.when(moves, F.date_sub("_next.date", 1)).alias("unit_end"),
        *(F.col(f"_end._key.{name[c]}" if c in name else f"_end._last.{k}").alias(k) for k, c in last.items()), *(F.col(f"_at.{name[c]}").alias(k) for k, c in current.items()),
    )


def with_history(pairs: DataFrame, summary: DataFrame, position: str) -> DataFrame:
    """``pairs`` with the struct ``hist`` of the source's position."""
    own = summary.select(F.col("position").cast("string").alias("_position"), F.struct("*").alias("hist"))
    return pairs.join(own, F.col(f"s.`{position}`").cast("string") == F.col("_position"), "left").drop("_position")
