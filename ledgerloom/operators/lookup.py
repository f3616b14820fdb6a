"""Reason lookup and functional dependency between codes and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import clean


def first_by_key(table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the first in order."""
    return table.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_nth = 1").drop("_nth")


def with_reason(pairs: DataFrame, reasons: DataFrame, code: str) -> DataFrame:
    """``pairs`` with the struct ``reason``. ``reasons`` has key, access and (if any) code, one row per key; the join is
    left to the optimiser, which broadcasts the table only while it is small."""
    if "code" not in reasons.columns:
        reasons = reasons.withColumn("code", F.lit(None).cast("string"))
    own = reasons.select(clean(F.col("key")).alias("_key"), F.struct(clean(F.col("key")).alias("key"), F.col("access").cast("string").alias("access"), F.col("code").cast("string").alias("code")).alias("reason"))
    return pairs.join(own, clean(F.col(f"s.`{code}`")) == F.col("_key"), "left").drop("_key")


def one_to_one(table: DataFrame, code: str, label: str) -> DataFrame:
    """code, label, one_to_one: whether each belongs to the other alone in ``table`` (a null counts as a value)."""
    pairs = table.select(F.col(code).cast("string").alias("code"), F.col(label).cast("string").alias("label")).distinct()
    codes = pairs.groupBy("label").agg(F.count("*").alias("_codes"))
    labels = pairs.groupBy("code").agg(F.count("*").alias("_labels"))
    c, x = codes.withColumnRenamed("label", "_label"), labels.withColumnRenamed("code", "_code")
    return pairs.join(c, pairs.label.eqNullSafe(c["_label"])).join(x, pairs.code.eqNullSafe(x["_code"])).select("code", "label", ((F.col("_codes") == 1) & (F.col("_labels") == 1)).alias("one_to_one"))


def with_dependency(pairs: DataFrame, table: DataFrame, code: str, label: str) -> DataFrame:
    """``pairs`` with the struct ``fd``, for the target's code and label."""
    own = one_to_one(table, code, label).select(F.col("code").alias("_code"), F.col("label").alias("_label"), F.struct("one_to_one").alias("fd"))
    return pairs.join(own, F.col(f"d.`{code}`").cast("string").eqNullSafe(F.col("_code")) & F.col(f"d.`{label}`").cast("string").eqNullSafe(F.col("_label")), "left").drop("_code", "_label")
