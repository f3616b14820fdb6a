"""Expert overrides: for one row, or for every row of a field with the same signature.

Overrides apply in the order of their ordinal. One that finds its verdict already set by an expert is skipped; each
other one wraps the explanation and extends the path. All overrides of a row are folded in one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "ordinal long, date string, field string, scope string, verdict string, id string, signature string, comment string"


#: What of an override a fold needs; entries sort by their ordinal.
ENTRY = ("ordinal", "date", "verdict", "scope", "signature", "field", "comment")


def apply_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """``df`` has id, field, signature, verdict, layer, confidence, explanation, path; ``overrides`` follows SCHEMA."""
    entry = F.struct(*ENTRY)
    rows = overrides.where("scope = 'row'").groupBy("id").agg(F.collect_list(entry).alias("_by_row"))
    patterns = overrides.where("scope = 'pattern' and signature <> ''").groupBy("field", "signature").agg(F.collect_list(entry).alias("_by_pattern"))
    own = df.join(rows, "id", "left").join(patterns, ["field", "signature"], "left")
    none = F.array().cast(rows.schema["_by_row"].dataType)
    return folded(own, F.concat(F.coalesce("_by_row", none), F.coalesce("_by_pattern", none))).select(*df.columns)


def folded(own: DataFrame, entries: Column) -> DataFrame:
    """Every row with its ``entries`` (structs of ENTRY, in any order) applied in the order of their ordinals."""
    steps = F.sort_array(entries)
    begin = F.struct(F.col("verdict").alias("verdict"), (F.col("layer") == "EXPERT").alias("expert"), F.col("explanation").alias("explanation"), F.col("path").alias("path"))

    def step(acc, o):
        where = F.when(o["scope"] == "row", F.lit("this row")).otherwise(F.concat(F.lit("pattern "), o["signature"], F.lit(" of "), o["field"]))
        comment = F.when(F.coalesce(o["comment"], F.lit("")) != "", F.concat(F.lit(" - "), o["comment"])).otherwise("")
        text = F.concat(F.lit("Expert ("), F.substring(F.coalesce(o["date"], F.lit("")), 1, 10), F.lit(", "), where, F.lit("): "), acc["verdict"], F.lit(" → "), o["verdict"], comment, F.lit(". Before: "), F.coalesce(acc["explanation"], F.lit("")))
        done = F.struct(o["verdict"].alias("verdict"), F.lit(True).alias("expert"), text.alias("explanation"), F.concat(F.coalesce(acc["path"], F.lit("")), F.lit(" | [EXPERT] Verdict set → "), o["verdict"]).alias("path"))
        return F.when(acc["expert"] & (acc["verdict"] == o["verdict"]), acc).otherwise(done)

    done = own.withColumn("_f", F.aggregate(steps, begin, step))
    return done.withColumns({
        "verdict": F.col("_f.verdict"), "explanation": F.col("_f.explanation"), "path": F.col("_f.path"),
        "confidence": F.when(F.col("_f.expert"), 1.0).otherwise(F.col("confidence")), "layer": F.when(F.col("_f.expert"), "EXPERT").otherwise(F.col("layer")),
    }).drop("_f")
