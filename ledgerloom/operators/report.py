"""Reports over verdicts: counts, crosstabs, browsing, picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tree import AMBIGUOUS, ANOMALY, VERDICTS

LAYERS = ("RULE", "LEARNED", "EXPERT")
LABELS = {"MATCH": "Match", "JUSTIFIED": "Justified difference", "ANOMALY": "Anomaly", "AMBIGUOUS": "Open"}
SEARCHED = ("id", "entity", "field", "expected", "actual", "explanation")


def _counts(values: tuple[str, ...], column: str) -> list:
    return [F.count_if(F.col(column) == v).alias(v) for v in values]


def kpis(df: DataFrame) -> DataFrame:
    """Checks, rows to investigate, justified, matching, settled by the learned layer and by experts, entities."""
    v = F.col("verdict")
    return df.agg(
        F.count("*").alias("checks"), F.count_if(v.isin(ANOMALY, AMBIGUOUS)).alias("to_investigate"), F.count_if(v == "JUSTIFIED").alias("justified"), F.count_if(v == "MATCH").alias("matching"),
        F.count_if(F.col("layer") == "LEARNED").alias("learned"), F.count_if(F.col("layer") == "EXPERT").alias("expert"), F.countDistinct("entity").alias("entities"),
    )


def by_field(df: DataFrame, total: str | None = "TOTAL") -> DataFrame:
    """Rows per field and verdict, zero-filled, with a total row. One pass: the total comes from a rollup."""
    grouped = df.rollup("field") if total else df.groupBy("field")
    out = grouped.agg(*_counts(VERDICTS, "verdict"), F.grouping("field").alias("_total") if total else F.lit(0).alias("_total"))
    return out.withColumn("field", F.when(F.col("_total") == 1, total).otherwise(F.col("field"))).drop("_total")


def by_layer(df: DataFrame) -> DataFrame:
    return df.groupBy("layer").agg(*_counts(VERDICTS, "verdict"), F.count("*").alias("total"))


def flow(df: DataFrame) -> DataFrame:
    """Rule verdicts against final ones: all four rows, zero-filled."""
    spark = df.sparkSession
    every = spark.createDataFrame([(v,) for v in VERDICTS], "rule_verdict string")
    return every.join(df.groupBy("rule_verdict").agg(*_counts(VERDICTS, "verdict")), "rule_verdict", "left").na.fill(0)


def to_investigate(df: DataFrame) -> DataFrame:
    return df.where(F.col("verdict").isin(ANOMALY, AMBIGUOUS)).orderBy(F.desc("priority"), "id")


def browse(df: DataFrame, verdicts: list[str] | None = None, layers: list[str] | None = None, fields: list[str] | None = None, text: str | None = None) -> DataFrame:
    """Rows that meet all criteria; ``text`` is looked for in several columns, whatever the case."""
    for column, wanted in (("verdict", verdicts), ("layer", layers), ("field", fields)):
        if wanted:
            df = df.where(F.col(column).isin(*wanted))
    if text:
        df = df.where(F.exists(F.array(*(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in SEARCHED if c in df.columns)), lambda x: F.contains(x, F.lit(text.lower()))))
    return df


def page(df: DataFrame, order: list, size: int = 100, start: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(size)


def labelled(df: DataFrame) -> DataFrame:
    """With the verdicts as words for readers."""
    return df.withColumn("verdict", F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[F.col("verdict")])


def catalogue(df: DataFrame) -> DataFrame:
    """The rules that occur, by name, with their texts and rows."""
    return df.groupBy("rule").agg(F.first("rule_text", ignorenulls=True).alias("rule_text"), F.count("*").alias("rows")).orderBy("rule")


def field_bars(df: DataFrame) -> DataFrame:
    """Fields by anomalies, open and justified rows."""
    return by_field(df, None).orderBy(F.desc(ANOMALY), F.desc(AMBIGUOUS), F.desc("JUSTIFIED"), "field")


def demo_picks(df: DataFrame, cases: dict[str, tuple]) -> DataFrame:
    """For each case (name: preferred condition, fallback condition) the first row that meets the preferred condition,
    else the first that meets the other; order by id and field."""
    rows = F.array(*(F.when(fallback | preferred, F.struct(F.lit(k).alias("case"), F.when(preferred, 0).otherwise(1).alias("_choice"))) for k, (preferred, fallback) in cases.items()))
    fits = df.withColumn("_fit", F.explode(F.filter(rows, lambda x: x.isNotNull()))).select("*", "_fit.*").drop("_fit")
    best = fits.groupBy("case").agg(F.min(F.struct("_choice", "id", "field_order", F.struct(*df.columns).alias("row"))).alias("_best"))
    return best.select("case", "_best.row.*")


def learned_and_rest(df: DataFrame, learned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of fields that have a learned rule, and the others. ``learned`` has field. The fields go to the rows: rows of
    few fields would meet in few tasks."""
    fields = F.broadcast(learned.select("field").distinct())  # one row per field
    return df.join(fields, "field", "left_semi"), df.join(fields, "field", "left_anti")


def used_sources(df: DataFrame) -> DataFrame:
    """The source columns that each field reads."""
    names = F.filter(F.transform(F.split("sources", r"[+,]"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select("field", "sources").distinct().select("field", F.explode(names).alias("source")).distinct()


def path_steps(df: DataFrame) -> DataFrame:
    """The path as rows: step, node, question, answer."""
    out = df.select("id", "field", F.posexplode(F.split("path", r" \| ")).alias("step", "_text"))
    pattern = r"(?s)^\[([^\]]*)\] (.*?) → (.*)$"
    return out.select("id", "field", "step", *(F.regexp_extract("_text", pattern, i + 1).alias(c) for i, c in enumerate(("node", "question", "answer"))))


def drill_down(df: DataFrame, pairs: DataFrame, row: str) -> DataFrame:
    """The two records behind one verdict row."""
    return df.where(F.col("id") == row).join(pairs.select("pair_id", "s", "d"), "pair_id")
