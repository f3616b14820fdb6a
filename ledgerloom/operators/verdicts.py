"""From pairs to the long table of verdicts, with signatures, recurrence, priorities and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as n
from ..plans.fields import RULES
from ..plans.tree import AMBIGUOUS, ANOMALY, JUSTIFIED, MATCH, evaluate

#: Weight and area of a field without an entry of its own.
OTHER = (0.5, "Other")
#: Weight and area by field. Fixed values.
IMPACT = {
    "(assignment)": (1.0, "Missing assignment"), "contractTypeCode": (0.9, "Pay and hours"), "weeklyHoursOverride": (0.9, "Pay and hours"), "dailyHoursOverride": (0.9, "Pay and hours"), "payGradeId": (0.85, "Pay and hours"),
    "isPrimaryAssignment": (0.85, "Assignment"), "isTemporaryAssignment": (0.85, "Assignment"), "assignmentStartDate": (0.8, "Assignment"), "assignmentEndDate": (0.8, "Assignment"), "termEndDate": (0.8, "Assignment"),
    "detailedStatus": (0.8, "Status"), "statusReasonCode": (0.8, "Status"), "expectedReturnDate": (0.7, "Status"), "positionId": (0.7, "Position"), "positionCode": (0.7, "Position"), "positionName": (0.4, "Position"),
    "onboardDate": (0.6, "Identity"), "divisionId": (0.6, "Organisation"), "divisionCode": (0.6, "Organisation"), "divisionName": (0.4, "Organisation"), "siteCode": (0.6, "Organisation"), "siteName": (0.5, "Organisation"),
    "contactEmail": (0.5, "Identity"), "givenName": (0.4, "Identity"), "surname": (0.4, "Identity"),
}
RANK = {ANOMALY: 0, AMBIGUOUS: 1, JUSTIFIED: 2, MATCH: 3}


def _mapped(column: Column, values: dict, default: object) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[column], F.lit(default))


def identity(pairs: DataFrame, id_cols: dict[str, tuple[str, str]]) -> DataFrame:
    """``pairs`` with identity columns: the source's value, else the target's."""
    return pairs.withColumns({k: F.coalesce(F.col(f"s.`{a}`").cast("string"), F.col(f"d.`{b}`").cast("string")) for k, (a, b) in id_cols.items()})


def run_rules(pairs: DataFrame, rules: list, keep: list[str], trace: bool = True) -> DataFrame:
    """Verdicts of all matched pairs, and one R-MATCH anomaly for every record without a partner."""
    matched = evaluate(pairs.where("s is not null and d is not null"), rules, keep, trace)
    alone = pairs.where("s is null or d is null")
    side = F.when(F.col("d").isNull(), "source").otherwise("target")
    none = F.lit(None).cast("string")
    single = alone.select(
        *keep, F.lit(-1).alias("field_order"), F.lit("(assignment)").alias("field"), F.lit("").alias("sources"), F.lit(ANOMALY).alias("verdict"), F.lit("R-MATCH").alias("rule"),
        none.alias("expected"), none.alias("actual"), none.alias("raw"), *([F.concat(F.lit("No partner for this record of the "), side, F.lit(".")).alias("explanation"), F.concat(F.lit("[R-MATCH] Record on one side only → "), side).alias("path")] if trace else []),
    )
    return matched.unionByName(single)


def describe_rules(df: DataFrame) -> DataFrame:
    """With the description of each rule: what stands before '+', then before the node's name."""
    base = F.regexp_replace(F.split_part(F.split_part(F.col("rule"), F.lit("+"), F.lit(1)), F.lit("."), F.lit(1)), "-UNCOVERED$", "")
    return df.withColumn("rule_text", _mapped(base, RULES, ""))


def with_defaults(df: DataFrame) -> DataFrame:
    """Columns that the later layers change."""
    signature = F.when(F.col("rule") == "R-MATCH", "").otherwise(n.signature(F.col("expected"), F.col("actual")))
    return df.withColumns({"rule_verdict": F.col("verdict"), "layer": F.lit("RULE"), "confidence": F.lit(1.0), "method": F.lit(""), "signature": signature})


def signature_share(df: DataFrame) -> DataFrame:
    """Rows of each (field, signature) and their share of the field."""
    counts = df.groupBy("field", "signature").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("field")))


def signature_key(signature: Column, row: Column) -> Column:
    """What rows join counts of differences by. Rows without a difference, most of a table, meet no count, so they are
    dealt over many keys instead of landing on one."""
    return F.when(signature.isin("=", ""), F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(row), F.lit(4096)).cast("string"))).otherwise(signature)


def counted(df: DataFrame) -> DataFrame:
    """Rows and open rows (n, n_open) of each field and signature."""
    return df.groupBy("field", "signature").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == AMBIGUOUS).alias("n_open"))


def with_recurrence(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Rows with the same field and signature; 1 without a signature. Counted by an aggregate that combines before it
    shuffles (``counts``, if that is known). Equal rows take their field's count from a table of one row per field,
    differences join by signature."""
    counts = (counted(df) if counts is None else counts).where("signature <> ''").select("field", "signature", F.col("n").alias("_n"))
    equal = counts.where("signature = '='").select(F.col("field").alias("_equal_field"), F.col("_n").alias("_equal"))
    other = counts.where("signature <> '='").select(F.col("field").alias("_field"), F.col("signature").alias("_signature"), "_n")
    keyed = df.withColumn("_key", signature_key(F.col("signature"), F.col("pair_id")))
    both = keyed.join(F.broadcast(equal), F.col("field") == F.col("_equal_field"), "left")  # one row per mapped field
    both = both.join(other, (F.col("field") == F.col("_field")) & (F.col("_key") == F.col("_signature")), "left")
    return both.withColumn("recurrence", F.coalesce(F.when(F.col("signature") == "=", F.col("_equal")), "_n", F.lit(1))).select(*df.columns, "recurrence")


def with_priority(df: DataFrame, impact: dict[str, tuple[float, str]] = IMPACT) -> DataFrame:
    """Impact and, for anomalies and open rows, priority = 100 x weight x confidence (0.5 at least), half to even."""
    weight = _mapped(F.col("field"), {k: v[0] for k, v in impact.items()}, OTHER[0])
    score = F.bround(F.lit(100) * weight * F.greatest("confidence", F.lit(0.5)), 0).cast("int")
    return df.withColumn("impact", _mapped(F.col("field"), {k: v[1] for k, v in impact.items()}, OTHER[1])).withColumn("priority", F.when(F.col("verdict").isin(ANOMALY, AMBIGUOUS), score).otherwise(0))


def in_order(df: DataFrame, entity: str = "entity", tie: tuple[str, ...] = ("pair_id", "field_order")) -> DataFrame:
    """Report order: verdict, priority downwards, entity."""
    return df.orderBy(_mapped(F.col("verdict"), RANK, 9), F.desc("priority"), entity, *tie)
