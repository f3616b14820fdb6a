"""The whole reconciliation: pair, look up, evaluate, settle, override, prioritise, order."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.normalize import row_id
from .keeping import checkpointed
from .learn.search import Leaves
from .learn.resolve import FieldModel, field_model, most_common, settle
from .operators.features import Features, feature_table
from .operators.overrides import apply_overrides
from .operators.verdicts import counted, describe_rules, in_order, run_rules, with_defaults, with_priority, with_recurrence

COLUMNS = [
    "id", "priority", "verdict", "layer", "confidence", "entity", "kind", "position", "job", "field", "sources", "expected", "actual", "rule", "rule_text",
    "explanation", "path", "rule_verdict", "method", "signature", "recurrence", "impact", "pair_id", "field_order",
]


@dataclass
class Result:
    verdicts: DataFrame
    models: list[FieldModel] = field(default_factory=list)


def with_ids(df: DataFrame) -> DataFrame:
    """What a row is called: entity, kind, position, field and, as an entity can have two assignments alike in these, the
    pair."""
    return df.withColumn("id", row_id(*(F.col(c) for c in ("entity", "kind", "position", "field")), F.col("pair_id").cast("string")))


def reconcile(pairs: DataFrame, rules: list, learned: bool = True, features: Features | None = None, overrides: DataFrame | None = None) -> Result:
    """``pairs`` has pair_id, entity, kind, position, job, s, d and what the rules look up (hist, reason). With
    ``learned`` open rows are settled from the population: by rules learned from ``features`` (if not given, made of the
    pairs) and by signatures.

    Pairs are kept, being all that joins and solvers have made. Verdicts are not: they are one projection of the pairs
    with many rows each, so whatever needs few columns of them makes these anew. They are passed through twice, to count
    signatures and open rows by field, which no later layer changes, and for the result."""
    pairs = checkpointed(pairs)
    verdicts = with_defaults(with_ids(describe_rules(run_rules(pairs, rules, ["pair_id", "entity", "kind", "position", "job"]))))
    counts = checkpointed(counted(verdicts))
    models: list[FieldModel] = []
    if learned:
        open_fields = sorted(r[0] for r in counts.where("n_open > 0").select("field").distinct().collect())  # one per rule at most
        if open_fields:
            features = replace(features, df=checkpointed(features.df)) if features else feature_table(pairs, open_fields)
            modelled = [f for f in open_fields if f in features.targets]
            leaves = Leaves(features.df, [features.targets[f] for f in modelled], features.kinds) if modelled else None
            models = [field_model(features, f, leaves) for f in modelled]
            verdicts = settle(verdicts, features, models, counts=counts)
    if overrides is not None:
        verdicts = apply_overrides(verdicts, overrides)
    return Result(with_priority(with_recurrence(verdicts, counts)).select(*COLUMNS), models)


def report_order(result: Result) -> DataFrame:
    return in_order(result.verdicts)


def learned_rules(result: Result) -> list[dict]:
    """One entry per modelled field: rule, coverage, stability, accepted, signatures, rows it settled."""
    if not result.models:
        return []
    settled = {r["field"]: r["count"] for r in result.verdicts.where("layer = 'LEARNED'").groupBy("field").count().collect()}
    shapes = {r["field"]: r["signatures"] for r in most_common(result.verdicts.where(F.col("field").isin(*[m.field for m in result.models]))).collect()}
    return [{"field": m.field, "rule": str(m.learned), "coverage": m.learned.coverage, "stability": m.stability, "accepted": m.learned.accepted, "signatures": shapes.get(m.field, ""), "settled": settled.get(m.field, 0)} for m in result.models]
