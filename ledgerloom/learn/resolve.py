"""What the rules leave open, settled from the whole population: learned rules first, then difference signatures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keeping import checkpointed
from ..operators.features import Features
from ..operators.verdicts import counted, signature_key
from ..plans.tree import AMBIGUOUS, ANOMALY, JUSTIFIED
from .dsl import Kinds, Rule, from_json
from .search import ACCEPTED, PENALTY, Case, Hypothesis, Learned, Leaves, Search, chosen

#: Share of a field's rows from which a signature counts as systemic.
SYSTEMIC = 0.5


@dataclass
class FieldModel:
    field: str
    learned: Learned
    stability: float


@dataclass
class Folds:
    """The winner without a row, for rows whose absence changes counts but not what is proposed. ``rules`` and then the
    cells of ``cases`` are what a row is described by."""

    simple: list[Hypothesis]
    cases: list[Case]
    rules: list[Rule]
    rows: int

    def winner(self, bits: str) -> str:
        hit = dict(zip(self.rules, map(int, bits), strict=False))
        found = [Hypothesis(h.rule, h.hits - hit[h.rule], self.rows - 1) for h in self.simple]
        for case, inside in zip(self.cases, map(int, bits[len(self.rules) :]), strict=True):
            less = lambda way, here: [(i, r, n - hit[r] * here) for i, r, n in way]
            best = replace(case, size=case.size - inside, then=less(case.then, inside), other=less(case.other, 1 - inside)).best(self.rows - 1)
            found += [best] if best else []
        return str(chosen(sorted(found, key=lambda h: (-h.score, h.rule.complexity))).rule)


def leave_one_out(search: Search, found: list[Hypothesis]) -> list[tuple[str, int, float]]:
    """(rule, folds, share) over all folds that leave one row out and search anew, most frequent first.

    Nearly all rows change nothing but counts: their folds' winners follow from the hits of the few rules and cells that
    can matter, once for each description that occurs, on the cluster; names come back with their folds. Rows on which
    a constant, an end, a cell's size or the beam hangs (the search notes conditions for them) are searched anew without
    the row; of rows that hang on the same things and have the same description one is. A beam counts only if a chain
    could win."""
    if search.rows < 2 or not found:
        return []
    rules = list(dict.fromkeys([*(h.rule for h in search.simple), *(r for c in search.cases for way in (c.then, c.other) for _, r, _ in way)]))
    folds = Folds(search.simple, search.cases, rules, search.rows)
    described = search.bits([search.fits(r) for r in rules] + [c.where for c in search.cases])
    top = chosen(found)
    least = next(h for h in found if h.rule == top.rule).score - 4 / (search.rows - 1)
    chains = any("concat" in str(h.rule.to_json()) and h.score >= least for h in found)
    hangs = list(dict.fromkeys(search.hangs))
    for beam in (b for b in search.beams if b.stems and (chains or b.loose() - PENALTY * 3 >= least)):
        bits, kept = search.bits(beam.conditions), beam.chosen()
        seen = [r[0] for r in search.weighed(bits).selectExpr(f"{bits} as b").distinct().collect()]  # descriptions by the stems near the cut
        if moved := [b for b in seen if beam.chosen(b) != kept]:
            hangs.append(f"{bits} in ({', '.join(repr(b) for b in moved)})")
    wins: dict[str, int] = {}
    both = [f"{described} as described", f"{search.bits(hangs)} as hangs"]
    alike = checkpointed(search.weighed(*both).selectExpr(*both, "_n").groupBy("described", "hangs").agg(F.sum("_n").alias("n")))
    if hangs and not alike.where(F.col("hangs").contains("1")).isEmpty():
        apart = search.frame.selectExpr(*both, "_row").where(F.col("hangs").contains("1")).groupBy("described", "hangs").agg(F.count("*").alias("n"), F.min("_row").alias("row"))
        for r in apart.collect():
            with search.without(r["row"]) as other:
                name = str(chosen(other.hypotheses()).rule)
            wins[name] = wins.get(name, 0) + r["n"]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([folds.winner(b) for b in batch.column("described").to_pylist()], pa.string()), batch.column("n")], ["name", "n"])

    usual = alike.where(~F.col("hangs").contains("1")).select("described", "n")
    for r in usual.mapInArrow(named, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).collect():  # one row per winner
        wins[r["name"]] = wins.get(r["name"], 0) + r["n"]
    return sorted(((k, n, n / search.rows) for k, n in wins.items()), key=lambda x: -x[1])


def stability(features: DataFrame, target: str, kinds: Kinds) -> list[tuple[str, int, float]]:
    with Search(features, target, kinds) as search:
        return leave_one_out(search, search.hypotheses())


def field_model(features: Features, field: str, leaves: Leaves | None = None) -> FieldModel:
    with Search(features.df, features.targets[field], features.kinds, leaves=leaves) as search:
        found = search.hypotheses()
        learned = chosen(found)
        shares = {name: share for name, _, share in leave_one_out(search, found)} if learned.accepted else {}
    return FieldModel(field, learned, shares.get(str(learned), 0.0))


def signature_counts(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Per field and signature: rows and share of the field's rows that have one. ``counts``: as of ``verdicts.counted``, if
    that is known."""
    counts = (counted(df) if counts is None else counts).where("signature <> ''").select("field", "signature", "n")
    return counts.join(counts.groupBy("field").agg(F.sum("n").alias("total")), "field").select("field", "signature", "n", (F.col("n") / F.col("total")).alias("share"))


def most_common(df: DataFrame) -> DataFrame:
    """The signatures of each field with their counts as one text, most frequent first (signatures break ties)."""
    each = F.sort_array(F.collect_list(F.struct(F.negative("n").alias("less"), "signature")))
    return signature_counts(df).groupBy("field").agg(F.array_join(F.transform(each, lambda x: F.concat(x["signature"], F.lit(" x"), F.negative(x["less"]).cast("string"))), "; ").alias("signatures"))


def judge(df: DataFrame) -> DataFrame:
    """Per field: systemic signatures, share of the commonest difference, confidence (that share, or what is missing to 1)."""
    shares = signature_counts(df).where("signature <> '='")
    top = F.max("share")
    return shares.groupBy("field").agg(
        F.sort_array(F.collect_list(F.when(F.col("share") >= SYSTEMIC, F.col("signature")))).alias("systemic"), top.alias("top_share"), F.when(top >= SYSTEMIC, top).otherwise(1 - top).alias("confidence")
    )


def _by_field(values: dict, kind: str) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("field")] if values else F.lit(None).cast(kind)


def settle(verdicts: DataFrame, features: Features, models: list[FieldModel], systemic: float = SYSTEMIC, counts: DataFrame | None = None) -> DataFrame:
    """Open rows of modelled fields decided, in this order: the learned rule gives the target's value; the signature is
    systemic; a reliable rule is broken; the signature is isolated; else open. ``verdicts`` has pair_id, field, actual,
    signature, verdict, layer, confidence, method, explanation, path.

    Only open rows meet shares and what the rules give; the others, nearly all of a table, pass by without a shuffle."""
    if not models:
        return verdicts
    is_open = F.col("field").isin(*[m.field for m in models]) & (F.col("verdict") == AMBIGUOUS)
    reliable = {m.field: m.learned for m in models if m.learned.accepted}
    shares = signature_counts(verdicts, counts).where("signature <> '='").select(F.col("field").alias("_field"), F.col("signature").alias("_signature"), F.col("share").alias("_share"))
    wide = verdicts.where(is_open).withColumn("_key", signature_key(F.col("signature"), F.col("pair_id")))
    wide = wide.join(shares, (F.col("field") == F.col("_field")) & (F.col("_key") == F.col("_signature")), "left").drop("_key", "_field", "_signature")
    if reliable:
        guesses = F.create_map(*(x for name, m in reliable.items() for x in (F.lit(name), m.rule.text(features.kinds))))
        wide = wide.join(features.df.select("pair_id", guesses.alias("_guesses")), "pair_id", "left")
        wide = wide.withColumn("_guess", F.col("_guesses")[F.col("field")])
    else:
        wide = wide.withColumn("_guess", F.lit(None).cast("string"))
    wide = wide.withColumns({
        "_rule": _by_field({name: str(m) for name, m in reliable.items()}, "string"),
        "_coverage": _by_field({name: m.coverage for name, m in reliable.items()}, "double"),
        "_steady": _by_field({m.field: m.stability for m in models if m.field in reliable}, "double"),
    })
    known, other, share = F.col("_rule").isNotNull(), ~F.col("signature").isin("=", ""), F.coalesce("_share", F.lit(0.0))

    def case(verdict: str, confidence: Column, method: str) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), F.round(confidence, 3).alias("confidence"), F.lit(method).alias("method"))

    decided = (
        F.when(known & F.col("_guess").eqNullSafe(F.col("actual")), case(JUSTIFIED, F.col("_coverage") * F.greatest("_steady", F.lit(0.5)), "learned rule"))
        .when(other & (share >= systemic), case(JUSTIFIED, share, "systemic signature"))
        .when(known, case(ANOMALY, F.col("_coverage"), "learned rule broken"))
        .when(other, case(ANOMALY, 1 - share, "isolated signature"))
        .otherwise(case(AMBIGUOUS, F.lit(0.0), ""))
    )
    wide = wide.withColumn("_new", decided)
    settled = F.col("_new.method") != ""
    note = F.concat(F.col("_new.method"), F.when(F.col("_new.method").startswith("learned"), F.concat(F.lit(" "), F.col("_rule"))).otherwise(F.concat(F.lit(" "), F.col("signature"))))
    wide = wide.withColumns({
        "explanation": F.when(settled, F.concat(F.lit("Population: "), note, F.lit(". Rule: "), F.coalesce("explanation", F.lit("")))).otherwise(F.col("explanation")),
        "path": F.when(settled, F.concat(F.coalesce("path", F.lit("")), F.lit(" | [LEARNED] "), note, F.lit(" → "), F.col("_new.verdict"))).otherwise(F.col("path")),
        "confidence": F.col("_new.confidence"),
        "method": F.when(settled, F.col("_new.method")).otherwise(F.col("method")),
        "layer": F.when(settled, "LEARNED").otherwise(F.col("layer")),
        "verdict": F.when(settled, F.col("_new.verdict")).otherwise(F.col("verdict")),
    })
    return verdicts.where(~is_open).unionByName(wide.select(*verdicts.columns))


def evidence(features: DataFrame, target: str, kinds: Kinds, rule: Rule) -> DataFrame:
    """The rule row by row: what it read, what it gave, what the target has."""
    given = rule.text(kinds)
    return features.select("pair_id", *(F.col(f"`{c}`") for c in rule.columns()), given.alias("given"), F.col(f"`{target}`").alias("target_value"), given.eqNullSafe(F.col(f"`{target}`")).alias("reproduced"))


def alternatives(features: DataFrame, target: str, kinds: Kinds, k: int = 8) -> list[Hypothesis]:
    """The best different rules."""
    with Search(features, target, kinds) as search:
        found = search.hypotheses()
    return list({str(h.rule): h for h in reversed(found)}.values())[::-1][:k]


def verify_proposals(features: DataFrame, target: str, kinds: Kinds, proposals: list[dict]) -> Learned:
    """Rules proposed from outside (JSON): each is executed on all rows; the best is accepted from ACCEPTED on."""
    with Search(features, target, kinds) as search:
        rules = []
        for j in proposals:
            try:
                rule = from_json(j)
                rule.compiled(search.sql)
            except (KeyError, TypeError, ValueError):
                continue  # no rule of the language, or of these columns
            rules.append(rule)
        found = search.weigh(rules) if rules and search.rows else []
    if not found:
        return Learned(None, 0.0, False, [])
    best = max(found, key=lambda h: h.coverage)
    return Learned(best.rule, best.coverage, best.coverage >= ACCEPTED, [h for h in found if h is not best])


def agreement_of(proposals: list[dict]) -> float:
    """Share of the proposals that are the commonest rule."""
    texts = [str(from_json(j)) for j in proposals]
    return max(map(texts.count, texts)) / len(texts) if texts else 0.0
