"""Comparing rule-learning methods: rediscovery of known rules (A), injected errors (B), open fields (C).

A method gives flags (row is wrong), maybe predictions. Truth comes from the compiled trees, run again on the changed
target. Errors are injected by a draw from the row and seed, so every run and engine injects the same ones.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chance import drawn
from ..functions.normalize import signature
from ..operators.features import Features
from ..operators.verdicts import run_rules
from ..plans.tree import ANOMALY, JUSTIFIED
from ..sources.tables import as_markdown, write_csv
from . import trees
from .dsl import Kinds
from .resolve import SYSTEMIC, verify_proposals
from .search import Learned, Search, chosen

#: What the methods do, for the report.
METHODS = {
    "S1": "search for a rule without conditions", "S1b": "search for a rule with one condition", "S2": "decision tree, each row judged by the tree grown without it", "S3": "rules proposed from outside, kept if they cover enough",
    "S4": "difference signatures: systemic or isolated", "H": "S1b where it found a reliable rule, else S4",
}
#: Rows whose values may stand in for others, for each row that is made wrong.
DONORS = 8


@dataclass
class Method:
    """``flag`` and ``prediction`` are Columns over the features; ``learned`` where a rule was."""

    name: str
    flag: Column
    prediction: Column | None = None
    learned: Learned | None = None
    abstained: bool = False


@dataclass
class Study:
    """Pairs with all that the rules look up, the rules by field, features with a target for each field; ``known`` fields
    have a documented rule, ``open`` ones don't. ``proposals``: rules from outside (JSON) for open fields."""

    pairs: DataFrame
    rules: list
    features: Features
    known: list[str]
    open: list[str] = field(default_factory=list)
    proposals: dict[str, list[dict]] = field(default_factory=dict)

    def rule(self, name: str):
        return next(r for r in self.rules if r.target == name)


def counts(flagged: DataFrame, by: list[str]) -> DataFrame:
    """TP, FP, FN of ``flag`` against ``truth``."""
    return flagged.groupBy(*by).agg(F.count_if(F.col("flag") & F.col("truth")).alias("tp"), F.count_if(F.col("flag") & ~F.col("truth")).alias("fp"), F.count_if(~F.col("flag") & F.col("truth")).alias("fn"))


def prf(df: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of summed counts; null where there is nothing to divide by."""
    g = df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    part = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(a) + F.col(b), F.lit(0)))
    g = g.withColumns({"precision": part("tp", "fp"), "recall": part("tp", "fn")})
    return g.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))))


def recovered(df: DataFrame) -> DataFrame:
    """Per method: fields whose documented rule was found again (agreement 1) and abstentions."""
    return df.groupBy("method").agg(F.count_if(F.col("agreement") == 1).alias("recovered"), F.count_if("abstained").alias("abstentions"))


def detection(df: DataFrame) -> DataFrame:
    """Per method: share of injected errors that were flagged."""
    return df.groupBy("method").agg(F.sum("found").alias("found"), F.sum("injected").alias("injected")).withColumn("rate", F.try_divide("found", "injected"))


def f1_pivot(df: DataFrame, methods: list[str]) -> DataFrame:
    return prf(df, ["field", "method"]).groupBy("field").pivot("method", methods).agg(F.first("f1"))


def measures_long(df: DataFrame) -> DataFrame:
    """precision, recall, f1 as rows; rows without a value go."""
    return df.unpivot(["method"], ["precision", "recall", "f1"], "measure", "value").na.drop(subset=["value"])


def inject_errors(df: DataFrame, target: str, row: str, seed: int, per_field: int, eligible: Column, kind: str = "string") -> DataFrame:
    """``df`` with ``target`` wrong in ``per_field`` eligible rows (those drawn lowest) and ``injected``. The wrong value is
    one of other rows' values, so frequent ones are likelier; where all are equal, the value changed in its kind.
    ``row`` is an integer column; only the drawn rows and DONORS values for each are ever gathered."""
    y = F.col(f"`{target}`")
    order = lambda k: (drawn(F.col(row), seed * 4 + k), F.col(row))
    rows = df.where(eligible).select(F.col(row).alias("_row")).orderBy(drawn(F.col("_row"), seed * 4), "_row").limit(per_field)
    donors = [r[0] for r in df.where(y.isNotNull()).orderBy(*order(1)).select(y).limit(DONORS * per_field).collect()]
    given = F.array(*map(F.lit, donors)).cast("array<string>")
    low, high = df.agg(F.min(y), F.max(y)).first()
    others = F.filter(F.concat(given, F.when(F.size(F.filter(given, lambda x: ~x.eqNullSafe(y))) == 0, F.array(F.lit(low), F.lit(high)).cast("array<string>")).otherwise(F.array().cast("array<string>"))), lambda x: x.isNotNull() & ~x.eqNullSafe(y))
    changed = {"boolean": F.when(y == "yes", "no").otherwise("yes"), "double": (y.try_cast("double") + 1).cast("string"), "date": F.date_add(y.try_cast("date"), 31).cast("string")}.get(kind, F.concat(y, F.lit("X")))
    drawn_one = F.when(F.size(others) > 0, F.element_at(others, (drawn(F.col(row), seed * 4 + 2) % F.greatest(F.size(others), F.lit(1)) + 1).cast("int")))
    wrong = F.coalesce(drawn_one, changed, F.lit("2020-01-01" if kind == "date" else "X"))
    out = df.join(F.broadcast(rows), F.col(row) == F.col("_row"), "left")  # per_field rows
    return out.withColumn("injected", F.col("_row").isNotNull()).withColumn(target, F.when(F.col("injected"), wrong).otherwise(y)).drop("_row")


def run_methods(df: DataFrame, target: str, kinds: Kinds, expected: str, proposals: list[dict] | None = None, row: str = "pair_id") -> tuple[DataFrame, list[Method]]:
    """S1, S1b, S2, S3 (if there are ``proposals``), S4 and H, and ``df`` with what their Columns read. ``expected`` is the
    documented value. One search serves S1 and S1b."""
    y, off = F.col(f"`{target}`"), F.lit(False)

    def of_rule(name: str, found: Learned) -> Method:
        if not found.accepted:
            return Method(name, off, None, found, True)
        given = found.rule.text(kinds)
        return Method(name, ~given.eqNullSafe(y), given, found)

    with Search(df, target, kinds) as search:
        found = search.hypotheses()
    out = [of_rule("S1", chosen([h for h in found if "if_eq" not in h.rule.op])), of_rule("S1b", chosen(found))]
    told = trees.predictions(df, target, kinds, row)
    if told is not None:
        df = df.join(told.withColumnRenamed("prediction", "_tree"), row, "left")
        out.append(Method("S2", ~F.col("_tree").eqNullSafe(y), F.col("_tree")))
    else:
        out.append(Method("S2", off, abstained=True))
    if proposals is not None:
        out.append(of_rule("S3", verify_proposals(df, target, kinds, proposals)))
    sig = signature(F.col(f"`{expected}`"), y)
    n = search.rows
    systemic = [r[0] for r in df.groupBy(sig.alias("s")).count().where(F.col("count") >= SYSTEMIC * n).collect()]  # two at most
    s4 = Method("S4", (sig != "=") & ~sig.isin(*systemic) if systemic else sig != "=")
    s1b = out[1]
    return df, [*out, s4, replace(s1b, name="H", flag=s4.flag if s1b.abstained else s1b.flag, abstained=False)]


def experiment(df: DataFrame, field: str, target: str, kinds: Kinds, expected: str, truth: str, injected: str | None = None, justified: str | None = None, proposals: list[dict] | None = None, row: str = "pair_id") -> DataFrame:
    """One row per method: rule, coverage, agreement with the documented rule, abstained, TP, FP, FN, found, injected."""
    spark = df.sparkSession
    df, methods = run_methods(df, target, kinds, expected, proposals, row)
    aggs = []
    for m in methods:
        hit = F.col(truth)
        agree = m.prediction.eqNullSafe(F.col(f"`{expected}`")) if m.prediction is not None else F.lit(None).cast("boolean")
        if justified and m.prediction is not None:
            agree = agree | (F.col(justified) & m.prediction.eqNullSafe(F.col(f"`{target}`")))
        aggs += [F.count_if(m.flag & hit), F.count_if(m.flag & ~hit), F.count_if(~m.flag & hit), F.avg(agree.cast("double")), F.count_if(m.flag & F.col(injected)) if injected else F.lit(0), F.count_if(injected) if injected else F.lit(0)]
    values = df.agg(*(a.alias(f"_{i}") for i, a in enumerate(aggs))).first()
    out = []
    for i, m in enumerate(methods):
        tp, fp, fn, agreement, found, total = values[6 * i : 6 * i + 6]
        out.append((field, m.name, str(m.learned) if m.learned else None, m.learned.coverage if m.learned else None, agreement, m.abstained, tp, fp, fn, found, total))
    return spark.createDataFrame(out, "field string, method string, rule string, coverage double, agreement double, abstained boolean, tp long, fp long, fn long, found long, injected long")


def judged(pairs: DataFrame, rule, features: Features, target: str) -> DataFrame:
    """The features with what the documented rule says: expected, truth (an anomaly), justified."""
    said = run_rules(pairs.where("s is not null and d is not null"), [rule], ["pair_id"], trace=False).select("pair_id", "expected", (F.col("verdict") == ANOMALY).alias("truth"), (F.col("verdict") == JUSTIFIED).alias("justified"))
    return features.df.select("pair_id", *(f"`{c}`" for c in features.kinds), f"`{target}`").join(said, "pair_id")


def experiment_known(study: Study) -> DataFrame:
    """A: does a learner that can't see the documented rule find it again, and flag the same rows?"""
    parts = []
    for name in study.known:
        y = study.features.targets[name]
        parts.append(experiment(judged(study.pairs, study.rule(name), study.features, y), name, y, study.features.kinds, "expected", "truth", justified="justified"))
    return _union(parts)


def experiment_injected(study: Study, seeds: int = 5, per_field: int = 2) -> DataFrame:
    """B: ``per_field`` wrong values per field and seed; the trees say anew what is wrong, and how much the methods find."""
    parts = []
    for seed in range(seeds):
        for name in study.known:
            y, rule = study.features.targets[name], study.rule(name)
            kind = next(f.dataType for f in study.pairs.schema["d"].dataType.fields if f.name == name)
            plain = {"date": "date", "boolean": "boolean"}.get(kind.simpleString(), "string" if kind.simpleString() == "string" else "double")
            before = judged(study.pairs, rule, study.features, y)
            wrong = inject_errors(before, y, "pair_id", seed, per_field, ~F.col("truth"), plain).persist()
            value = F.col("_y") == "yes" if plain == "boolean" else F.col("_y").try_cast(kind)
            only = wrong.where("injected").select(F.col("pair_id").alias("_pair"), F.col(f"`{y}`").alias("_y"))
            pairs = study.pairs.join(F.broadcast(only), F.col("pair_id") == F.col("_pair"), "left")  # per_field rows
            pairs = pairs.withColumn("d", F.when(F.col("_pair").isNotNull(), F.col("d").withField(f"`{name}`", value)).otherwise(F.col("d"))).drop("_pair", "_y")
            features = replace(study.features, df=wrong.drop("expected", "truth", "justified", "injected"))
            after = judged(pairs, rule, features, y).join(wrong.select("pair_id", "injected"), "pair_id")
            parts.append(experiment(after, name, y, study.features.kinds, "expected", "truth", "injected").withColumn("seed", F.lit(seed)))
            wrong.unpersist()
    return _union(parts)


def experiment_open(study: Study) -> DataFrame:
    """C: what each method concludes where no documented rule decides."""
    spark, out = study.pairs.sparkSession, []
    for name in study.open:
        y = study.features.targets[name]
        df, methods = run_methods(judged(study.pairs, study.rule(name), study.features, y), y, study.features.kinds, "expected", study.proposals.get(name))
        flagged = df.agg(*(F.count_if(m.flag).alias(m.name) for m in methods)).first()
        out += [(name, m.name, str(m.learned) if m.learned else None, m.learned.coverage if m.learned else None, m.abstained, flagged[m.name]) for m in methods]
    return spark.createDataFrame(out, "field string, method string, conclusion string, coverage double, abstained boolean, flagged long")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_study(study: Study, folder: str | Path, seeds: int = 5) -> Path:
    """A.csv, B.csv, C.csv and comparison.md in ``folder``. All three tables have a row per field, method and seed."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    a, b = experiment_known(study), experiment_injected(study, seeds)
    tables = {"A": a, "B": b} | ({"C": experiment_open(study)} if study.open else {})
    for name, df in tables.items():
        write_csv(df, folder / f"{name}.csv")
    found = recovered(a).join(prf(a, ["method"]), "method").orderBy("method")
    caught = prf(b, ["method"]).join(detection(b).select("method", "rate"), "method").orderBy("method")
    names = [r[0] for r in b.select("method").distinct().orderBy("method").collect()]  # six at most
    lines = [
        "# Rule-learning methods compared", "", f"{len(study.known)} fields with a documented rule, {len(study.open)} open ones, {seeds} seeds.", "", *(f"- **{k}**: {v}" for k, v in METHODS.items()), "",
        "## A. Documented rules, hidden from the learners", "", as_markdown(found), "", as_markdown(a.orderBy("field", "method")), "",
        "## B. Injected errors", "", as_markdown(caught), "", "F1 by field:", "", as_markdown(f1_pivot(b, names).orderBy("field")), "", "All measures:", "", as_markdown(measures_long(caught).orderBy("measure", "method")), "",
    ]
    if study.open:
        lines += ["## C. Open fields", "", as_markdown(tables["C"].orderBy("field", "method")), ""]
    path = folder / "comparison.md"
    path.write_text("\n".join(lines), "utf-8")
    return path


def load_study(spark, folder: str | Path) -> dict[str, DataFrame]:
    """The tables of a written study, read again, and what the report sums up of them."""
    read = {p.stem: spark.read.csv(str(p), header=True, inferSchema=True) for p in sorted(Path(folder).glob("[ABC].csv"))}
    return read | {"recovered": recovered(read["A"]), "known": prf(read["A"], ["method"]), "injected": prf(read["B"], ["method"]), "detection": detection(read["B"])}
