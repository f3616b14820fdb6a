"""What a front end asks for, as plain functions over DataFrames: datasets, results, one row, rules, proofs, overrides,
evaluations, exports. Results are kept per dataset and state of the override log; proofs per field and version of a
dataset, and with a ``ProofStore`` beyond the session."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keeping import checkpointed
from .learn import evaluate, privacy, resolve
from .learn.dsl import OPS, from_json
from .learn.search import Learned, Search
from .operators import report
from .operators.features import Features, feature_table
from .pipeline import Result, learned_rules, reconcile, report_order
from .plans.tree import describe
from .proofs import ProofStore, fingerprints
from .sources.tables import Inputs, add_line, add_override, as_json, load_all, load_overrides, remove_override, write_csv, write_report


@dataclass
class Dataset:
    """Pairs with all looked-up columns, the rules, and the source columns that learners may not see."""

    pairs: DataFrame
    rules: list
    features: Features | None = None
    hidden: tuple[str, ...] = ()

    def learnable(self) -> Features:
        if self.features is None:
            self.features = feature_table(self.pairs, [r.target for r in self.rules], self.hidden)
        return self.features

    def study(self, open_fields: list[str], proposals: dict | None = None) -> evaluate.Study:
        names = [r.target for r in self.rules if r.target in self.learnable().targets]
        return evaluate.Study(self.pairs, self.rules, self.features, [x for x in names if x not in open_fields], [x for x in names if x in open_fields], proposals or {})


@dataclass
class Service:
    spark: SparkSession
    log: Path
    datasets: dict[str, Dataset] = field(default_factory=dict)
    _versions: dict[str, int] = field(default_factory=dict)
    _results: dict[tuple, Result] = field(default_factory=dict)
    _proofs: dict[tuple, dict] = field(default_factory=dict)
    proofs: ProofStore | None = None
    _prints: dict[tuple, dict[str, str]] = field(default_factory=dict)

    def register(self, name: str, dataset: Dataset) -> None:
        """A dataset of this name begins a new version: results and proofs of the old one are let go."""
        self.datasets[name] = replace(dataset, pairs=checkpointed(dataset.pairs))
        self._versions[name] = self._versions.get(name, 0) + 1
        for old in [k for k in self._results if k[0] == name]:
            del self._results[old]
        for old in [k for k in self._proofs if k[0] == name]:
            del self._proofs[old]

    def upload(self, name: str, paths: dict[str, str], build: Callable[[Inputs], Dataset]) -> DataFrame:
        """Loads the four inputs (all must be named), builds the dataset and reconciles it once. If anything fails the
        dataset of this name stays what it was."""
        before = self.datasets.get(name)
        made = build(load_all(self.spark, paths))
        try:
            self.register(name, made)
            return self.spark.createDataFrame(report.kpis(self.result(name).verdicts).collect())
        except Exception:
            if before is None:
                self.datasets.pop(name, None)
            else:
                self.register(name, before)
            raise

    def result(self, name: str) -> Result:
        key = (name, self._versions[name], self.log.stat().st_mtime_ns if self.log.exists() else 0)
        if key not in self._results:
            for old in [k for k in self._results if k[0] == name]:
                del self._results[old]
            d = self.datasets[name]
            self._results[key] = reconcile(d.pairs, d.rules, True, d.learnable(), load_overrides(self.spark, self.log))
        return self._results[key]

    def summary(self, name: str) -> dict[str, DataFrame]:
        df = self.result(name).verdicts
        learned = self.spark.createDataFrame(learned_rules(self.result(name)), "field string, rule string, coverage double, stability double, accepted boolean, signatures string, settled long")
        return {"kpis": report.kpis(df), "fields": report.by_field(df), "layers": report.by_layer(df), "flow": report.flow(df), "learned": learned, "catalogue": report.catalogue(df)}

    def rows(self, name: str, size: int = 100, start: int = 0, **criteria) -> DataFrame:
        return report_order(Result(report.browse(self.result(name).verdicts, **criteria))).offset(start).limit(size)

    def rows_json(self, name: str, size: int = 100, start: int = 0, **criteria) -> list[str]:
        """A page as JSON objects."""
        return [r["json"] for r in as_json(self.rows(name, size, start, **criteria)).collect()]

    def top(self, name: str, size: int = 8) -> DataFrame:
        """What to look at first."""
        return report.page(report.to_investigate(self.result(name).verdicts), [F.desc("priority"), "id"], size)

    def row(self, name: str, row: str) -> DataFrame:
        return report.drill_down(self.result(name).verdicts, self.datasets[name].pairs, row)

    def rules(self, name: str) -> list[dict]:
        """The rules with their counts, what was learned about their fields and the overrides of their fields."""
        df = self.result(name).verdicts
        counts = {r["field"]: r.asDict() for r in report.by_field(df, None).collect()}
        learned = {x["field"]: x for x in learned_rules(self.result(name))}
        said = {r["field"]: r["count"] for r in load_overrides(self.spark, self.log).groupBy("field").count().collect()}
        used: dict[str, list[str]] = {}
        for r in report.used_sources(df).collect():  # a few per rule
            used.setdefault(r["field"], []).append(r["source"])
        return [
            {"field": r.target, "sources": r.sources, "columns": sorted(used.get(r.target, [])), "rule": r.rule, "tree": describe(r.tree), "learned": learned.get(r.target), "overrides": said.get(r.target, 0)} | counts.get(r.target, {})
            for r in self.datasets[name].rules
        ]

    def proof(self, name: str, of: str) -> dict:
        """The learned rule of a field, its evidence, rivals, folds and whether pseudonyms change its coverage. With
        ``proofs`` it is read from there if it was made from the same data, in whatever session."""
        key = (name, self._versions[name], of)
        if key not in self._proofs:
            f = self.datasets[name].learnable()
            said = self._kept_proof(key, f) if self.proofs else self._made_proof(f, of)
            rule = said.pop("json")
            if rule:
                said["evidence"] = in_doubt_first(resolve.evidence(f.df, f.targets[of], f.kinds, from_json(rule)))
            self._proofs[key] = said
        return self._proofs[key]

    def _kept_proof(self, key: tuple[str, int, str], f: Features) -> dict:
        name, version, of = key
        if (name, version) not in self._prints:
            self._prints = {k: v for k, v in self._prints.items() if k[0] != name} | {(name, version): fingerprints(f)}
        now = self._prints[name, version][of]
        said = self.proofs.read(name, of, now)
        if said is None:
            said = self._made_proof(f, of)
            self.proofs.write(name, of, now, said)
        return said

    @staticmethod
    def _made_proof(f: Features, of: str) -> dict:
        y = f.targets[of]
        learned = resolve.field_model(f, of).learned
        said = {
            "rule": str(learned), "coverage": learned.coverage, "accepted": learned.accepted, "json": learned.rule.to_json() if learned.rule else None,
            "rivals": [{"rule": str(h.rule), "coverage": h.coverage} for h in resolve.alternatives(f.df, y, f.kinds)], "folds": [list(x) for x in resolve.stability(f.df, y, f.kinds)],
        }
        return said | ({"private": privacy_check(f, y, learned)} if learned.rule else {})

    def override(self, entry: dict) -> dict:
        return add_override(entry, self.log)

    def undo(self, index: int) -> None:
        remove_override(index, self.log)

    def feedback(self, entry: dict) -> dict:
        """A remark of a reader, kept beside the override log."""
        return add_line(entry, self.log.with_name("feedback.jsonl"))

    def evaluate(self, name: str, open_fields: list[str], folder: str | Path, seeds: int = 5, proposals: dict | None = None) -> dict[str, DataFrame]:
        evaluate.write_study(self.datasets[name].study(open_fields, proposals), folder, seeds)
        return evaluate.load_study(self.spark, folder)

    def export_csv(self, name: str, path: str | Path) -> None:
        write_csv(report_order(self.result(name)), path)

    def export_workbook(self, name: str, path: str | Path) -> Path:
        """A workbook for readers, with all rows: a sheet that is full goes on in another."""
        df, parts = self.result(name).verdicts, self.summary(name)
        whole = {"To investigate": report.to_investigate(df), "Justified": df.where("verdict = 'JUSTIFIED'"), "Match": df.where("verdict = 'MATCH'"), "All": report_order(self.result(name))}
        sheets = {"Summary": parts["kpis"], "Layers": parts["layers"], "Fields": parts["fields"]} | whole
        return write_report(sheets | {"Learned rules": parts["learned"], "Rule catalogue": parts["catalogue"], "Overrides": load_overrides(self.spark, self.log)}, path, report.LABELS)


def in_doubt_first(evidence: DataFrame) -> DataFrame:
    """Rows that the rule does not give come first."""
    return evidence.orderBy("reproduced", "pair_id")


def privacy_check(features: Features, target: str, learned: Learned, identifiers: dict[str, str] | None = None) -> dict[str, float]:
    """Coverage of the rule on real rows and on rows as they would be sent out: what holds inside a row survives."""
    names = identifiers or {}
    dates = [c for c, kind in features.kinds.items() if kind == "date"]
    sent = privacy.pseudonymise(features.df, "pair_id", names, [c for c in features.kinds if c not in names], dates, target)
    out = {}
    for name, df in (("real", features.df), ("pseudonyms", sent)):
        with Search(df, target, features.kinds) as search:
            out[name] = search.weigh([learned.rule])[0].coverage
    return out


def agreement(evidence: DataFrame, documented: DataFrame) -> DataFrame:
    """How often a learned rule gives the documented value, over rows that are not justified, and how many differ.
    ``documented``: pair_id, expected, verdict."""
    both = evidence.join(documented, "pair_id").where("verdict <> 'JUSTIFIED'")
    equal = F.col("given").eqNullSafe(F.col("expected"))
    return both.agg(F.avg(equal.cast("double")).alias("share"), F.count_if(~equal).alias("differing"))


def flagged_labels(flags: DataFrame) -> DataFrame:
    """Labels of flagged rows per method, in order, as one text. ``flags``: method, seq, label, flag."""
    own = flags.where("flag").groupBy("method").agg(F.sort_array(F.collect_list(F.struct("seq", "label"))).alias("_l"))
    return own.select("method", F.array_join(F.transform("_l", lambda x: x["label"]), ", ").alias("labels"))


def examples(features: DataFrame, target: str, columns: list[str], k: int = 6) -> list[str]:
    """The first rows as JSON for an external proposer: sorted columns, empty ones left out. Pseudonymise before."""
    rows = features.orderBy("pair_id").select(*(F.col(f"`{c}`").cast("string").alias(c) for c in sorted(columns)), F.col(f"`{target}`").cast("string").alias("target")).limit(k).collect()
    return [json.dumps({c: v for c, v in r.asDict().items() if v not in (None, "")}, ensure_ascii=False) for r in rows]


def grammar() -> str:
    """The rule language as JSON forms, one per operation."""
    form = lambda name, op: {"op": name} | {w: "..." for w in op.words} | ({op.parts: ["rule", "rule"]} if isinstance(op.parts, str) else {p: "rule" for p in op.parts})
    return "\n".join(json.dumps(form(name, op)) for name, op in OPS.items())


def payload(study: evaluate.Study, of: str, identifiers: dict[str, str], allowed: list[str], folder: str | Path, k: int = 6) -> str:
    """What would be sent out to have a rule proposed for an open field: ``k`` rows, in which the identifiers of all rows
    are pseudonyms. It is written to ``folder`` before anybody can send it. A field with a documented rule is never sent."""
    if of not in study.open:
        raise ValueError(f"{of} has a documented rule and is not sent")
    f, y = study.features, study.features.targets[of]
    some = f.df.orderBy("pair_id").limit(k)
    dates = [c for c in allowed if f.kinds.get(c) == "date"]
    rows = examples(privacy.pseudonymise(some, "pair_id", identifiers, allowed, dates, y, everyone=f.df), y, [*identifiers, *allowed], k)
    text = "\n".join([f"Target field: {of}. Give the rule that makes the target of the other columns, as JSON.", grammar(), *rows])
    audit(text, Path(folder, f"{of}.txt"))
    return text


def audit(text: str, path: str | Path) -> None:
    """Keeps what was sent out."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text + "\n", "utf-8")
