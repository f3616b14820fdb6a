"""Command line: run, demo, learn, payload, trees. ``data`` is a folder of star-schema tables or, with ``--domain``, one
with the four inputs of the HR mapping (source, target, history, reasons; each a spreadsheet, CSV, JSON lines or
Parquet). Spark settings come from spark-submit."""

from __future__ import annotations

import argparse
from datetime import date
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import bindings, hr
from .operators.report import by_field, demo_picks, kpis, to_investigate
from .pipeline import Result, reconcile, report_order
from .operators.verdicts import run_rules
from .plans.tree import describe
from .service import Dataset, payload
from .sources.tables import REQUIRED, load_all, load_overrides, write_report, write_verdicts


def _dataset(spark: SparkSession, args: argparse.Namespace) -> Dataset:
    if not args.domain:
        return bindings.dataset(spark, args.data)
    return hr.hr_dataset(hr.hr_inputs(load_all(spark, found_inputs(args.data))), args.domain, args.reference or date.today(), args.policy)


def found_inputs(folder: str) -> dict[str, str]:
    """The files of a folder that are named as the inputs are."""
    return {p.name.split(".")[0]: str(p) for p in sorted(Path(folder).iterdir()) if p.name.split(".")[0] in REQUIRED}


def _result(spark: SparkSession, args: argparse.Namespace) -> Result:
    made = _dataset(spark, args)
    features = made.features if made.features or not made.hidden else made.learnable()
    return reconcile(made.pairs, made.rules, not args.no_learning, features, load_overrides(spark, args.overrides) if args.overrides else None)


def _open(made: Dataset, args: argparse.Namespace) -> list[str]:
    """Fields whose rule leaves rows open."""
    if not args.domain:
        return bindings.OPEN
    rows = run_rules(made.pairs, made.rules, ["pair_id"], trace=False)
    return sorted(r[0] for r in rows.where("verdict = 'AMBIGUOUS'").select("field").distinct().collect())  # one per rule at most


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser("ledgerloom")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("run", "demo", "learn", "payload", "trees"):
        p = verbs.add_parser(verb)
        if verb == "trees":
            p.add_argument("field", nargs="?")
            continue
        p.add_argument("data")
        p.add_argument("--domain", help="the mail domain of the HR mapping, as @x.org; data then holds its four inputs")
        p.add_argument("--reference", help="the day on which the history is read (today)")
        p.add_argument("--policy", default="latest", choices=("latest", "oldest"), help="which date the start-date rule takes")
        if verb in ("run", "learn", "payload"):
            p.add_argument("out")
        if verb in ("run", "demo"):
            p.add_argument("--overrides")
            p.add_argument("--no-learning", action="store_true", help="leave open rows open")
        if verb == "run":
            p.add_argument("--report", help="also a workbook with summaries and the rows to investigate")
        if verb == "learn":
            p.add_argument("--seeds", type=int, default=5)
    args = parser.parse_args(argv)
    if args.verb == "trees":
        print("\n".join(f"{r.target} <- {r.sources} ({r.rule})\n{describe(r.tree, 1)}" for r in bindings.STAR_RULES if args.field in (None, r.target)))
        return
    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    if args.verb == "learn":
        from .learn.evaluate import write_study

        made = _dataset(spark, args)
        print(write_study(made.study(_open(made, args)), args.out, args.seeds))
        return
    if args.verb == "payload":
        made = _dataset(spark, args)
        study = made.study(_open(made, args))
        identifiers, permitted = (hr.IDENTIFIERS, hr.ALLOWED) if args.domain else (bindings.IDENTIFIERS, bindings.ALLOWED)
        allowed = [c for c in study.features.kinds if c in permitted]
        for name in study.open:
            payload(study, name, {k: v for k, v in identifiers.items() if k in study.features.kinds}, allowed, args.out)
        print("\n".join(str(p) for p in sorted(Path(args.out).glob("*.txt"))))
        return
    result = _result(spark, args)
    if args.verb == "run":
        write_verdicts(result.verdicts, args.out)
        written = spark.read.parquet(args.out)
        if args.report:
            write_report({"Summary": kpis(written), "Fields": by_field(written), "To investigate": to_investigate(written)}, args.report)
        return
    v, layer = F.col("verdict"), F.col("layer")
    cases = {x.lower(): (v == x, v == x) for x in ("MATCH", "JUSTIFIED", "ANOMALY", "AMBIGUOUS")} | {"learned": (layer == "LEARNED", layer == "LEARNED")}
    demo_picks(report_order(result), cases).show(truncate=False)


if __name__ == "__main__":
    main()
