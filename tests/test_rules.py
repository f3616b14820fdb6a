import itertools
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.history import summarise
from ledgerloom.operators.lookup import one_to_one, with_reason
from ledgerloom.operators.assignment import Assignment, assign
from ledgerloom.operators.pairing import WORTH, pair_records
from ledgerloom.operators.verdicts import run_rules
from ledgerloom.plans.fields import CONTRACT_CODES, CONTRACT_PROFILED, RULES, FieldRule, contract, hr_rules, name, situation, Situation, start_date
from ledgerloom.plans.tree import describe


def pairs(spark, rows, source, target):
    s = ", ".join(f"`{c}`:string" for c in source)
    d = ", ".join(f"`{c}`:string" for c in target)
    return spark.createDataFrame([(i, tuple(r[0]), tuple(r[1])) for i, r in enumerate(rows)], f"pair_id long, s struct<{s}>, d struct<{d}>")


def outcome(df, tree):
    return [(r["verdict"], r["rule"]) for r in run_rules(df, [FieldRule("x", "", "", tree)], ["pair_id"]).orderBy("pair_id").collect()]


def test_contract_branches(spark):
    tree = contract("cat", "perm", "full", "code", CONTRACT_CODES, CONTRACT_PROFILED)
    rows = [(("V", "Oui", "Oui"), ("JWN",)), (("V", "Oui", "Non"), ("XFLR",)), (("O", None, None), ("WHX",)), (("Q", None, None), ("TRSY",)), (("V", "Non", "Oui"), ("JWN",)), (("Y", None, None), (None,)), (("T", None, None), ("WHX",))]
    got = outcome(pairs(spark, rows, ["cat", "perm", "full"], ["code"]), tree)
    assert got == [("MATCH", "R-CT")] * 4 + [("AMBIGUOUS", "R-CT.perm-UNCOVERED"), ("AMBIGUOUS", "R-CT.cat-UNCOVERED"), ("ANOMALY", "R-CT")]


def test_reason_table_justifies(spark):
    df = pairs(spark, [(("2", "807", "3"), ("170.0",)), (("2", "1", "3"), ("x",)), (("0", None, None), (None,))], ["access", "reason", "status"], ["code"])
    reasons = spark.createDataFrame([("807", 2, "170")], "key string, access int, code string")
    tree = situation(Situation("access", "reason"), "code", "code", "status")
    rows = run_rules(with_reason(df, reasons, "reason"), [FieldRule("x", "", "", tree)], ["pair_id"]).orderBy("pair_id").collect()
    assert [r["verdict"] for r in rows] == ["JUSTIFIED", "AMBIGUOUS", "MATCH"]
    assert "807" in rows[0]["explanation"] and "170" in rows[0]["explanation"]
    assert all(r["path"].startswith("[R-SIT.access]") for r in rows)


def test_names(spark):
    rows = [(("Éva",), ("Éva",)), (("Éva",), ("Eva",)), (("Éva",), ("EVA",)), (("Éva",), ("Ivo",)), ((None,), (None,))]
    assert [v for v, _ in outcome(pairs(spark, rows, ["n"], ["n"]), name("n", "n"))] == ["MATCH", "JUSTIFIED", "AMBIGUOUS", "ANOMALY", "MATCH"]


def test_start_date_policies(spark):
    df = pairs(spark, [(("2020-05-01", "7"), ("2021-01-01",)), (("2020-05-01", "8"), ("2021-01-01",)), ((None, "7"), ("2021-01-01",))], ["entry", "unit"], ["start"])
    df = df.withColumn("hist", F.struct(F.lit(3).alias("records"), F.lit("7").alias("unit"), F.lit("2021-01-01").cast("date").alias("unit_date"), F.lit("2021-01-01").cast("date").alias("last_date")))
    assert [v for v, _ in outcome(df, start_date("entry", "unit", "start"))] == ["JUSTIFIED", "AMBIGUOUS", "AMBIGUOUS"]
    assert [v for v, _ in outcome(df, start_date("entry", "unit", "start", "oldest"))] == ["ANOMALY", "AMBIGUOUS", "AMBIGUOUS"]


def test_catalogue():
    rules = hr_rules("@example.org")
    assert len(rules) == 24 and len({r.target for r in rules}) == 24 and {r.rule for r in rules} <= set(RULES)
    assert all("UNCOVERED" in describe(r.tree) for r in rules)


def first_optimum(rows, columns):
    """By all permutations: the highest total, then the first in the order of the rows."""
    score = lambda r, c: sum(w for w, x, y in zip(WORTH, r, c) if x == y)
    best = max(itertools.permutations(range(len(columns)), len(rows)), key=lambda p: (sum(score(rows[i], columns[j]) for i, j in enumerate(p)), [-j for j in p]))
    return list(best)


@pytest.mark.parametrize("seed", range(30))
def test_assignment_is_the_first_optimum(seed):
    rng = random.Random(seed)
    for _ in range(20):
        kinds = rng.choice([(2, 2, 2), (3, 2, 3), (1, 2, 2), (4, 3, 4)])
        record = lambda: (rng.randrange(kinds[0]) or None, *(rng.randrange(k) for k in kinds[1:]))  # noqa: B023, E731
        n = rng.randint(1, 5)
        rows, columns = [record() for _ in range(n)], [record() for _ in range(rng.randint(n, 6))]
        assert assign(rows, columns, WORTH) == first_optimum(rows, columns)
        assert Assignment(rows, columns, WORTH).dealt() == first_optimum(rows, columns)


def test_assignment_of_many_copies_is_that_of_few():
    """Classes, not records, are searched: beside 40 equal pairs the rest is dealt as if they were not there."""
    rng = random.Random(5)
    for _ in range(30):
        record = lambda: (rng.randrange(3), rng.randrange(2), rng.randrange(3))
        rows, columns = [record() for _ in range(4)], [record() for _ in range(6)]
        other = ("apart",) * 3
        got = assign(rows + [other] * 40, columns + [other] * 40, WORTH)
        assert got[4:] == list(range(6, 46)) and got[:4] == first_optimum(rows, columns)


def test_an_entity_of_a_million_records(spark):
    """One entity, a million records: every record once, all of the smaller side paired, at the best total (that of a flow
    over classes, which is bounded by the pairs that agree)."""
    n = 500_000
    side = lambda more, a: spark.range(n + more).select((F.col("id") + a).alias("seq"), F.lit("e").alias("entity"), *((F.xxhash64("id", F.lit(a + k)) % m).cast("string").alias(c) for k, (c, m) in enumerate((("job", 5), ("kind", 3), ("start", 4)))))
    same = lambda c: (c, c)
    left, right = side(0, 0), side(1000, 10_000_000)
    made = pair_records(left, right, *map(same, ("entity", "job", "kind", "start", "seq"))).select(F.col("s.seq").alias("a"), F.col("d.seq").alias("b"), F.concat_ws("/", "s.job", "s.kind", "s.start").alias("x"), F.concat_ws("/", "d.job", "d.kind", "d.start").alias("y"))
    r = made.agg(F.count("*"), F.count("a"), F.count("b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), F.count_distinct("a"), F.count_distinct("b"), F.count_if(F.col("x") == F.col("y"))).first()
    assert tuple(r)[:6] == (n + 1000, n, n + 1000, n, n, n + 1000)
    classes = lambda df: df.groupBy("job", "kind", "start").count()
    most = classes(left).join(classes(right).withColumnRenamed("count", "other"), ["job", "kind", "start"]).agg(F.sum(F.least("count", "other"))).first()[0]
    assert 0.97 * most <= r[6] <= most


def test_pairing_keeps_every_record_once(spark):
    rng = random.Random(2)
    make = lambda n, base: [(None if i % 9 == 0 else f"e{rng.randint(0, 12)}", base + i, rng.choice("ab"), rng.choice("xy"), rng.choice("12")) for i in range(n)]
    schema = "entity string, seq long, job string, kind string, start string"
    left, right = make(40, 0), make(45, 1000)
    same = lambda c: (c, c)
    made = pair_records(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), *map(same, ("entity", "job", "kind", "start", "seq")))
    got = made.select("pair_id", "entity", F.col("s.seq").alias("s_seq"), F.col("d.seq").alias("d_seq")).collect()
    assert all(r["pair_id"] == f"{'x' if r['s_seq'] is None else r['s_seq']}-{'x' if r['d_seq'] is None else r['d_seq']}" for r in got)
    assert sorted(r["s_seq"] for r in got if r["s_seq"] is not None) == [x[1] for x in left]
    assert sorted(r["d_seq"] for r in got if r["d_seq"] is not None) == [x[1] for x in right]
    for e in {x[0] for x in left} - {None}:
        a, b = sum(x[0] == e for x in left), sum(x[0] == e for x in right)
        assert sum(r["entity"] == e and r["s_seq"] is not None and r["d_seq"] is not None for r in got) == min(a, b)


def test_history(spark):
    rows = [(1, "2020-01-01", 7, 30.0), (1, "2020-06-01", 7, 35.0), (1, "2021-01-01", 8, 36.0), (1, "2022-01-01", 9, 40.0), (2, "2030-01-01", 5, 10.0)]
    df = spark.createDataFrame(rows, "p long, eff string, unit long, h double").withColumn("eff", F.to_date("eff"))
    got = {r["position"]: r for r in summarise(df, "p", "eff", "unit", "2021-06-01", [], {"last_h": "h"}).collect()}
    assert (got[1]["unit"], str(got[1]["unit_date"]), str(got[1]["unit_end"]), got[1]["last_h"], got[1]["records"]) == (8, "2021-01-01", "2021-12-31", 40.0, 4)
    assert (got[2]["unit"], str(got[2]["unit_date"]), got[2]["unit_end"]) == (5, "2030-01-01", None)


def history_of(records, reference):
    """What summarise gives for the (date, seq, unit, hours) of one position, found in their order."""
    own = sorted(records, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    at = max((i for i, r in enumerate(own) if r[0] is not None and r[0] <= reference), default=0)
    changed = [r[0] for i, r in enumerate(own[: at + 1]) if not i or own[i - 1][2] != r[2]]
    after = own[at + 1] if at + 1 < len(own) else None
    end = str(date.fromisoformat(after[0]) - timedelta(1)) if after and after[2] != own[at][2] and after[0] else None
    dates = [r[0] for r in own if r[0] is not None]
    return len(own), min(dates, default=None), max(dates, default=None), own[at][2], max((d for d in changed if d), default=None), end, own[-1][3], own[at][3]


@pytest.mark.parametrize("reference", ["2021-01-12", "2020-01-01", "2022-01-01"])
def test_history_equals_a_walk_and_splits_a_hot_position(spark, reference):
    rnd, rows = random.Random(reference), []
    for i in range(3000):
        day = rnd.choice([None, *(str(date(2021, 1, 1) + timedelta(rnd.randrange(40))) for _ in range(9))])
        rows.append((1 if i % 3 == 0 else rnd.choice([None, *range(2, 300)]), day, i, rnd.choice(["A", "B", None]), float(i % 7)))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame(rows, "p int, eff string, seq int, unit string, h double").withColumn("eff", F.to_date("eff")).repartition(6)
        made = summarise(df, "p", "eff", "unit", reference, ["seq"], {"last_h": "h"}, {"now_h": "h"})
        got = {r[0]: tuple(None if v is None else str(v) if hasattr(v, "year") else v for v in r[1:]) for r in made.collect()}
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {p: history_of([r[1:] for r in rows if r[0] == p], reference) for p in {r[0] for r in rows} - {None}}
    assert "Window" not in plan and "skew=true" in plan


def test_history_of_equal_records(spark):
    rows = [(1, "2021-05-01", "A"), (1, "2021-05-01", "A"), (1, "2021-06-01", "B"), (2, None, "A"), (2, None, "A")]
    df = spark.createDataFrame(rows, "p int, eff string, unit string").withColumn("eff", F.to_date("eff"))
    got = {r["position"]: r for r in summarise(df, "p", "eff", "unit", "2021-05-15", []).collect()}
    assert (str(got[1]["unit_date"]), str(got[1]["unit_end"]), got[1]["records"]) == ("2021-05-01", "2021-05-31", 2 + 1)
    early = {r["position"]: r for r in summarise(df, "p", "eff", "unit", "2020-01-01", []).collect()}
    assert early[1]["unit_end"] is None and early[2]["unit"] == "A" and early[2]["unit_date"] is None
    assert summarise(df.where("false"), "p", "eff", "unit", "2020-01-01", []).count() == 0


def test_one_to_one(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b"), ("3", "b"), (None, "c")], "c string, l string")
    assert {(r["code"], r["label"]): r["one_to_one"] for r in one_to_one(df, "c", "l").collect()} == {("1", "a"): True, ("2", "b"): False, ("3", "b"): False, (None, "c"): True}


def test_empty_inputs(spark):
    df = pairs(spark, [], ["n"], ["n"])
    assert run_rules(df, [FieldRule("x", "", "", name("n", "n"))], ["pair_id"]).count() == 0
