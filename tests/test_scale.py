"""What steps hold and read, as far as plans and folders tell."""

from test_override_stream import SAID, VERDICTS, Streams

from ledgerloom.learn import privacy
from ledgerloom.learn.dsl import call, col
from ledgerloom.learn.search import Search
from ledgerloom.operators.history import summarise
from ledgerloom.operators.report import learned_and_rest
from ledgerloom.operators.verdicts import run_rules
from ledgerloom.plans.fields import FieldRule, name


def test_override_stream_has_no_state_of_rows(spark, tmp_path):
    streams = Streams(spark, tmp_path)
    streams.add(VERDICTS, SAID[:2])
    streams.add((), SAID[2:])
    assert not (tmp_path / "state" / "state").exists()
    assert streams.table().count() == len(VERDICTS)


def test_texts_that_nobody_reads_are_not_made(spark):
    rows = spark.sql("select 1 as pair_id, named_struct('name', 'a') as s, named_struct('name', 'A') as d")
    df = run_rules(rows, [FieldRule("name", "name", "R-NOM", name("name", "name"))], ["pair_id"])
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "explanation" in plan(df) and "explanation" not in plan(df.select("pair_id", "verdict"))
    assert [tuple(r) for r in df.select("verdict", "expected", "actual", "explanation").collect()] == [("AMBIGUOUS", "a", "A", "Only case differs (a / A).")]


def test_history_records_carry_only_what_is_compared(spark):
    rows = spark.sql("select 1 as p, date'2020-01-01' as d, 7 as u, 2.0d as hours, 1 as ok")
    df = summarise(rows, "p", "d", "u", "2021-01-01", ["ok", "u", "hours"], {"last_hours": "hours", "last_ok": "ok"}, {"hours": "hours"})
    first = [x for x in df._jdf.queryExecution().analyzed().toString().split("\n") if "Aggregate" in x][-1]
    assert "count(" not in first and "first_date" not in first
    assert [tuple(map(str, r)) for r in df.collect()] == [("1", "1", "2020-01-01", "2020-01-01", "7", "2020-01-01", "None", "2.0", "1", "2.0")]


def test_conditions_meet_combinations_not_rows(spark):
    rows = spark.range(3000).selectExpr("id as pair_id", "if(id % 3 = 0, 'F', 'G') as a", "concat('w', id % 5) as b", "cast(id as double) as n", "concat('w', id % 5) as y")
    with Search(rows, "y", {"a": "string", "b": "string", "n": "double"}, sample=300) as search:
        fits = [search.fits(col("b")), search.fits(call("upper", col("b"))), "_y <=> 'w1'"]
        assert search.tried < search.rows and search.weighed(*fits).count() == 5  # values of b and y, not of a and n
        assert search.tally(fits) == [3000, 0, 600]
        assert search.crossed(fits, [f"{search.sql.column('a')} <=> 'F'", "true"]).tolist() == [[1000, 3000], [0, 0], [200, 600]]


def test_fakes_are_not_joined_and_texts_are_looked_through_once(spark):
    rows = spark.createDataFrame([(1, "Roy#1", "call ROY#1 at 123456"), (2, "roy#2", "Roy#3, roy#1: roy#2roy#1"), (3, None, "nobody"), (4, "Éva#4", "ÉVA#4 Roy#12")], "k long, last string, note string")
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString().split("\n")
    own = privacy.pseudonymise(rows, "k", {"last": "surname"}, [], [], None, "s")
    assert not [x for x in plan(own) if "Join" in x] and [r["last"] is None for r in own.orderBy("k").collect()] == [False, False, True, False]
    sent = privacy.pseudonymise(rows, "k", {"last": "surname"}, [], [], "note", "s")
    (runs,) = (x for x in plan(sent) if "Generate" in x)
    assert runs.count("extract_all(") == 1 and "éva,roy" in runs.replace("roy,éva", "éva,roy")  # only runs that begin like an identifier


def test_identifiers_are_found_by_every_way(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "Roy#1", "call ROY#1 at 123456"), (2, "roy#2", "Roy#3, roy#1: roy#2roy#1"), (3, None, "nobody"), (4, "Éva#4", "ÉVA#4 Roy#12"), (5, "Zoé", " \n zoé"), (6, "Zoé d'Arc", "zoé zoé d'arc"), (7, " ", "")], "k long, last string, note string")
    made = lambda: [tuple(r) for r in privacy.pseudonymise(rows, "k", {"last": "surname"}, [], [], "note", "s").orderBy("k").collect()]
    usual = made()
    fake, note = {r[0]: r[1] for r in usual}, {r[0]: r[2] for r in usual}
    assert note[2] == f"Roy#3, {fake[1]}: roy#2roy#1" and note[3] == "nobody" and note[4] == f"{fake[4]} Roy#12" and note[5] == f" \n {fake[5]}"
    assert note[6] == f"{fake[5]} {fake[6]}" and note[7] == "" and note[1].startswith(f"call {fake[1]} at ") and "123456" not in note[1]
    for limit in ("FIRST_WORDS", "BROADCAST_ROWS"):
        monkeypatch.setattr(privacy, limit, 0)
        assert made() == usual


def test_fields_go_to_the_rows(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 7 = 0, null, concat('f', id % 3)) as field", "if(id % 3 = 1, 'AMBIGUOUS', 'MATCH') as verdict")
    ours, rest = learned_and_rest(rows, rows.where("verdict = 'AMBIGUOUS'"))
    for df, kind, n in ((ours, "LeftSemi", 857), (rest, "LeftAnti", 2143)):
        with_hint = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if f"Join {kind}" in x]
        assert len(with_hint) == 1 and "broadcast" in with_hint[0] and df.count() == n
