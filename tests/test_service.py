import json
import re
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.features import Features
from ledgerloom.plans.fields import FieldRule, name
from ledgerloom.hr import hr_dataset, hr_inputs
from ledgerloom.learn import resolve
from ledgerloom.pipeline import reconcile
from ledgerloom.proofs import ProofStore, column_sums
from ledgerloom.service import Dataset, Service, agreement, examples, flagged_labels
from ledgerloom.sources.tables import Inputs, write_report


@pytest.fixture
def service(spark, tmp_path):
    rows = [(i, f"e{i}", "P", "1", "j", (f"Éva{i}",), (f"ÉVA{i}".replace("É", "E"),)) for i in range(20)]
    pairs = spark.createDataFrame(rows, "pair_id long, entity string, kind string, position string, job string, s struct<n:string>, d struct<n:string>")
    features = pairs.select("pair_id", F.col("s.n").alias("n"), F.lit("2020-01-01").cast("date").alias("day"))
    made = Service(spark, tmp_path / "log.jsonl")
    made.register("x", Dataset(pairs, [FieldRule("name", "n", "R-NOM", name("n", "n"))], Features(features.withColumn("y", F.upper("n")), {"n": "string", "day": "date"}, {"name": "y"})))
    return made


def test_round(service, tmp_path):
    first = service.result("x")
    assert first is service.result("x") and first.verdicts.count() == 20
    assert {r["layer"] for r in first.verdicts.collect()} == {"LEARNED"}
    row = service.rows("x", size=1).first()["id"]
    assert service.row("x", row).count() == 1 and service.rules("x")[0]["field"] == "name"
    service.override({"scope": "row", "id": row, "verdict": "ANOMALY"})
    assert service.rows("x", verdicts=["ANOMALY"]).first()["layer"] == "EXPERT"
    service.undo(0)
    proof = service.proof("x", "name")
    assert proof["rule"] == "upper(n)" and proof["private"] == {"real": 1.0, "pseudonyms": 1.0} and proof["folds"][0][1] == 20
    service.export_csv("x", tmp_path / "o.csv")
    assert service.export_workbook("x", tmp_path / "o.xlsx").stat().st_size > 1000
    with zipfile.ZipFile(tmp_path / "o.xlsx") as z:
        names = re.findall(r'<sheet name="([^"]+)"', z.read("xl/workbook.xml").decode())
        sheet = z.read(f"xl/worksheets/sheet{names.index('All') + 1}.xml").decode()
    assert len(re.findall(r's="4" t="inlineStr"><is><t xml:space="preserve">Justified difference<', sheet)) == 20  # coloured by the code, shown as the word
    with pytest.raises(ValueError, match="history"):
        service.upload("y", {"source": "a", "target": "b", "reasons": "c"}, lambda inputs: service.datasets["x"])
    assert service.top("x", 3).count() == 0 and json.loads(service.rows_json("x", 1)[0])["field"] == "name"
    rule = service.rules("x")[0]
    assert rule["columns"] == ["n"] and rule["learned"]["settled"] == 20 and rule["learned"]["signatures"].startswith("a9 → a9") and rule["overrides"] == 0
    assert service.feedback({"text": "well"})["text"] == "well"
    service.register("x", service.datasets["x"])
    assert service.proof("x", "name") is not proof


def test_proofs_outlive_the_session(spark, tmp_path, monkeypatch):
    def served(session, rows, kept=True):
        df = session.createDataFrame(rows, "pair_id long, n string, m string, y string, z string")
        pairs = df.select("pair_id", F.struct("n").alias("s"), F.struct(F.col("y").alias("a"), F.col("z").alias("b")).alias("d"))
        made = Service(session, tmp_path / "log.jsonl", proofs=ProofStore(session, str(tmp_path / "proofs")) if kept else None)
        made.register("all / of it", Dataset(pairs, [], Features(df, {"n": "string", "m": "string"}, {"a": "y", "b": "z"})))
        return lambda of: made.proof("all / of it", of)

    plain = lambda proof: {k: sorted(map(str, v.collect())) if k == "evidence" else v for k, v in proof.items()}
    rows = [(i, f"é{i % 7}", None if i % 5 else "x", f"É{i % 7}", f"é{i % 7}" if i else None) for i in range(40)]
    first = plain(served(spark, rows)("a"))
    assert first["rule"] == "upper(n)" and len(first["evidence"]) == 40 and first["rivals"] and first["folds"]

    found = []
    monkeypatch.setattr(Service, "_made_proof", staticmethod(lambda f, of: found.append(of) or {"rule": f"new {len(found)}", "json": None}))
    again = served(spark.newSession(), rows[::-1])
    assert plain(again("a")) == first and found == []
    assert again("b") == {"rule": "new 1"} == served(spark, rows)("b") and found == ["b"]
    changed = served(spark, [*rows[:-1], (39, "é4", None, "É4", None)])  # a row's target of b
    assert plain(changed("a")) == first and changed("b") == {"rule": "new 2"}
    assert served(spark, rows)("b") == {"rule": "new 3"}  # the proof of the changed data stood there
    other = served(spark, [*rows[:-1], (39, "é4", "é4", *rows[-1][3:])])  # a column that both can read
    assert other("a") == {"rule": "new 4"} and other("a") is other("a") and found == ["b", "b", "b", "a"]
    assert served(spark, rows, False)("b") == {"rule": "new 5"}


def test_fingerprints(spark):
    sums = lambda rows: column_sums(spark.createDataFrame(rows, "pair_id long, a string, b string"), "pair_id", ["a", "b"])
    one = sums([(1, "x", None), (2, None, "x"), (None, "y", "y")])
    assert one == sums([(None, "y", "y"), (2, None, "x"), (1, "x", None)]) and len(set(one.values())) == 2
    swapped, nulls, more = sums([(2, "x", None), (1, None, "x"), (None, "y", "y")]), sums([(1, "x", ""), (2, None, "x"), (None, "y", "y")]), sums([(1, "x", None), (2, None, "x"), (None, "y", "y"), (None, None, None)])
    assert one["a"] != swapped["a"] and one["a"] == nulls["a"] and one["b"] != nulls["b"] and all(one[c] != more[c] for c in "ab")
    assert set(sums([]).values()) == {"0:None:None"}


def hr_rows(spark):
    """A small company: the reference's kinds of cases, with invented people."""
    names = ["Matricule", "PrénomUsuel", "NomFamille", "DateEmbaucheRécente", "TypeAffectation", "CodePoste", "CodeEmploi", "IntituléEmploi", "DateEntréePoste", "DateSortiePoste", "CodeSite", "LibelléSite", "CodeDirection", "LibelléDirection", "CodeImputation",
             "CatégorieEmploi", "EstPermanent", "EstTempsPlein", "ÉchelleSalariale", "HeuresNormeHebdo", "HeuresNormeQuotidienne", "CodeStatutEmploi", "CodeRaisonStatut", "CodeSuspensionAccès", "DateRetourAnticipée", "IdentifiantResponsable", "NomResponsable"]
    people = [("Éva", "Lune"), ("Otto", "Prado"), ("Ines", "Vald"), ("Marc", "Orme"), ("Nina", "Brun"), ("Paul", "Cher"), ("Lise", "Fort"), ("Hugo", "Gard"), ("Anne", "Hiver"), ("Rene", "Jura")]
    source = [(str(1000 + i), a, b, "2015-01-05", "P" if i != 9 else "A", "7", "55", "Clerk", "2020-01-01", None, "10", "North", "3", "Sales", "99", "V", "Oui", "Oui", "12", "35.0", "7.0", "1", "807" if i == 2 else None, "2" if i == 2 else "0", None, "m", "Boss") for i, (a, b) in enumerate(people)]
    given = ["personId", "givenName", "surname", "contactEmail", "onboardDate", "positionId", "positionCode", "positionName", "siteCode", "siteName", "divisionId", "divisionCode", "divisionName", "contractTypeCode", "payGradeId", "isPrimaryAssignment", "isTemporaryAssignment",
             "assignmentStartDate", "assignmentEndDate", "termEndDate", "weeklyHoursOverride", "dailyHoursOverride", "statusReasonCode", "detailedStatus", "expectedReturnDate"]
    plain = lambda x: x.replace("É", "E")
    target = [(str(1000 + i), plain(a), b, f"{plain(a)[0]}{b}{str(1000 + i)[-3:]}@x.org", "2015-01-05", "55", "55", "55-Clerk", "10", "North", "3", "99", "3-Sales", "WHX" if i == 4 else "JWN", "12", str(i != 9), str(i == 9), "2020-01-01", None, None, "40.0", "8.0", "170" if i == 2 else None, "Absence complète" if i == 2 else "Actif", None) for i, (a, b) in enumerate(people) if i != 7]
    history = [("7", "43831", "3", "40.0", "8.0", "55", "b1", "g", "5")]
    table = lambda rows, columns: spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"`{c}` string" for c in columns) + ", _seq long")
    past = table(history, ["IdentifiantPoste", "DateEffet", "CodeDirectionAffectée", "HeuresSemaineContrat", "HeuresJourContrat", "IdentifiantEmploi", "CodeBudget", "IndicateurGestion", "JoursTravailléesSemaine"])
    past = past.withColumns({"DateEffet": F.lit("2020-01-01").cast("date"), "HeuresSemaineContrat": F.col("HeuresSemaineContrat").cast("double"), "HeuresJourContrat": F.col("HeuresJourContrat").cast("double")})
    there = table(target, given).withColumns({c: F.col(c).cast("double") for c in ("weeklyHoursOverride", "dailyHoursOverride")})
    return Inputs(table(source, names), there, past, table([("807", "170", "2")], ["CodeCatégorieStatut", "CodeStatutSystèmeExterne", "CodeGestionAccès"]))


def test_hr_catalogue_end_to_end(spark):
    made = hr_dataset(hr_rows(spark), "@x.org", "2024-01-01")
    result = reconcile(made.pairs, made.rules, features=made.learnable())
    rows = {(r["entity"], r["field"]): r for r in result.verdicts.collect()}
    assert len(rows) == 9 * 24 + 1 and rows["1007", "(assignment)"]["priority"] == 100
    assert rows["1000", "givenName"]["verdict"] == "JUSTIFIED" and rows["1001", "givenName"]["verdict"] == "MATCH"
    assert rows["1002", "statusReasonCode"]["verdict"] == "JUSTIFIED" and "807" in rows["1002", "statusReasonCode"]["explanation"]
    assert rows["1004", "contractTypeCode"]["verdict"] == "ANOMALY" and "category O" in rows["1004", "contractTypeCode"]["explanation"]
    assert rows["1009", "isTemporaryAssignment"]["verdict"] == "MATCH"
    hours = {r["layer"]: r for (e, f), r in rows.items() if f == "weeklyHoursOverride"}
    assert set(hours) == {"LEARNED"} and hours["LEARNED"]["verdict"] == "JUSTIFIED"
    model = {m.field: m for m in result.models}["weeklyHoursOverride"]
    assert model.learned.accepted and str(model.learned) == "hist_week_hours" and model.learned.coverage == 1.0
    assert all(r["verdict"] != "AMBIGUOUS" for r in rows.values()) and all(r["priority"] > 0 for r in rows.values() if r["verdict"] == "ANOMALY")
    assert not {c for c in made.learnable().kinds if "Responsable" in c}


def test_command_line_on_four_files(spark, tmp_path, service):
    """What a user has: four files in a folder, the history as lines of CSV in one column with spreadsheet days."""
    from ledgerloom.__main__ import found_inputs, main

    given, folder = hr_rows(spark), tmp_path / "in"
    folder.mkdir()
    write_report({"A": given.source.drop("_seq")}, folder / "source.xlsx")
    given.target.drop("_seq").toPandas().to_csv(folder / "target.csv", index=False)
    past = "7,43831,3,55,b1,g,40.0,8.0,5"
    write_report({"A": spark.createDataFrame([(past,)], "line string")}, folder / "history.xlsx")
    given.reasons.drop("_seq").write.parquet(str(folder / "reasons.parquet"))
    main(["run", str(folder), str(tmp_path / "out"), "--domain", "@x.org", "--reference", "2024-01-01"])
    rows = {(r["entity"], r["field"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(rows) == 9 * 24 + 1 and rows["1004", "contractTypeCode"]["verdict"] == "ANOMALY" and rows["1002", "statusReasonCode"]["verdict"] == "JUSTIFIED"
    assert rows["1001", "weeklyHoursOverride"]["layer"] == "LEARNED" and rows["1001", "weeklyHoursOverride"]["verdict"] == "JUSTIFIED"
    with pytest.raises(ValueError, match="_seq"):
        hr_dataset(Inputs(given.source.drop("_seq"), given.target, given.history, given.reasons), "@x.org", "2024-01-01")
    # the files uploaded: a dataset of that name is reconciled; one that fails leaves what was there
    paths, small = found_inputs(str(folder)), service.datasets["x"]
    assert service.upload("hr", paths, lambda inputs: small if hr_inputs(inputs).history.first()["HeuresSemaineContrat"] == 40.0 else None).first()["checks"] == 20
    with pytest.raises(Exception, match="nonsense"):
        service.upload("hr", paths, lambda inputs: Dataset(small.pairs, [FieldRule("name", "n", "R-NOM", name("nonsense", "nonsense"))]))
    assert service.datasets["hr"].rules is small.rules and service.rows("hr", size=1).count() == 1


def test_command_line(spark, tmp_path, capsys):
    from ledgerloom.__main__ import main

    main(["trees", "name"])
    assert "R-NOM" in capsys.readouterr().out
    if Path("/root/testdata/sf0.001").exists():
        main(["run", "/root/testdata/sf0.001", str(tmp_path / "out"), "--report", str(tmp_path / "r.xlsx")])
        written = spark.read.parquet(str(tmp_path / "out"))
        assert written.where("verdict = 'AMBIGUOUS'").isEmpty() and not written.where("layer = 'LEARNED'").isEmpty()
        main(["payload", "/root/testdata/sf0.001", str(tmp_path / "sent")])
        assert "Customer#" not in (tmp_path / "sent" / "name.txt").read_text("utf-8")


def test_small_reports(spark, service):
    evidence = service.proof("x", "name")["evidence"]
    documented = service.datasets["x"].features.df.select("pair_id", F.upper("n").alias("expected"), F.lit("MATCH").alias("verdict"))
    assert tuple(agreement(evidence, documented).first()) == (1.0, 0)
    flags = spark.createDataFrame([("S1", 2, "b", True), ("S1", 1, "a", True), ("S1", 3, "c", False)], "method string, seq int, label string, flag boolean")
    assert flagged_labels(flags).first()["labels"] == "a, b"
    assert json.loads(examples(service.datasets["x"].features.df, "y", ["n"])[0])["n"].startswith("Éva")
