"""The HR-to-timekeeping mapping as a dataset: pairs of assignments with history, reason and label checks looked up."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import normalize as n
from .functions.normalize import excel_date
from .keeping import checkpointed
from .operators.history import summarise, with_history
from .operators.lookup import first_by_key, with_dependency, with_reason
from .operators.pairing import pair_records
from .operators.verdicts import identity
from .plans.fields import PRIMARY, TEMPORARY, FieldRule, hr_rules
from .service import Dataset
from .sources.tables import Inputs, nested_csv

#: Source columns that neither learners nor anything outside may see.
HIDDEN = ("IdentifiantResponsable", "NomResponsable")
#: Columns of the position history that hold at a date.
CURRENT = ("IdentifiantEmploi", "CodeBudget", "IndicateurGestion", "JoursTravailléesSemaine")


#: Columns that may leave the cluster as fakes, and those that may as they are. Fixed values.
IDENTIFIERS = {"src_Matricule": "id", "src_PrénomUsuel": "given name", "src_NomFamille": "surname"}
ALLOWED = {f"src_{c}" for c in (
    "DateEmbaucheRécente", "TypeAffectation", "CodePoste", "CodeEmploi", "IntituléEmploi", "DateEntréePoste", "DateSortiePoste", "CodeSite", "LibelléSite", "CodeDirection", "LibelléDirection", "CodeImputation", "CatégorieEmploi", "EstPermanent", "EstTempsPlein",
    "ÉchelleSalariale", "LibelléÉchelleSalariale", "HeuresNormeHebdo", "HeuresNormeQuotidienne", "CodeStatutEmploi", "CodeRaisonStatut", "CodeSuspensionAccès", "DateRetourAnticipée", "LibelléRaisonStatut",
)} | {"hist_week_hours", "hist_day_hours", "hist_unit", "hist_unit_date", "hist_unit_end", "reason_code", "reason_access"}
HISTORY = "IdentifiantPoste string, DateEffet int, `CodeDirectionAffectée` string, IdentifiantEmploi string, CodeBudget string, IndicateurGestion string, HeuresSemaineContrat double, HeuresJourContrat double, `JoursTravailléesSemaine` double"


def numbered(df: DataFrame) -> DataFrame:
    """With ``_seq`` in the order of the columns' texts, where the file gave no order: dealt by ranges and sorted, so the
    numbers rise from part to part; kept, so that they stay. Rows alike in all columns may change places."""
    if "_seq" in df.columns:
        return df
    order = [F.col(f"`{c}`").cast("string") for c in df.columns]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_seq", F.monotonically_increasing_id()))


def hr_inputs(inputs: Inputs) -> Inputs:
    """Inputs as their files have them, typed: the history's lines of CSV inside one column taken apart, its days and the
    hours as dates and numbers; rows numbered by the columns themselves where the file gave no order."""
    history = numbered(inputs.history)
    if "IdentifiantPoste" not in history.columns:
        history = nested_csv(history, history.columns[0], HISTORY, "DateEffet")
    elif not isinstance(history.schema["DateEffet"].dataType, T.DateType):
        history = history.withColumn("DateEffet", F.coalesce(excel_date(F.col("DateEffet").cast("string").try_cast("int")), F.left(F.col("DateEffet").cast("string"), F.lit(10)).try_cast("date")))
    as_number = lambda df, columns: df.withColumns({c: n.to_num(F.col(f"`{c}`").cast("string")) for c in columns if c in df.columns})
    return Inputs(numbered(inputs.source), as_number(numbered(inputs.target), ("weeklyHoursOverride", "dailyHoursOverride")), as_number(history, ("HeuresSemaineContrat", "HeuresJourContrat")), numbered(inputs.reasons))


def _flags(primary: Column, temporary: Column) -> Column:
    word = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    return F.concat_ws("/", word(primary), word(temporary))


def _mapped(column: Column, values: dict[str, bool]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[n.clean(column)]


def hr_pairs(inputs: Inputs, reference: date | str) -> DataFrame:
    """``inputs`` as loaded; history with DateEffet (a date); every input with ``_seq``, a unique long that says the order of its
    rows. ``reference``: the day on which the history is read."""
    for name, df in vars(inputs).items():
        if "_seq" not in df.columns:
            raise ValueError(f"{name} has no _seq: the order of its rows decides ties, and Spark keeps none")
    own = inputs.source.withColumns({
        "_entity": n.to_str(n.to_num(F.col("Matricule"))), "_job": n.key(F.col("CodeEmploi")), "_start": n.date_key(F.col("DateEntréePoste")),
        "_kind": _flags(_mapped(F.col("TypeAffectation"), PRIMARY), _mapped(F.col("TypeAffectation"), TEMPORARY)),
    })
    other = inputs.target.withColumns({
        "_entity": n.to_str(n.to_num(F.col("personId"))), "_job": n.key(F.col("positionId")), "_start": n.date_key(F.col("assignmentStartDate")),
        "_kind": _flags(n.to_bool(F.col("isPrimaryAssignment")), n.to_bool(F.col("isTemporaryAssignment"))),
    })
    pairs = pair_records(own, other, ("_entity",) * 2, ("_job",) * 2, ("_kind",) * 2, ("_start",) * 2, ("_seq",) * 2)
    history = inputs.history
    last = {"week_hours": "HeuresSemaineContrat", "day_hours": "HeuresJourContrat"}
    current = {c: c for c in CURRENT if c in history.columns}
    pairs = with_history(pairs, summarise(history, "IdentifiantPoste", "DateEffet", "CodeDirectionAffectée", reference, ["_seq"], last, current), "CodePoste")
    reasons = first_by_key(inputs.reasons, "CodeCatégorieStatut", ["_seq"])
    reasons = reasons.select(F.col("CodeCatégorieStatut").alias("key"), F.col("CodeGestionAccès").alias("access"), F.col("CodeStatutSystèmeExterne").alias("code"))
    pairs = with_dependency(with_reason(pairs, reasons, "CodeRaisonStatut"), inputs.target, "positionId", "positionName")
    pairs = identity(pairs, {"kind": ("TypeAffectation", "_kind"), "position": ("CodePoste", "positionId"), "job": ("CodeEmploi", "positionId")})
    plain = lambda side: F.col(side).dropFields("_entity", "_job", "_start", "_kind", "_seq")
    return pairs.withColumns({"s": F.when(F.col("s").isNotNull(), plain("s")), "d": F.when(F.col("d").isNotNull(), plain("d"))})


def hr_dataset(inputs: Inputs, domain: str, reference: date | str, policy: str = "latest") -> Dataset:
    rules: list[FieldRule] = hr_rules(domain, policy)
    return Dataset(hr_pairs(inputs, reference), rules, hidden=HIDDEN)
