"""Field rules as configuration: builders of trees, and the catalogue of an HR-to-timekeeping mapping.

Builders take names of columns of the source (``s``) and target (``d``) records. Looked-up values (reason table,
position history) are columns of the pair that the operators have joined before: ``reason`` and ``hist``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import normalize as n
from .tree import AMBIGUOUS, ANOMALY, JUSTIFIED, MATCH, Ask, End, Let, Tree, Vars


@dataclass(frozen=True)
class FieldRule:
    target: str
    sources: str
    rule: str
    tree: Tree


def s(name: str) -> Column:
    return F.col(f"s.`{name}`")


def d(name: str) -> Column:
    return F.col(f"d.`{name}`")


def anomaly(rule: str, text: str = "Expected {expected}, found {actual}.") -> End:
    return End(ANOMALY, rule, text)


Compare = Callable[[Column, Column], Column]


def finish(rule: str, justification: str, mismatch: Tree, compare: Compare = n.same, raw: bool = False) -> Tree:
    """Is the target as expected? If so and a raw source value is bound, a target that differs from it is justified."""
    equal: Tree = End(MATCH, rule, "As expected ({actual}).")
    if raw:
        equal = Ask(f"{rule}.raw", "Target equals the raw source value?", lambda v: compare(v["raw"], v["actual"]), {True: equal, False: End(JUSTIFIED, rule, justification)})
    return Ask(f"{rule}.eq", "Target equals the expected value?", lambda v: compare(v["expected"], v["actual"]), {True: equal, False: mismatch})


def direct(source: str, target: str, rule: str = "R-DIRECT") -> Tree:
    return Let(f"{rule}.exp", f"Source {source}", "expected", lambda v: n.clean(s(source)), Let(f"{rule}.act", f"Target {target}", "actual", lambda v: n.clean(d(target)), finish(rule, "", anomaly(rule))))


def date_copy(source: str, target: str, rule: str = "R-DIRECT") -> Tree:
    return Let(f"{rule}.exp", f"Source date {source}", "expected", lambda v: n.date_key(s(source)), Let(f"{rule}.act", f"Target date {target}", "actual", lambda v: n.date_key(d(target)), finish(rule, "", anomaly(rule), n.date_eq)))


def name(source: str, target: str, rule: str = "R-NOM") -> Tree:
    """Accents are taken off the expected value only; a difference of case alone is for an expert."""
    plain = lambda v: n.strip_accents(F.coalesce(v["expected"], F.lit("")))
    actual = lambda v: F.coalesce(v["actual"], F.lit(""))
    case = Ask(f"{rule}.case", "Equal but for case?", lambda v: n.case_fold(plain(v)) == n.case_fold(actual(v)), {True: End(AMBIGUOUS, rule, "Only case differs ({expected} / {actual})."), False: anomaly(rule)})
    accent = Ask(f"{rule}.accent", "Equal without accents?", lambda v: plain(v) == actual(v), {True: End(JUSTIFIED, rule, "Accents removed as the rule asks: {expected} → {actual}."), False: case})
    exact = Ask(f"{rule}.exact", "Equal?", lambda v: v["expected"].eqNullSafe(v["actual"]), {True: End(MATCH, rule, "Equal ({actual})."), False: accent})
    return Let(f"{rule}.exp", f"Source {source}", "expected", lambda v: n.clean(s(source)), Let(f"{rule}.act", f"Target {target}", "actual", lambda v: n.clean(d(target)), exact))


def email(given: str, surname: str, ident: str, target: str, domain: str, rule: str = "R-EMAIL") -> Tree:
    first, last, code = (n.clean(s(c)) for c in (given, surname, ident))
    expected = F.when(first.isNotNull() & last.isNotNull() & code.isNotNull(), F.concat(F.replace(n.strip_accents(F.concat(n.first_char(first), last, n.last_three(code))), F.lit(" "), F.lit("")), F.lit(domain)))

    def structure(v: Vars) -> Column:
        local = F.lower(v["bare"])
        stem = F.lower(F.regexp_extract(n.strip_accents(F.coalesce(last, F.lit(""))), r"^([^\d]*)", 1))
        begin = F.lower(n.strip_accents(F.coalesce(n.first_char(first), F.lit(""))))
        return F.coalesce(local.endswith(domain) & (n.first_char(local) == begin) & F.startswith(F.substring(local, 2, 1 << 30), stem) & local.rlike(r"\d{3}@"), F.lit(False))

    mismatch = Ask(f"{rule}.struct", "Built as the rule says (initial, surname, three digits, domain)?", structure, {True: End(AMBIGUOUS, rule, "Well built, but not as expected ({bare} / {expected})."), False: anomaly(rule)})
    prefix = Ask(f"{rule}.env", "Environment prefix?", lambda v: v["prefix"].isNotNull(), {True: End(JUSTIFIED, rule, "As expected without the environment prefix {prefix}."), False: End(MATCH, rule, "As expected ({actual}).")})
    equal = Ask(f"{rule}.eq", "Equal without prefix and case?", lambda v: F.lower(F.coalesce(v["expected"], F.lit(""))) == F.lower(v["bare"]), {True: prefix, False: mismatch})
    bare = Let(f"{rule}.bare", "Target without prefix", "bare", lambda v: n.split_env_prefix(F.coalesce(v["actual"], F.lit("")))[1], equal)
    pre = Let(f"{rule}.pfx", "Environment prefix", "prefix", lambda v: n.split_env_prefix(F.coalesce(v["actual"], F.lit("")))[0], bare)
    return Let(f"{rule}.exp", "Initial, surname, last three of the id, domain", "expected", lambda v: expected, Let(f"{rule}.act", f"Target {target}", "actual", lambda v: n.clean(d(target)), pre))


def labelled(code: str, label: str, target: str, rule: str, one_to_one: Callable[[Vars], Column] | None = None) -> Tree:
    """code-label. ``one_to_one``: whether code and label belong to each other alone in the target (see lookup)."""
    tail: Tree = anomaly(rule)
    if one_to_one:

        def consistent(v: Vars) -> Column:
            head, rest = n.split_label(v["actual"])
            digits = F.regexp_replace(F.coalesce(rest, F.lit("")), r"\D", "")
            equal = F.when(head.rlike(r"^\d{1,18}$") & digits.rlike(r"^\d{1,18}$"), head.try_cast("long") == digits.try_cast("long"))
            return F.coalesce(equal & one_to_one(v), F.lit(False))

        tail = Ask(f"{rule}.anon", "Label consistent in itself, code and label one to one?", consistent, {True: End(AMBIGUOUS, rule, "{actual} is consistent in itself but not {expected}."), False: anomaly(rule)})
    pad = Ask(f"{rule}.pad", "Equal but for zeros before the code?", lambda v: n.padded_equal(v["expected"], v["actual"]), {True: End(JUSTIFIED, rule, "Same code and label, code filled up with zeros ({expected} → {actual})."), False: tail})
    exact = Ask(f"{rule}.exact", "Equal?", lambda v: n.same(v["expected"], v["actual"]), {True: End(MATCH, rule, "As expected ({actual})."), False: pad})
    return Let(f"{rule}.exp", f"{code}-{label}", "expected", lambda v: F.concat(n.clean(s(code)), F.lit("-"), n.clean(s(label))), Let(f"{rule}.act", f"Target {target}", "actual", lambda v: n.clean(d(target)), exact))


@dataclass(frozen=True)
class Situation:
    """Access codes of active and absent records, and the words for both."""

    access: str
    reason: str
    active: tuple[int, ...] = (0, 1)
    absent: tuple[int, ...] = (2, 3, 6, 7)
    active_word: str = "Active"
    absent_word: str = "Absent"


def situation(spec: Situation, target: str, part: str, raw: str | None = None, rule: str = "R-SIT") -> Tree:
    """``part``: code (from the reason table), date (``raw`` is the source date) or label."""
    compare = n.date_eq if part == "date" else n.same
    code = n.to_num(s(spec.access))
    state = F.when(code.isin(*map(float, spec.active)), "active").when(code.isin(*map(float, spec.absent)), "absent").otherwise(F.concat(F.lit("code "), F.coalesce(n.to_str(code), F.lit(n.NOTHING)), F.lit(" undefined")))
    mismatch: Tree = anomaly(rule)
    if part == "label":
        mismatch = Ask("R-ENC.chk", "Equal with the encoding mended?", lambda v: n.fix_mojibake(v["actual"]).eqNullSafe(v["expected"]), {True: End(JUSTIFIED, f"{rule}+R-ENC", "Right value ({expected}), wrongly encoded ({actual})."), False: mismatch})

    def tail(with_raw: bool) -> Tree:
        actual = (lambda v: n.date_key(d(target))) if part == "date" else (lambda v: n.clean(d(target)))
        return Let(f"{rule}.act", f"Target {target}", "actual", actual, finish(rule, "By the reason table: reason {reason} → {expected} (source: {raw}).", mismatch, compare, with_raw))

    if part == "code":
        absent: Tree = Let(f"{rule}.code", "Code by the reason table", "expected", lambda v: n.clean(F.col("reason.code")), Let(f"{rule}.raw", f"Source {raw}", "raw", lambda v: n.clean(s(raw)), tail(True)) if raw else tail(False))
    elif part == "date":
        absent = Let(f"{rule}.back", f"Source {raw}", "expected", lambda v: n.date_key(s(raw)), tail(False))
    else:
        absent = Let(f"{rule}.label", "Word for the situation", "expected", lambda v: F.lit(spec.absent_word), tail(False))
    found = F.when(F.col("reason.key").isNull(), "missing").when(n.same(F.col("reason.access"), s(spec.access)), "yes").otherwise("no")
    known = Ask(f"{rule}.reason", "Reason in the table, with this access code?", lambda v: found, {"yes": absent, "no": End(AMBIGUOUS, rule, "The access code of reason {reason} is another."), "missing": End(AMBIGUOUS, rule, "Reason {reason} is not in the table.")}, "string")
    active_value = F.lit(spec.active_word) if part == "label" else F.lit(None).cast("string")
    active = Let(f"{rule}.active", "Expected of an active record", "expected", lambda v: active_value, tail(False))
    return Ask(f"{rule}.access", "Situation by access code?", lambda v: state, {"active": active, "absent": Let(f"{rule}.why", f"Source {spec.reason}", "reason", lambda v: n.clean(s(spec.reason)), known)}, "string")


def contract(category: str, permanent: str, full_time: str, target: str, simple: dict[str, str], profiled: tuple[str, str, str], rule: str = "R-CT") -> Tree:
    """Categories with a code of their own, and one that depends on permanent and full time (category, full, part)."""
    special, full, part = profiled
    profiles = {full: f"{special}, permanent, full time", part: f"{special}, permanent, part time"} | {v: f"category {k}" for k, v in simple.items()}
    reverse = F.coalesce(F.create_map(*(F.lit(x) for kv in profiles.items() for x in kv))[F.coalesce(n.clean(d(target)), F.lit(""))], F.lit("none known"))

    def leaf(code: str) -> Tree:
        wrong = Let(f"{rule}.rev", "Profile that gives the target's value", "other", lambda v: reverse, anomaly(rule, "Expected {expected}, found {actual}, which is for: {other}."))
        return Let(f"{rule}.exp", f"Code for {profiles[code]}", "expected", lambda v: F.lit(code), Let(f"{rule}.act", f"Target {target}", "actual", lambda v: n.clean(d(target)), finish(rule, "", wrong)))

    time = Ask(f"{rule}.full", f"{full_time}?", lambda v: n.to_bool(s(full_time)), {True: leaf(full), False: leaf(part)})
    lasting = Ask(f"{rule}.perm", f"{permanent}?", lambda v: n.to_bool(s(permanent)), {True: time})
    return Ask(f"{rule}.cat", f"{category}?", lambda v: n.clean(s(category)), {special: lasting} | {k: leaf(v) for k, v in simple.items()}, "string")


def flag(source: str, target: str, wanted: dict[str, bool], rule: str = "R-AFF") -> Tree:
    def leaf(value: bool) -> Tree:
        same = lambda a, b: n.to_bool(a.cast("string")).eqNullSafe(n.to_bool(b.cast("string")))
        return Let(f"{rule}.exp", "Flag for this type", "expected", lambda v: F.lit(value), Let(f"{rule}.act", f"Target {target}", "actual", lambda v: n.to_bool(d(target)), finish(rule, "", anomaly(rule), same), "boolean"), "boolean")

    return Ask(f"{rule}.type", f"{source}?", lambda v: n.clean(s(source)), {k: leaf(v) for k, v in wanted.items()}, "string")


def with_history(unit: str, rule: str, then: Tree) -> Tree:
    check = Ask(f"{rule}.unitchk", "Unit in the history equals the source's?", lambda v: n.same(v["unit"], s(unit)), {True: then, False: End(AMBIGUOUS, rule, "The history's unit ({unit}) is not the source's.")})
    there = Ask(f"{rule}.has", "Position has a history?", lambda v: v["records"] > 0, {True: Let(f"{rule}.unit", "Current unit in the history", "unit", lambda v: F.col("hist.unit").cast("string"), check), False: End(AMBIGUOUS, rule, "No history for this position.")})
    return Let(f"{rule}.hist", "Records in the position's history", "records", lambda v: F.coalesce(F.col("hist.records"), F.lit(0)), there, "double")


def start_date(entry: str, unit: str, target: str, policy: str = "latest", rule: str = "R-ASD") -> Tree:
    """The later (``latest``) or earlier (``oldest``) of entry date and date of the current unit."""
    pick = F.greatest if policy == "latest" else F.least

    def expected(v: Vars) -> Column:
        both = v["entry"].isNotNull() & v["unit_date"].isNotNull()
        return F.when(both, pick(v["entry"], v["unit_date"]))

    why = Ask(f"{rule}.diag", "Target equals the history's last date?", lambda v: n.date_eq(v["actual"], v["last_date"]), {True: anomaly(rule, "Expected {expected}, found {actual}: the history's last date, though the unit did not change."), False: anomaly(rule)})
    end = finish(rule, "Date of the unit ({unit_date}) instead of the entry date ({entry}).", why, n.date_eq, raw=True)
    known = Ask(f"{rule}.both", "Both dates known?", lambda v: v["expected"].isNotNull(), {True: end, False: End(AMBIGUOUS, rule, "One of the two dates is missing.")})
    tree: Tree = Let(f"{rule}.act", f"Target {target}", "actual", lambda v: n.date_key(d(target)), known)
    tree = Let(f"{rule}.exp", f"Expected date ({policy})", "expected", expected, tree)
    tree = Let(f"{rule}.last", "Last date of the history", "last_date", lambda v: F.col("hist.last_date").cast("string"), tree)
    tree = Let(f"{rule}.raw", "Source value", "raw", lambda v: v["entry"], tree)
    tree = Let(f"{rule}.entry", f"Source {entry}", "entry", lambda v: n.date_key(s(entry)), tree)
    tree = Let(f"{rule}.change", "Date of the current unit", "unit_date", lambda v: F.col("hist.unit_date").cast("string"), tree)
    return with_history(unit, rule, tree)


def end_date(leaving: str, unit: str, target: str, rule: str = "R-AED") -> Tree:
    end = finish(rule, "End of the unit ({unit_end}).", anomaly(rule), n.date_eq, raw=True)
    tree: Tree = Let(f"{rule}.act", f"Target {target}", "actual", lambda v: n.date_key(d(target)), end)
    tree = Let(f"{rule}.exp", "Earlier of both", "expected", lambda v: F.least(v["raw"], v["unit_end"]), tree)
    tree = Let(f"{rule}.fu", "End of the current unit", "unit_end", lambda v: F.col("hist.unit_end").cast("string"), tree)
    return with_history(unit, rule, Let(f"{rule}.raw", f"Source {leaving}", "raw", lambda v: n.date_key(s(leaving)), tree))


def hours(source: str, target: str, contract_hours: str, rule: str = "R-HRS") -> Tree:
    check = Ask(f"{rule}.ctrchk", "Target equals the position's contract hours?", lambda v: n.same(v["actual"], v["contract"]), {True: End(AMBIGUOUS, rule, "The target ({actual}) has the position's contract hours, not the employee's ({expected})."), False: anomaly(rule)})
    tree: Tree = Let(f"{rule}.ctr", f"Contract hours ({contract_hours})", "contract", lambda v: n.to_str(F.col(f"hist.`{contract_hours}`")), finish(rule, "", check))
    return Let(f"{rule}.exp", f"Source {source}", "expected", lambda v: n.to_str(n.to_num(s(source))), Let(f"{rule}.act", f"Target {target}", "actual", lambda v: n.to_str(n.to_num(d(target))), tree))


# Catalogue ----------------------------------------------------------------------------------------------------------

#: Contract codes by category. Fixed values.
CONTRACT_CODES = {"T": "KELH", "O": "WHX", "M": "CEGQ", "R": "CNZC", "J": "RMQ", "Z": "JAW", "Q": "TRSY"}
CONTRACT_PROFILED = ("V", "JWN", "XFLR")
PRIMARY = {"P": True, "A": False, "S": False}
TEMPORARY = {"P": False, "A": True, "S": False}

RULES = {
    "R-DIRECT": "Copy of the source field.", "R-NOM": "Names copied, accents removed.", "R-EMAIL": "Initial, surname, last three digits of the id, domain, without accents.",
    "R-DIVNAME": "Unit code - unit label.", "R-POSNAME": "Job code - job label.", "R-SIT": "Employment situation by access code and reason table.", "R-CT": "Contract code by category, permanence and working time.",
    "R-AFF": "Primary and temporary flags by assignment type.", "R-ASD": "Start date from entry date and unit change.", "R-AED": "End date from leaving date and end of the unit.",
    "R-HRS": "Hours of the employee's norm.", "R-ENC": "UTF-8 text read as Latin-1.", "R-MATCH": "Pairing of source and target assignments.",
}


def hr_rules(domain: str, policy: str = "latest", one_to_one: Callable[[Vars], Column] | None = None) -> list[FieldRule]:
    """The 24 mapped fields of the HR extract."""
    sit = Situation("CodeSuspensionAccès", "CodeRaisonStatut", active_word="Actif", absent_word="Absence complète")
    one_to_one = one_to_one or (lambda v: F.coalesce(F.col("fd.one_to_one"), F.lit(False)))
    copies = {"siteName": "LibelléSite", "siteCode": "CodeSite", "divisionId": "CodeDirection", "divisionCode": "CodeImputation", "positionId": "CodeEmploi", "positionCode": "CodeEmploi", "payGradeId": "ÉchelleSalariale"}
    rules = {
        "givenName": ("PrénomUsuel", "R-NOM", name("PrénomUsuel", "givenName")),
        "surname": ("NomFamille", "R-NOM", name("NomFamille", "surname")),
        "contactEmail": ("PrénomUsuel, NomFamille, Matricule", "R-EMAIL", email("PrénomUsuel", "NomFamille", "Matricule", "contactEmail", domain)),
        "onboardDate": ("DateEmbaucheRécente", "R-DIRECT", date_copy("DateEmbaucheRécente", "onboardDate")),
        "divisionName": ("CodeDirection, LibelléDirection", "R-DIVNAME", labelled("CodeDirection", "LibelléDirection", "divisionName", "R-DIVNAME")),
        "positionName": ("CodeEmploi, IntituléEmploi", "R-POSNAME", labelled("CodeEmploi", "IntituléEmploi", "positionName", "R-POSNAME", one_to_one)),
        "statusReasonCode": ("CodeStatutEmploi, CodeRaisonStatut, CodeSuspensionAccès", "R-SIT", situation(sit, "statusReasonCode", "code", "CodeStatutEmploi")),
        "expectedReturnDate": ("DateRetourAnticipée, CodeSuspensionAccès", "R-SIT", situation(sit, "expectedReturnDate", "date", "DateRetourAnticipée")),
        "detailedStatus": ("CodeSuspensionAccès", "R-SIT", situation(sit, "detailedStatus", "label")),
        "contractTypeCode": ("CatégorieEmploi, EstPermanent, EstTempsPlein", "R-CT", contract("CatégorieEmploi", "EstPermanent", "EstTempsPlein", "contractTypeCode", CONTRACT_CODES, CONTRACT_PROFILED)),
        "isPrimaryAssignment": ("TypeAffectation", "R-AFF", flag("TypeAffectation", "isPrimaryAssignment", PRIMARY)),
        "isTemporaryAssignment": ("TypeAffectation", "R-AFF", flag("TypeAffectation", "isTemporaryAssignment", TEMPORARY)),
        "assignmentStartDate": ("DateEntréePoste + history", "R-ASD", start_date("DateEntréePoste", "CodeDirection", "assignmentStartDate", policy)),
        "weeklyHoursOverride": ("HeuresNormeHebdo", "R-HRS", hours("HeuresNormeHebdo", "weeklyHoursOverride", "week_hours")),
        "dailyHoursOverride": ("HeuresNormeQuotidienne", "R-HRS", hours("HeuresNormeQuotidienne", "dailyHoursOverride", "day_hours")),
        "assignmentEndDate": ("DateSortiePoste + history", "R-AED", end_date("DateSortiePoste", "CodeDirection", "assignmentEndDate")),
        "termEndDate": ("DateSortiePoste + history", "R-AED", end_date("DateSortiePoste", "CodeDirection", "termEndDate")),
    }
    rules |= {target: (source, "R-DIRECT", direct(source, target)) for target, source in copies.items()}
    return [FieldRule(target, *spec) for target, spec in rules.items()]
