"""Queries over the driver's tables, one per operator family, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bindings as b
from .functions import normalize as n
from .keeping import kept, new_folder
from .learn import evaluate as ev
from .functions.chance import drawn_sql
from .learn import privacy, resolve, search, trees
from .learn.dsl import branch, call, col, joined
from .operators import features as ft
from .operators import history, lookup, overrides, pairing, report, verdicts
from .pipeline import learned_rules, reconcile, report_order, with_ids
from .plans import fields as f
from .streaming import overrides as override_streams
from .streaming import verdicts as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SRC = """src AS (SELECT o_orderkey AS k, concat(o_custkey, '-', year(o_orderdate)) AS entity, o_orderstatus AS type, o_orderpriority AS job, CAST(o_orderdate AS DATE) AS entry,
 o_orderkey % 200 AS position, c_nationkey AS reason, c_name AS name, o_totalprice AS amount, c_mktsegment AS segment, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey)"""
TGT = """tgt AS (SELECT k, entity, CASE WHEN k % 31 = 0 THEN 'X' ELSE type END AS type, CASE WHEN k % 17 = 0 THEN 'RECODED' ELSE job END AS job, CASE WHEN k % 13 <> 0 THEN entry END AS entry,
 position, reason, CASE WHEN k % 11 = 0 THEN lower(name) ELSE name END AS name, CASE WHEN k % 7 = 0 THEN amount + 1 ELSE amount END AS amount, segment, o_custkey FROM src WHERE k % 29 <> 0)"""
BOTH = f"WITH {SRC}, {TGT}"
MATCHED = "FROM src s JOIN tgt d USING (k)"
CASES = {
    "amount": "CASE WHEN abs(s.amount - d.amount) < 1e-9 THEN 'MATCH' ELSE 'ANOMALY' END",
    "type": "CASE WHEN s.type = d.type THEN 'MATCH' ELSE 'ANOMALY' END",
    "job": "CASE WHEN s.job = d.job THEN 'MATCH' ELSE 'ANOMALY' END",
    "entry": "CASE WHEN s.entry IS NOT DISTINCT FROM d.entry THEN 'MATCH' ELSE 'ANOMALY' END",
    "name": "CASE WHEN s.name = d.name THEN 'MATCH' WHEN lower(s.name) = lower(d.name) THEN 'AMBIGUOUS' ELSE 'ANOMALY' END",
}
TEXT = {"amount": "CAST({0}.amount AS VARCHAR)", "entry": "strftime({0}.entry, '%Y-%m-%d')"}
LONG = ", v AS (" + " UNION ALL ".join(
    f"SELECT k, s.entity, s.type AS kind, s.position, '{name}' AS field, {case} AS verdict, '{'R-NOM' if name == 'name' else 'R-DIRECT'}' AS rule, {TEXT.get(name, '{0}.' + name).format('s')} AS expected, {TEXT.get(name, '{0}.' + name).format('d')} AS actual {MATCHED}" for name, case in CASES.items()
) + " UNION ALL SELECT k, entity, type, position, '(assignment)', 'ANOMALY', 'R-MATCH', NULL, NULL FROM src WHERE k % 29 = 0)"
SHAPE = "coalesce(regexp_replace(regexp_replace({0}, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+', 'a', 'g'), '\\p{{Nd}}+', '9', 'g'), '∅')"
SIGNATURE = f"CASE WHEN rule = 'R-MATCH' THEN '' WHEN expected IS NOT DISTINCT FROM actual THEN '=' ELSE concat({SHAPE.format('expected')}, ' → ', {SHAPE.format('actual')}) END"
SIGNED = f"{LONG}, w AS (SELECT *, {SIGNATURE} AS signature FROM v)"
FOUR = ", ".join(f"count(*) FILTER (verdict = '{v}') AS \"{v}\"" for v in verdicts.RANK)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _orders(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    return b.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", f"{expression} AS t")


# Scalars ------------------------------------------------------------------------------------------------------------

NUMBERS = "CASE o_orderkey % 6 WHEN 0 THEN concat('', o_orderkey) WHEN 1 THEN concat('x', o_orderkey) WHEN 2 THEN concat(' ', o_orderkey, '.5 ') WHEN 3 THEN '' WHEN 4 THEN concat(o_orderkey, 'D') ELSE concat('-', o_orderkey, 'e1') END"
NUMERIC = "CASE WHEN regexp_full_match(trim(t), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN CAST(trim(t) AS DOUBLE) END"
DATES = "CASE o_orderkey % 4 WHEN 0 THEN concat('20', lpad(concat('', o_orderkey % 30), 2, '0'), '-', lpad(concat('', o_orderkey % 12 + 1), 2, '0'), '-', lpad(concat('', o_orderkey % 28 + 1), 2, '0')) WHEN 1 THEN concat('19', lpad(concat('', o_orderkey % 90 + 10), 2, '0'), lpad(concat('', o_orderkey % 12 + 1), 2, '0'), lpad(concat('', o_orderkey % 28 + 1), 2, '0')) WHEN 2 THEN 'n/a' ELSE ' ' END"
WORDS = "CASE o_orderkey % 6 WHEN 0 THEN ' Oui' WHEN 1 THEN 'non' WHEN 2 THEN 'TRUE' WHEN 3 THEN '' WHEN 4 THEN '1' ELSE 'x' END"


@query(f"SELECT k, {NUMERIC} AS num FROM (SELECT o_orderkey AS k, {NUMBERS} AS t FROM orders)")
def norm_to_num(spark, sf_dir):
    return _orders(spark, sf_dir, NUMBERS).select("k", n.to_num(F.col("t")).alias("num"))


@query(f"SELECT k, CASE WHEN regexp_full_match(t, '\\d{{8}}') THEN concat(substr(t, 1, 4), '-', substr(t, 5, 2), '-', substr(t, 7, 2)) ELSE nullif(trim(t), '') END AS date_key FROM (SELECT o_orderkey AS k, {DATES} AS t FROM orders)")
def norm_to_date(spark, sf_dir):
    return _orders(spark, sf_dir, DATES).select("k", n.date_key(F.col("t")).alias("date_key"))


@query("SELECT o_orderkey AS k, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole FROM orders")
def norm_to_str(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), n.to_str(F.floor("o_totalprice").cast("double")).alias("whole"))


@query(f"SELECT k, CASE WHEN trim(t) <> '' THEN lower(trim(t)) IN ('oui', 'true', '1', 'o', 'y', 'yes', 'vrai') END AS flag FROM (SELECT o_orderkey AS k, {WORDS} AS t FROM orders)")
def norm_to_bool(spark, sf_dir):
    return _orders(spark, sf_dir, WORDS).select("k", n.to_bool(F.col("t")).alias("flag"))


@query(f"SELECT k, CASE WHEN trim(t) = '' THEN false WHEN {NUMERIC} IS NOT NULL THEN abs({NUMERIC} - k) < 1e-9 ELSE trim(t) = concat('', k) END AS same FROM (SELECT o_orderkey AS k, {NUMBERS} AS t FROM orders)")
def norm_same(spark, sf_dir):
    return _orders(spark, sf_dir, NUMBERS).select("k", n.same(F.col("t"), F.concat(F.lit("00"), F.col("k").cast("string"))).alias("same"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def norm_strip_accents(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", n.strip_accents(F.col("text")).alias("plain"))


@query(f"SELECT doc_id, {SHAPE.format('text')} AS shape FROM documents")
def norm_shape(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", n.shape(F.col("text")).alias("shape"))


@query(f"SELECT doc_id, CASE WHEN source = lang THEN '=' ELSE concat({SHAPE.format('source')}, ' → ', {SHAPE.format('lang')}) END AS signature FROM documents")
def norm_signature(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", n.signature(F.col("source"), F.col("lang")).alias("signature"))


#: Letters beyond ASCII up to U+00FF, as they look when their UTF-8 is read as Latin-1. Fixed values.
_SPOILED = [(chr(c), chr(c).encode().decode("latin-1")) for c in range(0xA1, 0x100)]


@query(f"SELECT doc_id, t AS mended, t <> raw AS broken FROM (SELECT doc_id, concat(text, ' ') AS t, CASE WHEN doc_id % 2 = 0 AND regexp_full_match(text, '[\\x00-\\x7F\\xA1-\\xFF]*') THEN {'replace(' * len(_SPOILED)}concat(text, ' '){''.join(f", '{a}', concat(chr({ord(b[0])}), chr({ord(b[1])})))" for a, b in reversed(_SPOILED))} ELSE t END AS raw FROM documents)")
def norm_mojibake(spark, sf_dir):
    """Every other document spoiled (its UTF-8 read as Latin-1), and mended again; the others have to stay as they are."""
    docs = b.table(spark, sf_dir, "documents")
    narrow = F.col("text").rlike(r"^[\x00-\x7F\xA1-\xFF]*$")
    text = F.concat("text", F.lit(" "))
    raw = F.when((F.col("doc_id") % 2 == 0) & narrow, F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")).otherwise(text)
    return docs.select("doc_id", n.fix_mojibake(raw).alias("mended"), n.has_mojibake(raw).alias("broken"))


MAIL = "CASE o_orderkey % 3 WHEN 0 THEN concat('TEST-a1_', o_custkey, '@x.org') WHEN 1 THEN concat('u', o_custkey, '@x.org') ELSE concat('_', o_custkey) END"


@query(f"SELECT k, nullif(regexp_extract(t, '(?i)^([a-z0-9]+(?:-[a-z0-9]+)*_)', 1), '') AS prefix, regexp_replace(t, '(?i)^([a-z0-9]+(?:-[a-z0-9]+)*_)', '') AS rest FROM (SELECT o_orderkey AS k, {MAIL} AS t FROM orders)")
def split_prefix(spark, sf_dir):
    prefix, rest = n.split_env_prefix(F.col("t"))
    return _orders(spark, sf_dir, MAIL).select("k", prefix.alias("prefix"), rest.alias("rest"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderpriority LIKE '%-%' THEN split_part(o_orderpriority, '-', 1) END AS code, CASE WHEN o_orderpriority LIKE '%-%' THEN substr(o_orderpriority, instr(o_orderpriority, '-') + 1) ELSE o_orderpriority END AS label FROM orders")
def split_label(spark, sf_dir):
    code, label = n.split_label(F.col("t"))
    return _orders(spark, sf_dir, "o_orderpriority").select("k", code.alias("code"), label.alias("label"))


@query("SELECT o_orderkey AS k, o_orderkey % 5 <> 0 AS equal, lpad(concat('', o_orderkey), CAST(greatest(length(concat('', o_orderkey)), 5) AS INT), '0') AS padded FROM orders")
def zero_pad_eq(spark, sf_dir):
    a = F.concat(F.lit("00"), F.col("k").cast("string"), F.lit("-x"))
    other = F.concat((F.col("k") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)).cast("string"), F.lit("-x"))
    return _orders(spark, sf_dir, "''").select("k", n.padded_equal(a, other).alias("equal"), n.pad_five(F.col("k").cast("string")).alias("padded"))


# Pairing and lookups ------------------------------------------------------------------------------------------------


@query(f"{BOTH} SELECT coalesce(a.entity, z.entity) AS entity, coalesce(n_source, 0) AS n_source, coalesce(n_target, 0) AS n_target FROM (SELECT entity, count(*) AS n_source FROM src GROUP BY 1) a FULL JOIN (SELECT entity, count(*) AS n_target FROM tgt GROUP BY 1) z ON a.entity = z.entity")
def entity_full_outer(spark, sf_dir):
    return pairing.entity_counts(b.source(spark, sf_dir), b.target(spark, sf_dir), "entity")


@query(f"{BOTH} SELECT CASE WHEN s.job IS NOT DISTINCT FROM d.job THEN 2 ELSE 0 END + CASE WHEN s.type IS NOT DISTINCT FROM d.type THEN 1 ELSE 0 END + CASE WHEN s.entry IS NOT DISTINCT FROM d.entry THEN 1 ELSE 0 END AS score, count(*) AS n FROM src s JOIN tgt d USING (entity) GROUP BY 1")
def pair_score(spark, sf_dir):
    return pairing.scored_candidates(b.source(spark, sf_dir), b.target(spark, sf_dir), "entity", "job", "type", "entry").groupBy("score").agg(F.count("*").alias("n"))


#: All ways to assign the smaller side's records, one step a record; the best, and of these the first, is kept.
ASSIGNED = f"""{BOTH.replace("WITH src", "WITH RECURSIVE src")},
 sr AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM src),
 tr AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY k) - 1 AS j, count(*) OVER (PARTITION BY entity) AS m FROM tgt),
 scored AS (SELECT s.entity, n <= m AS straight, least(n, m) AS small, CASE WHEN n <= m THEN i ELSE j END AS a, CASE WHEN n <= m THEN j ELSE i END AS b, CASE WHEN s.job IS NOT DISTINCT FROM d.job THEN 2 ELSE 0 END + CASE WHEN s.type IS NOT DISTINCT FROM d.type THEN 1 ELSE 0 END + CASE WHEN s.entry IS NOT DISTINCT FROM d.entry THEN 1 ELSE 0 END AS score FROM sr s JOIN tr d USING (entity)),
 walk AS (SELECT DISTINCT entity, straight, small, 0 AS depth, CAST([] AS BIGINT[]) AS chosen, 0 AS total FROM scored
  UNION ALL SELECT w.entity, w.straight, w.small, depth + 1, list_append(chosen, b), total + score FROM walk w JOIN scored c ON c.entity = w.entity AND a = depth AND NOT list_contains(chosen, b)),
 best AS (SELECT entity, straight, arg_min(chosen, {{'less': -total, 'list': chosen}}) AS chosen FROM walk WHERE depth = small GROUP BY 1, 2),
 met AS (SELECT entity, straight, unnest(range(len(chosen))) AS a, unnest(chosen) AS b FROM best),
 matched AS (SELECT entity, s.k AS s_k, d.k AS d_k FROM met JOIN sr s USING (entity) JOIN tr d USING (entity) WHERE s.i = CASE WHEN straight THEN a ELSE b END AND d.j = CASE WHEN straight THEN b ELSE a END),
 assigned AS (SELECT entity, s_k, d_k FROM matched UNION ALL SELECT entity, k, NULL FROM src WHERE k NOT IN (SELECT s_k FROM matched) UNION ALL SELECT entity, NULL, k FROM tgt WHERE k NOT IN (SELECT d_k FROM matched))"""


for _name in ("src", "tgt", "sr", "tr", "scored", "best", "met", "matched"):  # else each step of the recursion makes them again
    ASSIGNED = ASSIGNED.replace(f" {_name} AS (", f" {_name} AS MATERIALIZED (", 1)


@query(f"{ASSIGNED} SELECT concat(coalesce(CAST(s_k AS VARCHAR), 'x'), '-', coalesce(CAST(d_k AS VARCHAR), 'x')) AS pair_id, entity, s_k, d_k FROM assigned")
def pair_assignment(spark, sf_dir):
    return b.solved_pairs(spark, sf_dir).select("pair_id", "entity", F.col("s.k").alias("s_k"), F.col("d.k").alias("d_k"))


@query(f"{BOTH} SELECT k, entity FROM src WHERE k NOT IN (SELECT k FROM tgt)")
def source_only(spark, sf_dir):
    return b.source(spark, sf_dir).join(b.target(spark, sf_dir), "k", "left_anti").select("k", "entity")


@query(f"{BOTH} SELECT k, entity FROM tgt WHERE k NOT IN (SELECT k FROM src WHERE k % 23 <> 0)")
def target_only(spark, sf_dir):
    return b.target(spark, sf_dir).join(b.source(spark, sf_dir).where("k % 23 <> 0"), "k", "left_anti").select("k", "entity")


@query(f"WITH {SRC} SELECT k, n_name AS code, CAST(n_regionkey AS VARCHAR) AS access FROM src LEFT JOIN nation ON reason = n_nationkey")
def reason_lookup(spark, sf_dir):
    once = lookup.first_by_key(b.reasons(spark, sf_dir), "key", ["code"])
    pairs = b.source(spark, sf_dir).select(F.struct("*").alias("s"))
    return lookup.with_reason(pairs, once, "reason").select("s.k", "reason.code", "reason.access")


HISTORY = f"""WITH h AS (SELECT l_partkey AS position, CAST(l_shipdate AS DATE) AS effective, l_suppkey AS unit, l_quantity AS hours, l_orderkey AS ok, l_linenumber AS line FROM lineitem),
 o AS (SELECT *, row_number() OVER w AS rn, lag(unit) OVER w AS before, lead(unit) OVER w AS after, lead(effective) OVER w AS next_date FROM h WINDOW w AS (PARTITION BY position ORDER BY effective, ok, line, unit, hours)),
 c AS (SELECT *, coalesce(max(CASE WHEN effective <= DATE '{b.REFERENCE}' THEN rn END) OVER (PARTITION BY position), 1) AS cur FROM o)"""


@query(f"{HISTORY} SELECT position, count(*) AS records, min(effective) AS first_date, max(effective) AS last_date, max(CASE WHEN rn = cur THEN unit END) AS unit, max(CASE WHEN (rn = 1 OR before IS DISTINCT FROM unit) AND rn <= cur THEN effective END) AS unit_date, max(CASE WHEN rn = cur AND after <> unit THEN next_date - 1 END) AS unit_end, arg_max(hours, rn) AS last_hours, max(CASE WHEN rn = cur THEN hours END) AS hours FROM c GROUP BY position")
def history_asof(spark, sf_dir):
    return history.summarise(b.history(spark, sf_dir), "position", "effective", "unit", b.REFERENCE, b.ORDER, {"last_hours": "hours"}, {"hours": "hours"})


@query("WITH p AS (SELECT DISTINCT p_brand AS code, p_type AS label FROM part) SELECT code, label, count(*) OVER (PARTITION BY code) = 1 AND count(*) OVER (PARTITION BY label) = 1 AS one_to_one FROM p")
def fd_check(spark, sf_dir):
    return lookup.one_to_one(b.table(spark, sf_dir, "part"), "p_brand", "p_type")


# Rules --------------------------------------------------------------------------------------------------------------


def _rule(pairs: DataFrame, tree, field: str = "x") -> DataFrame:
    out = verdicts.run_rules(pairs.where("d is not null"), [f.FieldRule(field, "", "", tree)], ["pair_id"], trace=False)
    return out.select(F.col("pair_id").alias("k"), "verdict", "rule")


@query(f"{BOTH} SELECT k, {CASES['amount']} AS verdict, 'R-DIRECT' AS rule {MATCHED}")
def rule_direct(spark, sf_dir):
    return _rule(b.known_pairs(spark, sf_dir), f.direct("amount", "amount"))


@query(f"{BOTH} SELECT k, {CASES['entry']} AS verdict, 'R-DIRECT' AS rule {MATCHED}")
def rule_date(spark, sf_dir):
    return _rule(b.known_pairs(spark, sf_dir), f.date_copy("entry", "entry"))


@query(f"{BOTH} SELECT k, {CASES['name']} AS verdict, 'R-NOM' AS rule {MATCHED}")
def rule_name(spark, sf_dir):
    return _rule(b.known_pairs(spark, sf_dir), f.name("name", "name"))


@query(f"{BOTH} SELECT k, CASE k % 4 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'JUSTIFIED' WHEN 2 THEN 'AMBIGUOUS' ELSE 'ANOMALY' END AS verdict, 'R-EMAIL' AS rule {MATCHED}")
def rule_email(spark, sf_dir):
    mail = F.concat(F.left("segment", F.lit(1)), F.col("s_name"), F.right(F.col("o_custkey").cast("string"), F.lit(3)), F.lit("@x.org"))
    stem = F.concat(F.left("segment", F.lit(1)), F.regexp_extract("s_name", r"^([^\d]*)", 1), F.lit("zz123@x.org"))
    k = F.col("k")
    changed = {"s_name": F.initcap("name"), "mail": F.when(k % 4 == 0, F.lower(mail)).when(k % 4 == 1, F.concat(F.lit("test_"), mail)).when(k % 4 == 2, stem).otherwise("nobody")}
    pairs = b.known_pairs(spark, sf_dir, {"s_name": changed["s_name"]})
    pairs = pairs.withColumn("d", F.col("d").withField("mail", F.expr("cast(null as string)")))
    d = pairs.where("d is not null").select("pair_id", "d.*").withColumn("mail", changed["mail"])
    joined = pairs.drop("d").join(d.select("pair_id", F.struct("mail").alias("d")), "pair_id")
    return _rule(joined, f.email("segment", "name", "o_custkey", "mail", "@x.org"))


@query(f"{BOTH} SELECT k, CASE k % 4 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'JUSTIFIED' WHEN 2 THEN 'AMBIGUOUS' ELSE 'ANOMALY' END AS verdict, 'R-POSNAME' AS rule {MATCHED}")
def rule_concat(spark, sf_dir):
    k, code = F.col("k"), F.col("k").cast("string")
    label = F.when(k % 4 == 0, F.concat(code, F.lit("-"), F.col("segment"))).when(k % 4 == 1, F.concat(F.lit("00"), code, F.lit("-"), F.col("segment"))).when(k % 4 == 2, F.concat(code, F.lit("-Job"), code)).otherwise("other")
    return _rule(b.known_pairs(spark, sf_dir, {"label": label}), f.labelled("k", "segment", "label", "R-POSNAME", lambda v: F.lit(True)))


@query(f"{BOTH} SELECT k, CASE WHEN k % 5 = 4 THEN 'AMBIGUOUS' WHEN n_regionkey IN (0, 1) THEN CASE WHEN k % 3 = 0 THEN 'ANOMALY' ELSE 'MATCH' END WHEN n_regionkey IN (2, 3) THEN CASE WHEN k % 3 = 0 THEN 'MATCH' ELSE 'ANOMALY' END ELSE 'AMBIGUOUS' END AS verdict, CASE WHEN k % 5 = 4 OR n_regionkey > 3 THEN 'R-SIT.access-UNCOVERED' ELSE 'R-SIT' END AS rule {MATCHED} JOIN nation ON s.reason = n_nationkey")
def rule_situation(spark, sf_dir):
    pairs = b.known_pairs(spark, sf_dir, {"status": F.when(F.col("k") % 3 == 0, "Absent").otherwise("Active")})
    region = b.reasons(spark, sf_dir).select(F.col("key").cast("long").alias("_key"), F.col("access").alias("_access"))
    pairs = pairs.join(region, F.col("s.reason") == F.col("_key")).drop("_key").withColumn("s", F.col("s").withField("access", F.when(F.col("s.k") % 5 == 4, F.lit(9)).otherwise(F.col("_access"))))
    return _rule(lookup.with_reason(pairs, b.reasons(spark, sf_dir), "reason"), f.situation(f.Situation("access", "reason"), "status", "label"))


@query(f"{BOTH} SELECT k, CASE WHEN s.type = 'F' THEN CASE WHEN k % 2 = 0 THEN 'MATCH' ELSE 'ANOMALY' END WHEN s.type = 'O' THEN CASE WHEN k % 3 = 0 THEN 'AMBIGUOUS' WHEN k % 2 = 0 THEN 'MATCH' ELSE 'ANOMALY' END ELSE 'AMBIGUOUS' END AS verdict, CASE WHEN s.type = 'F' THEN 'R-CT' WHEN s.type = 'O' THEN CASE WHEN k % 3 = 0 THEN 'R-CT.perm-UNCOVERED' ELSE 'R-CT' END ELSE 'R-CT.cat-UNCOVERED' END AS rule {MATCHED}")
def rule_contract(spark, sf_dir):
    pairs = b.known_pairs(spark, sf_dir)
    k = F.col("s.k")
    pairs = pairs.withColumn("s", F.col("s").withField("permanent", F.when(k % 3 == 0, "non").otherwise("oui")).withField("full", F.when(k % 5 == 0, "non").otherwise("oui")))
    right = F.when(F.col("s.type") == "F", "FF").otherwise(F.when(k % 5 == 0, "PART").otherwise("FULL"))
    pairs = pairs.where("d is not null").withColumn("d", F.col("d").withField("contract", F.when(k % 2 == 0, right).otherwise("NONE")))
    return _rule(pairs, f.contract("type", "permanent", "full", "contract", {"F": "FF"}, ("O", "FULL", "PART")))


@query(f"{BOTH} SELECT k, CASE WHEN s.type NOT IN ('O', 'F') THEN 'AMBIGUOUS' WHEN (s.type = 'O') = (d.type = 'O') THEN 'MATCH' ELSE 'ANOMALY' END AS verdict, CASE WHEN s.type NOT IN ('O', 'F') THEN 'R-AFF.type-UNCOVERED' ELSE 'R-AFF' END AS rule {MATCHED}")
def rule_flags(spark, sf_dir):
    return _rule(b.known_pairs(spark, sf_dir, {"primary": (F.col("type") == "O")}), f.flag("type", "primary", {"O": True, "F": False}))


def _with_history(spark: SparkSession, sf_dir: str, changed: dict | None = None) -> DataFrame:
    """Pairs whose source unit is the history's, but for every tenth."""
    own = history.summarise(b.history(spark, sf_dir), "position", "effective", "unit", b.REFERENCE, b.ORDER, {"contract": "hours"})
    pairs = history.with_history(b.known_pairs(spark, sf_dir, changed), own, "position")
    return pairs.withColumn("s", F.col("s").withField("unit", F.when(F.col("s.k") % 10 == 0, F.lit(-1)).otherwise(F.col("hist.unit"))))


DATED = HISTORY + f", hist AS (SELECT position, count(*) AS records, max(effective) AS last_date, max(CASE WHEN (rn = 1 OR before IS DISTINCT FROM unit) AND rn <= cur THEN effective END) AS unit_date, max(CASE WHEN rn = cur AND after <> unit THEN next_date - 1 END) AS unit_end, arg_max(hours, rn) AS contract FROM c GROUP BY position), {SRC}, {TGT}"
GUARD = "WHEN records IS NULL OR k % 10 = 0 THEN 'AMBIGUOUS'"


@query(f"{DATED} SELECT k, CASE {GUARD} WHEN d.entry IS NOT DISTINCT FROM greatest(s.entry, unit_date) THEN CASE WHEN d.entry = s.entry THEN 'MATCH' ELSE 'JUSTIFIED' END ELSE 'ANOMALY' END AS verdict, 'R-ASD' AS rule {MATCHED} LEFT JOIN hist ON s.position = hist.position")
def rule_start(spark, sf_dir):
    return _rule(_with_history(spark, sf_dir), f.start_date("entry", "unit", "entry"))


@query(f"{DATED} SELECT k, CASE {GUARD} WHEN d.entry IS NOT DISTINCT FROM least(s.entry, coalesce(unit_end, s.entry)) THEN CASE WHEN d.entry = s.entry THEN 'MATCH' ELSE 'JUSTIFIED' END ELSE 'ANOMALY' END AS verdict, 'R-AED' AS rule {MATCHED} LEFT JOIN hist ON s.position = hist.position")
def rule_end(spark, sf_dir):
    return _rule(_with_history(spark, sf_dir), f.end_date("entry", "unit", "entry"))


@query(f"{DATED} SELECT k, CASE WHEN k % 3 = 0 THEN 'MATCH' WHEN k % 3 = 1 THEN CASE WHEN contract IS NULL THEN 'ANOMALY' ELSE 'AMBIGUOUS' END ELSE 'ANOMALY' END AS verdict, 'R-HRS' AS rule {MATCHED} LEFT JOIN hist ON s.position = hist.position")
def rule_hours(spark, sf_dir):
    pairs = _with_history(spark, sf_dir).where("d is not null")
    pairs = pairs.withColumn("s", F.col("s").withField("norm", F.lit("1000")))
    pairs = pairs.withColumn("d", F.col("d").withField("norm", F.when(F.col("d.k") % 3 == 0, F.lit(1000.0)).when(F.col("d.k") % 3 == 1, F.coalesce(F.col("hist.contract"), F.lit(-5.0))).otherwise(-7.0)))
    return _rule(pairs, f.hours("norm", "norm", "contract"))


@query(f"{BOTH} SELECT k, CASE WHEN s.type = 'F' THEN CASE WHEN d.type = 'F' THEN 'MATCH' ELSE 'ANOMALY' END ELSE 'AMBIGUOUS' END AS verdict, CASE WHEN s.type = 'F' THEN 'R-AFF' ELSE 'R-AFF.type-UNCOVERED' END AS rule {MATCHED}")
def rule_uncovered(spark, sf_dir):
    return _rule(b.known_pairs(spark, sf_dir, {"is_f": F.col("type") == "F"}), f.flag("type", "is_f", {"F": True}))


# Verdicts and reports -----------------------------------------------------------------------------------------------

#: The id of a row of v.
ID = "concat(entity, '/', kind, '/', position, '/', field, '/', k)"
KEEP = ["pair_id", "entity", "kind", "position", "job"]


def _long(spark: SparkSession, sf_dir: str, trace: bool = False) -> DataFrame:
    return verdicts.run_rules(b.known_pairs(spark, sf_dir), b.STAR_RULES, KEEP, trace)


def _signed(spark: SparkSession, sf_dir: str, trace: bool = False) -> DataFrame:
    return with_ids(verdicts.with_defaults(_long(spark, sf_dir, trace)))


@query(f"{BOTH}{LONG} SELECT k AS pair_id, field, verdict, rule, expected, actual FROM v WHERE field <> 'amount'")
def verdict_long(spark, sf_dir):
    return _long(spark, sf_dir).where("field <> 'amount'").select("pair_id", "field", "verdict", "rule", "expected", "actual")


@query(f"{BOTH} SELECT k AS pair_id, concat('[R-DIRECT.exp] Source type → ', s.type, ' | [R-DIRECT.act] Target type → ', d.type, ' | [R-DIRECT.eq] Target equals the expected value? → ', CASE WHEN s.type = d.type THEN 'yes' ELSE 'no' END) AS path {MATCHED}")
def trace_path(spark, sf_dir):
    return _long(spark, sf_dir, True).where("field = 'type'").select("pair_id", "path")


@query(f"{BOTH}{LONG} SELECT coalesce(field, 'TOTAL') AS field, {FOUR} FROM v GROUP BY ROLLUP (field)")
def crosstab_field(spark, sf_dir):
    return report.by_field(_long(spark, sf_dir))


#: All layers: open names are settled (see resolve_ambiguous), one amount has an expert's verdict.
LAYERED = f"""{BOTH}{LONG}, l AS (SELECT k, field, verdict AS rule_verdict, CASE WHEN k = 14 AND field = 'amount' THEN 'EXPERT' WHEN verdict = 'AMBIGUOUS' THEN 'LEARNED' ELSE 'RULE' END AS layer,
 CASE WHEN k = 14 AND field = 'amount' THEN 'JUSTIFIED' WHEN verdict = 'AMBIGUOUS' THEN 'ANOMALY' ELSE verdict END AS verdict FROM v)"""


def _named(spark: SparkSession, sf_dir: str, pair: int, field: str) -> str:
    """The id of a row."""
    return with_ids(b.known_pairs(spark, sf_dir).where(F.col("pair_id") == pair).withColumn("field", F.lit(field))).first()["id"]


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.createDataFrame([(0, "2024-01-02", "amount", "row", "JUSTIFIED", _named(spark, sf_dir, 14, "amount"), None, "seen")], overrides.SCHEMA)
    return reconcile(b.known_pairs(spark, sf_dir), b.STAR_RULES, overrides=said).verdicts


@query(f"{LAYERED} SELECT layer, {FOUR}, count(*) AS total FROM l GROUP BY 1")
def crosstab_layer(spark, sf_dir):
    return report.by_layer(_layered(spark, sf_dir))


@query(f"{LAYERED}, every AS (SELECT unnest(['MATCH', 'JUSTIFIED', 'ANOMALY', 'AMBIGUOUS']) AS rule_verdict), w AS (SELECT every.rule_verdict, l.verdict FROM every LEFT JOIN l USING (rule_verdict)) SELECT rule_verdict, {FOUR} FROM w GROUP BY 1")
def flow_matrix(spark, sf_dir):
    return report.flow(_layered(spark, sf_dir))


@query(f"{BOTH}{LONG} SELECT count(*) AS checks, count(*) FILTER (verdict IN ('ANOMALY', 'AMBIGUOUS')) AS to_investigate, count(*) FILTER (verdict = 'JUSTIFIED') AS justified, count(*) FILTER (verdict = 'MATCH') AS matching, 0 AS learned, 0 AS expert, count(DISTINCT entity) AS entities FROM v")
def kpis(spark, sf_dir):
    return report.kpis(_signed(spark, sf_dir))


@query(f"{BOTH}{SIGNED} SELECT field, signature, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY field) AS share FROM w GROUP BY 1, 2")
def signature_share(spark, sf_dir):
    return verdicts.signature_share(_signed(spark, sf_dir))


@query(f"{BOTH}{SIGNED} SELECT k AS pair_id, field, CASE WHEN signature = '' THEN 1 ELSE count(*) OVER (PARTITION BY field, signature) END AS recurrence FROM w")
def recurrence(spark, sf_dir):
    return verdicts.with_recurrence(_signed(spark, sf_dir)).select("pair_id", "field", "recurrence")


IMPACT = {"amount": (0.9, "Pay"), "name": (0.625, "Identity"), "(assignment)": (1.0, "Missing assignment")}
PRIORITY = "CASE WHEN verdict IN ('ANOMALY', 'AMBIGUOUS') THEN CAST(round_even(100 * CASE field WHEN 'amount' THEN 0.9 WHEN 'name' THEN 0.625 WHEN '(assignment)' THEN 1.0 ELSE 0.5 END, 0) AS INT) ELSE 0 END"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.with_priority(_signed(spark, sf_dir), IMPACT)


@query(f"{BOTH}{LONG} SELECT k AS pair_id, field, {PRIORITY} AS priority FROM v")
def priority(spark, sf_dir):
    return _ranked(spark, sf_dir).select("pair_id", "field", "priority")


@query(f"{BOTH}{LONG} SELECT k AS pair_id, field, verdict FROM (SELECT *, {PRIORITY} AS p, CASE verdict WHEN 'ANOMALY' THEN 0 WHEN 'AMBIGUOUS' THEN 1 WHEN 'JUSTIFIED' THEN 2 ELSE 3 END AS o FROM v) ORDER BY o, p DESC, entity, k, field LIMIT 200")
def top_k(spark, sf_dir):
    return verdicts.in_order(_ranked(spark, sf_dir), tie=("pair_id", "field")).select("pair_id", "field", "verdict").limit(200)


@query(f"{BOTH}{LONG} SELECT k AS pair_id, field, verdict FROM v WHERE verdict = 'ANOMALY' AND (lower(entity) LIKE '%7-199%' OR lower(field) LIKE '%7-199%' OR lower(coalesce(expected, '')) LIKE '%7-199%' OR lower(coalesce(actual, '')) LIKE '%7-199%')")
def browse_filter(spark, sf_dir):
    return report.browse(_signed(spark, sf_dir).drop("id"), ["ANOMALY"], ["RULE"], None, "7-199").select("pair_id", "field", "verdict")


@query(f"{BOTH}{LONG} SELECT * FROM (SELECT 'name case' AS \"case\", k AS pair_id FROM v WHERE field = 'name' AND verdict = 'AMBIGUOUS' ORDER BY {ID} LIMIT 1) UNION ALL SELECT * FROM (SELECT 'wrong amount', k FROM v WHERE field = 'amount' AND verdict = 'ANOMALY' ORDER BY {ID} LIMIT 1) UNION ALL SELECT * FROM (SELECT 'fallback', k FROM v WHERE verdict = 'MATCH' ORDER BY {ID} LIMIT 1)")
def demo_pick(spark, sf_dir):
    v, field = F.col("verdict"), F.col("field")
    cases = {"name case": ((field == "name") & (v == "AMBIGUOUS"), v == "AMBIGUOUS"), "wrong amount": ((field == "amount") & (v == "ANOMALY"), v == "ANOMALY"), "fallback": (F.lit(False), v == "MATCH")}
    return report.demo_picks(_signed(spark, sf_dir), cases).select("case", "pair_id")


@query(f"{BOTH}{LONG} SELECT field, {FOUR} FROM v GROUP BY 1")
def field_bars(spark, sf_dir):
    return report.field_bars(_long(spark, sf_dir))


@query(f"{BOTH} SELECT k AS pair_id, s.amount AS s_amount, d.amount AS d_amount {MATCHED} WHERE k = 7")
def drill_down(spark, sf_dir):
    return report.drill_down(_signed(spark, sf_dir), b.known_pairs(spark, sf_dir), _named(spark, sf_dir, 7, "amount")).select("pair_id", F.col("s.amount").alias("s_amount"), F.col("d.amount").alias("d_amount"))


@query(f"{BOTH} SELECT concat(entity, '/', type, '/', position, '/job/', k) AS id, step, node, answer FROM (SELECT k, s.entity, s.type, s.position, unnest([0, 1, 2]) AS step, unnest(['R-DIRECT.exp', 'R-DIRECT.act', 'R-DIRECT.eq']) AS node, unnest([s.job, d.job, CASE WHEN s.job = d.job THEN 'yes' ELSE 'no' END]) AS answer {MATCHED})")
def path_steps(spark, sf_dir):
    return report.path_steps(_signed(spark, sf_dir, True).where("field = 'job'")).select("id", "step", "node", "answer")


# Overrides ----------------------------------------------------------------------------------------------------------


def _overridden(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    return overrides.apply_overrides(_signed(spark, sf_dir, True), spark.createDataFrame(rows, overrides.SCHEMA)).select("pair_id", "field", "verdict", "layer", "confidence", "explanation")


#: What the rules say of each row.
SAID = """CASE WHEN field = '(assignment)' THEN 'No partner for this record of the source.' WHEN verdict = 'AMBIGUOUS' THEN concat('Only case differs (', expected, ' / ', actual, ').') WHEN verdict = 'ANOMALY' THEN concat('Expected ', coalesce(expected, '∅'), ', found ', coalesce(actual, '∅'), '.')
 WHEN field = 'name' THEN concat('Equal (', coalesce(actual, '∅'), ').') ELSE concat('As expected (', coalesce(actual, '∅'), ').') END"""


def _overridden_sql(hit: str, verdict: str, head: str) -> str:
    changed = lambda new, old: f"CASE WHEN {hit} THEN {new} ELSE {old} END"
    text = f"concat('Expert (2024-01-02, {head}): ', verdict, ' → {verdict}'"
    comment = "' - seen'" if head == "this row" else "''"
    return f"{BOTH}{SIGNED} SELECT k AS pair_id, field, {changed(repr(verdict), 'verdict')} AS verdict, {changed(repr('EXPERT'), repr('RULE'))} AS layer, 1.0 AS confidence, CASE WHEN field <> 'amount' THEN {changed(f'{text}, {comment}, {chr(39)}. Before: {chr(39)}, {SAID})', SAID)} END AS explanation FROM w"


def _without_numbers(df: DataFrame) -> DataFrame:
    """Texts that hold a double are left out: engines write doubles differently."""
    return df.withColumn("explanation", F.when(F.col("field") != "amount", F.col("explanation")))


@query(_overridden_sql("k = 14 AND field = 'type'", "JUSTIFIED", "this row"))
def override_row(spark, sf_dir):
    return _without_numbers(_overridden(spark, sf_dir, [(0, "2024-01-02", "type", "row", "JUSTIFIED", _named(spark, sf_dir, 14, "type"), None, "seen")]))


@query(_overridden_sql("field = 'type' AND signature = 'a → a'", "JUSTIFIED", "pattern a → a of type"))
def override_pattern(spark, sf_dir):
    return _without_numbers(_overridden(spark, sf_dir, [(0, "2024-01-02", "type", "pattern", "JUSTIFIED", None, "a → a", "")]))


@query(f"""{BOTH}{SIGNED}, one AS (SELECT *, concat('Expert (2024-01-02, pattern a → a of type): ', verdict, ' → JUSTIFIED. Before: ', {SAID}) AS first FROM w WHERE field = 'type' AND signature = 'a → a')
 SELECT k AS pair_id, field, 'ANOMALY' AS verdict, 'EXPERT' AS layer, 1.0 AS confidence, CASE WHEN k = 31 THEN concat('Expert (2024-01-03, this row): JUSTIFIED → ANOMALY - no. Before: ', first) ELSE concat('Expert (2024-01-04, pattern a → a of type): JUSTIFIED → ANOMALY. Before: ', first) END AS explanation FROM one""")
def override_fold(spark, sf_dir):
    rows = [(0, "2024-01-02", "type", "pattern", "JUSTIFIED", None, "a → a", ""), (1, "2024-01-03", "type", "row", "ANOMALY", _named(spark, sf_dir, 31, "type"), None, "no"), (2, "2024-01-04", "type", "pattern", "ANOMALY", None, "a → a", "")]
    return _overridden(spark, sf_dir, rows).where("layer = 'EXPERT'")


@query(ORACLE["override_fold"])
def override_stream(spark, sf_dir):
    """The same as two streams: verdicts in two micro-batches, one override a micro-batch and in falling order."""
    rows = [(2, "2024-01-04", "type", "pattern", "ANOMALY", None, "a → a", ""), (1, "2024-01-03", "type", "row", "ANOMALY", _named(spark, sf_dir, 31, "type"), None, "no"), (0, "2024-01-02", "type", "pattern", "JUSTIFIED", None, "a → a", "")]
    folder = new_folder(spark, "override_stream")
    signed = _signed(spark, sf_dir, True).select("pair_id", "id", "field", "signature", "verdict", "layer", "confidence", "explanation", "path")
    signed.write.parquet(f"{folder}/verdicts")
    half = -(-len(spark.read.parquet(f"{folder}/verdicts").inputFiles()) // 2)
    for one in rows:
        spark.createDataFrame([one], overrides.SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/said")
    read = lambda name, schema, files: spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}")
    changes = override_streams.stream_overridden(read("verdicts", signed.schema, half), read("said", overrides.SCHEMA, 1))
    override_streams.write_changes(changes, f"{folder}/changes", f"{folder}/state")
    return override_streams.current(spark.read.parquet(f"{folder}/changes")).where("layer = 'EXPERT'").select("pair_id", "field", "verdict", "layer", "confidence", "explanation")


# Learning -----------------------------------------------------------------------------------------------------------

KINDS = {"s_type": "string", "s_job": "string", "s_segment": "string", "s_entry": "date", "s_amount": "double"}


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = b.known_pairs(spark, sf_dir).where("d is not null")
    own = pairs.select("pair_id", *(F.col(f"s.{c[2:]}").alias(c) for c in KINDS), F.col("d.type").alias("y_type"), n.key(F.col("d.entry"), "date").alias("y_entry"), F.concat(F.lit("ID_"), F.upper("s.job"), F.lit("@x")).alias("y_made"))
    return own.withColumn("y_mixed", F.when(F.col("s_type") == "F", F.col("s_job")).otherwise(F.col("s_segment")))


MADE = f"{BOTH}, f AS (SELECT k, s.type AS s_type, s.job AS s_job, s.segment AS s_segment, strftime(s.entry, '%Y-%m-%d') AS s_entry, d.type AS y_type, strftime(d.entry, '%Y-%m-%d') AS y_entry, CASE WHEN s.type = 'F' THEN s.job ELSE s.segment END AS y_mixed, concat('ID_', upper(s.job), '@x') AS y_made {MATCHED})"
#: The copies of source columns, as rows, with the target ``y``.
COPIES = "leaf AS (SELECT k, y, unnest(['s_type', 's_job', 's_segment', 's_entry']) AS rule, unnest([s_type, s_job, s_segment, s_entry]) AS given FROM g), hit AS (SELECT k, rule, CAST(given IS NOT DISTINCT FROM y AS INT) AS h FROM leaf), total AS (SELECT rule, sum(h) AS hits, count(*) AS n FROM hit GROUP BY 1)"


@query(f"{BOTH} SELECT 'type' AS rule, avg(CAST(s.type IS NOT DISTINCT FROM d.type AS INT)) AS coverage {MATCHED} UNION ALL SELECT 'lower(type)', avg(CAST(lower(s.type) IS NOT DISTINCT FROM d.type AS INT)) {MATCHED} UNION ALL SELECT 'type + type', avg(CAST(concat(s.type, s.type) IS NOT DISTINCT FROM d.type AS INT)) {MATCHED}")
def dsl_coverage(spark, sf_dir):
    rules = {"type": col("s_type"), "lower(type)": call("lower", col("s_type")), "type + type": joined("", col("s_type"), col("s_type"))}
    with search.Search(_features(spark, sf_dir), "y_type", KINDS) as s:
        rates = [h.coverage for h in s.weigh(list(rules.values()))]
    return spark.createDataFrame(list(zip(rules, rates, strict=True)), "rule string, coverage double")


@query(f"{MADE} SELECT avg(CAST((s_segment = 'BUILDING' AND s_segment = y_mixed) OR (s_segment <> 'BUILDING' AND s_job = y_mixed) AS INT)) AS coverage, avg(CAST(s_job = y_mixed AS INT)) AS plain FROM f")
def dsl_conditional(spark, sf_dir):
    with search.Search(_features(spark, sf_dir), "y_mixed", KINDS) as s:
        rates = [h.coverage for h in s.weigh([branch("s_segment", "BUILDING", col("s_segment"), col("s_job")), col("s_job")])]
    return spark.createDataFrame([tuple(rates)], "coverage double, plain double")


@query(f"""{MADE}, m AS (SELECT min(y_made) AS y, count(y_made) AS n FROM f), c AS (SELECT y, n, unnest(range(1, length(y) + 1)) AS i FROM m), e AS (SELECT * FROM c WHERE substr(y, i, 1) IN ('_', '-', '@', '.')),
 p AS (SELECT max(i) AS i FROM e WHERE (SELECT count(*) FROM f WHERE starts_with(y_made, left(e.y, e.i))) = n), z AS (SELECT min(i) AS i FROM e WHERE (SELECT count(*) FROM f WHERE ends_with(y_made, substr(e.y, e.i))) = n)
 SELECT coalesce(left(m.y, p.i), '') AS prefix, coalesce(substr(m.y, z.i), '') AS suffix FROM m, p, z""")
def affix(spark, sf_dir):
    with search.Search(_features(spark, sf_dir), "y_made", KINDS) as s:
        return spark.createDataFrame([s.ends()], "prefix string, suffix string")


@query(f"{BOTH} SELECT avg(CAST(starts_with(concat(s.type, '-', s.job), s.type) AS INT)) AS first, avg(CAST(starts_with(concat(s.type, '-', s.job), s.segment) AS INT)) AS second {MATCHED}")
def prefix_rate(spark, sf_dir):
    made = _features(spark, sf_dir).withColumn("y", F.concat_ws("-", "s_type", "s_job"))
    with search.Search(made, "y", KINDS) as s:
        return spark.createDataFrame([tuple(x / s.rows for x in s.tally([s.begins("_y", r) for r in (col("s_type"), col("s_segment"))]))], "first double, second double")


@query(f"{MADE} SELECT count(DISTINCT s_type) AS few, (SELECT count(DISTINCT y_made) FROM f) AS made FROM f")
def constants(spark, sf_dir):
    found = []
    for y in ("y_type_plain", "y_made"):
        with search.Search(_features(spark, sf_dir).withColumn("y_type_plain", F.col("s_type")), y, KINDS) as s:
            found.append(len(s.constants()))
    return spark.createDataFrame([tuple(found)], "few long, made long")


def _best_sql(target: str) -> str:
    """The best rule of copies, and choices between copies by one value of a column, with its coverage."""
    return f"""(WITH g AS (SELECT *, {target} AS y FROM f), {COPIES},
 cell AS (SELECT k, rule AS c, given AS v FROM leaf WHERE rule <> 's_entry'), inside AS (SELECT c, v, rule, sum(h) AS hin FROM cell JOIN hit USING (k) GROUP BY 1, 2, 3),
 choice AS (SELECT c, v, arg_max(rule, hin) AS a, max(hin) AS ha, arg_max(rule, hits - hin) AS z, max(hits - hin) AS hz, max(n) AS n FROM inside JOIN total USING (rule) GROUP BY 1, 2),
 every AS (SELECT rule, hits / n AS coverage, 1 AS cost FROM total UNION ALL SELECT concat('IF ', c, ' = ''', v, ''' THEN ', a, ' ELSE ', z), (ha + hz) / n, 3 FROM choice WHERE a <> z)
 SELECT '{target}' AS target, rule, coverage, coverage >= 0.8 AS accepted FROM every ORDER BY coverage - 0.02 * cost DESC, cost LIMIT 1)"""


@query(f"{MADE} SELECT * FROM {_best_sql('y_type')} UNION ALL SELECT * FROM {_best_sql('y_entry')} UNION ALL SELECT * FROM {_best_sql('y_mixed')}")
def dsl_learn(spark, sf_dir):
    df, targets = _features(spark, sf_dir), ("y_type", "y_entry", "y_mixed")
    leaves = search.Leaves(df, targets, KINDS)
    out = [(y, str(m := search.learn(df, y, KINDS, leaves=leaves)), m.coverage, m.accepted) for y in targets]
    return spark.createDataFrame(out, "target string, rule string, coverage double, accepted boolean")


@query(f"{MADE}, g AS (SELECT *, y_type AS y FROM f), {COPIES}, fold AS (SELECT k, arg_max(rule, (hits - h) / (n - 1)) AS rule, max((hits - h) / (n - 1)) AS coverage FROM hit JOIN total USING (rule) GROUP BY 1) SELECT rule, count(*) / (SELECT count(*) FROM g) AS share FROM fold WHERE coverage >= 0.8 GROUP BY 1")
def stability(spark, sf_dir):
    return spark.createDataFrame([(r, s) for r, _, s in resolve.stability(_features(spark, sf_dir), "y_type", KINDS)], "rule string, share double")


#: Names: copied on ten of eleven rows, so the copy is learned, and rows that differ in case break it.
SETTLED = f"{BOTH}{LONG}, l AS (SELECT k, field, CASE WHEN verdict = 'AMBIGUOUS' THEN 'LEARNED' ELSE 'RULE' END AS layer, CASE WHEN verdict = 'AMBIGUOUS' THEN 'learned rule broken' ELSE '' END AS method, CASE WHEN verdict = 'AMBIGUOUS' THEN 'ANOMALY' ELSE verdict END AS verdict, CASE WHEN verdict = 'AMBIGUOUS' THEN round((SELECT count(*) FILTER (verdict = 'MATCH') / count(*) FROM v WHERE field = 'name'), 3) ELSE 1 END AS confidence FROM v)"


@query(f"{SETTLED} SELECT field, layer, method, verdict, max(confidence) AS confidence, count(*) AS n FROM l GROUP BY 1, 2, 3, 4")
def resolve_ambiguous(spark, sf_dir):
    result = reconcile(b.known_pairs(spark, sf_dir), b.STAR_RULES)
    return result.verdicts.groupBy("field", "layer", "method", "verdict").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


#: Every outcome of settling, from signatures and a rule given: field t copies the type on most rows, and for the rows it
#: leaves open the copy is right or broken; field m has no reliable rule, so signatures decide.
_OPENED = "SELECT k, 't' AS field, s.type AS given, d.type AS actual, CASE WHEN k % 5 = 0 THEN 'AMBIGUOUS' ELSE 'MATCH' END AS verdict, s.type AS expected {0} UNION ALL SELECT k, 'm', NULL, CASE WHEN k % 3 = 0 THEN 'x1' WHEN k % 97 = 1 THEN '7' ELSE 'yy' END, CASE WHEN k % 2 = 0 THEN 'AMBIGUOUS' ELSE 'MATCH' END, CASE WHEN k % 97 = 1 THEN 'z' ELSE 'abc-1' END {0}"


@query(f"""{BOTH}, o AS ({_OPENED.format(MATCHED)}), g AS (SELECT *, CASE WHEN expected IS NOT DISTINCT FROM actual THEN '=' ELSE concat({SHAPE.format('expected')}, ' → ', {SHAPE.format('actual')}) END AS signature FROM o),
 c AS (SELECT *, count(*) OVER (PARTITION BY field, signature) / count(*) OVER (PARTITION BY field) AS share FROM g),
 r AS (SELECT *, CASE WHEN verdict <> 'AMBIGUOUS' THEN '' WHEN field = 't' AND given IS NOT DISTINCT FROM actual THEN 'learned rule' WHEN signature <> '=' AND share >= 0.5 THEN 'systemic signature' WHEN field = 't' THEN 'learned rule broken' WHEN signature <> '=' THEN 'isolated signature' ELSE '' END AS method FROM c)
 SELECT field, method, CASE method WHEN '' THEN verdict WHEN 'learned rule' THEN 'JUSTIFIED' WHEN 'systemic signature' THEN 'JUSTIFIED' ELSE 'ANOMALY' END AS verdict, max(CASE WHEN verdict <> 'AMBIGUOUS' THEN 1 ELSE CASE method WHEN 'learned rule' THEN 0.9 WHEN 'systemic signature' THEN round(share, 3) WHEN 'learned rule broken' THEN 0.9 WHEN 'isolated signature' THEN round(1 - share, 3) ELSE 0 END END) AS confidence, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def settled_outcomes(spark, sf_dir):
    pairs = b.known_pairs(spark, sf_dir).where("d is not null")
    k, case = F.col("pair_id"), F.when
    row = lambda field, expected, actual, is_open: F.struct(F.lit(field).alias("field"), expected.alias("expected"), actual.alias("actual"), case(is_open, "AMBIGUOUS").otherwise("MATCH").alias("verdict"))
    rows = F.array(row("t", F.col("s.type"), F.col("d.type"), k % 5 == 0), row("m", case(k % 97 == 1, "z").otherwise("abc-1"), case(k % 3 == 0, "x1").when(k % 97 == 1, "7").otherwise("yy"), k % 2 == 0))
    opened = pairs.select("pair_id", F.inline(rows)).withColumns({"signature": n.signature(F.col("expected"), F.col("actual")), "layer": F.lit("RULE"), "confidence": F.lit(1.0), "method": F.lit(""), "explanation": F.lit(""), "path": F.lit("")})
    models = [resolve.FieldModel("t", search.Learned(col("s_type"), 0.9, True, []), 1.0), resolve.FieldModel("m", search.Learned(None, 0.0, False, []), 0.0)]
    features = ft.Features(_features(spark, sf_dir), KINDS, {"t": "y_type"})
    return resolve.settle(opened, features, models).groupBy("field", "method", "verdict").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


@query(f"{BOTH}{LONG} SELECT 'name' AS field, 'src_name' AS rule, count(*) FILTER (verdict = 'MATCH') / count(*) AS coverage, 1.0 AS stability, true AS accepted, concat('= x', count(*) FILTER (verdict = 'MATCH'), '; a#9 → a#9 x', count(*) FILTER (verdict <> 'MATCH')) AS signatures, count(*) FILTER (verdict = 'AMBIGUOUS') AS settled FROM v WHERE field = 'name'")
def learned_summary(spark, sf_dir):
    return spark.createDataFrame(learned_rules(reconcile(b.known_pairs(spark, sf_dir), b.STAR_RULES)), "field string, rule string, coverage double, stability double, accepted boolean, signatures string, settled long")


@query(f"{BOTH}{LONG} SELECT field, 'sum' AS method, count(*) FILTER (k % 5 = 0 AND verdict = 'ANOMALY') / nullif(count(*) FILTER (k % 5 = 0), 0) AS precision, count(*) FILTER (k % 5 = 0 AND verdict = 'ANOMALY') / nullif(count(*) FILTER (verdict = 'ANOMALY'), 0) AS recall FROM v GROUP BY 1")
def prf(spark, sf_dir):
    flagged = _long(spark, sf_dir).select("field", F.lit("sum").alias("method"), (F.col("pair_id") % 5 == 0).alias("flag"), (F.col("verdict") == "ANOMALY").alias("truth"))
    return ev.prf(ev.counts(flagged, ["field", "method"]), ["field", "method"]).select("field", "method", "precision", "recall")


@query(f"{BOTH}{LONG}, t AS (SELECT field, count(*) FILTER (k % 2 = 0 AND verdict = 'ANOMALY') AS tp, count(*) FILTER (k % 2 = 0 AND verdict <> 'ANOMALY') AS fp, count(*) FILTER (k % 2 <> 0 AND verdict = 'ANOMALY') AS fn FROM v GROUP BY 1) SELECT field, 2 * p * r / nullif(p + r, 0) AS even FROM (SELECT field, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM t)")
def f1_pivot(spark, sf_dir):
    flagged = _long(spark, sf_dir).select("field", F.lit("even").alias("method"), (F.col("pair_id") % 2 == 0).alias("flag"), (F.col("verdict") == "ANOMALY").alias("truth"))
    return ev.f1_pivot(ev.counts(flagged, ["field", "method"]), ["even"])


def _injected_sql(target: str, seed: int, per_field: int, eligible: str) -> str:
    """Rows of f made wrong as in evaluate.inject_errors."""
    d = lambda i: drawn_sql("k", seed * 4 + i)
    return f"""picked AS (SELECT k FROM f WHERE {eligible} ORDER BY {d(0)}, k LIMIT {per_field}), given AS (SELECT list({target} ORDER BY o, k) AS donors FROM (SELECT {target}, k, {d(1)} AS o FROM f WHERE {target} IS NOT NULL ORDER BY o, k LIMIT {ev.DONORS * per_field})),
 wrong AS (SELECT f.*, k IN (SELECT k FROM picked) AS injected, [x for x in donors if x <> {target}] AS others FROM f, given),
 spoiled AS (SELECT * REPLACE (CASE WHEN injected THEN others[({d(2)} % len(others)) + 1] ELSE {target} END AS {target}) FROM wrong)"""


@query(f"{MADE}, {_injected_sql('y_type', 1, 50, 'true')} SELECT k AS pair_id, y_type FROM spoiled WHERE injected")
def inject_errors(spark, sf_dir):
    return ev.inject_errors(_features(spark, sf_dir), "y_type", "pair_id", 1, 50, F.lit(True)).where("injected").select("pair_id", "y_type")


@query(f"""{MADE}, {_injected_sql('y_type', 3, 20, 'y_type = s_type')}, c AS (SELECT count(*) FILTER (y_type IS DISTINCT FROM s_type) AS tp, count(*) FILTER (injected) AS injected, avg(CAST(y_type IS NOT DISTINCT FROM s_type AS INT)) AS coverage FROM spoiled)
 SELECT 'type' AS field, method, CASE WHEN method IN ('S1', 'S1b', 'H') THEN 's_type' END AS rule, CASE WHEN method IN ('S1', 'S1b', 'H') THEN coverage END AS coverage, CASE WHEN method <> 'S4' THEN 1.0 END AS agreement, false AS abstained, tp, 0 AS fp, 0 AS fn, injected AS found, injected FROM c, (SELECT unnest(['S1', 'S1b', 'S2', 'S4', 'H']) AS method)""")
def experiment(spark, sf_dir):
    df = ev.inject_errors(_features(spark, sf_dir).withColumn("expected", F.col("s_type")), "y_type", "pair_id", 3, 20, F.col("y_type") == F.col("s_type"))
    kinds = {k: KINDS[k] for k in ("s_type", "s_job", "s_segment")}
    return ev.experiment(df.withColumn("truth", ~F.col("y_type").eqNullSafe(F.col("expected"))), "type", "y_type", kinds, "expected", "truth", "injected")


@query("""WITH r AS (SELECT c_custkey AS k, [c_nationkey, floor(c_acctbal / 1000)] AS x, c_mktsegment AS y FROM customer),
 cells AS (SELECT x, y FROM r GROUP BY ALL), splits AS (SELECT DISTINCT i, x[i] AS edge FROM cells, unnest([1, 2]) AS u(i)),
 tally AS (SELECT i, edge, x[i] <= edge AS low, y, count(*) AS n FROM r, splits GROUP BY ALL),
 without AS (SELECT c.x, c.y AS own, t.i, t.edge, t.low, t.y, t.n - CAST(t.y = c.y AND t.low = (c.x[t.i] <= t.edge) AS INT) AS n FROM cells c, tally t),
 sides AS (SELECT x, own, i, edge, low, CAST(sum(n * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS score FROM without GROUP BY ALL HAVING sum(n) > 0),
 scored AS (SELECT x, own, i, edge, sum(score) AS score FROM sides GROUP BY ALL HAVING count(*) = 2),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY x, own ORDER BY score DESC, i, edge) = 1),
 said AS (SELECT w.x, w.own, w.y FROM without w JOIN best USING (x, own, i, edge) WHERE w.low = (w.x[w.i] <= w.edge) QUALIFY row_number() OVER (PARTITION BY w.x, w.own ORDER BY w.n DESC, w.y) = 1)
 SELECT r.k, said.y AS prediction FROM r JOIN said ON r.x = said.x AND r.y = said.own""")
def tree_leave_one_out(spark, sf_dir):
    """Trees of one split, each grown without the customer whose segment it tells."""
    made = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("double").alias("nation"), F.floor(F.col("c_acctbal") / 1000).cast("double").alias("balance"), F.col("c_mktsegment").alias("y"))
    return trees.predictions(made, "y", {"nation": "double", "balance": "double"}, "k", depth=1)


_TP = "count(*) FILTER (k % 5 = 0 AND verdict = 'ANOMALY')"


@query(f"{BOTH}{LONG}, t AS (SELECT {_TP} / count(*) FILTER (k % 5 = 0) AS precision, {_TP} / count(*) FILTER (verdict = 'ANOMALY') AS recall FROM v WHERE field <> '(assignment)') SELECT 'fives' AS method, unnest(['precision', 'recall', 'f1']) AS measure, unnest([precision, recall, 2 * precision * recall / (precision + recall)]) AS value FROM t")
def measures(spark, sf_dir):
    flagged = _long(spark, sf_dir).where("field <> '(assignment)'").select(F.lit("fives").alias("method"), (F.col("pair_id") % 5 == 0).alias("flag"), (F.col("verdict") == "ANOMALY").alias("truth"))
    return ev.measures_long(ev.prf(ev.counts(flagged, ["method"]), ["method"]))


@query(f"{BOTH}{LONG}, c AS (SELECT field, avg(CAST(verdict = 'MATCH' AS INT)) AS agreement, bool_or(verdict = 'AMBIGUOUS') AS abstained, count(*) FILTER (verdict = 'ANOMALY' AND k % 2 = 0) AS found, count(*) FILTER (verdict = 'ANOMALY') AS injected FROM v GROUP BY 1) SELECT 'rules' AS method, count(*) FILTER (agreement = 1) AS recovered, count(*) FILTER (abstained) AS abstentions, sum(found) / sum(injected) AS rate FROM c")
def recovered_and_detected(spark, sf_dir):
    v, k = F.col("verdict"), F.col("pair_id")
    own = _long(spark, sf_dir).groupBy(F.lit("rules").alias("method"), "field").agg(F.avg((v == "MATCH").cast("int")).alias("agreement"), F.bool_or(v == "AMBIGUOUS").alias("abstained"), F.count_if((v == "ANOMALY") & (k % 2 == 0)).alias("found"), F.count_if(v == "ANOMALY").alias("injected"))
    return ev.recovered(own).join(ev.detection(own).select("method", "rate"), "method")


@query(f"{BOTH}{SIGNED}, c AS (SELECT field, signature, count(*) AS n FROM w WHERE signature <> '' GROUP BY 1, 2), t AS (SELECT *, n / sum(n) OVER (PARTITION BY field) AS share FROM c) SELECT field, max(share) AS top_share, 1 - max(share) AS confidence FROM t WHERE signature <> '=' GROUP BY 1 HAVING max(share) < 0.5")
def signature_judge(spark, sf_dir):
    return resolve.judge(_signed(spark, sf_dir)).where(F.size("systemic") == 0).select("field", "top_share", "confidence")


@query(f"{BOTH}{SIGNED}, c AS (SELECT field, signature, count(*) AS n FROM w WHERE signature <> '' GROUP BY 1, 2) SELECT field, string_agg(concat(signature, ' x', n), '; ' ORDER BY n DESC, signature) AS signatures FROM c GROUP BY 1")
def signatures_by_count(spark, sf_dir):
    return resolve.most_common(_signed(spark, sf_dir))


@query(f"{BOTH} SELECT k AS pair_id, s.type AS src_type, strftime(s.entry, '%Y-%m-%d') AS src_entry, s.k AS src_k, n_name AS reason_code, d.job AS y_job, strftime(d.entry, '%Y-%m-%d') AS y_entry {MATCHED} LEFT JOIN nation ON s.reason = n_nationkey")
def feature_rows(spark, sf_dir):
    made = ft.feature_table(lookup.with_reason(b.known_pairs(spark, sf_dir), b.reasons(spark, sf_dir), "reason"), ["job", "entry"], ("segment",))
    assert "src_segment" not in made.kinds and made.targets == {"job": "y_job", "entry": "y_entry"}
    return made.df.select("pair_id", "src_type", F.date_format("src_entry", "yyyy-MM-dd").alias("src_entry"), F.col("src_k").cast("long").alias("src_k"), "reason_code", "y_job", "y_entry")


SECRET = "0123456789abcdef"
_FAKE = "translate(left(sha256(concat('{secret}/fake/surname/', {0})), 24), '0123456789', 'ghijklmnop')".replace("{secret}", SECRET)
_DAYS = f"CAST(concat('0x', left(sha256(concat('{SECRET}/days/', k)), 8)) AS BIGINT) % {2 * privacy.MOST_DAYS}"
_RUN = f"left(translate(sha256(concat('{SECRET}/digits/', k + 100000)), 'abcdef', '012345'), length(concat('', k + 100000)))"


@query(f"WITH {SRC}, q AS (SELECT *, concat('S', {_FAKE.format('name')}) AS fake, {_DAYS} AS x FROM src) SELECT k, fake AS name, job, entry + CAST(CASE WHEN x < {privacy.MOST_DAYS} THEN x - {privacy.MOST_DAYS} ELSE x - {privacy.MOST_DAYS} + 1 END AS INT) AS entry, concat('call ', fake, ' at ', CASE WHEN {_RUN} <> concat('', k + 100000) THEN {_RUN} ELSE translate(concat('', k + 100000), '0123456789', '1234567890') END) AS note FROM q")
def pseudonymise_check(spark, sf_dir):
    rows = b.source(spark, sf_dir).select("k", "name", "job", "entry", F.concat_ws(" ", F.lit("call"), F.upper("name"), F.lit("at"), (F.col("k") + 100000).cast("string")).alias("note"))
    return privacy.pseudonymise(rows, "k", {"name": "surname"}, ["job", "entry"], ["entry"], "note", SECRET)


# Small parts --------------------------------------------------------------------------------------------------------


@query("SELECT k, strip_accents(t) AS strip_accents, lower(t) AS lower, upper(t) AS upper, left(t, 1) AS first_char, right(t, 3) AS last3, CASE WHEN regexp_full_match(u, '\\d+') THEN lpad(u, CAST(greatest(length(u), 5) AS INT), '0') END AS zpad5 FROM (SELECT o_orderkey AS k, concat(o_orderpriority, ' É', o_orderkey) AS t, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE concat('', o_orderkey) END AS u FROM orders)")
def dsl_functions(spark, sf_dir):
    rows = _orders(spark, sf_dir, "concat(o_orderpriority, ' É', o_orderkey)").join(_orders(spark, sf_dir, "CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE string(o_orderkey) END").withColumnRenamed("t", "u"), "k")
    kinds = {"t": "string", "u": "string"}
    return rows.select("k", *(call(fn, col("u" if fn == "zpad5" else "t")).text(kinds).alias(fn) for fn in ("strip_accents", "lower", "upper", "first_char", "last3", "zpad5")))


@query(f"{BOTH}{LONG} SELECT k AS pair_id, field, {ID} AS id FROM v")
def row_ids(spark, sf_dir):
    return with_ids(_long(spark, sf_dir)).select("pair_id", "field", "id")


@query(f"{BOTH}{LONG} SELECT k AS pair_id, field, {SAID} AS explanation FROM v WHERE field <> 'amount'")
def explanations(spark, sf_dir):
    return _long(spark, sf_dir, True).where("field <> 'amount'").select("pair_id", "field", "explanation")


@query(f"{BOTH} SELECT coalesce(s.k, d.k) AS pair_id, coalesce(s.type, d.type) AS kind, coalesce(s.job, d.job) AS job FROM (SELECT * FROM src WHERE k % 23 <> 0) s FULL JOIN tgt d ON s.k = d.k")
def source_first(spark, sf_dir):
    s, d = b.source(spark, sf_dir).where("k % 23 <> 0"), b.target(spark, sf_dir)
    pairs = s.select(F.col("k").alias("_a"), F.struct("*").alias("s")).join(d.select(F.col("k").alias("_b"), F.struct("*").alias("d")), F.col("_a") == F.col("_b"), "full_outer")
    return verdicts.identity(pairs.select(F.coalesce("_a", "_b").alias("pair_id"), "s", "d"), {"kind": ("type", "type"), "job": ("job", "job")}).select("pair_id", "kind", "job")


@query(f"{BOTH}{LONG} SELECT rule, CASE rule WHEN 'R-DIRECT' THEN '{f.RULES['R-DIRECT']}' WHEN 'R-NOM' THEN '{f.RULES['R-NOM']}' ELSE '{f.RULES['R-MATCH']}' END AS rule_text, count(*) AS rows FROM v GROUP BY 1")
def rule_catalogue(spark, sf_dir):
    return report.catalogue(verdicts.describe_rules(_long(spark, sf_dir)))


@query(f"{BOTH}{LONG} SELECT field, count(*) AS open FROM v WHERE verdict = 'AMBIGUOUS' GROUP BY 1")
def open_rows(spark, sf_dir):
    return _long(spark, sf_dir).where("verdict = 'AMBIGUOUS'").groupBy("field").agg(F.count("*").alias("open"))


@query(f"{BOTH}{LONG} SELECT k AS pair_id, field, {PRIORITY} AS priority FROM v WHERE verdict IN ('ANOMALY', 'AMBIGUOUS') ORDER BY 3 DESC, {ID} LIMIT 50 OFFSET 8")
def investigate_page(spark, sf_dir):
    return report.page(report.to_investigate(_ranked(spark, sf_dir)), [F.desc("priority"), "id"], 50, 8).select("pair_id", "field", "priority")


@query(f"{BOTH}{LONG} SELECT k AS pair_id, rule, verdict, {SAID} AS explanation FROM v WHERE field = '(assignment)'")
def unmatched_rows(spark, sf_dir):
    return _long(spark, sf_dir, True).where("rule = 'R-MATCH'").select("pair_id", "rule", "verdict", "explanation")


@query(f"{BOTH}{LONG} SELECT DISTINCT field, field AS source FROM v WHERE field <> '(assignment)'")
def used_columns(spark, sf_dir):
    return report.used_sources(_long(spark, sf_dir))


@query("SELECT DISTINCT p_brand AS field, source FROM (SELECT p_brand, unnest([p_name, split_part(p_type, ' ', 1), trim('of ' || split_part(p_type, ' ', 2))]) AS source FROM part)")
def used_columns_joined(spark, sf_dir):
    """Sources joined by commas and plus signs, with blanks around them and inside."""
    word = lambda i: F.split_part("p_type", F.lit(" "), F.lit(i))
    made = b.table(spark, sf_dir, "part").select(F.col("p_brand").alias("field"), F.concat(F.col("p_name"), F.lit(" + "), word(1), F.lit(", of "), word(2), F.lit(" ,")).alias("sources"))
    return report.used_sources(made)


@query(f"{BOTH}{LONG} SELECT field IN (SELECT field FROM v WHERE verdict = 'AMBIGUOUS') AS learned, field, count(*) AS n FROM v GROUP BY 1, 2")
def learned_split(spark, sf_dir):
    rows = kept(_long(spark, sf_dir).select("field", "verdict"))  # read three times
    ours, rest = report.learned_and_rest(rows, rows.where("verdict = 'AMBIGUOUS'"))
    return ours.withColumn("learned", F.lit(True)).unionByName(rest.withColumn("learned", F.lit(False))).groupBy("learned", "field").agg(F.count("*").alias("n"))


@query(f"{BOTH}, p AS (SELECT DISTINCT job AS code, type AS label FROM tgt), q AS (SELECT *, count(*) OVER (PARTITION BY code) = 1 AND count(*) OVER (PARTITION BY label) = 1 AS one_to_one FROM p) SELECT k AS pair_id, one_to_one {MATCHED} LEFT JOIN q ON d.job = q.code AND d.type = q.label")
def fd_lookup(spark, sf_dir):
    pairs = b.known_pairs(spark, sf_dir).where("d is not null")
    return lookup.with_dependency(pairs, b.target(spark, sf_dir), "job", "type").select("pair_id", F.col("fd.one_to_one").alias("one_to_one"))


@query(f"{BOTH}{LONG} SELECT k AS pair_id, field, CASE verdict WHEN 'MATCH' THEN 'Match' WHEN 'ANOMALY' THEN 'Anomaly' ELSE 'Open' END AS verdict FROM v")
def verdict_labels(spark, sf_dir):
    return report.labelled(_long(spark, sf_dir)).select("pair_id", "field", "verdict")


@query(f"{BOTH}, q AS (SELECT k, year(CAST(s.entry AS DATE)) AS year, {CASES['amount']} AS amount, {CASES['type']} AS type {MATCHED}), v AS (SELECT year, unnest(['amount', 'type']) AS field, unnest([amount, type]) AS verdict FROM q) SELECT year, field, {FOUR} FROM v GROUP BY 1, 2")
def stream_counts(spark, sf_dir):
    """The rules over a stream of orders; counts per year, as a stream keeps them, read from its table at the end."""
    orders = spark.readStream.schema(b.table(spark, sf_dir, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    rules = [r for r in b.STAR_RULES if r.target in ("amount", "type")]
    rows = streams.stream_verdicts(b.streamed_pairs(orders), rules, ["pair_id", "ts"])
    return streams.finished(streams.windowed_counts(rows, "ts", "1 day"), "verdict_windows").groupBy(F.year("window.start").alias("year"), "field").agg(*(F.sum(v).alias(v) for v in verdicts.RANK))


@query(f"""{ASSIGNED}, pr AS (SELECT concat(coalesce(CAST(s_k AS VARCHAR), 'x'), '-', coalesce(CAST(d_k AS VARCHAR), 'x')) AS pair_id, s_k, d_k FROM assigned), {LONG[2:].replace(MATCHED, "FROM pr JOIN src s ON s.k = s_k JOIN tgt d ON d.k = d_k").replace("SELECT k, s.entity", "SELECT pair_id AS k, s.entity").replace("SELECT k, entity, type, position, '(assignment)', 'ANOMALY', 'R-MATCH', NULL, NULL FROM src WHERE k % 29 = 0", "SELECT pair_id, coalesce(s.entity, d.entity), coalesce(s.type, d.type), coalesce(s.position, d.position), '(assignment)', 'ANOMALY', 'R-MATCH', NULL, NULL FROM pr LEFT JOIN src s ON s.k = s_k LEFT JOIN tgt d ON d.k = d_k WHERE s_k IS NULL OR d_k IS NULL")}
 SELECT k AS pair_id, field, verdict AS rule_verdict, rule, CASE WHEN verdict = 'AMBIGUOUS' THEN 'ANOMALY' ELSE verdict END AS verdict, CASE WHEN verdict = 'AMBIGUOUS' THEN 'LEARNED' ELSE 'RULE' END AS layer FROM v""")
def full_pipeline(spark, sf_dir):
    return report_order(reconcile(b.identified_pairs(spark, sf_dir), b.STAR_RULES)).select("pair_id", "field", "rule_verdict", "rule", "verdict", "layer")
