"""Secret scans by a trigram inverted index. DataFrame functions only on the main path.

A rule is a regular expression (syntax common to Python and Java) whose matches, leftmost and non-overlapping, are
spans; matches whose checked group is shorter than ``least`` are dropped after they are found.

Query: from each expression ``trigram_query`` derives what every matching text must contain: a set of clauses, each a
set of trigrams that occur together (in lower case, so one index serves rules of either case). An expression without
mandatory trigrams has the one empty clause.

Index: texts are keyed by a hash of id and text and dealt to blocks of about BLOCK keys; ``build_index`` lists for every
block and trigram the keys that have it, a posting. With ``only`` it lists just the trigrams that the rules ask for,
which is what a single scan needs; without, the index serves any later rule.

Scan: in each block the postings of a clause are intersected and those of its alternatives united; what is left are the
candidates of a rule. A text is searched for a rule only if it is a candidate, or the rule has the empty clause. Two
texts of one key can only make a candidate too many, never a match too few.

Cases: null text counts as empty and has no spans; null ids stay; repeated rows give repeated results; rules that match
in one place all give their span, ordered by start and then by the order of the rules; an empty table gives an empty
result; other columns are ignored. Positions are code points. A text of many matches costs about its length: sums of
lengths run in two levels, and no list is copied once a match.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, keyed

#: Keys a block of the index is meant to hold; candidates up to which they are broadcast (some 10 MB).
BLOCK, BROADCAST_KEYS = 4096, 200_000
#: Strings, clauses and characters of a class up to which the analysis of an expression keeps alternatives apart.
STRINGS, CLAUSES, LETTERS = 32, 64, 8
#: Matches whose lengths are summed at once.
STEP = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters that the group must have
    group: int = 0


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),  # a run of one pattern: what is shorter than 18 cannot hide a longer match
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=-]+)", 20, 1),
)

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _least(clauses: Iterable[frozenset[str]]) -> Query:
    """Without clauses that another one implies."""
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def either(a: Query, b: Query) -> Query:
    out = _least(a | b)
    return out if len(out) <= CLAUSES else ANY


def both(a: Query, b: Query) -> Query:
    out = _least(x | y for x in a for y in b)
    return out if len(out) <= CLAUSES else max(a, b, key=lambda q: min(map(len, q)))


def holding(strings: Iterable[str]) -> Query:
    """Texts that have one of the strings."""
    return _least(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


@dataclass(frozen=True)
class Part:
    """What is known of the texts an expression matches: all of them (``exact``), or how they begin and end and what
    they need to hold."""

    exact: frozenset[str] | None = None
    starts: frozenset[str] = frozenset([""])
    ends: frozenset[str] = frozenset([""])
    need: Query = ANY

    def open(self) -> Part:
        if self.exact is None:
            return self
        return Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), holding(self.exact))


UNKNOWN, NOTHING = Part(), Part(frozenset([""]))


def _few(strings: frozenset[str]) -> frozenset[str]:
    return strings if len(strings) <= STRINGS else frozenset([""])


def follow(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= STRINGS:
        return Part(frozenset(x + y for x in a.exact for y in b.exact))
    first, last = a.open(), b.open()
    need = both(both(first.need, last.need), holding(_few(frozenset(x + y for x in first.ends for y in last.starts))))
    starts = first.starts if a.exact is None else _few(frozenset((x + y)[:2] for x in a.exact for y in last.starts))
    ends = last.ends if b.exact is None else _few(frozenset((x + y)[-2:] for x in first.ends for y in b.exact))
    return Part(None, starts, ends, need)


def choice(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= STRINGS:
        return Part(a.exact | b.exact)
    a, b = a.open(), b.open()
    return Part(None, _few(a.starts | b.starts), _few(a.ends | b.ends), either(a.need, b.need))


def _literal(code: int) -> Part:
    """Characters beyond ASCII are left open: engines fold them differently."""
    return Part(frozenset([chr(code).lower()])) if code < 128 else UNKNOWN


def _class(items: list) -> Part:
    letters: set[str] = set()
    for kind, value in items:
        codes = [value] if kind is op.LITERAL else range(value[0], value[1] + 1) if kind is op.RANGE else [128]
        if len(codes) > 128 or max(codes) >= 128:
            return UNKNOWN
        letters |= {chr(c).lower() for c in codes}
    return Part(frozenset(letters)) if len(letters) <= LETTERS else UNKNOWN


def _part(item: tuple) -> Part:
    kind, value = item
    if kind is op.LITERAL:
        return _literal(value)
    if kind is op.IN:
        return _class(value)
    if kind is op.BRANCH:
        return reduce(choice, map(_sequence, value[1]))
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value[0], value[1], _sequence(value[2])
        if (least, most) == (0, 1):
            return choice(NOTHING, inner)
        many = reduce(follow, [inner] * min(least, 8), NOTHING)
        return many if least == most <= 8 else follow(follow(many, UNKNOWN), inner) if least else UNKNOWN
    if kind is op.ATOMIC_GROUP:
        return _sequence(value)
    return NOTHING if kind in (op.AT, op.ASSERT, op.ASSERT_NOT) else UNKNOWN


def _sequence(items: Iterable[tuple]) -> Part:
    return reduce(follow, map(_part, items), NOTHING)


def trigram_query(pattern: str) -> Query:
    return _sequence(_parser.parse(pattern)).open().need


def trigrams(text: Column, only: Iterable[str] | None = None) -> Column:
    """The distinct trigrams of the text in lower case; a look-ahead finds those that overlap, too."""
    wanted = sorted(set(only)) if only is not None else None
    if wanted == []:
        return F.array().cast("array<string>")
    if wanted is None:
        pattern = "(?s)(?=(...))"
    else:
        tails: dict[str, list[str]] = {}
        for t in wanted:
            tails.setdefault(t[0], []).append(_quoted(t[1:]))
        pattern = "(?=(" + "|".join(f"{_quoted(c)}(?:{'|'.join(rest)})" for c, rest in tails.items()) + "))"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))


def _quoted(s: str) -> str:
    return "".join(c if c in string.ascii_letters + string.digits else f"\\x{ord(c):02x}" for c in s)


def build_index(docs: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """(block, trigram, keys) of a table with _key and text."""
    blocks = max(1, docs.count() // BLOCK)
    found = docs.select("_key", F.explode(trigrams(F.col("text"), only)).alias("trigram"))
    return found.groupBy(F.pmod(F.hash("_key"), F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("_key").alias("keys"))


def _answer(query: Query) -> Callable[[Column], Column]:
    """The keys that fulfil the query, from a block's map of postings."""

    def keys(postings: Column) -> Column:
        posting = lambda t: F.coalesce(postings[t], F.array().cast("array<bigint>"))
        clauses = [reduce(F.array_intersect, [posting(t) for t in sorted(c)]) for c in sorted(query, key=sorted)]
        return reduce(F.array_union, clauses)

    return keys


def candidates(index: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(_key, _rules): for each text the rules, by number, that it may match; rules with the empty clause are left out."""
    asked = [(i, q) for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ANY]
    wanted = sorted({t for _, q in asked for c in q for t in c})
    blocks = index.where(F.col("trigram").isin(wanted)).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("postings"))
    answers = F.array(*(F.struct(F.lit(i).alias("rule"), _answer(q)(F.col("postings")).alias("keys")) for i, q in asked))
    found = blocks.select(F.inline(answers)).select("rule", F.explode("keys").alias("_key"))
    return found.groupBy("_key").agg(F.collect_set("rule").alias("_rules"))


def _named(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running_sums(numbers: Column) -> Column:
    """The sums of the first 1, 2, ... numbers of a non-empty array of integers."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / STEP).cast("int")), lambda c: F.slice(numbers, c * STEP + 1, F.lit(STEP)))
    within = lambda part, base: F.transform(part, lambda _, i: base + _sum(F.slice(part, F.lit(1), i + 1)))
    return _named(parts, lambda p: _named(F.transform(p, _sum), lambda sums: F.flatten(F.transform(p, lambda part, i: within(part, _sum(F.slice(sums, F.lit(1), i)))))))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, stop). Where a match lies follows from the lengths of the matches and of what is between
    them."""
    pattern = F.lit(rule.pattern)
    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("checked"), F.split(text, rule.pattern, -1).alias("between"))
    none = F.array().cast("array<struct<start:int,order:int,stop:int>>")

    def placed(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["between"], F.lit(1), F.size(x["hits"])), x["hits"], lambda a, b: F.length(a) + F.length(b))
        zipped = F.arrays_zip(running_sums(steps).alias("stop"), x["hits"].alias("hit"), x["checked"].alias("checked"))
        held = F.filter(zipped, lambda z: F.length(z["checked"]) >= rule.least)
        return F.transform(held, lambda z: F.struct((z["stop"] - F.length(z["hit"])).alias("start"), F.lit(order).alias("order"), z["stop"].alias("stop")))

    return _named(found, lambda x: F.when(F.size(x["hits"]) > 0, placed(x)).otherwise(none))


def scan(df: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text", index: DataFrame | None = None) -> DataFrame:
    """doc_id and ``spans``: array of (start, kind, stop), by start and then by the order of the rules. An ``index``
    built before has to be one of the same rows."""
    docs = keyed(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_key", F.xxhash64("doc_id", "text"))
    queries = [trigram_query(r.pattern) for r in rules]
    if index is None:
        index = build_index(docs, {t for q in queries for c in q for t in c})
    found = docs
    if any(q != ANY for q in queries):
        may = checkpointed(candidates(index, rules))
        found = docs.join(F.broadcast(may) if may.count() <= BROADCAST_KEYS else may, "_key", "left")
    none = F.array().cast("array<struct<start:int,order:int,stop:int>>")
    text = F.col("text")
    hits = [spans(text, r, i) if q == ANY else F.when(F.array_contains("_rules", i), spans(text, r, i)).otherwise(none) for i, (r, q) in enumerate(zip(rules, queries))]
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    ordered = F.sort_array(F.concat(*hits))
    return found.select("doc_id", F.transform(ordered, lambda z: F.struct(z["start"].alias("start"), F.get(kinds, z["order"]).alias("kind"), z["stop"].alias("stop"))).alias("spans"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda z: F.concat_ws(":", z["kind"], z["start"].cast("string"), z["stop"].cast("string"))), ",")


def digests(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts of the base rules, a hash of their spans, and all spans."""
    kinds = [r.kind for r in base]
    of = lambda *wanted: F.filter("spans", lambda z: z["kind"].isin(*wanted))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    own = of(*kinds)
    return found.select("doc_id", *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
