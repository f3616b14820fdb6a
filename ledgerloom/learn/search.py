"""Search for the rule that maps features to a target field.

``Search`` holds the features as a table of leaves (columns, and functions of columns, as canonical text) with the target
beside them, and a board of hits: on how many rows a rule gives the target's value. Rounds of proposals are weighed
together, many rules in one pass; what a round has found decides what the next one proposes. Only rules and counts are
on the driver. Rules over leaves are SQL text, as thousands of Column objects would take the driver longer than the
counting takes the cluster.

A round has two phases. A sample of the rows, drawn by a hash of their id and about SAMPLE in number, is kept and tried
with every rule; its hits bound the rule's hits on all rows (Chernoff, which holds for draws without replacement; all
bounds of a round together fail with probability RISK at most). Rules that cannot win, be among the RANKS best or win
when a row is left out go; the hits of those that are left are counted over all rows. So thousands of rules read the
sample and a few the table, and coverages are never estimates. A table of up to FULL times SAMPLE rows is its own sample.

The score of a rule is coverage - PENALTY x complexity; it is accepted from ACCEPTED coverage on if it reads the source.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from copy import copy
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, combinations, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keeping import checkpointed, kept
from .dsl import BY_KIND, Kinds, Rule, Sql, branch, call, col, const, date_edge, grounded, joined, wrapped

PENALTY, ACCEPTED, LEAST_BRANCH = 0.02, 0.80, 2
CONSTANTS, BRANCH_VALUES, BRANCH_COMPLEXITY = 12, (2, 6), 3
BEAM, PARTS, PREFIX_RATE, SEPARATORS = 40, 3, 0.5, ("", "-")
EDGE_CHARACTERS = "_-@."
#: Conditions in one pass.
CHUNK = 400
#: Rows of the sample, tables that are tried whole, chance that a bound fails, hypotheses that are told.
SAMPLE, FULL, RISK, RANKS = 20_000, 4, 1e-9, 9
#: Numbers the sample is drawn from.
DRAWS = 1 << 30


def bounds(hits: np.ndarray, tried: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and most hits on all rows, from those on a sample of ``tried`` rows."""
    hits = np.asarray(hits, float)
    if tried >= rows:
        return hits, hits
    share, limit = hits / tried, np.log(2 * max(hits.size, 1) / RISK) / tried

    def far(q: np.ndarray) -> np.ndarray:
        """Whether the share is farther from q than chance may bring it."""
        with np.errstate(divide="ignore", invalid="ignore"):
            part = lambda p, q: np.where(p > 0, p * np.log(p / q), 0.0)
            return part(share, q) + part(1 - share, 1 - q) > limit

    out = []
    for edge in (0.0, 1.0):
        near, beyond = share.copy(), np.full_like(share, edge)
        for _ in range(50):
            middle = (near + beyond) / 2
            away = far(middle)
            near, beyond = np.where(away, near, middle), np.where(away, middle, beyond)
        out.append(beyond)
    return np.maximum(np.floor(out[0] * rows), hits), np.minimum(np.ceil(out[1] * rows), rows - (tried - hits))


class Reach:
    """What a hypothesis has to reach to matter: as much as the best that is surely accepted, or as the RANKS best. The
    margin is what leaving out a row can move."""

    def __init__(self, low: np.ndarray, cost: np.ndarray, reads: np.ndarray, rows: int):
        score, self.rows, self.margin = low / rows - cost, rows, 2 / max(rows - 1, 1) + 1e-12
        sure = reads & (low >= ACCEPTED * rows)
        self.won = score[sure].max() if sure.any() else -np.inf
        self.told = np.sort(score)[-RANKS] if score.size >= RANKS else -np.inf

    def __call__(self, high: np.ndarray, cost: np.ndarray, reads: np.ndarray) -> np.ndarray:
        score = high / self.rows - cost + self.margin
        return (score >= self.told) | reads & (high / self.rows + self.margin >= ACCEPTED) & (score >= self.won)


@dataclass(frozen=True)
class Hypothesis:
    rule: Rule
    hits: int
    rows: int

    @property
    def coverage(self) -> float:
        return self.hits / self.rows

    @property
    def score(self) -> float:
        return self.coverage - PENALTY * self.rule.complexity


@dataclass
class Learned:
    rule: Rule | None
    coverage: float
    accepted: bool
    alternatives: list[Hypothesis]

    def __str__(self) -> str:
        return str(self.rule) if self.rule else "(no hypothesis)"


def leaf_rules(kinds: Kinds) -> Iterator[Rule]:
    for name, kind in kinds.items():
        yield col(name)
        yield from (call(fn, col(name)) for fn in BY_KIND.get(kind, ()))


def date_rules(kinds: Kinds) -> Iterator[Rule]:
    dates = [col(name) for name, kind in kinds.items() if kind == "date"]
    return (date_edge(side, a, b) for (a, b), side in product(combinations(dates, 2), ("min", "max")))


def _numbers(conditions: list[str]) -> str:
    """SQL of the numbers of the conditions that hold on a row."""
    return f"filter(array({', '.join(f'if({c}, {i}, -1)' for i, c in enumerate(conditions))}), x -> x >= 0)"


@dataclass
class Beam:
    """The stems of a level that are in the beam or would be but for a row: conditions, and (hits, cost, number)."""

    conditions: list[str]
    stems: list[tuple[int, float, int]]
    rows: int

    def chosen(self, bits: str | None = None) -> list[int]:
        """Numbers of the stems in the beam; with ``bits``, without a row that has these hits."""
        fewer, rows = (map(int, bits), self.rows - 1) if bits is not None else ([0] * len(self.stems), self.rows)
        ranked = ((b - n, cost, i) for (n, cost, i), b in zip(self.stems, fewer, strict=True) if n - b >= PREFIX_RATE * rows)
        return [i for *_, i in heapq.nsmallest(BEAM, ranked)]

    def loose(self) -> float:
        """Share of rows of the best stem that another one could replace; below 0 if none."""
        near = sorted((n for n, *_ in self.stems), reverse=True)
        if len(near) > BEAM and near[BEAM - 1] - near[BEAM] <= 1:
            return (near[BEAM - 1] + 1) / self.rows
        half = [n for n in near if abs(n - PREFIX_RATE * self.rows) <= 1]
        return max(half) / self.rows if half else -1.0


@dataclass
class Case:
    """A cell with the rules that may be the best inside and outside: (number, rule, hits there)."""

    column: str
    value: str
    where: str
    size: int
    then: list[tuple[int, Rule, int]]
    other: list[tuple[int, Rule, int]]

    def best(self, rows: int) -> Hypothesis | None:
        if min(self.size, rows - self.size) < LEAST_BRANCH:
            return None
        a, b = (max(way, key=lambda x: (x[2] / rows - PENALTY * x[1].complexity, -x[0])) for way in (self.then, self.other))
        return Hypothesis(branch(self.column, self.value, a[1], b[1]), a[2] + b[2], rows) if a[0] != b[0] else None


class Leaves:
    """Features as a table of leaves with the targets beside them, and its sample, for the searches for several targets.
    Columns and targets are kept once by columns, as every round passes through some of them. Leaves and what rules give
    are made once for each combination of the columns that they read (``weighed``), not for each row. The sample is kept
    without the plan that made it until nobody holds it any more."""

    def __init__(self, features: DataFrame, targets: Iterable[str], kinds: Kinds, row: str = "pair_id", sample: int = SAMPLE):
        self.kinds = kinds
        leaves = {rule: f"_l{i}" for i, rule in enumerate(leaf_rules(kinds))}
        self.sql = Sql(leaves)
        self.texts = [r for r in leaves if kinds[r.columns()[0]] in BY_KIND]  # what can be a part of a text
        self.targets = {y: f"_y{i}" for i, y in enumerate(dict.fromkeys(targets))}
        draw = F.pmod(F.xxhash64(f"`{row}`"), F.lit(DRAWS)) if row in features.columns else (F.rand(7) * DRAWS).cast("long")
        own = F.col(f"`{row}`").cast("string") if row in features.columns else F.monotonically_increasing_id().cast("string")
        self.made = {name: (rule.columns()[0], rule) for rule, name in leaves.items()}
        self.base = base = kept(features.select(draw.alias("_draw"), own.alias("_row"), *(F.col(f"`{y}`").alias(name) for y, name in self.targets.items()), *(f"`{c}`" for c in kinds)))
        frame = base.select("_draw", "_row", *self.targets.values(), *(r.text(kinds).alias(name) for r, name in leaves.items()))
        self.rows = self.tried = base.count()
        if self.rows <= FULL * sample:
            self.frame = self.some = checkpointed(frame)
        else:
            self.frame, self.some = frame, checkpointed(frame.where(F.col("_draw") < sample * DRAWS // self.rows))
            self.tried = self.some.count()

    def without(self, row: str) -> Leaves:
        """The same table without a row."""
        out = copy(self)
        out.__dict__.pop("few", None)
        other = F.col("_row") != row
        out.base, out.frame, out.some, out.rows = self.base.where(other), self.frame.where(other), self.some.where(other), self.rows - 1
        out.tried = out.rows if self.tried == self.rows else out.some.count()
        return out

    def weighed(self, target: str, texts: list[str]) -> DataFrame:
        """All rows as the combinations of what ``texts`` (SQL) read: leaves, the target as ``_y``, and rows ``_n``."""
        if self.tried == self.rows:
            return self.frame.select("*", F.col(self.targets[target]).alias("_y"), F.lit(1).cast("long").alias("_n"))
        names = sorted(set(re.findall(r"\b_l\d+\b", " ".join(texts))) & set(self.made))
        columns = sorted({self.made[name][0] for name in names})
        alike = self.base.groupBy(F.col(self.targets[target]).alias("_y"), *(f"`{c}`" for c in columns)).agg(F.count("*").alias("_n"))
        return alike.select("_y", "_n", *(self.made[name][1].text(self.kinds).alias(name) for name in names))

    @cached_property
    def few(self) -> tuple[list[str], dict[tuple[int, str], int]]:
        """Columns with few values, and the rows of each value of theirs."""
        names = list(self.kinds)
        about = self.frame.selectExpr(*(f"approx_count_distinct({self.sql.column(c)})" for c in names)).first()
        few = [c for c, n in zip(names, about, strict=True) if BRANCH_VALUES[0] <= n <= BRANCH_VALUES[1] + 2]
        if not few:
            return [], {}
        rows = self.frame.selectExpr(self.stacked(few)).where("_v is not null").groupBy("_c", "_v").agg(F.count("*").alias("n"))
        return few, {(r["_c"], r["_v"]): r["n"] for r in rows.collect()}  # few columns x few values

    def stacked(self, columns: list[str]) -> str:
        return f"posexplode(array({', '.join(map(self.sql.column, columns))})) as (_c, _v)"


class Search:
    """Use as a context. ``leaves`` can be shared by searches for several targets."""

    def __init__(self, features: DataFrame, target: str, kinds: Kinds, row: str = "pair_id", sample: int = SAMPLE, leaves: Leaves | None = None):
        self.kinds, self.hits = kinds, {}
        self._make = lambda: leaves or Leaves(features, [target], kinds, row, sample)
        self._target = target

    def __enter__(self) -> Search:
        self.leaves = held = self._make()
        self.sql, self.texts, self.rows, self.tried = held.sql, held.texts, held.rows, held.tried
        self.frame, self.some = (df.withColumnRenamed(held.targets[self._target], "_y") for df in (held.frame, held.some))
        self.hangs: list[str] = []  # conditions of rows without which something else would be proposed
        self.beams: list[Beam] = []
        self.simple: list[Hypothesis] = []  # what mattered, in the order it was proposed in
        self.cases: list[Case] = []
        return self

    def without(self, row: str) -> Search:
        return Search(None, self._target, self.kinds, leaves=self.leaves.without(row))

    def __exit__(self, *_) -> None:
        del self.leaves, self.frame, self.some  # if nobody else holds the sample, it goes

    def weighed(self, *texts: str) -> DataFrame:
        return self.leaves.weighed(self._target, list(texts))

    def tally(self, conditions: list[str], some: bool = False) -> list[int]:
        """On how many rows (of all, or of the sample) each condition holds: rows give the numbers of those that hold."""
        out: list[int] = []
        for i in range(0, len(conditions), CHUNK):
            part = conditions[i : i + CHUNK]
            rows = self.some.withColumn("_n", F.lit(1).cast("long")) if some else self.weighed(*part)
            out += self._count(self._alike(part, rows), "_d", len(part))
        return out

    @staticmethod
    def _alike(conditions: list[str], weighed: DataFrame) -> DataFrame:
        """The sets of conditions that hold on a row (their numbers, ``_d``) with their rows (``_n``)."""
        return weighed.selectExpr("_n", f"{_numbers(conditions)} as _d").groupBy("_d").agg(F.sum("_n").alias("_n"))

    @staticmethod
    def _count(weighed: DataFrame, numbers: str, size: int) -> list[int]:
        """The rows of each number, from ``_n`` rows for all ``numbers`` (SQL). Outer, as the optimiser puts a filter for rows
        that have numbers before all grouping otherwise, where every row would test all conditions."""
        counted = weighed.selectExpr("_n", f"explode_outer({numbers}) as _i").groupBy("_i").agg(F.sum("_n").alias("n"))
        found = {r["_i"]: r["n"] for r in counted.collect()}  # one row per number
        return [found.get(i, 0) for i in range(size)]

    def crossed(self, rules: list[str], cells: list[str]) -> np.ndarray:
        """On how many rows each rule fits in each cell (rule x cell), in one pass: a row tests every rule and cell once."""
        size = len(cells)
        of = f"flatten(transform(filter(_d, r -> r < {len(rules)}), r -> transform(filter(_d, c -> c >= {len(rules)}), c -> r * {size} + c - {len(rules)})))"
        return np.array(self._count(self._alike(rules + cells, self.weighed(*rules, *cells)), of, len(rules) * size), np.int64).reshape(len(rules), size)

    def exact(self, which: list[int], tried: np.ndarray, condition: Callable[[int], str]) -> list[int]:
        """The hits on all rows of the conditions ``which``, of which the sample's are known."""
        return [int(tried[i]) for i in which] if self.tried == self.rows else self.tally([condition(i) for i in which])

    def weigh(self, rules: list[Rule]) -> list[Hypothesis]:
        """Counted over all rows."""
        new = [r for r in dict.fromkeys(rules) if r not in self.hits]
        self.hits.update(zip(new, self.tally([self.fits(r) for r in new]), strict=True))
        return [Hypothesis(r, self.hits[r], self.rows) for r in dict.fromkeys(rules)]

    def fits(self, rule: Rule) -> str:
        return f"{rule.compiled(self.sql)} <=> _y"

    def constants(self) -> list[Rule]:
        """The target's values, if they are few."""
        found = {r["_y"]: r["count"] for r in self.frame.groupBy("_y").count().limit(CONSTANTS + 2).collect()}
        if len(found) == CONSTANTS + 1:  # one value less, and all are constants
            self.hangs += [f"_y <=> {self.sql.value(v)}" for v, n in found.items() if n == 1]
        return [const(v) for v in sorted(found, key=lambda v: (v is None, v))] if len(found) <= CONSTANTS else []

    def ends(self) -> tuple[str, str]:
        """The longest beginning and end that all values of the target share, of those that a separator closes: the
        candidates come from one value, and counting tells which of them all values have."""
        value, some = self.frame.selectExpr("min(_y)", "count(_y)").first()
        if some < 2 or not value:
            return "", ""
        cuts = [i for i, c in enumerate(value) if c in EDGE_CHARACTERS]
        begins, closes = [value[: i + 1] for i in reversed(cuts)], [value[i:] for i in cuts]  # longest first
        counts = self.tally([f"startswith(_y, {self.sql.value(x)})" for x in begins] + [f"endswith(_y, {self.sql.value(x)})" for x in closes])
        longest = lambda texts, found: next((x for x, n in zip(texts, found, strict=True) if n == some), "")
        self._hang_ends(some)
        return longest(begins, counts[: len(begins)]), longest(closes, counts[len(begins) :])

    def _hang_ends(self, some: int) -> None:
        """Rows that alone have the least or greatest value (or reversed value), if the others share more of an end."""
        if some == 2:
            self.hangs.append("_y is not null")
            return
        shared = lambda a, b: next((i for i in range(min(len(a), len(b)), 0, -1) if a[:i] == b[:i] and a[i - 1] in EDGE_CHARACTERS), 0)
        for y in ("_y", "reverse(_y)"):
            low, high = self.frame.selectExpr(f"min({y})", f"max({y})").first()
            at = [f"{y} = {self.sql.value(x)}" for x in (low, high)]
            low2, high2, *alone = self.frame.selectExpr(f"min(if({at[0]}, null, {y}))", f"max(if({at[1]}, null, {y}))", *(f"count_if({x})" for x in at)).first()
            for condition, n, (a, b) in zip(at, alone, ((low2, high), (low, high2)), strict=True):
                if n == 1 and a is not None and b is not None and shared(a, b) != shared(low, high):
                    self.hangs.append(condition)

    def begins(self, core: str, rule: Rule) -> str:
        """Whether the text ``core`` begins with what a rule gives (both SQL)."""
        x = rule.compiled(self.sql)
        return f"{x} <> '' and startswith({core}, {x})"

    def chains(self, core: str) -> list[Rule]:
        """Concatenations of up to PARTS leaves that ``core`` often begins with; BEAM of each length. A level is one pass:
        a row looks up the leaves it can go on with once for each place where one of its stems and a separator end."""
        size, n_seps = len(self.texts), len(SEPARATORS)

        def fitting(rule: Callable[[int], Rule], tried: list[int], condition: Callable[[int], str], weight: int) -> list[Rule]:
            low, high = bounds(np.array(tried), self.tried, self.rows)
            least = max(PREFIX_RATE * self.rows, np.sort(low)[-BEAM] if low.size > BEAM else 0)
            which = np.flatnonzero(high >= least - 1).tolist()  # and those that one row keeps out
            beam = Beam([condition(i) for i in which], [(n, weight * rule(i).complexity, i) for i, n in zip(which, self.exact(which, tried, condition), strict=True)], self.rows)
            self.beams.append(beam)
            return [rule(i) for i in beam.chosen()]

        def longer(stems: list[Rule]) -> list[Rule]:
            stem = lambda i: (stems[i // (n_seps * size)], SEPARATORS[i // size % n_seps], self.texts[i % size])

            def rule(i: int) -> Rule:
                first, sep, leaf = stem(i)
                return joined(sep, *(first.parts if (first.op, first.words) == ("concat", (sep,)) else (first,)), leaf)

            def condition(i: int) -> str:
                first, sep, leaf = stem(i)
                return f"startswith({core}, concat({first.compiled(self.sql)}, {self.sql.value(sep)}, {leaf.compiled(self.sql)}))"

            return fitting(rule, self._count(self.some.selectExpr(f"{core} as _core", *arrays(stems)).selectExpr(*ends).selectExpr(*fits).selectExpr("1L as _n", "*"), numbers, len(stems) * n_seps * size), condition, 1)

        def arrays(stems: list[Rule]) -> list[str]:
            return [f"array({', '.join(x)}) as {name}" for name, x in (("_p", [r.compiled(self.sql) for r in stems]), ("_l", [r.compiled(self.sql) for r in self.texts]))]

        seps = f"array({', '.join(map(self.sql.value, SEPARATORS))})"
        ends = ["_core", "_l", f"flatten(transform(_p, (p, i) -> transform({seps}, (s, j) -> if(startswith(_core, concat(p, s)), named_struct('k', i * {n_seps} + j, 'end', length(p) + length(s)), null)))) as _e"]
        found = "filter(transform(_l, (l, m) -> if(startswith(substr(_core, x + 1), l), m, -1)), m -> m >= 0)"
        fits = ["filter(_e, e -> e is not null) as _e", f"map_from_entries(transform(array_distinct(transform(filter(_e, e -> e is not null), e -> e.end)), x -> struct(x, {found}))) as _m"]
        numbers = f"flatten(transform(_e, e -> transform(_m[e.end], m -> e.k * {size} + m)))"
        begun = [self.begins(core, r) for r in self.texts]
        levels = [fitting(self.texts.__getitem__, self.tally(begun, True), begun.__getitem__, 0)]
        while len(levels) < PARTS and levels[-1]:
            levels.append(longer(levels[-1]))
        return list(chain.from_iterable(levels[1:]))

    def pool(self) -> list[Rule]:
        """All rules without conditions, in the order that decides between equal ones."""
        rules = [*leaf_rules(self.kinds), *date_rules(self.kinds), *self.constants(), *self.chains("_y")]
        prefix, suffix = self.ends()
        if prefix or suffix:
            edge = len(prefix) + len(suffix)
            fits = f"startswith(_y, {self.sql.value(prefix)}) and endswith(_y, {self.sql.value(suffix)}) and length(_y) >= {edge}"
            core = f"if({fits}, substr(_y, {len(prefix) + 1}, length(_y) - {edge}), null)"
            rules += [wrapped(prefix, r, suffix) for r in self.texts + self.chains(core)]
        return rules

    def cells(self, rules: list[Rule]) -> tuple[list[tuple[str, str]], np.ndarray, np.ndarray]:
        """The (column, value) cells of columns with few values, their rows, and the hits of each rule inside each cell of
        the sample."""
        few, sizes = self.leaves.few
        if not few or not rules:
            return [], np.zeros(0, np.int64), np.zeros((len(rules), 0), np.int64)
        stacked = self.leaves.stacked(few)
        values = np.bincount([c for c, _ in sizes], minlength=len(few))
        own = sorted(cell for cell in sizes if BRANCH_VALUES[0] <= values[cell[0]] <= BRANCH_VALUES[1])
        inside, number = np.zeros((len(rules), len(own)), np.int64), {cell: k for k, cell in enumerate(own)}
        for first in range(0, len(rules), CHUNK):
            part = [self.fits(r) for r in rules[first : first + CHUNK]]
            hits = self.some.selectExpr(f"{_numbers(part)} as _h", stacked).where("_v is not null").selectExpr("_c", "_v", "explode(_h) as _i")
            for r in hits.groupBy("_c", "_v", "_i").agg(F.count("*").alias("n")).collect():  # few columns x few values x rules
                if (cell := (r["_c"], r["_v"])) in number:
                    inside[first + r["_i"], number[cell]] = r["n"]
        return [(few[c], v) for c, v in own], np.array([sizes[cell] for cell in own], np.int64), inside

    def branches(self, rules: list[Rule], tried: np.ndarray, reach: Reach) -> list[Hypothesis]:
        """For each cell that can matter the best rule inside and the best outside; outside is everywhere less inside."""
        cells, sizes, inside = self.cells(rules)
        cost = np.array([PENALTY * r.complexity for r in rules])
        enough = (sizes >= LEAST_BRANCH) & (self.rows - sizes >= LEAST_BRANCH)
        asked: list[tuple[int, list[int], list[int]]] = []
        for k in np.flatnonzero(enough).tolist():
            ways, most, best = [], 0.0, -PENALTY
            for hits, size in ((inside[:, k], sizes[k]), (tried - inside[:, k], self.rows - sizes[k])):
                low, high = bounds(hits, self.tried, self.rows)
                high = np.minimum(high, size)
                ways.append(np.flatnonzero((high + 2) / self.rows - cost >= (np.minimum(low, size) / self.rows - cost).max()).tolist())  # a row may decide
                most, best = most + high.max(), best + (high / self.rows - cost).max()
            if reach(np.array([most]), np.array([most / self.rows - best]), np.array([True]))[0]:
                asked.append((k, *ways))
        at = lambda k: f"{self.sql.column(cells[k][0])} <=> {self.sql.value(cells[k][1])}"
        total = tried
        if asked and self.tried < self.rows:
            which = sorted({i for _, *ways in asked for way in ways for i in way})
            counted = self.crossed([self.fits(rules[i]) for i in which], ["true", *(at(k) for k, *_ in asked)])
            total, inside = np.zeros_like(tried), np.zeros_like(inside)
            total[which], inside[np.ix_(which, [k for k, *_ in asked])] = counted[:, 0], counted[:, 1:]
        of = lambda way, hits: [(i, rules[i], int(hits[i])) for i in way]
        self.cases = [Case(*cells[k], at(k), int(sizes[k]), of(then, inside[:, k]), of(other, total - inside[:, k])) for k, then, other in asked]
        values = Counter(c for c, _ in self.leaves.few[1])
        for (c, v), n in self.leaves.few[1].items():  # values that a row takes with it, or brings near enough
            where = f"{self.sql.column(self.leaves.few[0][c])} <=> {self.sql.value(v)}"
            if n == 1 and values[c] in (BRANCH_VALUES[0], BRANCH_VALUES[1] + 1) or n == LEAST_BRANCH and values[c] <= BRANCH_VALUES[1]:
                self.hangs.append(where)
            if self.rows - n == LEAST_BRANCH and values[c] <= BRANCH_VALUES[1]:
                self.hangs.append(f"not ({where})")
        return [h for case in self.cases if (h := case.best(self.rows))]

    def hypotheses(self, conditions: bool = True) -> list[Hypothesis]:
        """The hypotheses that matter (see ``Reach``), best first; equal ones in the order they were proposed in."""
        if not self.rows:
            return []
        rules = list(dict.fromkeys(self.pool()))
        tried = np.array(self.tally([self.fits(r) for r in rules], True), np.int64)
        cost, reads = np.array([PENALTY * r.complexity for r in rules]), np.array([grounded(r) for r in rules])
        low, high = bounds(tried, self.tried, self.rows)
        which = np.flatnonzero(Reach(low, cost, reads, self.rows)(high, cost, reads)).tolist()
        hits = self.exact(which, tried, lambda i: self.fits(rules[i]))
        found = [Hypothesis(rules[i], n, self.rows) for i, n in zip(which, hits, strict=True)]
        self.simple = list(found)
        if conditions:
            short = [i for i, r in enumerate(rules) if r.complexity <= BRANCH_COMPLEXITY]
            found += self.branches([rules[i] for i in short], tried[short], Reach(np.array(hits, float), cost[which], reads[which], self.rows))
        return sorted(found, key=lambda h: (-h.score, h.rule.complexity))

    def bits(self, conditions: list[str]) -> str:
        """SQL of a text of 1 or 0 for each condition."""
        return "concat('', " + ", ".join(f"if({c}, '1', '0')" for c in conditions) + ")" if conditions else "''"


def chosen(found: list[Hypothesis]) -> Learned:
    """The best hypothesis that covers enough and reads the source, else the best, not accepted."""
    if not found:
        return Learned(None, 0.0, False, [])
    best = next((h for h in found if h.coverage >= ACCEPTED and grounded(h.rule)), None)
    top = best or found[0]
    return Learned(top.rule, top.coverage, best is not None, [h for h in found if h is not top][:8])


def learn(features: DataFrame, target: str, kinds: Kinds, conditions: bool = True, leaves: Leaves | None = None) -> Learned:
    """``target`` is a column of canonical text. ``leaves`` can be shared by several targets of the same features."""
    with Search(features, target, kinds, leaves=leaves) as search:
        return chosen(search.hypotheses(conditions))
