"""Decision trees over a pair of records, compiled to Column expressions.

``Let`` binds a value, ``Ask`` branches on an answer, ``End`` gives a verdict. A tree is compiled in two steps: every
bound value becomes a column of its own (values of one depth in one projection, so that what they share is computed
once), then the tree becomes one CASE expression for the number of the ending. Verdict, rule and texts are looked up by
that number.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import NOTHING, shown

MATCH, JUSTIFIED, ANOMALY, AMBIGUOUS = VERDICTS = ("MATCH", "JUSTIFIED", "ANOMALY", "AMBIGUOUS")
#: The variables that rows show as columns.
PLAIN = ("expected", "actual", "raw")
Vars = dict[str, Column]


@dataclass(frozen=True)
class End:
    verdict: str
    rule: str
    text: str


@dataclass(frozen=True)
class Let:
    """``value`` gives the Column, from the columns of the pair and the variables bound above."""

    node: str
    label: str
    name: str
    value: Callable[[Vars], Column]
    then: Tree
    kind: str = "string"


@dataclass(frozen=True)
class Ask:
    """Branches by answer; an answer without a branch (null too) ends in AMBIGUOUS, rule <node>-UNCOVERED."""

    node: str
    question: str
    answer: Callable[[Vars], Column]
    branches: dict = field(default_factory=dict)
    kind: str = "boolean"


Tree = End | Let | Ask


def describe(tree: Tree, indent: int = 0) -> str:
    pad = "  " * indent
    if isinstance(tree, End):
        return f"{pad}=> {tree.verdict} ({tree.rule}) {tree.text}".rstrip()
    if isinstance(tree, Let):
        return f"{pad}[{tree.node}] {tree.name} := {tree.label}\n{describe(tree.then, indent)}"
    lines = [f"{pad}[{tree.node}] {tree.question}"]
    for answer, branch in tree.branches.items():
        lines.append(f"{pad}- {_word(answer)}:\n{describe(branch, indent + 1)}")
    return "\n".join([*lines, f"{pad}- otherwise:\n{pad}  => {AMBIGUOUS} ({tree.node}-UNCOVERED)"])


def _word(answer: object) -> str:
    return {True: "yes", False: "no"}.get(answer, str(answer)) if isinstance(answer, bool) else str(answer)


def _filled(text: str, seen: dict[str, int]) -> list[str | int]:
    """The template's {names} as numbers of shown values; unknown names stay as they are."""
    parts = [p for p in re.split(r"(\{\w+\})", text) if p]
    return [seen[p[1:-1]] if p[0] == "{" and p[1:-1] in seen else p for p in parts]


@dataclass
class Ending:
    """How a row can end: its verdict and rule, its texts as parts (a text, or the number of a shown value), and which
    values are the expected, actual and raw one."""

    verdict: str
    rule: str
    text: list[str | int]
    path: list[str | int]
    plain: dict[str, int]


@dataclass
class Compiled:
    """Columns to add, depth by depth, the number of the ending over them, the endings and the shown values."""

    stages: list[dict[str, Column]]
    number: Column
    endings: list[Ending]
    values: list[Column]


def compile_tree(tree: Tree, prefix: str, first: int = 0) -> Compiled:
    """Endings are numbered from ``first`` on."""
    stages: list[dict[str, Column]] = []
    endings: list[Ending] = []
    values: list[Column] = []
    count = 0

    def kept(depth: int, value: Column, kind: str) -> tuple[Column, int]:
        nonlocal count
        name = f"{prefix}_{count}"
        count += 1
        while len(stages) <= depth:
            stages.append({})
        stages[depth][name] = value
        values.append(shown(F.col(name), kind))
        return F.col(name), len(values) - 1

    def walk(node: Tree, depth: int, bound: Vars, seen: dict[str, int], steps: list[str | int]) -> Column:
        between = [" | "] if steps else []
        if isinstance(node, Let):
            column, at = kept(depth, node.value(bound), node.kind)
            return walk(node.then, depth + 1, bound | {node.name: column}, seen | {node.name: at}, [*steps, *between, f"[{node.node}] {node.label} → ", at])
        if isinstance(node, Ask):
            answer, at = kept(depth, node.answer(bound), node.kind)
            here = [*steps, *between, f"[{node.node}] {node.question} → ", at]
            out = None
            for value, branch in node.branches.items():
                result = walk(branch, depth + 1, bound, seen, here)
                out = F.when(answer == F.lit(value), result) if out is None else out.when(answer == F.lit(value), result)
            last = ended(AMBIGUOUS, f"{node.node}-UNCOVERED", ["No branch covers this answer."], seen, here)
            return last if out is None else out.otherwise(last)
        return ended(node.verdict, node.rule, _filled(node.text, seen), seen, steps)

    def ended(verdict: str, rule: str, text: list[str | int], seen: dict[str, int], steps: list[str | int]) -> Column:
        endings.append(Ending(verdict, rule, text, steps, {k: seen[k] for k in PLAIN if k in seen}))
        return F.lit(first + len(endings) - 1)

    number = walk(tree, 0, {}, {}, [])
    return Compiled(stages, number, endings, values)


def _looked_up(number: Column, texts: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), number + 1)


def _written(number: Column, templates: list[list[str | int]], values: Column) -> Column:
    """The template of an ending with the row's values. Templates are data, so the code stays small however many endings
    a catalogue has."""
    part = lambda x: F.struct(F.lit(-1 if isinstance(x, str) else x).alias("at"), F.lit(x if isinstance(x, str) else "").alias("text"))
    parts = F.element_at(F.array(*(F.array(*map(part, t or [""])) for t in templates)), number + 1)
    return F.array_join(F.transform(parts, lambda x: F.when(x["at"] < 0, x["text"]).otherwise(F.get(values, x["at"]))), "")


def evaluate(pairs: DataFrame, rules: list, keep: list[str], trace: bool = True) -> DataFrame:
    """One row per pair and rule: the columns ``keep``, then field, sources, verdict, rule, expected, actual, raw (and
    explanation, path). ``rules`` have target, sources and tree.

    A pair gives, for each rule, the number of its ending and the shown values; all else follows from these after the
    pair has become rows, so columns that nobody reads are never made, and no text is code."""
    compiled: list[Compiled] = []
    for i, r in enumerate(rules):
        compiled.append(compile_tree(r.tree, f"_r{i}", sum(len(c.endings) for c in compiled)))
    for depth in range(max((len(c.stages) for c in compiled), default=0)):
        pairs = pairs.withColumns({k: v for c in compiled if depth < len(c.stages) for k, v in c.stages[depth].items()})
    rows = F.array(*(F.struct(F.lit(i).alias("field_order"), c.number.alias("_ending"), F.array(*c.values).cast("array<string>").alias("_values")) for i, c in enumerate(compiled)))
    out = pairs.select(*keep, F.inline(rows))
    endings = [e for c in compiled for e in c.endings]
    number, values, order = F.col("_ending"), F.col("_values"), F.col("field_order")
    at = lambda name: F.nullif(F.get(values, F.element_at(F.array(*(F.lit(e.plain.get(name, -1)) for e in endings)), number + 1)), F.lit(NOTHING))
    columns = [_looked_up(order, [r.target for r in rules]).alias("field"), _looked_up(order, [r.sources for r in rules]).alias("sources"), _looked_up(number, [e.verdict for e in endings]).alias("verdict"), _looked_up(number, [e.rule for e in endings]).alias("rule"), *(at(name).alias(name) for name in PLAIN)]
    if trace:
        columns += [_written(number, [e.text for e in endings], values).alias("explanation"), _written(number, [e.path for e in endings], values).alias("path")]
    return out.select(*keep, "field_order", *columns)
