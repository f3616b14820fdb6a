"""Decision trees that judge each row without it (leave one out), grown for all rows at once.

A tree grown without a row differs from the others only by one in the counts along the way of that row. So no tree is
grown for a row: for the nodes that rows can reach, the cluster counts labels by input and bin over all rows, and the
row's own label is taken off before a split is chosen. Where the row lies decides on which side of a split it is taken
off, so a split has two scores for each label; only splits whose better score reaches the greatest worse score can win,
and among these each row picks its own. Mostly one is left; rows on whose presence a split hangs go another way, to
nodes of their own. The result equals growing the tree anew without each row.

Split: the greatest ``sum(left²)/n(left) + sum(right²)/n(right)`` over label counts (the least Gini impurity) in double
arithmetic; ties go to the first input, then the lowest bin. A leaf is pure, ``depth`` deep or has no split with rows on
both sides; it predicts its most frequent label, in a tie the least (null is a label, the last). Inputs and bins come
from all rows: a yes/no input for each word of text columns of at most ``one_hot`` words; other columns as numbers (dates
as days, null and NaN as -1), each value a bin or, beyond ``bins`` values, at quantiles.

The driver holds counts of the nodes reached (labels x inputs x bins each) and the splits that can win. Rows are read as
distinct (bins, label) with their number; tasks count sparse, by batch. Cases: no prediction for the only row of a table;
without inputs all trees are leaves; targets of more than ``classes`` labels and empty tables give None.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..keeping import checkpointed
from .dsl import Kinds

#: Rows that a task judges at a time.
SLICE = 4096


@dataclass
class Choice:
    """What a node says to rows of one label: a leaf's label (-1: none), or the splits that can win, in order of ties."""

    leaf: int
    inputs: np.ndarray | None = None
    bins: np.ndarray | None = None
    on_left: np.ndarray | None = None
    on_right: np.ndarray | None = None


@dataclass
class Node:
    """``conditions``: (input, bin, whether the row is at or below it); ``children`` by the last of these."""

    conditions: tuple[tuple[int, int, bool], ...] = ()
    choices: dict[int, Choice] = field(default_factory=dict)
    children: dict[tuple[int, int, bool], int] = field(default_factory=dict)


@dataclass
class Encoded:
    """Rows with ``_x`` (the bin of each input) and ``_label`` (its place in ``labels``)."""

    df: DataFrame
    labels: list[str | None]
    names: list[str]
    sizes: list[int]


def encode(df: DataFrame, target: str, kinds: Kinds, classes: int, one_hot: int, bins: int) -> Encoded | None:
    """Two aggregates whatever the number of columns: estimated numbers of values, then the values of narrow columns."""
    plain = {c: F.col(f"`{c}`") for c in kinds}
    number = {c: F.coalesce(F.nanvl((F.datediff(plain[c], F.lit("1970-01-01")) if k == "date" else plain[c]).cast("double"), F.lit(-1.0)), F.lit(-1.0)) for c, k in kinds.items() if k != "string"}
    limit = {c: bins if c in number else one_hot for c in kinds}
    guess = df.agg(F.count("*"), F.approx_count_distinct(F.col(f"`{target}`")), *(F.approx_count_distinct(number.get(c, plain[c])) for c in kinds)).first()
    if not guess[0] or guess[1] > 2 * classes:  # the estimate of so few values is not off by half
        return None
    near = {c: n <= 2 * limit[c] for c, n in zip(kinds, guess[2:], strict=True)}
    quantiles = [i / bins for i in range(1, bins)]
    found = df.agg(F.collect_set(F.col(f"`{target}`")), F.count_if(F.col(f"`{target}`").isNull()), *(F.collect_set(number.get(c, plain[c])) if near[c] else F.percentile_approx(number[c], quantiles, 100 * bins) if c in number else F.lit(None) for c in kinds)).first()
    labels = sorted(found[0]) + ([None] if found[1] else [])
    if len(labels) > classes:
        return None
    inputs: list[Column] = []
    names, sizes, wide = [], [], {}
    for c, values in zip(kinds, found[2:], strict=True):
        if c not in number:
            for word in sorted(values) if near[c] and len(values) <= one_hot else []:
                inputs.append(F.coalesce((plain[c] == word).cast("int"), F.lit(0)))
                names.append(f"{c} = {word}")
                sizes.append(2)
        elif near[c] and len(values) > bins:
            wide[c] = len(inputs)
            inputs.append(number[c]), names.append(c), sizes.append(0)
        elif len(edges := sorted(set(values))[: None if not near[c] else -1]):
            inputs.append(binned(number[c], edges)), names.append(c), sizes.append(len(edges) + 1)
    if wide:  # a little over the limit: their quantiles, too
        cut = df.agg(*(F.percentile_approx(number[c], quantiles, 100 * bins) for c in wide)).first()
        for (c, i), edges in zip(wide.items(), cut, strict=True):
            inputs[i], sizes[i] = binned(number[c], sorted(set(edges))), len(set(edges)) + 1
    if not inputs:  # one that tells nothing
        inputs, names, sizes = [F.lit(0)], [""], [1]
    y = F.col(f"`{target}`")
    known = labels[:-1] if labels[-1] is None else labels
    label = F.coalesce(F.array_position(F.array(*map(F.lit, known)).cast("array<string>"), y) - 1, F.lit(len(known))) if known else F.lit(0)
    return Encoded(df.select("*", F.array(*(x.cast("int") for x in inputs)).alias("_x"), label.cast("int").alias("_label")), labels, names, sizes)


def binned(value: Column, edges: list[float]) -> Column:
    """How many of ``edges`` are below the value."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value))


def inside(x: np.ndarray, conditions: tuple[tuple[int, int, bool], ...]) -> np.ndarray:
    keep = np.ones(len(x), bool)
    for i, k, low in conditions:
        keep &= (x[:, i] <= k) == low
    return keep


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The score of splits from the label counts on their sides (last axis); -inf where a side is empty."""
    a, b = left.sum(-1), right.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = (left * left).sum(-1) / a + (right * right).sum(-1) / b
    return np.where((a > 0) & (b > 0), value, -np.inf)


def choose(counts: dict[int, np.ndarray], labels: np.ndarray, own: int, may_split: bool) -> Choice:
    """For rows of label ``own`` in a node with these counts (input: bin x label; ``labels``: of the node), less one row."""
    rest = labels.copy()
    rest[own] -= 1
    leaf = int(rest.argmax()) if rest.sum() else -1
    if not may_split or (rest > 0).sum() <= 1:
        return Choice(leaf)
    parts = []
    for i, table in sorted(counts.items()):
        left = table.cumsum(0)[:-1]
        right, one = labels - left, np.zeros(labels.size, np.int64)
        one[own] = 1
        a = np.where(left[:, own] > 0, scores(left - one, right), -np.inf)
        b = np.where(right[:, own] > 0, scores(left, right - one), -np.inf)
        parts.append((np.full(len(a), i), np.arange(len(a)), a, b, left[:, own] > 0, right[:, own] > 0))
    inputs, bins, a, b, can_left, can_right = map(np.concatenate, zip(*parts, strict=True))
    worse = np.minimum(np.where(can_left, a, np.inf), np.where(can_right, b, np.inf))
    keep = np.maximum(a, b) >= worse.max(initial=-np.inf)
    keep &= np.maximum(a, b) > -np.inf
    return Choice(leaf, inputs[keep], bins[keep], a[keep], b[keep]) if keep.any() else Choice(leaf)


def walk(nodes: list[Node], x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, chosen split (place among the choice's splits, -1: none) and leaf label of each row, as far as nodes are known."""
    at, pick, said = np.zeros(len(x), np.int64), np.full(len(x), -1), np.full(len(x), -1)
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        at[rows] = k
        for own, choice in nodes[k].choices.items():
            mine = rows[label[rows] == own]
            said[mine] = choice.leaf
            if choice.inputs is None or not mine.size:
                continue
            low = x[mine][:, choice.inputs] <= choice.bins
            score = np.where(low, choice.on_left, choice.on_right)
            best = score.argmax(1)
            each = np.arange(mine.size)
            able = score[each, best] > -np.inf
            pick[mine[able]] = best[able]
            way = best * 2 + low[each, best]
            for w in np.unique(way[able]):
                j, side = int(w) // 2, bool(w % 2)
                child = nodes[k].children.get((int(choice.inputs[j]), int(choice.bins[j]), side))
                if child is not None:
                    pick[mine[able & (way == w)]] = -1
                    todo.append((child, mine[able & (way == w)]))
    return at, pick, said


def grow(cells: DataFrame, n_labels: int, sizes: list[int], depth: int) -> list[Node]:
    """All nodes that rows reach in the trees without them, level by level. ``cells``: _x, _label, _n."""
    nodes, level = [Node()], [0]
    width = max(sizes)
    for d in range(depth + 1):
        tables = count(cells, [(k, nodes[k].conditions) for k in level], n_labels, width, len(sizes) if d < depth else 1)
        for k in level:
            node = nodes[k]
            by_input = {i: tables[k, i][: sizes[i]] for i in range(len(sizes) if d < depth else 1)}
            labels = by_input[0].sum(0)
            for own in np.flatnonzero(labels).tolist():
                node.choices[own] = choose(by_input, labels, own, d < depth)
        if d == depth:
            break
        level = []
        for k, i, b, low in reached(cells, nodes):
            nodes[k].children[i, b, low] = len(nodes)
            level.append(len(nodes))
            nodes.append(Node((*nodes[k].conditions, (i, b, low))))
        if not level:
            break
    return nodes


def count(cells: DataFrame, wanted: list[tuple[int, tuple]], n_labels: int, width: int, inputs: int) -> dict[tuple[int, int], np.ndarray]:
    """Rows by bin and label, for each node and each of the first ``inputs`` inputs."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            x, label, n = np.stack(batch["_x"].to_numpy()), batch["_label"].to_numpy(np.int64), batch["_n"].to_numpy(np.int64)
            for k, conditions in wanted:
                keep = inside(x, conditions)
                if keep.any():
                    place = (np.arange(inputs) * width + x[keep][:, :inputs]) * n_labels + label[keep, None]
                    which, inverse = np.unique(place, return_inverse=True)
                    total = np.zeros(which.size, np.int64)
                    np.add.at(total, inverse.ravel(), np.repeat(n[keep], inputs))
                    yield pd.DataFrame({"_k": k, "_place": which, "_n": total})

    rows = cells.mapInPandas(counted, "_k long, _place long, _n long").groupBy("_k", "_place").agg(F.sum("_n").alias("_n")).collect()
    out = {(k, i): np.zeros((width, n_labels), np.int64) for k, _ in wanted for i in range(inputs)}
    for k, place, n in rows:
        i, rest = divmod(place, width * n_labels)
        out[k, i][divmod(rest, n_labels)] = n
    return out


def reached(cells: DataFrame, nodes: list[Node]) -> list[tuple[int, int, int, bool]]:
    """Node, input, bin and side of the splits that rows choose where no child is known yet."""

    def ways(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch[i : i + SLICE] for i in range(0, len(batch), SLICE)):
                x, label = np.stack(part["_x"].to_numpy()), part["_label"].to_numpy(np.int64)
                at, pick, _ = walk(nodes, x, label)
                made = set()
                for r in np.flatnonzero(pick >= 0).tolist():
                    choice = nodes[at[r]].choices[label[r]]
                    i, b = int(choice.inputs[pick[r]]), int(choice.bins[pick[r]])
                    made.add((int(at[r]), i, b, bool(x[r, i] <= b)))
                if made:
                    yield pd.DataFrame(sorted(made), columns=["k", "i", "b", "low"])

    found = cells.mapInPandas(ways, "k long, i long, b long, low boolean").distinct()
    return [tuple(r) for r in found.orderBy("k", "i", "b", "low").collect()]  # at most two for each split that can win


def predictions(df: DataFrame, target: str, kinds: Kinds, row: str, depth: int = 3, classes: int = 12, one_hot: int = 15, bins: int = 32) -> DataFrame | None:
    """``row`` and ``prediction`` of the tree grown without the row."""
    made = encode(df, target, kinds, classes, one_hot, bins)
    if made is None:
        return None
    cells = checkpointed(made.df.groupBy("_x", "_label").agg(F.count("*").alias("_n")))
    nodes = grow(cells, len(made.labels), made.sizes, depth)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE)):
                _, _, said = walk(nodes, np.stack(part.column("_x").to_numpy(zero_copy_only=False)), part.column("_label").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(row), pa.array(said, pa.int64())], [row, "_said"])

    kind = df.schema[row].dataType.simpleString()
    words = F.array(*(F.lit(x).cast("string") for x in made.labels))
    out = made.df.select(row, "_x", "_label").mapInArrow(judged, f"`{row}` {kind}, _said long")
    return out.select(row, F.when(F.col("_said") >= 0, F.get(words, F.col("_said").cast("int"))).alias("prediction"))
