"""Merkle manifest of a dataset: a leaf for each row, a tree for each language, a tree over the languages' roots, and for
every row the siblings that prove it.

H is lower-case hex SHA-256 of inputs put together, digests as hex text. A run is up to ARITY consecutive nodes of a level;
its H is a node of the next level, while a level has more than one node.

Places: rows are dealt by ranges of (group, key), so no group has to fit one task, and counted; a row's place is what
lies before its range plus its place inside. Rows alike in everything may stand anywhere among each other.

Blocks: the nodes at places [k * BLOCK, (k + 1) * BLOCK) of a group are an aligned block, which a task passes through in
order by fractal traversal: the block's tree is cut into stacked layers of HEIGHT levels; for each layer the existing
subtree, which holds the siblings of the present leaf, and the desired one, which comes next and grows by as many leaves
as are passed, so it is complete when it is needed. Both together are a few hundred digests beside the BLOCK leaves.
Block roots are the leaves of the same work again, until a group has one node; the proofs found there, one for each
block, stand in the stream before the block's rows and are appended to what the traversal emits.

A proof is a list of (left, right): the digests before and after one's own in its run. Folding a leaf upwards gives
the root only if leaf and siblings are those of the tree.

Cases: null in a column is "-"; null lang is a group of its own, before all others; null ids stand first in their group;
rows alike are leaves of their own; a single leaf is its own subroot and has no siblings there; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, checkpointed, shuffle_width

ARITY, HEIGHT, LAYERS = 8, 2, 2
BLOCK = ARITY ** (HEIGHT * LAYERS)
BATCH = 2048
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above n nodes."""
    levels, held = 0, 1
    while held < n:
        levels, held = levels + 1, held * ARITY
    return levels


class Subtree:
    """The nodes of one layer: levels low to high above the leaves, from leaf ``start`` on, stacked as leaves are put in.
    Nodes below ``low`` are combined and forgotten."""

    def __init__(self, start: int, low: int, high: int) -> None:
        self.start, self.low, self.high, self.next = start, low, high, start
        self.open: list[list[str]] = [[] for _ in range(high + 1)]  # of each level, the run that is not yet a node
        self.kept: dict[tuple[int, int], str] = {}

    @property
    def stop(self) -> int:
        return self.start + ARITY**self.high

    def put(self, node: str) -> None:
        """The next leaf; runs that it fills become nodes, upwards."""
        at, level = self.next, 0
        self.next += 1
        while level < self.high:
            if level >= self.low:
                self.kept[level, at] = node
            self.open[level].append(node)
            if len(self.open[level]) < ARITY:
                return
            node, self.open[level] = digest(*self.open[level]), []
            level, at = level + 1, at // ARITY
        self.open[level].append(node)

    def finish(self) -> None:
        """No more leaves: runs that have begun become nodes."""
        for level in range(self.high):
            if self.open[level]:
                node, self.open[level] = digest(*self.open[level]), []
                at = (self.next - 1) // ARITY ** (level + 1)
                if level + 1 < self.high and level + 1 >= self.low:
                    self.kept[level + 1, at] = node
                self.open[level + 1].append(node)

    def siblings(self, level: int, at: int) -> tuple[str, str]:
        first = at - at % ARITY
        held = self.kept.get
        return "".join(held((level, i), "") for i in range(first, at)), "".join(held((level, i), "") for i in range(at + 1, first + ARITY))


class Traversal:
    """Proofs of the n leaves of a block of that many levels, one after the other. ``leaf`` gives the digest at a place in
    the block."""

    def __init__(self, leaf: Callable[[int], str], n: int, levels: int) -> None:
        self.leaf, self.n, self.levels = leaf, n, levels
        bounds = [*range(0, self.levels, HEIGHT), self.levels]
        self.layers = list(zip(bounds, bounds[1:]))
        self.existing = [Subtree(0, low, high) for low, high in self.layers]
        self.desired: list[Subtree | None] = [None] * len(self.layers)
        for tree in self.existing:
            self.grow(tree, tree.stop)
        for i in range(len(self.layers)):
            self.wish(i)

    def grow(self, tree: Subtree, leaves: int) -> None:
        stop = min(self.n, tree.stop, tree.next + leaves)
        while tree.next < stop:
            tree.put(self.leaf(tree.next))
            if tree.next == self.n:
                tree.finish()

    def wish(self, i: int) -> None:
        start = self.existing[i].stop
        self.desired[i] = Subtree(start, *self.layers[i]) if start < self.n else None

    def __iter__(self) -> Iterator[list[tuple[str, str]]]:
        for at in range(self.n):
            for i, tree in enumerate(self.existing):
                if at == tree.stop:  # the layer's subtree is passed: the next one has grown meanwhile
                    self.existing[i] = self.desired[i]
                    self.wish(i)
            for tree in self.desired:
                if tree is not None:
                    self.grow(tree, 1)
            yield [tree.siblings(level, at // ARITY**level) for tree in self.existing for level in range(tree.low, tree.high)]

    def held(self) -> int:
        """Digests of the present state."""
        return sum(len(t.kept) + sum(map(len, t.open)) for t in [*self.existing, *self.desired] if t is not None)


def block_root(nodes: Iterator[str], levels: int) -> str:
    """The root of a block of that many levels, from its nodes as they come."""
    tree = Subtree(0, levels, levels)
    for node in nodes:
        tree.put(node)
    tree.finish()
    return tree.open[levels][0]


def leaves(df: DataFrame) -> DataFrame:
    """doc_id, group (null: _nul), leaf and the leaf after tampering, null where the row is left alone."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    written = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    h = lambda text: F.sha2(F.concat(*(written(F.col(c)) for c in FIELDS[:-1]), written(text)), 256)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return rows.select("doc_id", F.col("lang").isNull().alias("_nul"), F.coalesce("lang", F.lit("")).alias("_group"), h(F.col("text")).alias("node"), F.when(chosen & F.col("text").rlike("[A-Z]"), h(lowered)).alias("tampered"))


GROUP = ["_nul", "_group"]


def placed(df: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """With ``_at``, the place in the group's order from 0, and ``_n``, the group's size."""
    ranged = df.withColumn("_row", F.monotonically_increasing_id())  # parts rows alike, so that they need not share a range
    ranged = checkpointed(ranged.repartitionByRange(shuffle_width(df.sparkSession), *group, *order, "_row").withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "_range")
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_here"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_here").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("_n", F.sum("_here").over(Window.partitionBy(*group))).drop("_here")
    numbered = ranged.withColumn("_in", F.row_number().over(inside.orderBy(*order, "_row")) - 1)
    return numbered.join(counts, [*group, "_range"]).withColumn("_at", F.col("_before") + F.col("_in")).drop("_row", "_range", "_in", "_before")


def _streamed(df: DataFrame, order: list[str]) -> DataFrame:
    """Blocks of groups, each whole in one partition and in order."""
    return df.repartition(shuffle_width(df.sparkSession), *GROUP, "_block").sortWithinPartitions(*GROUP, "_block", *order)


def _blocks(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows that share the key columns, which stand first."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, lambda row: row[: len(key)])


def _batch(rows: list, to: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(column), type=t.type) for column, t in zip(zip(*rows), to)], schema=to)


def block_levels(n: int) -> int:
    """Levels of the blocks of a group of n nodes; its last block has as many as the others."""
    return min(height_of(n), HEIGHT * LAYERS)


def block_roots(nodes: DataFrame) -> DataFrame:
    """From (group, _at, _n, node): the same of the next level of blocks."""
    schema = "_nul boolean, _group string, _at long, _n long, node string"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (nul, group, block, n), rows in _blocks(batches, ("_nul", "_group", "_block", "_n")):
            out.append((nul, group, block, -(-n // BLOCK), block_root((row[-1] for row in rows), block_levels(n))))
            if len(out) >= BATCH:
                yield _batch(out, to)
                out = []
        if out:
            yield _batch(out, to)

    rows = nodes.select(*GROUP, F.expr(f"_at div {BLOCK}").alias("_block"), "_n", "_at", "node")
    return _streamed(rows, ["_at"]).mapInArrow(run, schema)


PROOF = "proof array<struct<left:string,right:string>>, top string"


def proofs(nodes: DataFrame) -> DataFrame:
    """(group, _at, _n, node) with the proof of each node up to its group's ``top``. Each step turns BLOCK nodes of a group
    into one, so steps grow with the logarithm of the largest group."""
    nodes = checkpointed(nodes)
    if nodes.where("_n > 1").isEmpty():
        return nodes.select("*", F.array().cast("array<struct<left:string,right:string>>").alias("proof"), F.col("node").alias("top"))
    roots = block_roots(nodes)
    upper = proofs(roots)
    return traversed(nodes.select(*GROUP, "_at", "_n", "node", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("tampered")), upper, _with_proofs, "_nul boolean, _group string, _at long, _n long, node string, " + PROOF)


def _with_proofs(key: tuple, row: tuple, inner: list, upper: dict) -> tuple:
    nul, group, _, n = key
    at, node = row[0], row[1]
    return nul, group, at, n, node, [{"left": a, "right": b} for a, b in inner] + upper["proof"], upper["top"]


def traversed(nodes: DataFrame, upper: DataFrame, emit: Callable[[tuple, tuple, list, dict], tuple], schema: str) -> DataFrame:
    """``emit`` of every node of (group, _at, _n, node, doc_id, tampered): the key of its block, the node, its proof inside
    the block and its block's row of ``upper``, which the block's rows follow in the stream."""
    to = arrow_schema(schema)
    block = F.expr(f"_at div {BLOCK}").alias("_block")
    rows = nodes.select(*GROUP, block, "_n", "_at", "node", "doc_id", "tampered", F.lit(None).cast("array<struct<left:string,right:string>>").alias("proof"), F.lit(None).cast("string").alias("top"))
    above = upper.select(*GROUP, F.col("_at").alias("_block"), F.lit(-1).cast("long").alias("_n"), F.lit(-1).cast("long").alias("_at"), "node", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("tampered"), "proof", "top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (nul, group, block), held in _blocks(batches, ("_nul", "_group", "_block")):
            first = next(held)
            top = {"node": first[5], "proof": first[8], "top": first[9]}
            held = list(held)  # BLOCK rows at most
            n = held[0][3]
            for row, inner in zip(held, Traversal(lambda i, held=held: held[i][5], len(held), block_levels(n))):
                out.append(emit((nul, group, block, n), row[4:], inner, top))
                if len(out) >= BATCH:
                    yield _batch(out, to)
                    out = []
        if out:
            yield _batch(out, to)

    return _streamed(rows.unionByName(above), ["_at"]).mapInArrow(run, schema)


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _manifest_row(key: tuple, row: tuple, inner: list, upper: dict) -> tuple:
    _, leaf, doc_id, tampered = row[:4]
    subroot, root = upper["top"].split(":")
    proof = inner + [(p["left"], p["right"]) for p in upper["proof"]]
    node = tampered or leaf
    for left, right in proof:
        node = digest(left, node, right)
    return doc_id, leaf, subroot, root, digest(*(s for pair in proof for s in pair)), node, node == root


def manifest(df: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of a table with FIELDS."""
    rows = checkpointed(placed(leaves(df), GROUP, ["doc_id", "node"]))
    inside = proofs(block_roots(rows.select(*GROUP, "_at", "_n", "node")))
    inside = checkpointed(inside)
    subroots = placed(inside.where("_at = 0").select(F.lit(False).alias("_all"), (~F.col("_nul")).alias("_named"), F.col("_group").alias("_lang"), F.col("top").alias("node")), ["_all"], ["_named", "_lang"])
    over = proofs(subroots.select(F.col("_all").alias("_nul"), F.lit("").alias("_group"), "_at", "_n", "node"))
    ranked = subroots.select("_at", (~F.col("_named")).alias("_nul"), F.col("_lang").alias("_group"))
    over = over.select("_at", F.col("proof").alias("_over"), F.col("top").alias("_root")).join(ranked, "_at").drop("_at")
    upper = inside.join(over, GROUP).select(*GROUP, "_at", "node", F.concat("proof", "_over").alias("proof"), F.concat_ws(":", "top", "_root").alias("top"))
    return traversed(rows.select(*GROUP, "_at", "_n", "node", "doc_id", "tampered"), upper, _manifest_row, MANIFEST)
