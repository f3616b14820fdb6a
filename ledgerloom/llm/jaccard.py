"""Near-duplicate classes by an exact Jaccard join on word shingles, with token-combination prefixes.

A token is a shingle. Two sets link if their Jaccard index reaches percent / 100. Every set's tokens are ordered by how
many documents hold them, rarest first (classes of ``shared``), then by hash. At most spare = n - ceil(n * percent / 100)
tokens of a set can be missing in a partner, so:

- of rare tokens, the first spare + 1 are indexed as they are;
- a set with fewer rare tokens goes on into its frequent ones (``FREQUENT`` documents and more). These are dealt to
  groups by hash, and pairs of tokens of one group are indexed: a group with g tokens in the prefix counts for g - 1, so
  the prefix is extended until rare tokens and groups count for spare + 1. How many groups there are goes by the power
  of two of the set's size; a set is indexed for each power that a partner's size may have (two at most).

The prefix that ends first in the common order lies wholly inside what the other shares up to there, so two linked sets
share an indexed token or pair. Tokens that one document alone holds are ordered but not indexed.

Sets alike are one node. In each bucket the most central node (whose tokens are held by most documents) is paired with
every other, and these pairs are verified on the texts. Only then do other nodes of a bucket matter, and only if they
are in different components so far. Such nodes form clusters (what shares a bucket, transitively), which are decided as
a whole in blocks by products of 0-1 matrices; a block returns what connects, not its pairs. So no link between
components is lost and pairs inside a group are never rows. Components come from the smallest label of neighbours and pointer jumping.

Cases: null and empty texts and texts without words have an empty set and link with nothing; rows with one id are one
document for the component, which links if one of its rows does; repeated rows get equal results; a null id counts as
the smallest id and is returned as null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, checkpointed, kept, keyed, map_arrow, new_folder, removed
from .shared import batches_of, classes_of, distinct_keys, with_classes
from .shingles import mixed, shingle_sets

#: Class (bit length of the number of documents) from which a token is frequent: 16 documents.
FREQUENT = 5
#: Frequent tokens of a set's prefix that are meant to fall into one group; nodes in a block.
GROUP = 6
BLOCK = 1024
_LOWEST = -(1 << 63)


def signatures(tokens: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """What is indexed of a set, given its tokens and their classes."""
    n = tokens.size
    spare = n - -(-n * percent // 100)
    if n < 2 or int((classes == 1).sum()) > spare:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, classes))
    tokens, classes = tokens[order], classes[order]
    rare = int(np.searchsorted(classes, FREQUENT))
    single = tokens[: min(rare, spare + 1)][classes[: min(rare, spare + 1)] > 1]
    if rare > spare:
        return single
    out, frequent = [single], tokens[rare:]
    for power in range((-(-n * percent // 100)).bit_length(), (n * 100 // percent).bit_length() + 1):
        groups = max(1, (100 - percent) * (1 << (power - 1)) // (GROUP * 100))
        group = mixed(frequent) % np.uint64(groups)
        new = np.zeros(frequent.size, bool)
        new[np.unique(group, return_index=True)[1]] = True
        worth = np.flatnonzero(np.cumsum(~new) >= spare + 1 - rare)
        size = int(worth[0]) + 1 if worth.size else frequent.size
        by = np.argsort(group[:size], kind="stable")
        sorted_group, sorted_token = group[by], frequent[by]
        begin = np.searchsorted(sorted_group, sorted_group)  # first of its group
        nth = np.arange(size) - begin
        later = np.repeat(np.arange(size), nth)
        earlier = begin[later] + np.arange(later.size) - np.repeat(np.cumsum(nth) - nth, nth)
        out.append(mixed(sorted_token[earlier] * np.uint64(0x9E3779B97F4A7C15) + sorted_token[later] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(power)))
    return np.unique(np.concatenate(out))


def prefix_index(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """For every document (doc_id, text): n (set size), held (tokens other documents hold too), central, same (digest of
    the set) and marks (its signatures)."""
    docs, count = batches_of(docs)
    schema = "doc_id long, n long, held long, central double, same binary, marks array<long>"
    to = arrow_schema(schema)

    def keys_of(table: pa.Table) -> list[np.ndarray]:
        return shingle_sets(table.column("text").to_pylist(), words)

    def rows_of(table: pa.Table, classes: np.ndarray) -> pa.Table:
        sets = keys_of(table)
        place = distinct_keys(sets)[1]
        out: dict[str, list] = {f.name: [] for f in to}
        at = 0
        for doc_id, own in zip(table.column("doc_id").to_pylist(), sets, strict=True):
            own_classes = classes[place[at : at + own.size]]
            at += own.size
            row = (doc_id, own.size, int((own_classes > 1).sum()), float(own_classes.mean()) if own.size else 0.0, hashlib.blake2b(own.tobytes(), digest_size=16).digest(), signatures(own, own_classes, percent).view(np.int64).tolist())
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return pa.table(out, schema=to)

    return with_classes(docs, classes_of(docs, count, keys_of), rows_of, schema)


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link, by their texts."""
    nodes = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("_text_a")), docs.select(F.col("doc_id").alias("b"), F.col("text").alias("_text_b"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in "ab")
            texts = [batch.column(c).to_pylist() for c in ("_text_a", "_text_b")]
            good = []
            for start in range(0, a.size, 256):
                ones, others = (shingle_sets(x[start : start + 256], words) for x in texts)
                for x, y in zip(ones, others, strict=True):
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    good.append(100 * shared >= percent * (both.size - shared))
            good = np.array(good, bool)
            yield {"a": a[good], "b": b[good]}

    return map_arrow(pairs.select("a", "b").join(nodes[0], "a").join(nodes[1], "b"), linked, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for the nodes of ``links`` (a, b)."""
    spark = links.sparkSession
    folder = new_folder(spark)
    edges = kept(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), f"{folder}/edges")
    labels = kept(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{folder}/0")
    for nth in itertools.count(1):
        around = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(around, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = nearer.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        following = kept(nearer.join(jump, "to", "left").select("node", F.least("to", F.coalesce("beyond", "to")).alias("label"), "was"), f"{folder}/{nth}")
        removed(spark, f"{folder}/{nth - 1}")
        labels = following.select("node", "label")
        if following.where("label <> was").isEmpty():
            removed(spark, f"{folder}/edges")
            return labels


def block_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs (places) that join the sets to their components: all pairs are decided by products of 0-1 matrices over
    the tokens that several sets hold, but only what connects is returned."""
    size = np.array([x.size for x in sets])
    place, owner = np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(size.size), size)
    held = np.bincount(place)
    several = held[place] > 1
    column = (np.cumsum(held > 1) - 1)[place[several]]
    owner = owner[several]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((size.size, size.size), np.float32)
    for low in range(0, int(column[-1]) + 1 if column.size else 0, 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        part = np.zeros((size.size, min(4096, int(column[-1]) + 1 - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        shared += part @ part.T
    linked = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
    out, free = [], np.ones(size.size, bool)
    for start in range(size.size):
        if free[start]:
            free[start] = False
            waiting = [start]
            while waiting:
                one = waiting.pop()
                near = np.flatnonzero(linked[one] & free)
                free[near] = False
                out += [(one, int(x)) for x in near]
                waiting += near.tolist()
    return out


def cluster_links(clusters: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked inside each cluster (node, label). Clusters over BLOCK nodes are dealt
    to blocks by hash and every two blocks meet in a task of their own; small clusters share tasks."""
    sizes = clusters.groupBy("label").agg(F.count("*").alias("_size"))
    dealt = clusters.join(sizes, "label").withColumn("_blocks", F.expr(f"cast(ceil(_size / {BLOCK}) as int)")).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    total = clusters.count()
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
    task = F.when(F.col("_blocks") > 1, F.xxhash64("label", "_i", "_j")).otherwise(F.pmod(F.xxhash64("label"), F.lit(max(1, total // BLOCK))))
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    rows = met.withColumn("_task", task).select("_task", "label", "_i", "_j", "node").join(texts, "node")
    schema = "a long, b long"
    to = arrow_schema(schema)

    def decide(table: pa.Table) -> pa.Table:
        key = list(zip(*(table.column(c).to_pylist() for c in ("label", "_i", "_j")), strict=True))
        node, text = table.column("node").to_pylist(), table.column("text").to_pylist()
        groups: dict[tuple, list[int]] = {}
        for i, k in enumerate(key):
            groups.setdefault(k, []).append(i)
        found: list[tuple[int, int]] = []
        for own in groups.values():
            found += [(node[own[x]], node[own[y]]) for x, y in block_links(shingle_sets([text[i] for i in own], words), percent)]
        return pa.table({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema=to)

    return rows.groupBy("_task").applyInArrow(decide, schema)


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) of every document."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    docs = keyed(df, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(_LOWEST)))
    index = checkpointed(prefix_index(docs, words, percent))
    filled = index.where("n > 0")
    nodes = filled.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.max("held").alias("held"), F.max("central").alias("central"), F.first("marks").alias("marks"))
    nodes = checkpointed(nodes)
    marks = nodes.where(F.size("marks") > 0).select("node", "n", "held", "central", F.explode("marks").alias("mark"))
    best = marks.groupBy("mark").agg(F.max(F.struct("central", F.negative("node").alias("_back"), "n", "held")).alias("_best"), F.count("*").alias("_size")).where("_size > 1")
    marks = checkpointed(marks.join(best, "mark").select("mark", "node", "n", "held", (-F.col("_best._back")).alias("hub"), F.col("_best.n").alias("hub_n"), F.col("_best.held").alias("hub_held")))

    def possible(n: str, held: str, other_n: str, other_held: str) -> str:
        least = f"ceil({percent}D * ({n} + {other_n}) / {100 + percent})"
        return f"least({n}, {other_n}) * 100 >= {percent} * greatest({n}, {other_n}) and least({held}, {other_held}) >= {least} - 0.001D"

    spokes = marks.where("node <> hub").where(possible("n", "held", "hub_n", "hub_held"))
    spokes = checkpointed(spokes.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    links = checkpointed(verified(spokes, docs, words, percent))
    own = filled.join(nodes.select("same", "node"), "same")
    same = own.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))  # copies
    labels = components(links)
    known = marks.where("node <> hub").join(labels, "node", "left").select("mark", "node", F.coalesce("label", "node").alias("label"))
    leads = known.groupBy("mark").agg(F.min("node").alias("lead"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high")
    undecided = checkpointed(known.join(leads, "mark").select(F.col("node").alias("a"), F.col("lead").alias("b")).where("a <> b").distinct())
    if not undecided.isEmpty():
        links = checkpointed(links.union(cluster_links(components(undecided), docs, words, percent)))
    labels = components(links.union(same))
    found = index.join(labels, index.doc_id == labels.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))
    null = lambda c: F.when(F.col(c) != _LOWEST, F.col(c)).alias(c)
    return found.select(null("doc_id"), "n_shingles", null("component_id"))
