"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

Targets: sources in code-point order (null last) take the weights in turn and share ``share`` times all words; a target
stops at ``most`` times its source's size and the excess goes to the others by weight (water filling, in closed form
over sources ordered by size per weight).

Quotas: the targets are paid out in blocks of ``block_words`` words. Blocks go to sources, and inside a source to its
shards, by highest quotients votes / (2k - 1). Rounded fair shares are the start; only the quotients that can still
change hands are listed and ranked, so the work depends on the number of sources and shards and never on that of blocks.

Selection: the documents of a shard stand in seeded order as one stream of words, cut into blocks. A quota Q of M
blocks takes block j if floor((jQ + c) / M) steps at j, with a seeded start c: exactly Q blocks, evenly spread. Beyond
one whole pass the stream starts again, twice at most. What a document gives is a difference of two closed forms, so
blocks are never made into rows. Where texts are wanted whole (``mix_whole``) the shard's quota goes to documents
instead: the whole passes and then the first documents of the stream until the rest is filled. A shard holds a small share of its
source, so a hot source is many windows.

Cases: null text has size 0 and gives 0; null source is a source of its own, last in order; an empty table gives an
empty result; sources without words have target 0; rows alike in id and size are interchangeable; other columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Renamed, checkpointed, row_key, word_count

WEIGHTS = (5, 2, 1)
PRIME = 2147483647
#: Documents a shard is meant to hold; a source of n documents has at most SHARD_ROOTS * sqrt(n) shards, so that the list
#: of its shards and the shards themselves grow alike.
SHARD_ROWS, SHARD_ROOTS = 512, 8
#: Beyond so many sources the source table is joined by shuffle.
BROADCAST_SOURCES = 50_000


def seeded(value: Column, seed: int) -> Column:
    """An integer hash in plain arithmetic, the same in any SQL engine."""
    first = F.pmod(F.pmod(F.coalesce(value.cast("long"), F.lit(-1)), F.lit(PRIME)) * 48271 + F.lit(seed), F.lit(PRIME))
    return F.pmod(first.bitwiseXOR(F.shiftright(first, 15)) * 69621 + 1013904223, F.lit(PRIME))


def apportion(df: DataFrame, group: list[str], unit: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """``unit`` columns and ``quota``: Sainte-Lague shares of ``seats`` (one number per group) by ``votes``.
    Equal quotients go by ``order``."""
    whole = Window.partitionBy(*group)
    near = (
        df.withColumn("_votes", F.sum(votes).over(whole))
        .withColumn("_base", F.expr(f"if(_votes > 0, floor({seats} * ({votes} / _votes) + 0.5D), 0L)"))
        .withColumn("_off", F.abs(F.sum("_base").over(whole) - F.col(seats)))
        .withColumn("_sure", F.expr("greatest(0L, _base - _off)"))
        .withColumn("_left", F.col(seats) - F.sum("_sure").over(whole))
        .withColumn("_k", F.expr("explode_outer(if(_off > 0, sequence(_sure + 1, _base + _off), cast(array() as array<bigint>)))"))
        .withColumn("_quotient", F.expr(f"{votes} / (2 * _k - 1)"))
    )
    ranked = near.withColumn("_place", F.row_number().over(whole.orderBy(F.col("_quotient").desc_nulls_last(), *order, "_k")))
    won = F.expr("if(_k is not null and _place <= _left, 1L, 0L)")
    return ranked.groupBy(*unit).agg((F.first("_sure") + F.sum(won)).alias("quota"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """From one row per source (_null, _src, source_size): rank, weight, target."""
    line = Window.orderBy("_null", "_src")  # one row per source
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("_rank", F.row_number().over(line) - 1)
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), F.col("_rank") % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.max("_level").over(everything) * F.col("_weight")))
    )


def _placed(
    df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block_words: int = 16, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """What ``mix`` and ``mix_whole`` choose from: every document with its place in its shard's stream, the words
    ``taken`` of it by blocks and its whole passes and one more (``times``) by documents."""
    sized = checkpointed(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).isNull().alias("_null"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_src"), word_count(F.col(text_col)).alias("size"),
        ).withColumn("_hash", seeded(F.col("doc_id"), seed))
    )
    key = ["_null", "_src"]
    sources = source_targets(sized.groupBy(*key).agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), weights, share, most)
    sources = checkpointed(
        sources.withColumn("_shards", F.expr(f"cast(least(ceil({SHARD_ROOTS} * sqrt(_rows)), ceil(_rows / {SHARD_ROWS})) as int)")).withColumn("_blocks", F.floor(F.sum("target").over(Window.partitionBy()) / block_words + 0.5))
    )
    few = sources.count() <= BROADCAST_SOURCES
    small = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    quotas = apportion(sources, [], key, "target", "_blocks", ["_rank"]).withColumnRenamed("quota", "_seats")
    dealt = sized.join(small(sources.select(*key, "source_size", "target", "_rank", "_shards")), key).withColumn("_shard", F.expr("cast(_hash % _shards as int)"))
    shards = dealt.groupBy(*key, "_shard").agg(F.sum("size").alias("_words"), F.first("_rank").alias("_rank")).join(small(quotas), key)
    unit = [*key, "_shard"]
    shares = apportion(shards, key, [*unit, "_words", "_rank"], "_words", "_seats", ["_shard"])
    shares = (
        shares.withColumn("_m", F.expr(f"(_words + {block_words} - 1) div {block_words}"))
        .withColumn("_q", F.expr(f"least(quota, {most} * _m)"))
        .withColumn("_passes", F.expr("if(_m > 0, greatest(0L, _q - 1) div _m, 0L)"))
        .withColumn("_q", F.expr("_q - _passes * _m"))
        .withColumn("_c", F.expr("_m") * 0 + F.when(F.col("_m") > 0, seeded(F.col("_shard") * 65537 + F.col("_rank"), seed + 1) % F.col("_m")).otherwise(0))
        .select(*unit, "_m", "_q", "_passes", "_c", "_words")
    )
    stream = Window.partitionBy(*unit).orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_end", F.sum("size").over(stream)).join(shares, unit)

    def upto(x: str) -> str:
        """Words taken before position x of the shard's stream."""
        j = f"(({x}) div {block_words})"
        before, after = (f"(({k} * _q + _c) div _m)" for k in (j, f"({j} + 1)"))
        return f"(_passes * ({x}) + {before} * {block_words} + ({after} - {before}) * (({x}) - {j} * {block_words}))"

    taken = F.expr(f"if(_m > 0, {upto('_end')} - {upto('_end - size')}, 0L)")
    times = F.expr(f"if(_m > 0 and size > 0, _passes + if(2 * _end - size <= 2 * ({upto('_words')} - _passes * _words), 1L, 0L), 0L)")
    return placed.select("doc_id", F.when(~F.col("_null"), F.col("_src")).alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"), times.alias("times"))


def mix(df: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken. The small columns are checkpointed: texts are read once."""
    return _placed(df, **options).drop("times")


def mix_whole(df: DataFrame, **options) -> DataFrame:
    """The mix as whole documents: ``df`` with each row as often as it is taken. A shard's quota of words is filled in
    seeded order, its last document being in if at least half of it fits, so a shard is at most half a document off.
    Rows count by all their columns: null and shared ids are documents of their own."""
    named = Renamed.of(df)
    own = {k: named[options.pop(k, v)] for k, v in (("text_col", "text"), ("source_col", "source"))}
    keyed = named.df.withColumn("_key", row_key(named.df))
    taken = _placed(keyed, id_col="_key", **own, **options).groupBy(F.col("doc_id").alias("_key")).agg(F.sum("times").alias("_times"), F.count("*").alias("_rows")).where("_times > 0")
    alike = Window.partitionBy("_key").orderBy("_key")
    rows = keyed.join(taken, "_key").withColumn("_nth", F.row_number().over(alike))
    rows = rows.withColumn("_copies", F.expr("cast(_times div _rows + if(_nth <= _times % _rows, 1, 0) as int)"))
    return named.back(rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))))
