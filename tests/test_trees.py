import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.learn import trees

KINDS = {"a": "string", "b": "string", "n": "double", "d": "date"}
SCHEMA = "pair_id long, a string, b string, n double, d date, y string"


def numbers(rows, one_hot):
    """Each row's inputs as plain numbers: words of narrow text columns, numbers, days."""
    words = [(c, w) for c in (1, 2) if len(found := sorted({r[c] for r in rows if r[c] is not None})) <= one_hot for w in found]
    return [[*(1.0 if r[c] == w else 0.0 for c, w in words), -1.0 if r[3] is None else r[3], -1.0 if r[4] is None else float((r[4] - date(1970, 1, 1)).days)] for r in rows]


def told(x, y, own, depth):
    """The label that a tree grown from x and y gives ``own``."""
    labels = sorted(set(y), key=lambda v: (v is None, v or ""))
    tally = [y.count(v) for v in labels]
    best = None
    if depth and len(labels) > 1:
        for i in range(len(own)):
            for edge in sorted({r[i] for r in x})[:-1]:
                sides = [[y[j] for j in range(len(y)) if (x[j][i] <= edge) == low] for low in (True, False)]
                score = sum(sum(s.count(v) ** 2 for v in labels) / len(s) for s in sides)
                if best is None or score > best[0]:
                    best = score, i, edge
    if best is None:
        return labels[tally.index(max(tally))]
    _, i, edge = best
    keep = [j for j in range(len(y)) if (x[j][i] <= edge) == (own[i] <= edge)]
    return told([x[j] for j in keep], [y[j] for j in keep], own, depth - 1)


def made(seed, n):
    """Tables where single rows decide: rare words, values that occur once, repeated rows, labels that hardly follow."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rnd.choice(["p", "q", "r", None]), rnd.choice(["u", "v"]) if rnd.random() < 0.9 else f"w{i % 2}"
        v = rnd.choice([None, *map(float, range(6))]) if seed % 2 else float(rnd.randrange(n))
        d = rnd.choice([None, *(date(2020, 1, 1) + timedelta(k) for k in range(4))])
        y = ("X" if a == "p" else "Y" if (v or 0) > 2 else None) if rnd.random() < 0.7 else rnd.choice(["X", "Y", "Z", None])
        rows.append((i, a, b, v, d, y))
    return rows + [(n + i, *r[1:]) for i, r in enumerate(rows[:5])]


@pytest.mark.parametrize("seed", range(4))
def test_each_row_is_judged_by_the_tree_grown_without_it(spark, seed):
    rows = made(seed, 22 + 9 * seed)
    out = trees.predictions(spark.createDataFrame(rows, SCHEMA).repartition(3), "y", KINDS, "pair_id", bins=100)
    got = {r["pair_id"]: r["prediction"] for r in out.collect()}
    x, y = numbers(rows, 15), [r[-1] for r in rows]
    want = {r[0]: told(x[:i] + x[i + 1 :], y[:i] + y[i + 1 :], x[i], 3) for i, r in enumerate(rows)}
    assert got == want
    assert any(told(x, y, x[i], 3) != want[r[0]] for i, r in enumerate(rows))  # leaving a row out does matter here


def test_rows_take_different_ways(spark):
    """At the root the splits of different rows differ, so trees without them are not one tree."""
    encoded = trees.encode(spark.createDataFrame(made(2, 40), SCHEMA), "y", KINDS, 12, 15, 100)
    cells = encoded.df.groupBy("_x", "_label").agg(F.count("*").alias("_n"))
    nodes = trees.grow(cells, len(encoded.labels), encoded.sizes, 3)
    assert len({k[:2] for n in nodes for k in n.children}) > len([n for n in nodes if n.children]) > 1


def test_bins(spark):
    """Beyond ``bins`` values numbers count by quantiles; splits of a large table are as few as those of one tree."""
    df = spark.range(20000).select(F.col("id").alias("pair_id"), F.concat(F.lit("w"), F.col("id") % 40).alias("a"), F.lit("k").alias("b"), (F.col("id") * 7 % 20000).cast("double").alias("n"), F.lit(None).cast("date").alias("d"), F.when(F.col("id") * 7 % 20000 < 5000, "low").otherwise("high").alias("y"))
    encoded = trees.encode(df, "y", KINDS, 12, 15, 32)
    assert encoded.names == ["b = k", "n"] and 16 <= encoded.sizes[1] <= 33
    cells = encoded.df.groupBy("_x", "_label").agg(F.count("*").alias("_n"))
    assert cells.count() <= 34 and len(trees.grow(cells, 2, encoded.sizes, 3)) <= 15
    out = trees.predictions(df, "y", KINDS, "pair_id").join(df.select("pair_id", "y"), "pair_id")
    assert out.count() == 20000 and out.where("prediction <> y").count() <= 20000 // 32 + 1
    slightly = trees.encode(df.where("n < 40"), "y", KINDS, 12, 15, 32)
    assert slightly.sizes[-1] <= 33


def test_small_and_wide_tables(spark):
    df = spark.createDataFrame([(1, "p", None, None, None, "X")], SCHEMA)
    assert [r["prediction"] for r in trees.predictions(df, "y", KINDS, "pair_id").collect()] == [None]
    assert trees.predictions(df.where("false"), "y", KINDS, "pair_id") is None
    many = spark.range(40).select(F.col("id").alias("pair_id"), F.col("id").cast("string").alias("y"), F.col("id").cast("string").alias("a"))
    assert trees.predictions(many, "y", {"a": "string"}, "pair_id") is None
    two = many.withColumn("y", F.when(F.col("pair_id") < 21, "X"))
    got = {r["pair_id"]: r["prediction"] for r in trees.predictions(two, "y", {"a": "string"}, "pair_id").collect()}
    assert all(v == "X" for v in got.values()) and len(got) == 40  # 21 X against 19 nulls: a leaf, whichever row is left out
    nulls = many.withColumn("y", F.lit(None).cast("string"))
    assert {r["prediction"] for r in trees.predictions(nulls, "y", {}, "pair_id").collect()} == {None}
