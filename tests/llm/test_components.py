from pathlib import Path
from urllib.parse import urlparse

import corpus_pipeline
from ledgerloom.llm import jaccard

WORDS = [f"w{i}" for i in range(2000)]


def estimated(df) -> int:
    """The bytes that the planner expects of a table."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def chain(first: int, n: int) -> list[tuple[int, str]]:
    """Documents of which each is a near duplicate of the one before and after it only."""
    return [(first + i, " ".join(f"c{first}{x}" for x in WORDS[9 * i : 9 * i + 100])) for i in range(n)]


def test_estimates_do_not_grow_with_the_rounds(spark):
    links = spark.range(40).selectExpr("id + 7 as a", "id + 8 as b")
    labels = jaccard.components(links)
    assert sorted(map(tuple, labels.select("node", "label").collect())) == [(i, 7) for i in range(7, 48)]
    assert estimated(labels) < 1 << 20
    rounds = Path(urlparse(labels.inputFiles()[0]).path).parents[1]
    assert len(list(rounds.iterdir())) == 1


def test_no_links(spark):
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_long_chains(spark):
    rows = chain(1000, 40) + chain(100, 30) + [(5, "a text of its own with some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = jaccard.near_duplicates(docs)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: 1000 if i >= 1000 else 100 if i >= 100 else 5 for i, _ in rows}
    assert estimated(found) < 1 << 200


def test_stage_of_long_chains(spark):
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in chain(1000, 40) + chain(100, 30)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {100, 1000}
