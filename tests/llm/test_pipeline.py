import corpus_pipeline
from ledgerloom.llm import jaccard


def test_pipeline(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog and runs into the deep green wood where nobody has ever been before tonight"
    rows = [(i, f"{base} number {i} {' '.join(f'w{i}x{j}' for j in range(40))}", "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s1", 0), (101, None, None, "s1", 0), (102, "12 34", None, "s1", 0), (103, rows[1][1] + " end", "en", "s2", 0)]
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path))
    docs, kept = spark.read.parquet(str(path)), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = set(range(40))
    assert kept[0] == clean | {100, 103} and kept[1] == clean | {100, 103} and kept[2] == clean
    assert docs.where("offset + length > 2048").isEmpty()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    found = jaccard.near_duplicates(spark.read.parquet(str(tmp_path / "near_dedup")))
    assert found.where("doc_id <> component_id").isEmpty()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_keeps_texts_with_null_and_shared_ids(spark):
    text = lambda i: " ".join(f"t{i}x{j}" for j in range(30))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (7, text(2)), (7, text(3)), (3, text(3) + " end"), (4, text(4)), (5, text(4)), (9, text(0) + " end"), (1, text(5))]
    docs = spark.createDataFrame([(a, b, "en", "s1", len(b)) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(map(str, ((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())))
    assert kept == sorted(map(str, [(None, text(0)), (None, text(1)), (7, text(2)), (3, text(3) + " end"), (4, text(4)), (1, text(5))]))
    other = docs.where("doc_id in (4, 5, 1)")
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, other, "").collect()} == {4, 1}


def test_columns_of_any_name_pass_through(spark, tmp_path):
    extra = ["taken", "_size", "score", "lang_pred", "n_lines", "n_removed", "a.b", "_key", "_doc", "_copy", "c1", "size", "component_id", "_nth"]
    long = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, long(i % 9), "en", f"s{i % 2}", 5, *[f"{c}{i}" for c in extra], {"k": i}) for i in range(12)] + [(None, None, None, None, None, *[None] * len(extra), None)]
    schema = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{c}` string" for c in extra), "labels map<string,int>"])
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "").collect()
        assert out and all(tuple(r)[5:] == tuple(next(x for x in rows if x[0] == r["doc_id"]))[5:] for r in out), name
    assert corpus_pipeline.pack(spark, docs, "").count() == 13
