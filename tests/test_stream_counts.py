from pyspark.sql import functions as F

from ledgerloom.streaming.verdicts import finished, windowed_counts

SCHEMA = "field string, verdict string, ts timestamp"


def test_counts_of_several_micro_batches(spark, tmp_path):
    days = {0: [("f", "MATCH", 1), ("f", "ANOMALY", 2), ("g", "MATCH", 1)], 1: [("f", "MATCH", 3), ("g", "JUSTIFIED", 30)], 2: [("f", None, 4)]}
    for batch in days.values():
        rows = spark.createDataFrame(batch, "field string, verdict string, m int").select("field", "verdict", F.timestamp_add("MINUTE", F.col("m"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = finished(windowed_counts(stream, "ts", "10 minutes", "1 hour"), "counts")
    got = {(str(r["window"]["start"])[11:16], r["field"]): (r["MATCH"], r["JUSTIFIED"], r["ANOMALY"], r["AMBIGUOUS"]) for r in made.collect()}
    assert got == {("00:00", "f"): (2, 0, 1, 0), ("00:00", "g"): (1, 0, 0, 0), ("00:30", "g"): (0, 1, 0, 0)}
    (tmp_path / "none").mkdir()
    assert finished(windowed_counts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "none")), "ts"), "counts").count() == 0
