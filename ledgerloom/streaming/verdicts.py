"""Verdicts over a stream of pairs: rules are stateless, so a compiled catalogue runs on a stream as on a table; open
rows are counted per field in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..keeping import new_folder
from ..plans.tree import VERDICTS, evaluate


def stream_verdicts(pairs: DataFrame, rules: list, keep: list[str]) -> DataFrame:
    """``pairs`` (streaming, with s and d) as verdict rows."""
    return evaluate(pairs.where("s is not null and d is not null"), rules, keep, trace=False)


def windowed_counts(verdicts: DataFrame, ts: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Verdicts per field and window; later rows than ``late`` are dropped."""
    return verdicts.withWatermark(ts, late).groupBy(F.window(ts, length).alias("window"), "field").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS))


def finished(counts: DataFrame, name: str) -> DataFrame:
    """What a stream of counts holds when all that is there has been read. Each micro-batch writes the windows that it
    changed to a part of its own of a table in the shared folder (written again if the batch is repeated), and the last
    part with a window has its counts, so no window passes through the driver."""
    spark, folder = counts.sparkSession, new_folder(counts.sparkSession, name)
    part = lambda n: f"{folder}/counts/batch={n}"
    spark.createDataFrame([], counts.schema).write.parquet(part(-1))  # a stream without rows has counts too: none
    keep = lambda changed, n: changed.write.mode("overwrite").parquet(part(n))
    run = counts.writeStream.queryName(name).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    last = spark.read.parquet(f"{folder}/counts").groupBy("window", "field").agg(F.max_by(F.struct(*VERDICTS), "batch").alias("_last"))
    return last.select("window", "field", "_last.*")
