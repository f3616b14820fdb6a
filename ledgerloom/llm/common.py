"""Shared pieces of the text operators: table access, checkpointing, Arrow plumbing, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: White space that separates words in every word-based contract: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Characters with the Unicode property White_Space (what the tokenizers' patterns call \s). Fixed values.
UNICODE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_root(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir. Where it is unset a single machine takes a temporary folder; a cluster has
    no folder that all machines see, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the checkpoint folder, gone with the application."""
    checkpoint_root(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def kept(df: DataFrame, folder: str) -> DataFrame:
    """Written once to ``folder``, for tables made in rounds. A checkpoint goes on with its plan's estimate of its size, which
    every join multiplies, so that after some rounds the number alone fills the driver's memory; of files the planner takes
    the size they have. Plain columns, so that files are not much smaller than their rows."""
    df.write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (long) and the text of ``df``: extra or clashing columns never reach an operator."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


@dataclass
class Renamed:
    """A table whose columns are numbered, so that no name of the user's meets one of an operator's."""

    df: DataFrame
    names: list[str]

    @classmethod
    def of(cls, df: DataFrame) -> Renamed:
        return cls(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), df.columns)

    def __getitem__(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def back(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, which has the numbered columns and maybe others, with the columns of before."""
        return df.select(*self.df.columns).toDF(*self.names)


def row_key(df: DataFrame) -> Column:
    """A hash of all columns; maps, which have no hash of their own, by their JSON."""
    return F.xxhash64(*(F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema))


def arrow_schema(schema: T.StructType | str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def map_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for a generator of column dictionaries; one dictionary becomes one record batch."""
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in to], schema=to)

    return df.mapInArrow(run, schema)


def utf8_length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


_LEADING = re.compile(f"[{UNICODE_SPACE}]*[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+")
_EDGE = re.compile(f"(?<=[^{UNICODE_SPACE}])(?=[{UNICODE_SPACE}])")


def safe_slices(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """Parts of about ``limit`` characters, cut only between a visible character and white space."""
    start = 0
    while len(text) - start > limit:
        cut = _EDGE.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def safe_chunks(text: str) -> list[str]:
    """White-space run and the visible run after it. A pre-tokenizer that never joins a visible character to white
    space behind it cuts at all these borders, so the chunks encode as they do in the whole text."""
    return _LEADING.findall(text)
