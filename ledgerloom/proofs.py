"""Proofs kept for other sessions: a small table for each dataset and field, tied to the data by a fingerprint.

The fingerprint of a field is taken from the columns that its proof depends on, the learnable ones and its own target. A
column's is two sums of hashes of its values with their row's id, so neither order nor partitions matter and changes in
one field leave the proofs of the others in place. One aggregate finds those of all columns.

A proof that was written over other data is no proof: reading it gives None, and the next one takes its place. The same
holds for a table that was not written to its end.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.features import Features

#: Raised when what proofs say, or how they are found, changes.
EDITION = 1


def column_sums(df: DataFrame, row: str, columns: Iterable[str]) -> dict[str, str]:
    """For each column: number of rows and two sums of hashes of (row, value), as text."""
    columns = list(columns)

    def total(c: str, seed: int):
        value = F.col(f"`{c}`")  # a null leaves a hash as it is, so whether there is a value is hashed, too
        return F.sum(F.xxhash64(F.lit(seed), F.col(row).isNull(), row, value.isNull(), value).cast("decimal(20,0)"))

    found = df.agg(F.count("*"), *(total(c, seed) for c in columns for seed in (1, 2))).first()
    return {c: f"{found[0]}:{found[2 * i + 1]}:{found[2 * i + 2]}" for i, c in enumerate(columns)}


def fingerprints(features: Features, row: str = "pair_id") -> dict[str, str]:
    """By field: a digest of the columns, their kinds and all their values."""
    sums = column_sums(features.df, row, dict.fromkeys([*features.kinds, *features.targets.values()]))
    inputs = [(c, kind, sums[c]) for c, kind in sorted(features.kinds.items())]
    return {name: hashlib.sha256(json.dumps([EDITION, inputs, y, sums[y]]).encode()).hexdigest() for name, y in features.targets.items()}


@dataclass
class ProofStore:
    """``folder``: one that every session sees."""

    spark: SparkSession
    folder: str

    def path(self, dataset: str, field: str) -> str:
        return "/".join([str(self.folder).rstrip("/"), *("of-" + quote(x, safe="") for x in (dataset, field))])

    def read(self, dataset: str, field: str, fingerprint: str) -> dict | None:
        try:
            rows = self.spark.read.schema("fingerprint string, proof string").parquet(self.path(dataset, field)).where(F.col("fingerprint") == fingerprint).collect()  # one row a table
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return json.loads(rows[0]["proof"]) if rows else None

    def write(self, dataset: str, field: str, fingerprint: str, proof: dict) -> None:
        row = self.spark.createDataFrame([(fingerprint, json.dumps(proof, ensure_ascii=False))], "fingerprint string, proof string")
        row.coalesce(1).write.mode("overwrite").parquet(self.path(dataset, field))
