"""The engine's roles played by star-schema tables: orders as source, a deterministic perturbation as target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.pairing import pair_records
from .operators.verdicts import identity
from .plans.fields import FieldRule, date_copy, direct, name
from .service import Dataset

REFERENCE = "1996-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("k"), F.concat_ws("-", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string")).alias("entity"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("job"),
        F.to_date("o_orderdate").alias("entry"), (F.col("o_orderkey") % 200).alias("position"), F.col("c_nationkey").cast("long").alias("reason"), F.col("c_name").alias("name"), F.col("o_totalprice").alias("amount"), F.col("c_mktsegment").alias("segment"), "o_custkey",
    )


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return source(spark, sf_dir).where(k % 29 != 0).withColumns({
        "type": F.when(k % 31 == 0, "X").otherwise(F.col("type")), "job": F.when(k % 17 == 0, "RECODED").otherwise(F.col("job")), "entry": F.when(k % 13 != 0, F.col("entry")),
        "name": F.when(k % 11 == 0, F.lower("name")).otherwise(F.col("name")), "amount": F.when(k % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount")),
    })


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("position"), F.to_date("l_shipdate").alias("effective"), F.col("l_suppkey").alias("unit"), F.col("l_quantity").alias("hours"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("line"))


ORDER = ["ok", "line", "unit", "hours"]


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("access"), F.col("n_name").alias("code"))


def known_pairs(spark: SparkSession, sf_dir: str, changed: dict | None = None) -> DataFrame:
    """Records paired on their key (source-only ones too). ``changed``: columns to set in the target record."""
    s, d = source(spark, sf_dir), target(spark, sf_dir)
    if changed:
        d = d.withColumns(changed)
    left, right = s.select(F.col("k").alias("_k"), F.struct("*").alias("s")), d.select(F.col("k").alias("_dk"), F.struct("*").alias("d"))
    pairs = left.join(right, F.col("_k") == F.col("_dk"), "left")
    return pairs.select(F.col("_k").alias("pair_id"), F.col("s.entity").alias("entity"), F.col("s.type").alias("kind"), F.col("s.position").cast("string").alias("position"), F.col("s.job").alias("job"), "s", "d")


def streamed_pairs(orders: DataFrame) -> DataFrame:
    """Pairs from a stream of orders: amount and type of each record, as in the source and as in the target."""
    k = F.col("o_orderkey")
    amount, kind = F.col("o_totalprice"), F.col("o_orderstatus")
    s = F.struct(amount.alias("amount"), kind.alias("type"))
    d = F.struct(F.when(k % 7 == 0, amount + 1).otherwise(amount).alias("amount"), F.when(k % 31 == 0, "X").otherwise(kind).alias("type"))
    return orders.where(k % 29 != 0).select(k.alias("pair_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), s.alias("s"), d.alias("d"))


def solved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records paired by score inside each entity."""
    return pair_records(source(spark, sf_dir), target(spark, sf_dir), ("entity",) * 2, ("job",) * 2, ("type",) * 2, ("entry",) * 2, ("k",) * 2)


STAR_RULES = [
    FieldRule("amount", "amount", "R-DIRECT", direct("amount", "amount")),
    FieldRule("type", "type", "R-DIRECT", direct("type", "type")),
    FieldRule("job", "job", "R-DIRECT", direct("job", "job")),
    FieldRule("entry", "entry", "R-DIRECT", date_copy("entry", "entry")),
    FieldRule("name", "name", "R-NOM", name("name", "name")),
]


#: Fields whose rule leaves rows open; the columns that may leave the cluster, and those that do so as fakes only.
OPEN = ["name"]
IDENTIFIERS = {"src_name": "surname", "src_o_custkey": "id"}
ALLOWED = {"src_type", "src_job", "src_entry", "src_segment", "src_amount"}


def identified_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity(solved_pairs(spark, sf_dir), {"kind": ("type", "type"), "position": ("position", "position"), "job": ("job", "job")})


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset(identified_pairs(spark, sf_dir), STAR_RULES)
