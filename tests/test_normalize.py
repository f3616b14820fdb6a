from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import normalize as n


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "number"), [("12", 12.0), (" 1.5 ", 1.5), ("-3e2", -300.0), ("12D", None), ("12f", None), ("nan", None), ("", None), (None, None), (".5", 0.5)])
def test_to_num(spark, text, number):
    assert one(spark, n.to_num(F.col("t")), t=text) == number


@pytest.mark.parametrize(("text", "key"), [("2020-01-02T03:04", "2020-01-02"), ("20200102", "2020-01-02"), ("01/02/2020", "2020-01-02"), ("soon", "soon"), (" ", None), (None, None)])
def test_date_key(spark, text, key):
    assert one(spark, n.date_key(F.col("t")), t=text) == key


@pytest.mark.parametrize(("a", "b", "equal"), [("00123", "123", True), ("1.0", "1", True), ("a", " a ", True), (None, "", True), (None, "x", False), ("nan", "nan", True), ("1", "2", False)])
def test_same(spark, a, b, equal):
    assert one(spark, n.same(F.col("a"), F.col("b")), a=a, b=b) is equal


@pytest.mark.parametrize(("raw", "mended"), [("complÃ¨te", "complète"), ("complète", "complète"), ("日本", "日本"), (None, None)])
def test_mojibake(spark, raw, mended):
    assert one(spark, n.fix_mojibake(F.col("t")), t=raw) == mended


@pytest.mark.parametrize(("raw", "shape"), [("AB-12", "a-9"), ("été", "a"), (None, "∅"), ("x1y22", "a9a9"), ("m²", "a")])
def test_shape(spark, raw, shape):
    assert one(spark, n.shape(F.col("t")), t=raw) == shape


@pytest.mark.parametrize(("a", "b", "equal"), [("0012-x", "12-x", True), ("12-x", "12-y", False), ("ab-x", "ab-x", False), (None, "1-x", False), ("12", "12", False)])
def test_padded_equal(spark, a, b, equal):
    assert one(spark, n.padded_equal(F.col("a"), F.col("b")), a=a, b=b) is equal


def test_rest(spark):
    assert one(spark, n.to_str(F.col("v")), v=12.0) == "12"
    assert one(spark, n.to_str(F.col("v")), v=float("nan")) is None
    assert one(spark, n.strip_accents(F.col("t")), t="Éà çñü") == "Ea cnu"
    assert one(spark, n.to_bool(F.col("t")), t=" Oui") is True and one(spark, n.to_bool(F.col("t")), t="non") is False
    assert one(spark, n.pad_five(F.col("t")), t="123456") == "123456" and one(spark, n.pad_five(F.col("t")), t="12") == "00012"
    assert one(spark, n.excel_date(F.col("t")), t="43831") == date(2020, 1, 1)
    assert one(spark, n.row_id(F.col("a"), F.col("b")), a="x", b=None) == "x/-"


@pytest.mark.parametrize("column, plain", [(n.strip_accents, n.without_marks), (n.case_fold, str.casefold)])
def test_foldings_of_all_characters(spark, column, plain):
    """Each character alone, and texts of 64 in a row, so that a letter's neighbours make no difference."""
    chars = spark.range(0x110000).where("id not between 55296 and 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("t"))
    texts = chars.groupBy(F.floor(F.col("id") / 64)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x.t), "").alias("t"))
    mixed = texts.select(F.concat(F.lit("Aé"), "t", F.lit("ΑΣ ﬁ한Z")).alias("t"))

    def wrong(batches):
        for batch in batches:
            yield batch[[plain(t) != f for t, f in zip(batch["t"], batch["f"], strict=True)]]

    both = chars.select("t").unionByName(mixed).repartition(8).withColumn("f", column(F.col("t")))
    assert both.count() == 0x110000 - 2048 + 0x110000 // 64 - 32
    assert both.mapInPandas(wrong, "t string, f string").limit(5).collect() == []
    assert [r["f"] for r in spark.createDataFrame([(None,), ("",)], "t string").select(column(F.col("t")).alias("f")).collect()] == [None, ""]
