from ledgerloom.operators.overrides import SCHEMA, apply_overrides
from ledgerloom.streaming.overrides import current, stream_overridden, write_changes

ROWS = "id string, field string, signature string, verdict string, layer string, confidence double, explanation string, path string, day date, at timestamp, `a b` double"


def row(i, field="f", signature="a → 9", verdict="ANOMALY", layer="RULE"):
    return (f"r{i}", field, signature, verdict, layer, 0.1 * i, None if i % 3 else f"said {i}", "p" if i % 2 else None, None, None, None if i % 4 else 1 / 3)


def entry(n, scope, verdict, id=None, signature=None, field="f", comment="c"):
    return (n, f"2024-01-0{n + 1}", field, scope, verdict, id, signature, comment)


VERDICTS = [(None, *row(1)[1:]), row(1), row(2, signature="", verdict="MATCH"), row(3), row(4, field="g"), row(5, layer="EXPERT"), row(6, signature=None)]
SAID = [
    entry(0, "pattern", "JUSTIFIED", signature="a → 9"), entry(1, "row", "MATCH", "r1"), entry(2, "pattern", "ANOMALY", signature="a → 9", comment=None), entry(3, "row", "ANOMALY", "r2"),
    entry(4, "row", "MATCH", "never"), entry(5, "pattern", "MATCH", signature=""), entry(6, "row", "ANOMALY", "r5", comment=""),
]


class Streams:
    """Both streams as folders of files; one call of ``add`` is one micro-batch."""

    def __init__(self, spark, folder, salts=3):
        self.spark, self.folder = spark, folder
        for name in ("rows", "said"):
            (folder / name).mkdir(parents=True)
        read = lambda name, schema: spark.readStream.schema(schema).parquet(str(folder / name))
        self.changes = stream_overridden(read("rows", ROWS), read("said", SCHEMA), salts)

    def add(self, rows=(), said=()):
        for name, part, schema in (("rows", rows, ROWS), ("said", said, SCHEMA)):
            if part:
                self.spark.createDataFrame(list(part), schema).coalesce(1).write.mode("append").parquet(str(self.folder / name))
        write_changes(self.changes, str(self.folder / "out"), str(self.folder / "state"))

    def table(self):
        return current(self.spark.read.parquet(str(self.folder / "out")))


def plain(df):
    return sorted(map(repr, df.collect()))


def test_any_order_of_micro_batches(spark, tmp_path):
    expected = plain(apply_overrides(spark.createDataFrame(VERDICTS, ROWS), spark.createDataFrame(SAID, SCHEMA)))
    orders = {
        "rows_first": [(VERDICTS, ()), ((), SAID)],
        "overrides_first": [((), SAID), (VERDICTS, ())],
        "backwards": [((), SAID[4:]), (VERDICTS[3:], ()), ((), SAID[1:4]), (VERDICTS[:3], SAID[:1])],
    }
    for name, batches in orders.items():
        streams = Streams(spark, tmp_path / name)
        for rows, said in batches:
            streams.add(rows, said)
        assert plain(streams.table()) == expected, name


def test_corrects_and_repeats(spark, tmp_path):
    streams = Streams(spark, tmp_path, 1)
    rows = [row(i) for i in range(200)]  # one signature
    streams.add(rows[:150])
    assert streams.table().where("id = 'r1'").first()["verdict"] == "ANOMALY"
    streams.add(rows[150:], SAID[:2])
    assert streams.table().where("id = 'r1'").first()["verdict"] == "MATCH"
    streams.add(rows[:3] + [row(1, signature="b")], SAID[:2])  # sent again, and another row of one id
    both = [*rows, row(1, signature="b")]
    assert plain(streams.table()) == plain(apply_overrides(spark.createDataFrame(both, ROWS), spark.createDataFrame(SAID[:2], SCHEMA)))
    assert spark.read.parquet(str(tmp_path / "out")).where("id = 'r150'").count() == 2  # as it came, and overridden
