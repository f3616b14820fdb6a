from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def plain(rows):
    word = lambda v: round(v, 6) if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else float(v) if type(v).__name__ in ("int", "Decimal") else v
    return sorted((tuple(word(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["norm_same", "pair_score", "history_asof", "rule_situation", "rule_start", "crosstab_field", "signature_share", "priority", "override_pattern", "f1_pivot", "experiment", "tree_leave_one_out"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = entry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_learned_split_makes_its_verdicts_once(spark):
    df = entry.queries()["learned_split"](spark, str(DATA))
    assert {x.split("/")[-2][:5] for x in df.inputFiles()} == {"kept-"}  # no table is read again
