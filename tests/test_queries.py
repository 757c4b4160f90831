"""Every registered query with SQL gives the rows that DuckDB gives."""

from pathlib import Path

import pandas as pd
import pytest

from krylite import catalog

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if x is None or x is pd.NA or x != x else str(x) if hasattr(x, "isoformat") else float(x) if not isinstance(x, (str, bool)) else x for x in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, str(SMALL)).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_does_not_need_the_text_operators():
    source = Path(catalog.__file__).parent
    for p in source.rglob("*.py"):
        if "llm" not in p.parts:
            assert "krylite.llm" not in p.read_text() and ".llm" not in p.read_text()
