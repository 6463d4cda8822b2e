import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidewater.session import local

    s = local("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def duck(sf: str):
    """DuckDB with a view for each table."""
    import duckdb

    c = duckdb.connect()
    for p in (DATA / sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def rows_of(df) -> list:
    """Rows of a pandas frame as comparable text, whatever their order; columns by name."""
    cols = sorted(df.columns)
    return sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


def same_as_sql(spark, name: str, sf: str = "sf0.001") -> None:
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, str(DATA / sf)).toPandas()
    want = duck(sf).sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
