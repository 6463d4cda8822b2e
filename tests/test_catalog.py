import pytest

from tests.conftest import DATA, same_as_sql
from tidewater.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    same_as_sql(spark, name)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_stepwise_operators_run(spark, name):
    assert catalog.queries()[name](spark, str(DATA / "sf0.001")).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["o_orderkey", "rank", "score", "reason", "completeness"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_optional_part_is_not_imported_by_the_rest():
    import re
    from pathlib import Path

    root = Path(catalog.__file__).resolve().parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"(from|import) [\w.]*\bllm\b", f.read_text()), f
