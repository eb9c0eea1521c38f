"""Every named query against DuckDB on the smallest tables."""

import re

import pytest

from offerlens.plans import registry
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    sql = registry.oracle_sql().get(name)
    if sql:
        same_rows(df, duck.execute(sql).to_arrow_table())
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship_plan_prunes_columns(spark):
    plan = registry.queries()["q01_representative_topk"](spark, SMALL)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "Python" not in plan
    assert "l_tax" not in plan.split("== Physical Plan ==")[1]


def test_claims_are_stated():
    """Every query says which items of the survey it covers, and what is left out on purpose is listed."""
    from pathlib import Path

    for name, f in registry.queries().items():
        assert re.match(r"(?:[A-N]\d*(?:\.\d+)?(?:, | to |: ))+", registry.documentation()[name]), name
    left_out = Path(__file__).resolve().parents[1].joinpath("README.md").read_text().split("## Left out on purpose")[1].split("\n## ")[0]
    assert all(re.search(rf"\b{item}\b", left_out) for item in "A6 A9 A10 A16 A17 D10 F19 L10 L13".split())
