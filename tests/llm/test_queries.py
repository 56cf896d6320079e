"""Every query with SQL against its SQL; what native operators must not contain; names."""

import re
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]
from compare import connect, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from chatlens.llm import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    ours = catalog.queries()[name](spark, SF).toPandas()
    assert differences(ours, connect(SF).execute(catalog.oracle_sql()[name]).df()) is None


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for number in range(1, 14):
        assert len([name for name in names if name.startswith(f"op{number}_")]) == 1


@pytest.mark.parametrize("name", ["op5_hilbert_sharding", "op6_source_mixing"])
def test_native_operators_run_no_python(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Pandas|MapInArrow|CartesianProduct", plan)
