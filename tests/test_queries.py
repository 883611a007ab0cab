"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest
from compare import compare
from conftest import SF

from tracewell.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    said = compare(spark, name, SF, registry.queries(), registry.oracle_sql())
    assert "match" in said if name in registry.oracle_sql() else "no SQL" in said, said


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark)
    assert rows.columns == ["session_id", "turn", "topic_id", "is_switch"] and rows.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
