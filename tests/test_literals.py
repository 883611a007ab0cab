import duckdb
import literal_queries
import pytest
from compare import rows_of


@pytest.mark.parametrize("name", literal_queries.QUERIES)
def test_rule_on_literal_rows(spark, name):
    df = literal_queries.QUERIES[name](spark, "")
    cur = duckdb.connect().execute(literal_queries.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([x[0] for x in cur.description], cur.fetchall())
