import os

import pytest

from lectern.llm.queries import QUERIES, SQL

from .. import oracle

DATA = os.environ.get("LECTERN_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": [("script_id", "bigint"), ("line_no", "bigint"), ("noise", "string")], "p2_found": [("csv_id", "bigint"), ("marker_id", "bigint")], "p3_found": [("field", "string"), ("row_id", "bigint"), ("ref_id", "bigint")],
    "p5_found": [("comparison_id", "bigint")], "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    oracle.check(spark, oracle.tables(DATA), QUERIES[name], SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_with_its_columns(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0 and (name not in COLUMNS or df.dtypes == COLUMNS[name])
