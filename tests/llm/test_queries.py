import __spark_entry__ as entry
import pytest
from compare import SF, check

from siltstone.llm.queries import QUERIES, SQL

COLUMNS = {"p1_found": ["id", "defect_type"], "p3_found": ["record_id"], "p7_found": ["doc_id"], "p8_found": ["doc_id", "eval_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, name):
    check(spark, name, QUERIES[name], SQL.get(name), SF)


def test_columns(spark):
    assert all(entry.queries()[k](spark, SF).columns == v for k, v in COLUMNS.items())
