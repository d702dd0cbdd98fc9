import pytest
from oracle import compare

from strandframe.llm.queries import REG


@pytest.mark.parametrize("name", sorted(REG.sql))
def test_against_sql(spark, name):
    compare(spark, REG, name)
