import pytest

import oracle
from cloakline.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), name, registry.queries()[name], registry.oracle_sql()[name], SF) is None
