"""Every query of the subpackage that has SQL, against DuckDB: values, columns and types."""
import pytest

from conftest import SF_SMALL
from oracle_harness import compare, duck
from tidemark.llm import registry

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, name, registry.QUERIES[name], registry.ORACLE_SQL[name], SF_SMALL)
    assert ok, message
    relation = con.sql(registry.ORACLE_SQL[name])
    types = {f.name: f.dataType.simpleString() for f in registry.QUERIES[name](spark, SF_SMALL).schema.fields}
    assert types == {c: TYPES[str(t)] for c, t in zip(relation.columns, relation.types)}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
