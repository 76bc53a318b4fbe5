"""Every registered query against its DuckDB oracle at sf0.01 (the driver's correctness gate)."""
import pytest

import __spark_entry__ as E
from conftest import SF_ORACLE
from oracle_harness import compare, duck

QUERIES = E.QUERIES      # the optional subpackage has tests of its own
ORACLE = E.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_ORACLE)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["consumer_group", "topic", "partition", "committed", "new_offset"]
    assert df.count() >= 0


DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_types_match_oracle(spark, con, name):
    spark_types = {f.name: f.dataType.simpleString() for f in QUERIES[name](spark, SF_ORACLE).schema.fields}
    rel = con.sql(ORACLE[name])
    duck_types = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types
