import duckdb
import pytest
from checks import connection, same

from findoc.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    same(registry.QUERIES[name](spark, sf), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["vector_normalise", "vector_upsert"])
def test_components_round_as_in_sql(spark, tmp_path, name):
    rows = [(3, [0.6, -0.8, 1e-7, -1e-7, 0.0]), (4, [0.6, -0.8, 1e-7, -1e-7, 0.0]), (6, [-123456.25, 0.015625, 0.5, -0.0000049, -0.3]), (7, [3e9, -0.015625, 0.5, -0.0000049, -0.3])]
    spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(registry.ORACLES[name] + " ORDER BY vec_id").fetchall()
    got = registry.QUERIES[name](spark, str(tmp_path)).orderBy("vec_id").collect()
    assert "-0.0" in repr(want)
    assert [repr(tuple(r)) for r in got] == [repr(r) for r in want]  # as printed: the sign of a zero counts


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:2] == ["query_id", "chunk_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
