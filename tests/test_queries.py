"""Every core query against its SQL, as the driver does it."""

import os

import duckdb
import pytest

from mosaiq import queries as q
from mosaiq import queries_io, queries_shapes  # noqa: F401  they add their queries

SLOW = {"baatz_converged", "srm_converged", "absorbed_converged"}


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{sf_dir}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_and_sql(spark, sql, sf_dir, name):
    df = q.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    asked = sql.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(names) == columns
    expected = sorted(tuple(row[names.index(c)] for c in columns) for row in asked.fetchall())
    assert sorted(tuple(r) for r in df.select(columns).collect()) == expected


def test_tiles_of_a_high_raster(spark, tmp_path):
    """More than a hundred rows of tiles: the SQL has them all."""
    spark.createDataFrame([(k, "a", 1.0, 1) for k in range(0, 100 * 30 * 120, 1000)], "event_id long, event_type string, value double, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    expected = c.execute(q.ORACLE_SQL["tiles"]).fetchall()
    assert len(expected) == 4 * 120 and sorted(expected) == sorted(tuple(r) for r in q.QUERIES["tiles"](spark, str(tmp_path)).collect())


def test_queries_without_sql(spark, sf_dir):
    """What they give is held against what must be so; merging to its end and mean shift have tests of their own."""
    rows = {name: q.QUERIES[name](spark, sf_dir).collect() for name in sorted(set(q.QUERIES) - set(q.ORACLE_SQL) - SLOW)}
    pixels = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    modes = rows.pop("meanshift_labels")
    assert sorted(r.pix for r in modes) == list(range(pixels)) and all(r.node <= r.pix for r in modes) and {r.node for r in modes} <= {r.pix for r in modes if r.pix == r.node}
    assert not rows
