"""Every registered query of the library against its SQL, on the smallest tables."""

import pathlib

import duckdb
import pytest

from gneiss.plans import analytics, catalogue, lineage, metadata, profiling, registry  # noqa: F401

SMALL = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def cells(rows):
    out = []
    for row in rows:
        out.append(tuple(None if v is None or v != v else f"{float(v):.8g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).removesuffix(" 00:00:00") for v in row))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, connection, name):
    got = registry.QUERIES[name](spark, str(SMALL))
    want = connection.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert cells(tuple(r[c] for c in names) for r in got.collect()) == cells(want.fetchall())


def test_the_rest_has_rows(spark):
    assert registry.QUERIES["profile_lineitem_approximate"](spark, str(SMALL)).count() == 11


@pytest.mark.parametrize("name", ["closure_upstream", "closure_downstream", "closure_cyclic"])
def test_closures_end_at_the_depth_of_their_sql(spark, tmp_path, name):
    c = duckdb.connect()
    c.execute(f"CREATE TABLE part AS SELECT CAST(1 AS BIGINT) << i AS p_partkey, * EXCLUDE (p_partkey, i) FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM '{SMALL}/part.parquet') WHERE i < 30")
    c.execute(f"CREATE TABLE supplier AS FROM '{SMALL}/supplier.parquet'")
    for t in ("part", "supplier"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path)).select("node", "depth")
    assert cells(got.collect()) == cells(c.execute(registry.ORACLE_SQL[name]).fetchall())


def test_closure_upstream_has_no_last_depth(spark, tmp_path):
    c = duckdb.connect()
    keys = [1 << i for i in range(45)] + [3 << 30]
    c.execute("CREATE TABLE part AS SELECT unnest(?::BIGINT[]) AS p_partkey", [keys])
    c.execute("CREATE TABLE supplier AS SELECT unnest([1::BIGINT << 44, 3]) AS s_suppkey")
    for t in ("part", "supplier"):
        c.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    rows = [tuple(r) for r in registry.QUERIES["closure_upstream"](spark, str(tmp_path)).select("node", "depth").collect()]
    far = {n: depth for n, depth in rows if n.split(".")[1] == "d"}
    assert len(rows) == len(dict(rows))
    assert far == {**{f"model.d.{1 << i}": i + 1 for i in range(45)}, f"source.d.{1 << 44}": 46}
    assert cells(rows) == cells(c.execute(registry.ORACLE_SQL["closure_upstream"]).fetchall())


def test_templates_of_one_file_are_read_by_many_tasks(spark, tmp_path):
    part = spark.read.parquet(f"{SMALL}/part.parquet").select("p_partkey", "p_brand", "p_size", "p_name")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = registry.QUERIES["templated_sql_parts"](spark, str(tmp_path))
    sizes = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) >= 8 and max(sizes) < 2 * sum(sizes) / len(sizes)
