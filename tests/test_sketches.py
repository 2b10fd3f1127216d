import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from gneiss.operators import profile, sketches


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(6_000).selectExpr("date_add(DATE'2024-01-01', int(id % 12)) AS day", "id % 700 AS k", "IF(id % 10 = 0, NULL, pmod(xxhash64(id), 9973) / 7.0) AS x", "concat('v', id % 9) AS name", "id % 3 = 0 AS flag", "array(id % 5) AS parts", "IF(id % 4 = 0, DOUBLE('nan'), -0.0) AS odd").repartition(5).cache()


def close(got, exact):
    for c, e in exact.items():
        g = got[c]
        assert (g.row_count, g.null_count) == (e.row_count, e.null_count)
        assert abs(g.distinct_count - e.distinct_count) <= 0.06 * e.distinct_count + 1
        if c in ("k", "x"):
            assert (g.min_num, g.max_num) == (pytest.approx(e.min_num, abs=1e-5), pytest.approx(e.max_num, abs=1e-5))
            assert (g.mean, g.stddev) == (pytest.approx(e.mean, abs=1e-5), pytest.approx(e.stddev, abs=1e-5))
            assert abs(g.median - e.median) < 0.05 * (e.max_num - e.min_num)


def by_name(df):
    return {r.column_name: r for r in df.collect()}


def test_merged_parts_are_the_whole(spark, table):
    parts = sketches.sketched(table, F.col("day"), [c for c in table.columns if c != "day"])
    assert parts.count() == 12 * 6
    close(by_name(sketches.merged(parts)), by_name(profile.table_stats(table.drop("day"))))
    some = parts.where("part < DATE'2024-01-05'")
    close(by_name(sketches.merged(some)), by_name(profile.table_stats(table.where("day < DATE'2024-01-05'").drop("day"))))
    top = [(r.column_name, r.value, r.frequency, r["rank"]) for r in sketches.merged_top(parts, 5).where("column_name = 'name'").orderBy("rank").collect()]
    want = profile.top_values(table.select("name")).where("rank <= 5").orderBy("rank").collect()
    assert top == [(r.column_name, r.value, r.frequency, r["rank"]) for r in want]


def test_empty_parts_and_columns(spark, table):
    parts = sketches.sketched(table.withColumn("x", F.lit(None).cast("double")).limit(0), F.col("day"), ["x", "name"])
    assert sketches.merged(parts).count() == 0
    nulls = by_name(sketches.merged(sketches.sketched(spark.range(3).selectExpr("CAST(NULL AS DOUBLE) AS x", "CAST(NULL AS STRING) AS s"), F.lit(1))))
    assert (nulls["x"].median, nulls["x"].mean, nulls["x"].distinct_count, nulls["s"].null_count) == (None, None, 0, 3)
    assert sketches.merged_top(sketches.sketched(spark.range(3).selectExpr("CAST(NULL AS STRING) AS s"), F.lit(1))).count() == 0


def test_only_changed_days_are_read_and_written(spark, table, tmp_path):
    path = str(tmp_path / "sketches")
    versions = spark.createDataFrame([(dt.date(2024, 1, 1 + i), "1") for i in range(12)], "part date, version string")
    first = by_name(sketches.merged(sketches.refresh(table, "day", versions, path)))
    close(first, by_name(profile.table_stats(table.drop("day"))))
    files = lambda: {p.parent.name: p.name for p in pathlib.Path(path).rglob("*.parquet")}
    before = files()
    assert len(before) == 12
    again = sketches.refresh(table.where("1 / (k - k) > 0"), "day", versions, path)  # would fail, were any row read
    assert files() == before and by_name(sketches.merged(again)).keys() == first.keys()
    third = F.col("day") == F.lit(dt.date(2024, 1, 3))
    changed = table.withColumn("k", F.when(third, F.col("k") * 1000).otherwise(F.col("k"))).where(third | (F.col("day") < F.lit(dt.date(2024, 1, 11))))
    newer = versions.where("part < DATE'2024-01-11'").withColumn("version", F.when(F.col("part") == F.lit(dt.date(2024, 1, 3)), "2").otherwise(F.col("version")))
    got = by_name(sketches.merged(sketches.refresh(changed, "day", newer, path)))
    close(got, by_name(profile.table_stats(changed.drop("day"))))
    after = files()
    assert {d for d in before if before[d] != after[d]} == {"part=2024-01-03"}
