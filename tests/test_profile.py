import datetime as dt
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from gneiss.operators import profile


@pytest.fixture(scope="module")
def orders(spark):
    day = lambda d: dt.date(2024, 1, d)
    rows = [(i + 1, [10, 20, 30, 40, 50][i % 5] if i != 5 else None, ["completed", "pending", "cancelled"][i % 3], Decimal(i * 10) if i != 3 else None, day(15 + i + (i > 4)) if i != 5 else None, i % 2 == 0 if i != 5 else None, [i]) for i in range(10)]
    return spark.createDataFrame(rows, "order_id int, customer_id int, status string, amount decimal(10,2), order_date date, is_active boolean, parts array<int>")


def stats(df, **kw):
    return {r.column_name: r for r in profile.table_stats(df, **kw).collect()}


def test_one_row_per_column(orders):
    got = stats(orders)
    assert {k: v.category for k, v in got.items()} == {"order_id": "numeric", "customer_id": "numeric", "status": "string", "amount": "numeric", "order_date": "date", "is_active": "boolean", "parts": "other"}
    assert (got["order_id"].row_count, got["order_id"].distinct_count, got["order_id"].is_unique, got["order_id"].min_num, got["order_id"].max_num) == (10, 10, True, 1, 10)
    assert (got["amount"].null_count, got["amount"].null_rate) == (1, 0.1)
    assert got["status"].min_len == 7 and got["status"].max_len == 9
    assert got["order_date"].min_text == "2024-01-15" and got["parts"].distinct_count == 10


def test_empty_and_all_null(spark, orders):
    got = stats(orders.limit(0))
    assert all(r.row_count == 0 and r.null_rate == 0 and r.distinct_rate == 0 and not r.is_unique for r in got.values())
    nulls = stats(spark.createDataFrame([(None, None)] * 3, "a double, b string"))
    assert nulls["a"].null_rate == 1 and nulls["a"].median is None and nulls["b"].distinct_count == 0


def test_date_keys(spark):
    df = spark.createDataFrame([(20240115, 1), (20240120, 2), (2024012, 3), (20249999, 4), (None, 5)], "order_date_key bigint, amount_key_x bigint")
    got = stats(df)
    assert got["order_date_key"].category == "date_key" and got["amount_key_x"].category == "numeric"
    assert (got["order_date_key"].min_text, got["order_date_key"].max_text) == ("2024-01-15", "2024-01-20")


def test_top_values_gate_and_withheld(orders):
    made = profile.table_stats(orders)
    got = profile.top_values(orders, made, threshold=5, withheld=["status"]).collect()
    assert {r.column_name for r in got} == {"customer_id", "is_active"}
    first = [r for r in got if r.column_name == "is_active" and r.rank == 1][0]
    assert first.value == "true" and first.frequency == 5
    assert profile.top_values(orders, made, threshold=0).count() == 0


def test_histogram_fills_empty_bins_and_needs_spread(spark):
    df = spark.createDataFrame([(0.0, 1)] * 3 + [(10.0, 1)], "x double, same int")
    got = profile.histogram(df, profile.table_stats(df)).orderBy("bin").collect()
    assert [r.frequency for r in got] == [3] + [0] * 8 + [1] and {r.column_name for r in got} == {"x"}
    assert (got[0].low, got[-1].high) == (0.0, 10.0)


def test_gaps(orders):
    got = profile.temporal_gaps(profile.temporal(orders)).collect()
    assert [(str(r.gap_start), str(r.gap_end), r.missing_days) for r in got] == [("2024-01-20", "2024-01-21", 2)]


def test_names_with_quotes(spark):
    df = spark.createDataFrame([(1, "a")], T.StructType([T.StructField("odd`na.me", T.IntegerType()), T.StructField("b c", T.StringType())]))
    assert set(stats(df)) == {"odd`na.me", "b c"} and profile.row_search(df, "A").count() == 1


@pytest.mark.parametrize(("name", "column", "kind"), [("DECIMAL(10,2)", "x", "numeric"), ("bigint", "order_date", "date_key"), ("TIMESTAMP_NTZ", "x", "date"), ("INTERVAL", "x", "numeric"), ("VARCHAR[]", "x", "string"), ("BOOL", "x", "boolean"), ("BLOB", "x", "other")])
def test_type_names(name, column, kind):
    assert profile.classify_name(name, column) == kind


def test_sorted_table(spark):
    df = spark.createDataFrame([("item 10",), ("Item 2",), (None,), ("item 1",)], "n string")
    assert [r.n for r in profile.sorted_table(df, "n").collect()] == ["item 1", "Item 2", "item 10", None]
    assert [r.n for r in profile.sorted_table(df, "n", True).collect()] == [None, "item 10", "Item 2", "item 1"]


INF, NAN = float("inf"), float("nan")
VALUES = [
    [1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [5.0] * 9 + [-1e9, 1e9], [float(x * x % 97) / 7 for x in range(501)], [0.1, 0.1, 0.3, 0.3], [None, None, 4.0, None], [None],
    [1.0, 2.0, INF], [-INF, 1.0, INF], [INF, INF, 1.0], [INF], [-1e308, 1e308, 1e308], [1.7e308, 1.7e308, 1.7e308, -1.7e308], [-0.0, 0.0, 1.0], [5e-324, 1e-323, 1.5e-323, 1e308], [NAN, NAN, 1.0, INF, NAN], [NAN],
]


@pytest.mark.parametrize("values", VALUES, ids=range(len(VALUES)))
def test_exact_medians(spark, values):
    real = sorted(v for v in values if v is not None and v == v)
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = statistics.median(real[(len(real) - 1) // 2 : len(real) // 2 + 1] if len(set(real[(len(real) - 1) // 2 : len(real) // 2 + 1])) > 1 else real[len(real) // 2 :][:1]) if real else None
    assert stats(df)["x"].median == (pytest.approx(want, abs=1e-6) if want is not None else None)
    for near in ((real[0], real[-1]), (real[-1], real[-1]), (-5.0, -4.0), (INF, INF)) if real else ():  # bounds that a sketch would not give
        assert profile.exact_medians(df, {"x": (len(real), *near)}) == {"x": pytest.approx(want)}


def test_medians_by_several_passes(spark, monkeypatch):
    df = spark.range(40_000).selectExpr("pmod(xxhash64(id), 30001) / 7.0 - 900 AS x", "IF(id % 3 = 0, DOUBLE('inf'), id) AS y", "IF(id % 10 < 6, 4.0, id) AS z", "CAST(id AS DECIMAL(12, 2)) AS d").repartition(4)
    rows = df.collect()
    want = {c: sorted(float(r[c]) for r in rows)[19_999:20_001] for c in df.columns}
    passes, run = [], profile._sketched_between
    monkeypatch.setattr(profile, "_sketched_between", lambda *a: passes.append(0) or run(*a))
    for near in ((0.0, 1.0), (-1e9, 1e9), (4.0, 4.0)):
        passes.clear()
        assert profile.exact_medians(df, {c: (40_000, *near) for c in want}, held=40) == {c: pytest.approx(sum(v) / 2) for c, v in want.items()}
        assert 1 <= len(passes) <= 7


def test_statistics_of_infinite_columns(spark):
    got = stats(spark.createDataFrame([(1.0, -1e308), (2.0, 1e308), (INF, 0.0)], "x double, y double"))
    assert (got["x"].min_num, got["x"].max_num, got["x"].mean, got["x"].median) == (1.0, INF, INF, 2.0) and got["y"].median == 0.0
    df = spark.createDataFrame([(1.0, 1), (INF, 2)], "x double, y int")
    assert {r.column_name for r in profile.histogram(df).collect()} == {"y"} == {r.column_name for r in profile.histogram(df, profile.table_stats(df)).collect()}


def test_not_a_number(spark):
    got = stats(spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (float("nan"),)], "x double"))["x"]
    assert (got.median, got.distinct_count) == (1.5, 3)


def test_distinct_counts_of_all_kinds(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(1, 2**60 + i % 3, i % 2 == 0, Decimal(i % 4), day + dt.timedelta(hours=i % 5), "x" * 100 + str(i % 6), bytes([i % 7]), [i % 8], 0.5 * (i % 9), None) for i in range(2520)]
    df = spark.createDataFrame(rows, "a int, b bigint, c boolean, d decimal(10,2), e timestamp_ntz, f string, g binary, h array<int>, i double, j string")
    assert {k: v.distinct_count for k, v in stats(df).items()} == {"a": 1, "b": 3, "c": 2, "d": 4, "e": 5, "f": 6, "g": 7, "h": 8, "i": 9, "j": 0}


def test_sketches_are_close(spark):
    df = spark.range(50_000).selectExpr("id", "id % 777 AS k", "CAST(id AS STRING) AS s", "sqrt(id) AS r")
    exact, near = stats(df), stats(df, approximate=True)
    for c, e in exact.items():
        assert abs(near[c].distinct_count - e.distinct_count) <= 0.15 * e.distinct_count
        assert e.median is None or abs(near[c].median - e.median) <= 0.01 * abs(e.median) + 1
        assert (near[c].row_count, near[c].min_num, near[c].max_num, near[c].mean) == (e.row_count, e.min_num, e.max_num, e.mean)


def test_top_values_without_stats(orders):
    got = profile.top_values(orders, threshold=5, withheld=["status"])
    assert {r.column_name for r in got.collect()} == {"customer_id", "is_active"}
    made = profile.top_values(orders, profile.table_stats(orders), threshold=5, withheld=["status"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, made.collect()))


def test_numbered(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS x").repartition(9)
    assert all(r.place == r.x + 1 for r in profile.numbered(df, [df.x]).collect())
