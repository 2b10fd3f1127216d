"""Profiling queries over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import erd, graph, profile, sketches
from .registry import query, table

#: Columns by category, as the classifier should find them; the SQL is made from these alone.
KINDS = {
    "lineitem": "l_orderkey:numeric l_partkey:numeric l_suppkey:numeric l_linenumber:numeric l_quantity:numeric l_extendedprice:numeric l_discount:numeric l_tax:numeric l_returnflag:string l_linestatus:string l_shipdate:date",
    "orders": "o_orderkey:numeric o_custkey:numeric o_orderstatus:string o_totalprice:numeric o_orderdate:date o_orderpriority:string",
    "customer": "c_custkey:numeric c_name:string c_nationkey:numeric c_acctbal:numeric c_mktsegment:string",
    "supplier": "s_suppkey:numeric s_name:string s_nationkey:numeric s_acctbal:numeric",
    "part": "p_partkey:numeric p_name:string p_brand:string p_type:string p_size:numeric p_retailprice:numeric",
    "events": "event_id:numeric ts:date user_id:numeric event_type:string value:numeric props:string",
    "documents": "doc_id:numeric text:string lang:string source:string n_chars:numeric",
    "nation": "n_nationkey:numeric n_name:string n_regionkey:numeric",
}


def _columns(name: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in KINDS[name].split()]


def stats_sql(name: str, source: str | None = None) -> str:
    """One SELECT per column, put together."""
    out = []
    for c, kind in _columns(name):
        num = lambda f, k=kind: f"round({f} + 1e-10, 6)" if k == "numeric" else "CAST(NULL AS DOUBLE)"
        length = lambda f, k=kind, t="BIGINT": f"CAST({f} AS {t})" if k == "string" else f"CAST(NULL AS {t})"
        day = lambda f, c=c, k=kind: f"strftime({f}({c}), '%Y-%m-%d')" if k == "date" else "CAST(NULL AS VARCHAR)"
        out.append(f"""SELECT '{c}' AS column_name, '{kind}' AS category, count(*) AS row_count, count(*) - count({c}) AS null_count, CASE WHEN count(*) > 0 THEN round((count(*) - count({c})) / count(*) + 1e-10, 4) ELSE 0 END AS null_rate,
          count(DISTINCT {c}) AS distinct_count, CASE WHEN count({c}) > 0 THEN round(count(DISTINCT {c}) / count({c}) + 1e-10, 4) ELSE 0 END AS distinct_rate, count(DISTINCT {c}) = count({c}) AND count({c}) > 0 AS is_unique,
          {num(f"min({c})::DOUBLE").replace(" + 1e-10", "")} AS min_num, {num(f"max({c})::DOUBLE").replace(" + 1e-10", "")} AS max_num, {num(f"avg({c})")} AS mean, {num(f"median({c})")} AS median, {num(f"stddev_samp({c})")} AS stddev,
          {length(f"min(length({c}))")} AS min_len, {length(f"max(length({c}))")} AS max_len, {length(f"round(avg(length({c})) + 1e-10, 6)", t="DOUBLE")} AS avg_len, {day("min")} AS min_text, {day("max")} AS max_text FROM {source or name}""")
    return " UNION ALL ".join(out)


for _name in KINDS:
    query(f"profile_{_name}", stats_sql(_name))(lambda spark, d, n=_name: profile.table_stats(table(spark, d, n)))


@query("profile_lineitem_bounded", stats_sql("lineitem"))
def bounded(spark, d):
    return profile.table_stats(table(spark, d, "lineitem"))


@query("profile_lineitem_approximate")
def approximate(spark, d):
    return profile.table_stats(table(spark, d, "lineitem"), approximate=True)


def _top_sql(name: str, withheld: tuple[str, ...] = ()) -> str:
    """All columns are counted; those of more than 50 values are left out by the count."""
    columns = [c for c, k in _columns(name) if k in ("numeric", "string") and c not in withheld]
    parts = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS frequency, count(*) OVER () AS n FROM {name} WHERE {c} IS NOT NULL GROUP BY {c}" for c in columns)
    return f"SELECT column_name, value, frequency, CAST(row_number() OVER (PARTITION BY column_name ORDER BY frequency DESC, value) AS INT) AS rank FROM ({parts}) WHERE n <= 50"


@query("top_values_lineitem", _top_sql("lineitem"))
def top_lineitem(spark, d):
    return profile.top_values(table(spark, d, "lineitem"))


@query("top_values_part_pii", _top_sql("part", ("p_brand",)))
def top_part(spark, d):
    return profile.top_values(table(spark, d, "part"), withheld=["p_brand"])


def _histogram_sql(name: str) -> str:
    parts = []
    for c in (c for c, k in _columns(name) if k == "numeric"):
        parts.append(f"""SELECT '{c}' AS column_name, b.k AS bin, round(lo + (b.k - 1) * (hi - lo) / 10, 6) AS low, round(lo + b.k * (hi - lo) / 10, 6) AS high, coalesce(n, 0) AS frequency
          FROM (SELECT round(min({c})::DOUBLE, 6) AS lo, round(max({c})::DOUBLE, 6) AS hi FROM {name}) JOIN (SELECT unnest(range(1, 11))::INT AS k) b ON hi > lo LEFT JOIN (
            SELECT k, count(*) AS n FROM (SELECT CAST(floor(10 * ({c}::DOUBLE - lo) / (hi + 1e-9 - lo)) AS INT) + 1 AS k FROM {name}, (SELECT round(min({c})::DOUBLE, 6) AS lo, round(max({c})::DOUBLE, 6) AS hi FROM {name})) GROUP BY k) h ON h.k = b.k""")
    return " UNION ALL ".join(parts)


for _name in ("lineitem", "orders"):
    query(f"histogram_{_name}", _histogram_sql(_name))(lambda spark, d, n=_name: profile.histogram(table(spark, d, n)))


def _daily_sql(name: str, c: str) -> str:
    return f"SELECT '{c}' AS column_name, strftime({c}, '%Y-%m-%d') AS day, count(*) AS frequency FROM {name} WHERE {c} IS NOT NULL GROUP BY ALL"


@query("temporal_orders", _daily_sql("orders", "o_orderdate"))
def temporal_orders(spark, d):
    return profile.temporal(table(spark, d, "orders")).withColumn("day", F.col("day").cast("string"))


@query("temporal_events", _daily_sql("events", "ts"))
def temporal_events(spark, d):
    return profile.temporal(table(spark, d, "events"), ["ts"]).withColumn("day", F.col("day").cast("string"))


def _gaps_sql(name: str, c: str) -> str:
    return f"""WITH x AS (SELECT DISTINCT CAST({c} AS DATE) AS day FROM {name}), y AS (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM x)
    SELECT '{c}' AS column_name, strftime(day + INTERVAL 1 DAY, '%Y-%m-%d') AS gap_start, strftime(nxt - INTERVAL 1 DAY, '%Y-%m-%d') AS gap_end, CAST(nxt - day - 1 AS BIGINT) AS missing_days FROM y WHERE nxt - day > 1"""


def _gaps(spark, d, name: str, c: str):
    found = profile.temporal_gaps(profile.temporal(table(spark, d, name), [c]))
    return found.withColumns({x: F.col(x).cast("string") for x in ("gap_start", "gap_end")})


for _name, _c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts")):
    query(f"temporal_gaps_{_name}", _gaps_sql(_name, _c))(lambda spark, d, n=_name, c=_c: _gaps(spark, d, n, c))


@query(
    "date_key_profile_orders",
    """WITH k AS (SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS order_date_key FROM orders) SELECT 'order_date_key' AS column_name, 'date_key' AS category, count(*) AS row_count, count(DISTINCT order_date_key) AS distinct_count,
    strftime(min(strptime(CAST(order_date_key AS VARCHAR), '%Y%m%d')), '%Y-%m-%d') AS min_text, strftime(max(strptime(CAST(order_date_key AS VARCHAR), '%Y%m%d')), '%Y-%m-%d') AS max_text FROM k""",
)
def date_key(spark, d):
    df = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").cast("bigint").alias("order_date_key"))
    return profile.table_stats(df).select("column_name", "category", "row_count", "distinct_count", "min_text", "max_text")


@query(
    "discrete_quantiles_lineitem",
    """WITH f AS (SELECT 'l_quantity' AS column_name, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(n) OVER (ORDER BY v) AS upto, sum(n) OVER () AS total FROM f)
    SELECT column_name, min(v) FILTER (upto >= 0.25 * total) AS q1, min_by(n, v) FILTER (upto >= 0.25 * total) AS q1_frequency, min(v) FILTER (upto >= 0.5 * total) AS q2, min_by(n, v) FILTER (upto >= 0.5 * total) AS q2_frequency,
    min(v) FILTER (upto >= 0.75 * total) AS q3, min_by(n, v) FILTER (upto >= 0.75 * total) AS q3_frequency FROM c GROUP BY column_name""",
)
def quantiles(spark, d):
    return profile.discrete_quantiles(profile.top_values(table(spark, d, "lineitem").select("l_quantity")))


@query("profile_summary", f"SELECT count(*) AS column_count, max(row_count) AS row_count, CAST(sum(null_count) AS BIGINT) AS null_count, round(sum(null_count) / (max(row_count) * count(*)), 6) AS avg_null_rate FROM ({stats_sql('orders')})")
def summary(spark, d):
    return profile.profile_summary(profile.table_stats(table(spark, d, "orders")))


@query("row_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in KINDS))
def row_counts(spark, d):
    out = None
    for n in KINDS:
        part = table(spark, d, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        out = part if out is None else out.unionByName(part)
    return out


@query("profiling_meta", "SELECT count(*) AS total_rows, least(count(*), 10000) AS profiled_rows, 10000::BIGINT AS sample_size, 10000 < count(*) AS is_sampled FROM lineitem")
def meta(spark, d):
    return profile.profiling_meta(table(spark, d, "lineitem"), 10_000)


@query("sampled_profile_orders", stats_sql("orders", "(SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000)"))
def sampled(spark, d):
    return profile.table_stats(profile.sampled(table(spark, d, "orders"), 1000, ["o_orderkey"]))


@query("redacted_customer", "SELECT c_custkey, '••••' AS c_name, c_nationkey, '••••' AS c_acctbal, c_mktsegment FROM customer")
def redacted(spark, d):
    return profile.redacted(table(spark, d, "customer"), ["c_name", "c_acctbal"])


@query("sample_table_search", "SELECT * FROM part WHERE lower(p_partkey || '|' || p_name || '|' || p_brand || '|' || p_type || '|' || p_size) LIKE '%brand#1%'")
def row_search(spark, d):
    df = table(spark, d, "part")
    return profile.row_search(df, "Brand#1", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


@query("column_search_orders", "SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def column_search(spark, d):
    return profile.column_search(table(spark, d, "orders"), "ORDER")


@query("natural_sort_part", "SELECT p_name, row_number() OVER (ORDER BY regexp_extract(p_name, '^[^0-9]*'), CAST(coalesce(nullif(regexp_extract(p_name, '[0-9]+'), ''), '0') AS BIGINT), p_name)::INT AS place FROM (SELECT DISTINCT p_name FROM part)")
def natural_sort(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    return profile.numbered(names, [profile.natural_key(F.col("p_name")), F.col("p_name")]).select("p_name", F.col("place").cast("int").alias("place"))


@query("fk_orphans", "SELECT o_custkey AS key, count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey")
def fk_orphans(spark, d):
    return erd.missing_parents(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey")


_FACT = "SELECT count(*) AS rows, count(DISTINCT {c}) AS distinct_values, count({c}) = count(*) AS not_null, count(DISTINCT {c}) = count({c}) AS is_unique FROM {t}"


@query("unique_check", _FACT.format(c="o_orderkey", t="orders"))
def unique_check(spark, d):
    return erd.key_facts(table(spark, d, "orders"), "o_orderkey")


@query("not_null_check", _FACT.format(c="l_partkey", t="lineitem"))
def not_null_check(spark, d):
    return erd.key_facts(table(spark, d, "lineitem"), "l_partkey")


@query(
    "erd_endpoints",
    """WITH p AS (SELECT count(DISTINCT c_custkey) = count(c_custkey) AS u FROM customer), c AS (SELECT count(o_custkey) = count(*) AS f FROM orders)
    SELECT 'orders' AS source, 'customer' AS target, CASE WHEN f THEN 'one_and_only_one' ELSE 'zero_or_one' END AS source_end, CASE WHEN u THEN 'one_or_many' ELSE 'zero_or_many' END AS target_end FROM p, c""",
)
def erd_endpoints(spark, d):
    child, parent = erd.key_facts(table(spark, d, "orders"), "o_custkey"), erd.key_facts(table(spark, d, "customer"), "c_custkey")
    both = child.select(F.col("not_null")).crossJoin(parent.select("is_unique"))  # one row each
    source_end, target_end = erd.endpoints(F.col("not_null"), F.col("is_unique"))
    return both.select(F.lit("orders").alias("source"), F.lit("customer").alias("target"), source_end.alias("source_end"), target_end.alias("target_end"))


def _day_sql(name: str, changed: str = "false") -> str:
    """Exact counts, bounds and means; for estimates whether they are within their error."""
    value = f"CASE WHEN {changed} THEN 2 * value ELSE value END"
    parts = {"event_id": ("numeric", "event_id"), "user_id": ("numeric", "user_id"), "event_type": ("string", None), "value": ("numeric", value), "props": ("string", None)}
    num = lambda f, x: f"{f}({x})::DOUBLE" if x else "CAST(NULL AS DOUBLE)"
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{kind}' AS category, count(*) AS row_count, count(*) - count({c}) AS null_count, {num('min', x)} AS min_num, {num('max', x)} AS max_num, round({num('avg', x)} + 1e-10, 4) AS mean, true AS distinct_is_near, true AS median_is_near FROM {name}" for c, (kind, x) in parts.items())


def _judged(merged, df):
    """Merged sketches with their estimates held against exact values: distinct counts within 5 %, medians within 2 % of the ranks."""
    estimates = {r.column_name: r for r in merged.collect()}  # a row for each column
    columns = list(estimates)
    exact = profile.distinct_counts(df, columns)
    rank = lambda c: [F.count_if(F.col(c) < F.lit(estimates[c].median)) / F.count(c) <= 0.52, F.count_if(F.col(c) <= F.lit(estimates[c].median)) / F.count(c) >= 0.48]
    held = [c for c in columns if estimates[c].median is not None]
    row = df.agg(*[(rank(c)[0] & rank(c)[1]).alias(c) for c in held]).first() if held else {}
    near = [(c, abs(estimates[c].distinct_count - exact[c]) <= 0.05 * exact[c] + 1, row[c] if c in held else True) for c in columns]
    judged = df.sparkSession.createDataFrame(near, "column_name string, distinct_is_near boolean, median_is_near boolean")
    return merged.select("column_name", "category", "row_count", "null_count", "min_num", "max_num", F.round("mean", 4).alias("mean")).join(judged, "column_name")


def _days(spark, d):
    return table(spark, d, "events").withColumn("day", F.to_date("ts")).drop("ts")


@query("sketch_profile_events", _day_sql("events"))
def sketch_profile(spark, d):
    events = _days(spark, d)
    return _judged(sketches.merged(graph.stored(sketches.sketched(events, F.col("day"), [c for c in events.columns if c != "day"]))), events.drop("day"))


@query("sketch_refresh_events", _day_sql("events", "CAST(ts AS DATE) = DATE '2024-01-05'"))
def sketch_refresh(spark, d):
    """Sketches by day, stored; then one day is rewritten, and only that one is read again."""
    events, path = _days(spark, d), f"{graph.shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    changed = F.col("day") == F.lit("2024-01-05").cast("date")
    days = events.groupBy(F.col("day").alias("part")).agg(F.count(F.lit(1)).cast("string").alias("version"))
    sketches.refresh(events, "day", days, path)
    later = events.withColumn("value", F.when(changed, 2 * F.col("value")).otherwise(F.col("value")))
    newer = days.withColumn("version", F.when(F.col("part") == F.lit("2024-01-05").cast("date"), F.concat("version", F.lit("b"))).otherwise(F.col("version")))
    return _judged(sketches.merged(sketches.refresh(later, "day", newer, path)), later.drop("day"))


@query("sketch_top_values_events", "SELECT 'event_type' AS column_name, event_type AS value, count(*) AS frequency, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INT) AS rank FROM events GROUP BY event_type")
def sketch_top(spark, d):
    return sketches.merged_top(sketches.sketched(_days(spark, d), F.col("day"), ["event_type"]))


_LINEITEM = [c for c, _ in _columns("lineitem")]


@query("profile_lineitem_approximate_error", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, true AS distinct_is_near, true AS median_is_near FROM lineitem" for c in _LINEITEM))
def approximate_error(spark, d):
    """The approximate profile held against exact values: distinct counts within 15 %, medians within 2 % of the ranks."""
    df = table(spark, d, "lineitem")
    near = profile.table_stats(df, approximate=True)
    rows, exact = near.collect(), profile.distinct_counts(df, _LINEITEM)  # a row for each column
    held = {r.column_name: r.median for r in rows if r.median is not None}
    share = lambda c, f: F.count_if(f(F.col(c), F.lit(held[c]))) / F.count(c)
    ranks = df.agg(*[((share(c, lambda x, m: x < m) <= 0.52) & (share(c, lambda x, m: x <= m) >= 0.48)).alias(c) for c in held]).first()
    judged = [(r.column_name, r.row_count, r.null_count, abs(r.distinct_count - exact[r.column_name]) <= 0.15 * exact[r.column_name], ranks[r.column_name] if r.column_name in held else True) for r in rows]
    return spark.createDataFrame(judged, "column_name string, row_count bigint, null_count bigint, distinct_is_near boolean, median_is_near boolean")
