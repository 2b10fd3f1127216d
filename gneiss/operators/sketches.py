"""Profiles from stored, mergeable sketches: one row for each part of a table (a day, a file) and column.

A part's row holds exact counts, bounds and moments, and sketches of distinct values, quantiles and frequent
values. Rows of parts merge into the profile of any set of parts without a look at the table, and of a
table that has grown only the parts whose version has changed are read again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import stored
from .profile import columns_of, quoted, rounded

#: Fineness of distinct sketches (a standard error of 1.04 / sqrt(2 ** LG_K)) and of quantile sketches, and frequent values that are tracked.
LG_K, QUANTILES, TRACKED = 12, 200, 1000


def distinct_key(c: Column, dtype: T.DataType) -> Column:
    """The values of a column as a distinct sketch takes them; -0.0 counts as 0.0."""
    if isinstance(dtype, (T.IntegralType, T.StringType, T.BinaryType)):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0)).cast("string")
    return F.to_json(F.struct(c)) if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")


def sketched(df: DataFrame, part: Column, columns: Iterable[str] | None = None) -> DataFrame:
    """(part, column_name, category, row_count, filled, low, high, numbers, mean, spread, distinct, quantiles, top), from one scan and one shuffle of a row for each part and task.

    ``numbers``, ``mean`` and ``spread`` (the sum of squared differences from the mean) are of the values that are numbers.
    """
    kinds = columns_of(df, columns)
    rows = df.select(part.alias("part"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(kinds)])
    made, cells = [F.count(F.lit(1)).alias("row_count")], []
    for i, (name, kind) in enumerate(kinds.items()):
        c, x = F.col(f"c{i}"), F.col(f"c{i}").cast("double")
        real = F.when(~F.isnan(x), x)
        none, blob = F.lit(None).cast("double"), F.lit(None).cast("binary")
        number = kind == "numeric"
        key = F.hll_sketch_agg(distinct_key(c, rows.schema[f"c{i}"].dataType), LG_K)
        top = F.expr(f"approx_top_k_accumulate(CAST(c{i} AS STRING), {TRACKED})") if kind in ("string", "boolean") else None
        each = {
            "filled": F.count(c), "low": F.min(real) if number else none, "high": F.max(real) if number else none, "numbers": F.count(real) if number else F.lit(0).cast("bigint"),
            "mean": F.avg(real) if number else none, "spread": F.var_pop(real) * F.count(real) if number else none, "distinct": key, "quantiles": F.kll_sketch_agg_double(real, QUANTILES) if number else blob,
        }
        made += [v.alias(f"{k}_{i}") for k, v in each.items()] + ([top.alias(f"top_{i}")] if top is not None else [])
        empty = F.lit(None).cast("struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>")
        cells.append(F.struct(F.lit(name).alias("column_name"), F.lit(kind).alias("category"), *[F.col(f"{k}_{i}").alias(k) for k in each], (F.col(f"top_{i}") if top is not None else empty).alias("top")))
    return rows.groupBy("part").agg(*made).select("part", "row_count", F.inline(F.array(*cells)))


def merged(sketches: DataFrame) -> DataFrame:
    """(column_name, category, row_count, null_count, distinct_count, min_num, max_num, mean, stddev, median) of the parts together; distinct counts and medians are estimates."""
    n, mean = F.sum("numbers"), F.sum(F.col("numbers") * F.col("mean"))
    between = F.sum(F.col("spread") + F.col("numbers") * F.col("mean") ** 2)
    rows = sketches.groupBy("column_name", "category").agg(
        F.sum("row_count").alias("row_count"), F.sum("filled").alias("filled"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_count"), F.min("low").alias("min_num"), F.max("high").alias("max_num"),
        n.alias("n"), mean.alias("total"), between.alias("squares"), F.kll_merge_agg_double("quantiles").alias("q"),
    )
    centre = F.try_divide("total", "n")
    spread = F.greatest(F.col("squares") - F.col("n") * centre**2, F.lit(0.0))
    return rows.select(
        "column_name", "category", "row_count", (F.col("row_count") - F.col("filled")).alias("null_count"), "distinct_count", "min_num", "max_num", rounded(centre, 6).alias("mean"),
        F.when(F.col("n") > 1, rounded(F.sqrt(spread / (F.col("n") - 1)), 6)).alias("stddev"), F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("q", F.lit(0.5))).alias("median"),
    )


def merged_top(sketches: DataFrame, most: int = 50) -> DataFrame:
    """(column_name, value, frequency, rank) of the parts together: the most frequent values of texts and booleans; exact while a column has no more than TRACKED values."""
    rows = sketches.where("top IS NOT NULL").groupBy("column_name").agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(top, {TRACKED}), {most + 1})").alias("found"))
    ranked = rows.select("column_name", F.filter("found", lambda e: e["item"].isNotNull()).alias("found"))
    order = F.array_sort("found", lambda a, b: F.when(a["count"] > b["count"], -1).when(a["count"] < b["count"], 1).when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0))
    return ranked.select("column_name", F.posexplode(F.slice(order, 1, most)).alias("i", "e")).select("column_name", F.col("e.item").alias("value"), F.col("e.count").alias("frequency"), (F.col("i") + 1).alias("rank"))


def refresh(df: DataFrame, part: str, versions: DataFrame, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The sketches of ``df`` by its column ``part``, stored at ``path``; only parts whose version is new are read, and only their files are written.

    ``versions``: (part, version), say a day and when its files were last written. Parts that are not among them count no longer.
    """
    spark = df.sparkSession
    wanted = versions.select(F.col("part"), F.col("version").cast("string").alias("version"))
    try:
        known = spark.read.parquet(path).select(F.col("part").cast(versions.schema["part"].dataType).alias("part"), "version").distinct()
        changed = stored(wanted.join(known, ["part", "version"], "left_anti"))
    except AnalysisException:
        changed = stored(wanted)
    fresh = df.join(changed.select(F.col("part").alias(part)), part, "left_semi")
    fresh = sketched(fresh, F.col(part), columns if columns is not None else [c for c in df.columns if c != part]).join(changed, "part")
    fresh.write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    try:
        now = spark.read.schema(fresh.schema).parquet(path)
    except AnalysisException:  # nothing was ever written
        return fresh
    return now.join(wanted, ["part", "version"], "left_semi")
