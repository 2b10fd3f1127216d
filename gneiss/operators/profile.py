"""Column profiling: a fixed number of jobs per table however many columns it has.

One job gives the simple statistics and distinct counts of all columns, another one the medians; each column is
read by a branch of its own, so that a table in columns is read once in all and the generated code of a
branch stays small. Distributions of all eligible columns come from one unpivoted grouping each. No task
holds all values of a column. Results are long tables, one row per column (and value, bin, day).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATS = "row_count null_count null_rate distinct_count distinct_rate is_unique min_num max_num mean median stddev min_len max_len avg_len min_text max_text".split()
DATE_KEY_NAMES, DATE_KEY_ENDS = ("date", "key", "dt"), ("_date", "_key", "_dt")
BINS = 10


def classify(dtype: T.DataType, name: str) -> str:
    """numeric, string, date, boolean, date_key (whole numbers named like YYYYMMDD keys) or other."""
    if isinstance(dtype, (T.IntegerType, T.LongType)) and (name.lower() in DATE_KEY_NAMES or name.lower().endswith(DATE_KEY_ENDS)):
        return "date_key"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "string" if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)) else "other"


def classify_name(type_name: str, column: str = "") -> str:
    """The category of a warehouse type that is known by name only: exact first, then by what the name contains."""
    base = type_name.split("(")[0].strip().upper()
    # Names of types by category.
    exact = {
        "numeric": "TINYINT SMALLINT INTEGER INT BIGINT HUGEINT UTINYINT USMALLINT UINTEGER UBIGINT FLOAT DOUBLE REAL DECIMAL NUMERIC NUMBER INT2 INT4 INT8 FLOAT4 FLOAT8",
        "date": "DATE TIMESTAMP TIMESTAMPTZ TIMESTAMP_NTZ TIMESTAMP_LTZ TIMESTAMP_TZ DATETIME",
        "string": "VARCHAR TEXT STRING CHAR CHARACTER BPCHAR CLOB NAME",
        "boolean": "BOOLEAN BOOL",
    }
    kind = next((k for k, names in exact.items() if base in names.split()), None)
    if kind == "numeric" and base in ("INTEGER", "INT", "BIGINT", "INT4", "INT8") and (column.lower() in DATE_KEY_NAMES or column.lower().endswith(DATE_KEY_ENDS)):
        return "date_key"
    contained = (("numeric", ("INT", "FLOAT", "DOUBLE", "DECIMAL", "NUMERIC", "NUMBER")), ("string", ("CHAR", "TEXT", "STRING")), ("date", ("DATE", "TIME")), ("boolean", ("BOOL",)))
    return kind or next((k for k, parts in contained if any(p in base for p in parts)), "other")


def columns_of(df: DataFrame, wanted: Iterable[str] | None = None) -> dict[str, str]:
    """Column to category, of the wanted columns that exist."""
    have = {f.name: classify(f.dataType, f.name) for f in df.schema.fields}
    return {c: k for c, k in have.items() if wanted is None or c in set(wanted)}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def rounded(x: Column, digits: int) -> Column:
    """Rounded half up; the nudge keeps exact ties from depending on the last bit of a sum."""
    return F.round(x + 1e-10, digits)


def date_key_day(c: Column) -> Column:
    """The day of a whole number that reads as YYYYMMDD, else null."""
    text = c.cast("string")
    return F.when(F.length(text) == 8, F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd"))))


def table_stats(df: DataFrame, columns: Iterable[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row per column with STATS, in the order of the columns.

    Distinct counts and medians are exact by default; ``approximate`` takes HyperLogLog and percentile sketches for
    both, with the rest. What is not read from files is kept while it is profiled, as every column reads it.
    """
    kinds = columns_of(df, columns)
    rows = df.select(*[quoted(c) for c in kinds])
    if approximate or not kinds or df.inputFiles():
        return _table_stats(rows, kinds, approximate)
    rows = rows.persist()
    try:
        return _table_stats(rows, kinds, approximate)
    finally:
        rows.unpersist()


#: Columns that one job profiles.
COLUMNS_AT_ONCE = 64


def _numbered(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns as c0, c1, ... and, where values can be told apart, what tells them apart as k0, k1, ..."""
    keys = [value_key(df, c).alias(f"k{i}") for i, c in enumerate(names) if _countable(df, c)]
    return df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)], *keys)


def _branches(df: DataFrame, branches: list[str]) -> DataFrame:
    """Selects from ``df``, as {t}, put together; one text is parsed much faster than as many plans are built."""
    return df.sparkSession.sql(" UNION ALL ".join(branches), t=df)


def _simple_sql(i: int, kind: str, dtype: T.DataType, approximate: bool, countable: bool) -> str:
    """The simple statistics of column number ``i`` as one row."""
    c, x = f"c{i}", f"double(c{i})"
    real = f"if(isnan({x}), NULL, {x})"
    half_up = lambda v: f"round({v} + 1e-10D, 6)"
    day = {"date": f"date({c})", "date_key": f"if(length(string({c})) = 8, to_date(try_to_timestamp(string({c}), 'yyyyMMdd')), NULL)"}.get(kind)
    number, text = kind == "numeric", kind == "string"
    made = {
        "place": f"{i}", "category": f"'{kind}'", "row_count": "count(*)", "filled": f"count({c})",
        "low": f"min({x})" if number else "double(NULL)", "high": f"max({x})" if number else "double(NULL)", "mean": half_up(f"avg({x})") if number else "double(NULL)", "stddev": half_up(f"stddev_samp({x})") if number else "double(NULL)",
        "middle": f"percentile_approx({x}, 0.5D, 1000)" if number and approximate else "double(NULL)", "distinct_count": f"approx_count_distinct({c})" if approximate and countable else "bigint(NULL)",
        "min_len": f"bigint(min(char_length({c})))" if text else "bigint(NULL)", "max_len": f"bigint(max(char_length({c})))" if text else "bigint(NULL)", "avg_len": half_up(f"avg(char_length({c}))") if text else "double(NULL)",
        "min_text": f"date_format(min({day}), 'yyyy-MM-dd')" if day else "string(NULL)", "max_text": f"date_format(max({day}), 'yyyy-MM-dd')" if day else "string(NULL)",
        "numbers": f"count({real})" if number else "bigint(NULL)", "around": f"percentile_approx({real}, array({0.5 - AROUND}D, {0.5 + AROUND}D), {FINENESS})" if number and not approximate else "CAST(NULL AS ARRAY<DOUBLE>)",
    }
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in made.items()) + " FROM {t}"


def _distinct_sql(i: int) -> str:
    return f"SELECT {i} AS place, count(DISTINCT k{i}) AS distinct_count FROM {{t}}"


def _table_stats(df: DataFrame, kinds: dict[str, str], approximate: bool) -> DataFrame:
    spark, names = df.sparkSession, list(kinds)
    rows = _numbered(df, names)
    parts = [_simple_sql(i, kinds[c], df.schema[c].dataType, approximate, _countable(df, c)) for i, c in enumerate(names)] or [_simple_sql(0, "", T.NullType(), True, False).replace("c0", "NULL") + " LIMIT 0"]
    if approximate or not names:
        stats = _branches(rows, parts)
    else:
        got, counted, schema = [], {}, None
        for at in range(0, len(names), COLUMNS_AT_ONCE):
            some = _branches(rows, parts[at : at + COLUMNS_AT_ONCE])
            schema, got = some.schema, got + some.collect()  # a row for each column
            counted |= {r.place: r.distinct_count for r in _distinct_counts(df, rows, range(at, min(at + COLUMNS_AT_ONCE, len(names))), names)}
        medians = exact_medians(df, {names[r.place]: (r.numbers, *r.around) for r in got if r.numbers})
        got = [r.asDict() | {"middle": medians.get(names[r.place]), "distinct_count": counted.get(r.place)} for r in got]
        stats = spark.createDataFrame([tuple(r[f] for f in schema.names) for r in got], T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
    stats = stats.withColumn("column_name", F.element_at(F.array(*[F.lit(c) for c in names] or [F.lit("")]), F.col("place") + 1))
    count, filled, distinct = F.col("row_count"), F.col("filled"), F.col("distinct_count")
    return stats.orderBy("place").select(
        "column_name", "category", "row_count", (count - filled).alias("null_count"),
        F.when(count > 0, rounded((count - filled) / count, 4)).otherwise(0.0).alias("null_rate"),
        "distinct_count", F.when(filled > 0, rounded(distinct / filled, 4)).otherwise(0.0).alias("distinct_rate"), ((distinct == filled) & (filled > 0)).alias("is_unique"),
        F.round("low", 6).alias("min_num"), F.round("high", 6).alias("max_num"), "mean", rounded(F.col("middle"), 6).alias("median"), "stddev",
        "min_len", "max_len", "avg_len", "min_text", "max_text",
    )


def _countable(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, (T.MapType, T.VariantType))


#: Bytes of a text that stands for itself among distinct values; of longer ones a digest does.
LONGEST_VALUE = 64


def value_key(df: DataFrame, name: str) -> Column:
    """What tells the values of a column apart and can be grouped by: long texts go by their digest, nested values by their JSON."""
    c, kind = quoted(name), df.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.StructType)):
        c = F.when(c.isNotNull(), F.to_json(F.struct(c)))
    elif isinstance(kind, T.BinaryType):
        c = F.base64(c)
    elif not isinstance(kind, T.StringType):
        return c
    return F.when(F.octet_length(c) > LONGEST_VALUE, F.sha2(c, 256)).otherwise(c)


def _distinct_counts(df: DataFrame, rows: DataFrame, places: Iterable[int], names: list[str]) -> list:
    """(place, distinct_count) of the columns that have one, a row each."""
    parts = [_distinct_sql(i) for i in places if _countable(df, names[i])]
    return _branches(rows, parts).collect() if parts else []


def distinct_counts(df: DataFrame, columns: Iterable[str]) -> dict[str, int]:
    """The exact distinct counts of columns, nulls aside."""
    names = list(columns)
    return {names[r.place]: r.distinct_count for r in _distinct_counts(df, _numbered(df, names), range(len(names)), names)}


#: Shares on either side of the middle that a first sketch gives values for, the sketch's fineness, and values that the driver may see of a column.
AROUND, FINENESS, HELD = 0.001, 10_000, 100_000


def exact_medians(df: DataFrame, around: dict[str, tuple[int, float, float]], held: int = HELD) -> dict[str, float]:
    """Exact medians of numeric columns in bounded memory, given how many numbers each has and two values near its middle.

    The values are a sketch's; whatever they are, every pass counts the values below, at and between them. A column of which
    at most ``held`` values can lie between is done when these are counted one by one. Of others a sketch of what lies strictly
    between gives closer values, so that a pass leaves about a fiftieth of it. Ranks decide and not widths: infinite, denormal
    and overflowing values are values like any other, and many equal ones are one. NaN counts for nothing.
    """
    bounds = {c: (low, high, int(n * 2 * (AROUND + 2 / FINENESS))) for c, (n, low, high) in around.items()}
    ranks = {c: ((n - 1) // 2, n // 2) for c, (n, _, _) in around.items()}
    done: dict[str, float] = {}
    while len(done) < len(around):
        few = {c: b[:2] for c, b in bounds.items() if c not in done and b[2] <= held}
        many = {c: b[:2] for c, b in bounds.items() if c not in done and b[2] > held}
        for c, (below, values) in (_counted_between(df, few) if few else {}).items():
            found = _at_ranks(ranks[c], below, values)
            if None in found:  # the sketch erred: from here on bounds rest on counts
                bounds[c] = (-float("inf"), float("inf"), 1 << 62)
            else:
                done[c] = _middle(*found)
        for c, (below, at_low, inside, at_high, steps) in (_sketched_between(df, many) if many else {}).items():
            low, high, _ = bounds[c]
            left, right = _at_ranks(ranks[c], below, [(low, at_low), (None, inside), (high, at_high)])
            first, last = ((r - below - at_low) for r in ranks[c])
            if not below <= ranks[c][0] <= ranks[c][1] < below + at_low + inside + at_high:
                bounds[c] = (-float("inf"), float("inf"), 1 << 62)
            elif left is not None and right is not None:
                done[c] = _middle(left, right)
            else:
                first = 0 if first < 0 else max(first * STEPS // inside - 1, 0)
                last = STEPS if last >= inside else min(-(-(last + 1) * STEPS // inside) + 1, STEPS)
                most = int(inside * ((last - first) / STEPS + 2 / FINENESS))
                bounds[c] = (steps[first] if left is None else low, steps[last] if right is None else high, most if most < inside else inside - 1)
    return done


def _at_ranks(ranks: tuple[int, int], below: int, values: list[tuple[float | None, int]]) -> list[float | None]:
    """The values at two ranks, of values in order with their counts after ``below`` others; None outside."""
    out: list[float | None] = [None, None]
    for x, n in values:
        for k, rank in enumerate(ranks):
            if below <= rank < below + n:
                out[k] = x
        below += n
    return out


def _middle(a: float, b: float) -> float:
    return a if a == b else (a + b) / 2 if abs(a + b) < float("inf") else a / 2 + b / 2


def _double(x: float) -> str:
    return f"double('{x!r}')"


def _counted_between(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, tuple[int, list[tuple[float, int]]]]:
    """How many values of each column lie below its bounds, and each value between them with its count."""
    names, parts = list(bounds), []
    for i, (low, high) in enumerate(bounds.values()):  # NaN is above all
        parts.append(f"SELECT {i} AS i, x, count(*) AS n FROM (SELECT if(double(c{i}) >= {_double(low)}, double(c{i}), NULL) AS x FROM {{t}} WHERE double(c{i}) <= {_double(high)}) GROUP BY x")
    out: dict[str, tuple[int, list]] = {c: (0, []) for c in bounds}
    for r in _branches(df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)]), parts).collect():
        below, values = out[names[r.i]]
        if r.x is None:
            out[names[r.i]] = (r.n, values)
        else:
            values.append((r.x, r.n))
    return {c: (below, sorted(values)) for c, (below, values) in out.items()}


#: Values between the bounds that a sketch gives.
STEPS = 200


def _sketched_between(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, tuple]:
    """How many values of each column lie below its bounds, at the lower, strictly between, and at the upper if it is another; and STEPS + 1 of those between at equal ranks."""
    cells = []
    for i, (c, (low, high)) in enumerate(bounds.items()):
        x, low, high = quoted(c).cast("double"), F.lit(low), F.lit(high)
        inside = F.when((x > low) & (x < high), x)
        cells += [F.count_if(x < low).alias(f"a_{i}"), F.count_if(x == low).alias(f"b_{i}"), F.count(inside).alias(f"n_{i}"), F.count_if((x == high) & (low != high)).alias(f"c_{i}"), F.percentile_approx(inside, [k / STEPS for k in range(STEPS + 1)], FINENESS).alias(f"s_{i}")]
    row = df.agg(*cells).first()
    return {c: tuple(row[f"{k}_{i}"] for k in "abncs") for i, c in enumerate(bounds)}


def unpivoted(df: DataFrame, columns: Iterable[str], value: str = "string") -> DataFrame:
    """(column_name, value) of the columns, in one scan that reads only these."""
    cells = [F.struct(F.lit(c).alias("column_name"), quoted(c).cast(value).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells)))


#: Rows of the first slice that may prove a column to be too varied for top values.
SLICE = 20_000


def few_valued(df: DataFrame, columns: Iterable[str], threshold: int) -> list[str]:
    """The columns but those of which a slice of the table already shows more than ``threshold`` values: what is left may still have more."""
    names = list(columns)
    if not names:
        return []
    row = df.select(*[quoted(c) for c in names]).limit(SLICE).agg(*[F.size(F.collect_set(quoted(c).cast("string"))).alias(f"n_{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if row[f"n_{i}"] <= threshold]


def top_values(df: DataFrame, stats: DataFrame | None = None, threshold: int = 50, withheld: Iterable[str] = ()) -> DataFrame:
    """Value frequencies of the columns of at most ``threshold`` distinct values, never of withheld (personal) ones; ties by value.

    Given no ``stats``, the values that are counted anyway show which columns these are.
    """
    if stats is None:
        names = few_valued(df, [c for c, k in columns_of(df).items() if k in ("string", "numeric", "boolean") and c not in set(withheld)], threshold)
    else:
        rows = stats.where(F.col("category").isin("string", "numeric", "boolean") & F.col("distinct_count").between(1, threshold)).select("column_name").collect()
        names = [r[0] for r in rows if r[0] not in set(withheld)]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, value string, frequency bigint, rank int")
    counts = unpivoted(df, names).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("frequency"))
    if stats is None:  # the ranks beyond the threshold are few or not even looked at
        place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("frequency"), "value"))
        counts = counts.withColumn("rank", place).where(F.col("rank") <= threshold + 1)
        most = F.max("rank").over(Window.partitionBy("column_name"))
        return counts.withColumn("most", most).where(F.col("most") <= threshold).drop("most")
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("frequency"), "value")))


def histogram(df: DataFrame, stats: DataFrame | None = None, bins: int = BINS) -> DataFrame:
    """Equal-width bins of every numeric column with finite max > min, empty bins included; bounds are those of ``stats`` or the columns' own."""
    spark = df.sparkSession
    if stats is None:
        names = [c for c, k in columns_of(df).items() if k == "numeric"]
        ends = [f(quoted(c).cast("double")) for c in names for f in (F.min, F.max)]
        found = df.agg(*[F.round(x, 6).alias(f"e_{i}") for i, x in enumerate(ends)]).first() if names else ()
        rows = [(c, found[2 * i], found[2 * i + 1]) for i, c in enumerate(names) if found[2 * i] is not None and found[2 * i + 1] > found[2 * i]]
    else:
        rows = stats.where("category = 'numeric' AND max_num > min_num").select("column_name", "min_num", "max_num").collect()
    rows = [r for r in rows if abs(r[1]) + abs(r[2]) < float("inf")]  # no bins are of equal width between infinite bounds
    if not rows:
        return spark.createDataFrame([], "column_name string, bin int, low double, high double, frequency bigint")
    cells = []
    for name, low, high in rows:
        at = F.width_bucket(quoted(name).cast("double"), F.lit(low), F.lit(high + 1e-9), F.lit(bins))
        cells.append(F.struct(F.lit(name).alias("column_name"), at.cast("int").alias("bin")))
    counts = df.select(F.inline(F.array(*cells))).where(F.col("bin").between(1, bins)).groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("frequency"))
    edges = spark.createDataFrame([(n, k, round(a + (k - 1) * (b - a) / bins, 6), round(a + k * (b - a) / bins, 6)) for n, a, b in rows for k in range(1, bins + 1)], "column_name string, bin int, low double, high double")
    return edges.join(counts, ["column_name", "bin"], "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)).cast("bigint"))


def temporal(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows per day of every date and date-key column."""
    kinds = {c: k for c, k in columns_of(df, columns).items() if k in ("date", "date_key")}
    cells = [F.struct(F.lit(c).alias("column_name"), (quoted(c).cast("date") if k == "date" else date_key_day(quoted(c))).alias("day")) for c, k in kinds.items()]
    if not cells:
        return df.sparkSession.createDataFrame([], "column_name string, day date, frequency bigint")
    return df.select(F.inline(F.array(*cells))).where("day IS NOT NULL").groupBy("column_name", "day").agg(F.count(F.lit(1)).alias("frequency"))


def temporal_gaps(daily: DataFrame) -> DataFrame:
    """Maximal runs of missing days of each column between its first and last day."""
    after = F.lead("day").over(Window.partitionBy("column_name").orderBy("day"))
    rows = daily.select("column_name", "day", after.alias("next")).where(F.datediff("next", "day") > 1)
    return rows.select("column_name", F.date_add("day", 1).alias("gap_start"), F.date_sub("next", 1).alias("gap_end"), (F.datediff("next", "day") - 1).cast("bigint").alias("missing_days"))


def discrete_quantiles(frequencies: DataFrame) -> DataFrame:
    """Q1, median and Q3 of numeric top values: the least value whose cumulative frequency reaches the share."""
    number = F.col("value").cast("double")
    upto = Window.partitionBy("column_name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = frequencies.select("column_name", number.alias("v"), "frequency")
    rows = rows.withColumns({"upto": F.sum("frequency").over(upto), "total": F.sum("frequency").over(Window.partitionBy("column_name"))})
    out = []
    for name, share in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)):
        reached = F.col("upto") >= share * F.col("total")
        out += [F.min(F.when(reached, F.col("v"))).alias(name), F.min_by("frequency", F.when(reached, F.col("v"))).alias(f"{name}_frequency")]
    return rows.groupBy("column_name").agg(*out)


def profile_summary(stats: DataFrame) -> DataFrame:
    """Of a table: columns, rows and average null rate (all nulls by all cells)."""
    cells = F.max("row_count") * F.count(F.lit(1))
    return stats.agg(
        F.count(F.lit(1)).alias("column_count"), F.max("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.coalesce(F.round(F.try_divide(F.sum("null_count").cast("double"), cells), 6), F.lit(0.0)).alias("avg_null_rate"),
    )


def sampled(df: DataFrame, rows: int, order: Iterable[str]) -> DataFrame:
    """The first ``rows`` rows in a total order, the same ones every time."""
    return df.orderBy(*order).limit(rows)


def profiling_meta(df: DataFrame, sample_size: int | None = None) -> DataFrame:
    """total_rows, profiled_rows, sample_size, is_sampled."""
    total = F.count(F.lit(1))
    size = F.lit(sample_size).cast("bigint")
    return df.agg(total.alias("total_rows"), F.least(total, F.coalesce(size, total)).alias("profiled_rows"), size.alias("sample_size"), F.coalesce(size < total, F.lit(False)).alias("is_sampled"))


def redacted(df: DataFrame, withheld: Iterable[str], mark: str = "••••") -> DataFrame:
    """Withheld columns show the mark in every row; the order of columns stays."""
    return df.select(*[F.lit(mark).alias(c) if c in set(withheld) else quoted(c) for c in df.columns])


def row_search(df: DataFrame, needle: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows of which any cell contains ``needle``, whatever its case."""
    found = F.lit(False)
    for c in columns or df.columns:
        found = found | F.coalesce(F.contains(F.lower(quoted(c).cast("string")), F.lit(needle.lower())), F.lit(False))
    return df.where(found)


def column_search(df: DataFrame, needle: str) -> DataFrame:
    """The columns whose name contains ``needle``."""
    return df.select(*[quoted(c) for c in df.columns if needle.lower() in c.lower()])


def natural_key(c: Column) -> Column:
    """A sort key under which digit runs compare as numbers."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place in a total order: ranges are sorted apart, and each begins where those before it end."""
    rows = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    rows = rows.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn(name, place).drop("_range", "_before")


def sorted_table(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Natural order with nulls last, or exactly reversed."""
    c = quoted(column)
    c = natural_key(c) if isinstance(df.schema[column].dataType, T.StringType) else c
    return df.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last())
