"""Table scans and result sinks: warehouse options, existing columns, profile cache, JSON payload."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVERS = {"postgres": ("jdbc:postgresql://{host}:{port}/{dbname}", "org.postgresql.Driver", 5432), "snowflake": ("jdbc:snowflake://{account}.snowflakecomputing.com/?db={database}", "net.snowflake.client.jdbc.SnowflakeDriver", 443), "duckdb": ("jdbc:duckdb:{path}", "org.duckdb.DuckDBDriver", 0)}


def connection_options(adapter: str, params: dict[str, str]) -> dict[str, str]:
    """JDBC options of a warehouse; a full URL in ``params`` is taken as it is."""
    if params.get("url", "").startswith("jdbc:"):
        return {k: str(v) for k, v in params.items()}
    if adapter not in DRIVERS:
        raise ValueError(f"no such warehouse adapter: {adapter}")
    url, driver, port = DRIVERS[adapter]
    out = {"url": url.format_map({"port": port, "host": "localhost", **params}), "driver": driver}
    return out | {k: str(params[k]) for k in ("user", "password") if k in params}


def scan(spark: SparkSession, options: dict[str, str], schema: str, name: str, key: str | None = None, partitions: int = 8) -> DataFrame:
    """A warehouse table by its quoted name; with a numeric ``key`` in several partitions of about as many rows, each row in one of them."""
    table = f'"{schema}"."{name}"'
    if key is None:
        return spark.read.format("jdbc").options(**options, dbtable=table).load()
    rest = {k: v for k, v in options.items() if k != "url"}
    return spark.read.jdbc(options["url"], table, predicates=key_ranges(spark, options, table, key, partitions), properties=rest)


#: Equal steps of a key whose rows the warehouse counts, so that ranges of them can be put together.
KEY_STEPS = 1000


def key_ranges(spark: SparkSession, options: dict[str, str], table: str, key: str, partitions: int) -> list[str]:
    """Conditions on a numeric key that hold about as many rows each; the first also holds rows without a key.

    The warehouse counts its rows by KEY_STEPS equal steps between the key's bounds; only these counts travel.
    """
    ask = lambda sql: spark.read.format("jdbc").options(**options, query=sql).load()
    quoted = f'"{key}"'
    low, high = (None if x is None else float(x) for x in ask(f"SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {table}").first())
    if low is None or not low < high:
        return ["1 = 1"]
    width = (high - low) / KEY_STEPS
    counts = ask(f"SELECT b, COUNT(*) AS n FROM (SELECT CAST(FLOOR((CAST({quoted} AS DOUBLE PRECISION) - {low!r}) / {width!r}) AS INTEGER) AS b FROM {table} WHERE {quoted} IS NOT NULL) x GROUP BY b")
    steps = sorted((int(r[0]), int(r[1])) for r in counts.collect())  # at most KEY_STEPS + 1 rows
    total, upto, ends = sum(n for _, n in steps), 0, []
    for b, n in steps:
        if len(ends) < partitions - 1 and upto >= (len(ends) + 1) * total / partitions:
            ends.append(low + b * width)
        upto += n
    if not ends:
        return ["1 = 1"]
    inner = [f"{quoted} >= {a!r} AND {quoted} < {b!r}" for a, b in zip(ends, ends[1:], strict=False)]
    return [f"({quoted} < {ends[0]!r} OR {quoted} IS NULL)", *inner, f"{quoted} >= {ends[-1]!r}"]


def profiled_models(models: DataFrame) -> DataFrame:
    """The models that are tables or views of the warehouse: ephemeral ones are not."""
    return models.where("coalesce(lower(materialization), '') <> 'ephemeral'")


def existing(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Only those of the wanted columns that the table has, whatever their case."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{have[c.lower()]}`") for c in dict.fromkeys(wanted) if c.lower() in have])


def schema_hash(df: DataFrame, row_count: int) -> str:
    """A cache key of a table's columns, types and row count."""
    columns = [f"{n}:{t}" for n, t in df.dtypes]
    return df.sparkSession.range(1).select(F.substring(F.sha2(F.lit("|".join([*columns, str(row_count)])), 256), 1, 16)).first()[0]


def cached_profiles(spark: SparkSession, path: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored profiles that still hold, tables to profile anew) for ``wanted`` (table_name, schema_hash)."""
    stored = spark.read.parquet(path)
    return stored.join(wanted, ["table_name", "schema_hash"], "left_semi"), wanted.join(stored.select("table_name", "schema_hash").distinct(), ["table_name", "schema_hash"], "left_anti")


def to_payload(df: DataFrame, name: str) -> DataFrame:
    """One compact JSON object per row, under the name of its collection."""
    return df.select(F.to_json(F.struct(F.lit(name).alias("collection"), F.struct(*df.columns).alias("row"))).alias("value"))


def slim(df: DataFrame, columns: Iterable[str] = ("sql", "raw_code", "compiled_code")) -> DataFrame:
    """SQL texts taken out, their columns kept empty."""
    return df.withColumns({c: F.lit("") for c in columns if c in df.columns})


def write_profiles(stats: DataFrame, path: str, table_name: str, key: str) -> None:
    """Puts a table's profile into the cache under the hash of its schema and size, in place of any older one of the table."""
    rows = stats.withColumns({"table_name": F.lit(table_name), "schema_hash": F.lit(key)})
    rows.write.partitionBy("table_name").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def profile_payload(stats: DataFrame, meta: DataFrame) -> DataFrame:
    """One JSON object: all columns of a profile, and about what rows it is."""
    columns = stats.agg(F.array_sort(F.collect_list(F.struct(*stats.columns))).alias("columns"))  # a row for each column of a table
    return columns.crossJoin(meta.select(F.struct(*meta.columns).alias("meta"))).select(F.to_json(F.struct("columns", "meta")).alias("value"))


def sample_payload(df: DataFrame, schema: str, name: str, limit: int = 50) -> DataFrame:
    """One JSON object of a table's first rows by all columns: schema, table, columns, rows, row_count, limit."""
    order = [f"`{c}`" for c in df.columns]
    cells = F.array(*[F.col(c).cast("string") for c in order])
    rows = df.orderBy(*order).limit(limit).agg(F.sort_array(F.collect_list(cells)).alias("rows"))
    head = [F.lit(schema).alias("schema"), F.lit(name).alias("table"), F.array(*[F.lit(c) for c in df.columns]).alias("columns")]
    return rows.select(F.to_json(F.struct(*head, "rows", F.size("rows").alias("row_count"), F.lit(limit).alias("limit"))).alias("value"))


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """(model, sample): sample payloads of a folder, one file for each model; those that lack a key are left out."""
    schema = "schema string, table string, columns array<string>, rows array<array<string>>, row_count bigint, `limit` bigint"
    texts = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("model"), F.from_json("value", schema).alias("sample"))
    whole = F.lit(True)
    for key in ("schema", "table", "columns", "rows", "row_count", "limit"):
        whole = whole & F.col(f"sample.{key}").isNotNull()
    return texts.where(whole)


def selected_by_file(nodes: DataFrame, path: str) -> DataFrame:
    """The nodes whose names stand in a text file, one on a line; blank lines and comments (#) count for nothing."""
    names = nodes.sparkSession.read.text(path).select(F.trim("value").alias("name")).where("name <> '' AND NOT startswith(name, '#')").distinct()
    return nodes.join(names, "name", "left_semi")


def read_exposure_fields(spark: SparkSession, path: str) -> DataFrame:
    """exposure, field, kind, expression, depends_on and components from an exposure sidecar of version 1; raises on any other."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<version:int,exposures:map<string,string>>").alias("x"))
    row = text.select("x.version", F.col("x.exposures").isNotNull().alias("ok")).first()
    if row is None or row.version != 1 or not row.ok:
        raise ValueError(f"{path}: an object of version 1 with exposures is expected")
    field = "struct<name:string,kind:string,expression:string,depends_on:array<struct<model:string,column:string,transformation:string>>,components:array<string>>"
    rows = text.select(F.explode("x.exposures").alias("exposure", "v")).select("exposure", F.explode(F.from_json(F.get_json_object("v", "$.fields"), f"array<{field}>")).alias("f"))
    return rows.select("exposure", F.col("f.name").alias("field"), F.coalesce("f.kind", F.lit("measure")).alias("kind"), "f.expression", "f.depends_on", "f.components")
