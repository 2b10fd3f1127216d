"""Relational analytics over project metadata: joined columns and tests, coverage, complexity, naming, freshness, health.

Inputs are DataFrames with one row per entity (see gneiss.sources.artifacts); every result has a
total order or is keyed, so that ties can't change it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How run statuses are named in results; others pass through.
STATUS = {"success": "pass", "failure": "fail", "warning": "warn", "skipped": "not_run"}
# Default weights of the health dimensions, complexity thresholds, naming rules and grade bounds.
WEIGHTS = {"documentation": 0.25, "testing": 0.25, "freshness": 0.15, "complexity": 0.15, "naming": 0.10, "orphans": 0.10}
LIMITS = {"lines": 200, "joins": 8, "ctes": 10, "subqueries": 5}
NAMING = {"staging": "^stg_", "intermediate": "^int_", "marts": "^(fct_|dim_)"}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]


def folder(path: Column) -> Column:
    """The directory part of a path, with forward slashes."""
    return F.regexp_extract(F.translate(path, "\\", "/"), "^(.*)/[^/]*$", 1)


def status_name(status: Column) -> Column:
    out = F.when(F.lit(False), status)
    for raw, name in STATUS.items():
        out = out.when(status == raw, name)
    return out.otherwise(status)


def _first_by_name(columns: DataFrame, order: str) -> DataFrame:
    """One row per (uid, lower(name)): the first in order."""
    place = F.row_number().over(Window.partitionBy("uid", F.lower("name")).orderBy(order, "name"))
    return columns.withColumns({"key": F.lower("name"), "place": place}).where("place = 1").drop("place")


def merged_columns(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Declared (uid, name, pos, description, data_type) with catalog (uid, name, type, idx) columns, matched whatever their case.

    Catalog columns come first by index, then those only declared; the catalog's type wins.
    """
    d, c = _first_by_name(declared, "pos").alias("d"), _first_by_name(found, "idx").alias("c")
    both = d.join(c, (F.col("d.uid") == F.col("c.uid")) & (F.col("d.key") == F.col("c.key")), "full_outer")
    uid = F.coalesce("c.uid", "d.uid")
    rows = both.select(
        uid.alias("uid"), F.coalesce("c.name", "d.name").alias("name"), F.coalesce("c.type", "d.data_type", F.lit("")).alias("data_type"),
        F.coalesce("d.description", F.lit("")).alias("description"), F.col("c.name").isNotNull().alias("in_catalog"), F.col("d.name").isNotNull().alias("declared"), "c.idx", "d.pos",
    )
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("idx").isNull(), "idx", "pos", "name"))
    return rows.select("uid", place.alias("ordinal"), "name", "data_type", "description", "in_catalog", "declared")


def with_stats(models: DataFrame, stats: DataFrame) -> DataFrame:
    """Models with row_count and bytes from the catalog's statistics, null where there is none or it is no number."""
    wide = stats.groupBy("uid").agg(*[F.max(F.when(F.lower("stat_id") == k, F.try_to_number("value", F.lit("99999999999999999999")))).cast("bigint").alias(n) for k, n in (("row_count", "row_count"), ("bytes", "bytes"))])
    return models.join(wide, "uid", "left")


def referenced_by(edges: DataFrame) -> DataFrame:
    """(uid, consumers): who depends on a node, tests and operations left out."""
    rows = edges.where(~F.split_part("target", F.lit("."), F.lit(1)).isin("test", "unit_test", "operation"))
    return rows.groupBy(F.col("source").alias("uid")).agg(F.array_sort(F.collect_set("target")).alias("consumers"))


def attached_tests(tests: DataFrame, results: DataFrame) -> DataFrame:
    """(uid, test_id, column_name, test_type, status, failures): every test on each node that it depends on."""
    rows = tests.select("test_id", "test_type", "column_name", F.explode("depends_on").alias("uid")).distinct()
    done = results.select("test_id", status_name(F.col("status")).alias("status"), "failures")
    return rows.join(done, "test_id", "left").select("uid", "test_id", F.lower("column_name").alias("column_name"), "test_type", F.coalesce("status", F.lit("not_run")).alias("status"), F.coalesce("failures", F.lit(0)).alias("failures"))


def test_rollup(attached: DataFrame) -> DataFrame:
    """(uid, test_count, failed, warned, passed, rollup): fail or error first, then warn, then pass, else none."""
    count = lambda *names: F.count_if(F.col("status").isin(*names))
    rollup = F.when(count("fail", "error") > 0, "fail").when(count("warn") > 0, "warn").when(count("pass") > 0, "pass").otherwise("none")
    return attached.groupBy("uid").agg(F.count(F.lit(1)).alias("test_count"), count("fail", "error").alias("failed"), count("warn").alias("warned"), count("pass").alias("passed"), rollup.alias("rollup"))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(1.0)


def coverage(models: DataFrame, columns: DataFrame, attached: DataFrame, by_folder: bool = False) -> DataFrame:
    """Documented and tested models and columns, overall or per folder; a rate of nothing is 1."""
    tests = attached.groupBy("uid").agg(F.count(F.lit(1)).alias("tests"))
    column_tests = attached.where("coalesce(column_name, '') <> ''").select("uid", F.col("column_name").alias("key")).distinct().withColumn("tested", F.lit(1))
    per_model = columns.withColumn("key", F.lower("name")).join(column_tests, ["uid", "key"], "left").groupBy("uid")
    per_model = per_model.agg(F.count(F.lit(1)).alias("cols"), F.count_if(F.trim("description") != "").alias("cols_doc"), F.count("tested").alias("cols_test"))
    rows = models.join(tests, "uid", "left").join(per_model, "uid", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    aggs = {
        "models": F.count(F.lit(1)), "documented_models": F.count_if(F.trim(F.coalesce("description", F.lit(""))) != ""), "tested_models": F.count_if(F.coalesce("tests", F.lit(0)) > 0),
        "columns": total("cols"), "documented_columns": total("cols_doc"), "tested_columns": total("cols_test"),
    }
    grouped = rows.groupBy("folder") if by_folder else rows.groupBy()
    out = grouped.agg(*[v.alias(k) for k, v in aggs.items()])
    return out.withColumns({f"{kind}_{what}_rate": F.round(rate(F.col(f"{kind}_{what}s"), F.col(f"{what}s")), 6) for kind in ("documented", "tested") for what in ("model", "column")})


def complexity(models: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """lines, joins, ctes, subqueries of each model's SQL, whether any exceeds its limit, and the ordering score."""
    bound = limits or LIMITS
    sql = F.trim(F.regexp_replace(F.coalesce("sql", F.lit("")), r"^\s+|\s+$", ""))
    count = lambda pattern: F.regexp_count(F.lower(sql), F.lit(pattern)).cast("bigint")
    out = models.select(
        "uid", F.when(sql == "", 0).otherwise(F.size(F.split(sql, "\n"))).cast("bigint").alias("lines"), count(r"\bjoin\b").alias("joins"),
        F.when(F.lower(sql).rlike(r"\bwith\b"), count(r"\b\w+\s+as\s*\(")).otherwise(0).alias("ctes"), count(r"\(\s*select\b").alias("subqueries"),
    )
    high = F.lit(False)
    for name, most in bound.items():
        high = high | (F.col(name) > most)
    return out.withColumns({"is_high": high, "score": F.col("lines") + 10 * F.col("joins") + 5 * F.col("ctes") + 8 * F.col("subqueries")})


def naming(models: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(uid, layer, compliant) of the models of which a path segment is a layer with a rule, the first such layer."""
    out = F.when(F.lit(False), F.lit(""))
    good = F.when(F.lit(False), F.lit(True))
    segments = F.split(F.lower(F.translate("path", "\\", "/")), "/")
    for layer, pattern in (rules or NAMING).items():
        out = out.when(F.array_contains(segments, layer), F.lit(layer))
        good = good.when(F.array_contains(segments, layer), F.col("name").rlike(pattern))
    return models.select("uid", "name", out.alias("layer"), good.alias("compliant")).where("layer IS NOT NULL")


def freshness_score(freshness: DataFrame) -> DataFrame:
    """(monitored, score): passes and runtime errors count 1, warnings a half; null if nothing is monitored."""
    points = F.sum(F.when(F.col("status").isin("pass", "runtime error"), 1.0).when(F.col("status") == "warn", 0.5).otherwise(0.0))
    return freshness.where("status IS NOT NULL").agg(F.count(F.lit(1)).alias("monitored"), F.round(100 * F.try_divide(points, F.count(F.lit(1))), 6).alias("score"))


def grade(score: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for least, letter in GRADES:
        out = out.when(score >= least, letter)
    return out.otherwise("F")


def health(covered: DataFrame, complex_models: DataFrame, named: DataFrame, fresh: DataFrame, total: DataFrame, orphaned: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row with the six scores, overall (1 decimal) and grade (by the unrounded overall). Freshness that isn't monitored gives its weight to the rest."""
    w = weights or WEIGHTS
    share = lambda df, good: df.agg((100 * rate(F.count_if(good), F.count(F.lit(1)))).alias("x"))
    parts = covered.select(
        (50 * (F.col("documented_model_rate") + F.col("documented_column_rate"))).alias("documentation"),
        (50 * (F.col("tested_model_rate") + F.col("tested_column_rate"))).alias("testing"),
    )
    for name, df in (
        ("freshness", fresh.select(F.col("score").alias("x"))), ("complexity", share(complex_models, ~F.col("is_high"))), ("naming", share(named, F.col("compliant"))),
        ("orphans", total.agg(F.count(F.lit(1)).alias("n")).crossJoin(orphaned.agg(F.count(F.lit(1)).alias("o"))).select((100 * rate(F.col("n") - F.col("o"), F.col("n"))).alias("x"))),
    ):  # one row each
        parts = parts.crossJoin(df.withColumnRenamed("x", name))
    active = F.when(F.col("freshness").isNull(), sum(w.values()) - w["freshness"]).otherwise(sum(w.values()))
    overall = sum((F.coalesce(F.col(k), F.lit(0.0)) * v for k, v in w.items()), F.lit(0.0)) / active
    return parts.select(*[F.round(F.col(k) + 1e-10, 4).alias(k) for k in w], F.round(overall + 1e-10, 1).alias("overall"), grade(overall).alias("grade"))


def ranked(models: DataFrame, missing: Column, downstream: DataFrame, limit: int | None = 50) -> DataFrame:
    """The models for which ``missing`` holds, by downstream count, then id; ``total`` counts them before the limit, None sets none."""
    rows = models.where(missing).join(downstream, "uid", "left").withColumn("downstream", F.coalesce("downstream", F.lit(0)))
    total = models.where(missing).agg(F.count(F.lit(1)).alias("total"))
    first = rows.orderBy(F.desc("downstream"), "uid")
    return (first if limit is None else first.limit(limit)).crossJoin(F.broadcast(total)).select("uid", "downstream", "total")  # one row


def looked_up(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(identifier, uid) for every identifier of ``asked``: an id, else a name, else source_name.name; of several the least id, null without any."""
    keys = entries.select("uid", F.posexplode(F.array("uid", "name", F.concat_ws(".", "source_name", "name"))).alias("place", "identifier"))
    best = keys.groupBy("identifier").agg(F.min(F.struct("place", "uid")).alias("best"))
    return asked.select("identifier").distinct().join(best, "identifier", "left").select("identifier", F.col("best.uid").alias("uid"))


def with_freshness(sources: DataFrame, freshness: DataFrame) -> DataFrame:
    """Sources with status, max_loaded_at and snapshotted_at of their first freshness row (by ``position``), unknown without one."""
    first = freshness.groupBy("unique_id").agg(*[F.min_by(c, "position").alias(c) for c in ("status", "max_loaded_at", "snapshotted_at")])
    out = sources.join(first.withColumnRenamed("unique_id", "uid"), "uid", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("unknown")))


def declared_questions(models: DataFrame, block: str) -> DataFrame:
    """(uid, question, test_name) of the questions in a block of the models' meta, trimmed; blank ones go."""
    entries = F.from_json(F.get_json_object("meta", f"$.{block}.questions"), "array<struct<question:string,test:string>>")
    rows = models.select("uid", F.posexplode(entries).alias("position", "e")).select("uid", "position", F.trim("e.question").alias("question"), F.trim("e.test").alias("test_name"))
    return rows.where("coalesce(question, '') <> ''").select("uid", "question", "test_name")


def test_sql(tests: DataFrame) -> DataFrame:
    """(test_id, sql) as run, else as compiled, else as written."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return tests.select("test_id", F.coalesce(filled("run_sql"), filled("compiled_sql"), filled("raw_sql"), F.lit("")).alias("sql"))


def explanations(scores: DataFrame) -> DataFrame:
    """(dimension, score, reading, text) of health scores by dimension: good from 80, fair from 50, else poor."""
    reading = F.when(F.col("score").isNull(), "unknown").when(F.col("score") >= 80, "good").when(F.col("score") >= 50, "fair").otherwise("poor")
    said = F.when(F.col("score").isNull(), F.concat(F.col("dimension"), F.lit(": no data"))).otherwise(F.concat(F.col("dimension"), F.lit(" is "), reading, F.lit(" at "), F.format_number("score", 0), F.lit("%")))
    return scores.select("dimension", "score", reading.alias("reading"), said.alias("text"))


def verified_questions(questions: DataFrame, tests: DataFrame, results: DataFrame) -> DataFrame:
    """(question, test_name, verdict): misconfigured without such a test, not_run without a result, else its status."""
    rows = questions.join(tests.select("test_name", "test_id").distinct(), "test_name", "left").join(results, "test_id", "left")
    verdict = F.when(F.col("test_id").isNull(), "misconfigured").otherwise(F.coalesce(status_name(F.col("status")), F.lit("not_run")))
    return rows.select("question", "test_name", verdict.alias("verdict"))


#: Projects of more models than this are listed without columns.
MOST_WITH_COLUMNS = 500


def compact_sources(sources: DataFrame, columns: DataFrame, model_count: int) -> DataFrame:
    """(name, description, schema, columns, freshness_status) of sources (uid, source_name, name, ...), the columns (uid, name, pos) in order."""
    named = columns.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("columns"))
    out = sources.join(named, "uid", "left") if model_count <= MOST_WITH_COLUMNS else sources.withColumn("columns", F.lit(None).cast("array<string>"))
    return out.select(F.concat_ws(".", "source_name", "name").alias("name"), F.coalesce("description", F.lit("")).alias("description"), "schema", "columns", "freshness_status")


#: Projects of more models than these are listed without columns, and without descriptions.
COLUMNS_TIER, DESCRIPTIONS_TIER = 200, 500


def compact_models(models: DataFrame, columns: DataFrame, attached: DataFrame) -> DataFrame:
    """(uid, name, description, columns, test_status) of models, the more of them the shorter: columns (by position) and descriptions are null beyond the tiers; test_status is a status:count list."""
    many = models.agg(F.count(F.lit(1)).alias("many"))
    named = columns.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("columns"))
    status = attached.groupBy("uid", "status").agg(F.count(F.lit(1)).alias("n")).groupBy("uid").agg(F.array_sort(F.collect_list(F.concat_ws(":", "status", "n"))).alias("test_status"))
    out = models.join(named, "uid", "left").join(status, "uid", "left").crossJoin(F.broadcast(many))  # one row
    return out.select("uid", "name", F.when(F.col("many") <= DESCRIPTIONS_TIER, F.col("description")).alias("description"), F.when(F.col("many") <= COLUMNS_TIER, F.col("columns")).alias("columns"), "test_status")


# The warehouse type that a column's name, or what it ends with after an underscore, stands for.
TYPE_OF_NAME = {
    "VARCHAR": "id uuid key name title description text label slug email url path type status code address phone",
    "DATE": "date",
    "TIMESTAMP_NTZ": "created_at updated_at deleted_at started_at ended_at timestamp at time",
    "NUMBER": "count number num",
    "NUMBER(38,2)": "amount total price cost",
    "FLOAT": "rate ratio percent percentage score weight",
    "BOOLEAN": "flag enabled active",
}
#: Names that stand for a type only as an ending.
ENDINGS = ("at", "time", "number", "num")


def synthetic_type(name: Column, declared: Column) -> Column:
    """A plausible warehouse type of a column that no catalog tells of: as declared, else by its name, else VARCHAR."""
    lower = F.lower(name)
    out = F.when(F.coalesce(declared, F.lit("")) != "", F.upper(declared))
    for kind, names in TYPE_OF_NAME.items():
        whole = "|".join(n for n in names.split() if n not in ENDINGS)
        out = out.when(lower.rlike(rf"^(?:{whole})$") | lower.rlike(rf"_(?:{names.replace(' ', '|')})$"), kind)
    return out.when(lower.rlike("^(?:is|has)_"), "BOOLEAN").otherwise("VARCHAR")


def synthetic_catalog(columns: DataFrame) -> DataFrame:
    """(uid, name, type, idx) of declared columns (uid, name, pos, data_type): what a catalog would say, names in capitals; of names that differ in case only the first."""
    first = F.row_number().over(Window.partitionBy("uid", F.upper("name")).orderBy("pos", "name"))
    rows = columns.withColumn("place", first).where("place = 1")
    number = F.row_number().over(Window.partitionBy("uid").orderBy("pos", "name"))
    return rows.select("uid", F.upper("name").alias("name"), synthetic_type(F.col("name"), F.col("data_type")).alias("type"), number.alias("idx"))
