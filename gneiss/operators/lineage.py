"""Relational work on lineage rows, table references, join pairs and measure components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import formula_columns
from .graph import reach

#: Seconds that tracing a column may take at worst, and the number of models from which a warning is due.
SECONDS_PER_COLUMN, WARN_MODELS = 2, 75


def resolved(references: DataFrame, known: DataFrame) -> DataFrame:
    """(ref, uid) of table references: exactly as named, then whatever the case, then by the last two parts.

    ``known`` has (uid, schema, name, source_name); a table answers to schema.name, source.name and name.
    """
    plain = F.regexp_replace("ref", "[`\"\\[\\]]", "")
    parts = F.split(plain, r"\.")
    last_two = F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)))
    names = known.select("uid", F.explode(F.array(F.concat_ws(".", "schema", "name"), F.concat_ws(".", "source_name", "name"), F.col("name"))).alias("key")).distinct()
    asked = references.select("ref").distinct().select("ref", F.posexplode(F.array(plain, F.lower(plain), F.lower(last_two))).alias("prio", "key"))
    exact = asked.where("prio = 0").join(names, "key")
    loose = asked.where("prio > 0").join(names.select("uid", F.lower("key").alias("key")).distinct(), "key")
    place = F.row_number().over(Window.partitionBy("ref").orderBy("prio", "uid"))
    return exact.unionByName(loose).withColumn("place", place).where("place = 1").select("ref", "uid")


def gap_backfill(lineage: DataFrame, edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Passthrough rows for columns that a child takes from a parent which has no trace of them, from each grandparent that has such a column."""
    used = lineage.where("source_model <> ''").select(F.col("source_model").alias("model"), F.lower("source_column").alias("column")).distinct()
    traced = lineage.select(F.col("target_model").alias("model"), F.lower("target_column").alias("column")).distinct()
    gaps = used.join(traced, ["model", "column"], "left_anti").join(edges.select(F.col("target").alias("model"), F.col("source").alias("parent")), "model")
    have = columns.select(F.col("model").alias("parent"), F.lower("column").alias("column")).distinct()
    found = gaps.join(have, ["parent", "column"])
    return found.select(F.col("model").alias("target_model"), F.col("column").alias("target_column"), F.col("parent").alias("source_model"), F.col("column").alias("source_column"), F.lit("passthrough").alias("transformation"))


def oriented(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Join pairs (left_model, left_column, right_model, right_column) as (source, target, source_column, target_column) of the edges they lie on, either way round."""
    same = pairs.toDF("source", "source_column", "target", "target_column")
    turned = pairs.select(F.col("right_model").alias("source"), F.col("right_column").alias("source_column"), F.col("left_model").alias("target"), F.col("left_column").alias("target_column"))
    return same.unionByName(turned).join(edges, ["source", "target"]).select("source", "target", "source_column", "target_column").distinct()


def pair_sets(joins: DataFrame) -> DataFrame:
    """(pair, columns): the columns of each unordered pair of models."""
    ends = joins.select(F.concat_ws("|", F.least("source", "target"), F.greatest("source", "target")).alias("pair"), F.explode(F.array(F.concat_ws(".", "source", "source_column"), F.concat_ws(".", "target", "target_column"))).alias("c"))
    return ends.groupBy("pair").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("columns"))


def collapsed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with every passthrough node (node, passthrough) replaced by what it passes on; none point at themselves."""
    inner = nodes.where("passthrough").select("node")
    from_inner = edges.join(inner.withColumnRenamed("node", "target"), "target", "left_semi")
    up = reach(from_inner, inner, "upstream")
    real = up.join(nodes.where("not passthrough").select("node"), "node", "left_semi").select(F.col("seed").alias("source"), F.col("node").alias("real"))
    out = edges.join(inner.withColumnRenamed("node", "target"), "target", "left_anti").join(real, "source", "left")
    return out.select(F.coalesce("real", "source").alias("source"), "target").where("source <> target").distinct()


def leaf_sources(components: DataFrame, direct: DataFrame) -> DataFrame:
    """(measure, model, column): everything a measure rests on through its components, cycles included once.

    The search goes from the measures with sources to those that rest on them: it finds no pair that the result doesn't
    have, and where many measures rest on one they are not gathered at it in each step.
    """
    got = reach(components.select(F.col("measure").alias("source"), F.col("component").alias("target")), direct.select("measure"), "upstream")
    return got.join(direct.withColumnRenamed("measure", "seed"), "seed").select(F.col("node").alias("measure"), "model", "column").distinct()


def lineage_nodes(lineage: DataFrame) -> DataFrame:
    """(model, targets, sources): models with lineage, and on how many rows they stand on either side."""
    sides = lineage.select(F.col("target_model").alias("model"), F.lit(1).alias("t"), F.lit(0).alias("s")).unionByName(lineage.where("source_model <> ''").select(F.col("source_model").alias("model"), F.lit(0).alias("t"), F.lit(1).alias("s")))
    return sides.groupBy("model").agg(F.sum("t").alias("targets"), F.sum("s").alias("sources"))


def cost_estimate(columns: DataFrame) -> DataFrame:
    """(models, columns, worst_seconds, warn)."""
    return columns.agg(F.count_distinct("model").alias("models"), F.count(F.lit(1)).alias("columns"), (SECONDS_PER_COLUMN * F.count(F.lit(1))).alias("worst_seconds"), (F.count_distinct("model") >= WARN_MODELS).alias("warn"))


def missing_columns(lineage: DataFrame, columns: DataFrame) -> DataFrame:
    """(model, column) that lineage rows name and the models don't have."""
    named = lineage.select(F.col("target_model").alias("model"), F.lower("target_column").alias("column")).union(lineage.where("source_model <> ''").select("source_model", F.lower("source_column"))).distinct()
    return named.join(columns.select("model", F.lower("column").alias("column")), ["model", "column"], "left_anti")


# Transformations that lineage knows, and other names for them.
TRANSFORMATIONS = ("passthrough", "rename", "derived", "aggregated", "constant", "untraced", "unknown", "direct")
ALIASES = {"renamed": "rename", "cast": "passthrough"}


def transformation_name(raw: Column) -> Column:
    """A transformation as lineage names it; what isn't known is aggregated."""
    name = F.lower(F.trim(raw))
    out = F.when(name.isin(*TRANSFORMATIONS), name)
    for other, known in ALIASES.items():
        out = out.when(name == other, known)
    return out.otherwise("aggregated")


def migrated(cached: DataFrame) -> DataFrame:
    """Lineage rows of an older cache: what was direct is passthrough now."""
    return cached.withColumn("transformation", F.when(F.col("transformation") == "direct", "passthrough").otherwise(F.col("transformation")))


def marts_of(fields: DataFrame) -> DataFrame:
    """(model): the models that fields of exposures name, trimmed."""
    return fields.select(F.explode("depends_on").alias("d")).select(F.trim("d.model").alias("model")).where("model <> ''").distinct()


def field_dependencies(fields: DataFrame, names: DataFrame) -> DataFrame:
    """(exposure, field, source_model, source_column, transformation, expression) of the fields' own dependencies.

    ``fields``: exposure, field, expression, depends_on (model, column, transformation). ``names``: (name, uid, place);
    of equal names the one of least place holds. A column may be an expression, which stands for the columns it names.
    The formula goes with a field's first dependency, or with an aggregated one made for it.
    """
    known = names.groupBy("name").agg(F.min_by("uid", F.struct("place", "uid")).alias("source_model"))
    plain, dotted = r"^[A-Za-z_]\w*$", r"^[A-Za-z_][\w.]*$"
    column = F.trim("d.column")
    columns = F.when(column.rlike(plain), F.array(column)).when(column.rlike(dotted), F.array(F.element_at(F.split(column, r"\."), -1))).otherwise(formula_columns(column))
    rows = fields.select("exposure", "field", F.posexplode("depends_on").alias("i", "d"))
    rows = rows.select("exposure", "field", "i", F.col("d.model").alias("name"), transformation_name(F.col("d.transformation")).alias("transformation"), F.posexplode(columns).alias("j", "source_column"))
    rows = rows.join(known, "name")
    first = F.row_number().over(Window.partitionBy("exposure", "field", "source_model", "source_column").orderBy("i", "j"))
    rows = rows.withColumn("first", first).where("first = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("exposure", "field").orderBy("i", "j")))
    formula = fields.select("exposure", "field", F.when(F.trim("expression") != "", F.trim("expression")).alias("expression"))
    out = formula.join(rows, ["exposure", "field"], "left").where("place IS NOT NULL OR expression IS NOT NULL")
    return out.select(
        "exposure", "field", "source_model", "source_column", F.coalesce("transformation", F.lit("aggregated")).alias("transformation"),
        F.when(F.coalesce("place", F.lit(1)) == 1, F.col("expression")).alias("expression"),
    )


def join_badge(join_type: Column) -> Column:
    """INNER for no or a blank type, else the type in capitals, its words joined by hyphens, eight characters at most; null has none."""
    name = F.upper(F.regexp_replace(F.trim(join_type), r"\s+", "-"))
    return F.when(name == "", "INNER").otherwise(F.substring(name, 1, 8))


def role_badges(pairs: DataFrame, indirect: DataFrame, bases: DataFrame, focus: DataFrame) -> DataFrame:
    """(model, badge) of the parents of the focused models: how they are joined, or AGG or CTE for those that come in by one alone.

    ``pairs``: model, position, left_model, right_model, join_type. ``indirect``: model, position, parent, kind. ``bases``:
    (model, base), the parent that stands in FROM, which gets no badge from its child. ``focus``: (model, place). Of several
    badges the first holds, by place and position, and a direct one before an indirect one.
    """
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left_model").alias("m")), F.struct(F.lit(1).alias("side"), F.col("right_model").alias("m")))).alias("e")
    direct = pairs.where("join_type IS NOT NULL").select("model", "position", ends, join_badge(F.col("join_type")).alias("badge")).select("model", "position", "e.side", F.col("e.m").alias("parent"), "badge", F.lit(0).alias("way"))
    kind = F.when(F.lower(F.coalesce("kind", F.lit("cte"))) == "agg", "AGG").otherwise("CTE")
    rest = indirect.where("coalesce(parent, '') <> ''").select("model", "position", F.lit(0).alias("side"), "parent", kind.alias("badge"), F.lit(1).alias("way"))
    rows = direct.unionByName(rest).join(focus, "model").join(bases, "model", "left").where("base IS NULL OR base <> parent")
    return rows.groupBy(F.col("parent").alias("model")).agg(F.min_by("badge", F.struct("way", "place", "position", "side")).alias("badge"))


def visible_endpoints(pairs: DataFrame, visible: DataFrame) -> DataFrame:
    """(model, column, relationship) of join keys whose two models are both visible; relationships are numbered by first sight, and of several the first holds.

    ``pairs``: position, left_model, left_column, right_model, right_column.
    """
    shown = pairs.join(visible.select(F.col("model").alias("left_model")), "left_model", "left_semi").join(visible.select(F.col("model").alias("right_model")), "right_model", "left_semi")
    shown = shown.withColumns({"a": F.least("left_model", "right_model"), "b": F.greatest("left_model", "right_model")})
    first = shown.groupBy("a", "b").agg(F.min("position").alias("seen"))
    ends = F.inline(F.array(F.struct(F.col("left_model").alias("model"), F.col("left_column").alias("column")), F.struct(F.col("right_model").alias("model"), F.col("right_column").alias("column"))))
    rows = shown.join(first, ["a", "b"]).select("position", "seen", ends)
    return rows.groupBy("model", "column").agg(F.min_by("seen", "position").alias("relationship"))


def cached_lineage(cached: DataFrame, wanted: DataFrame, version: int, dialect: str) -> tuple[DataFrame, DataFrame]:
    """(rows of a cache that still hold, models to trace anew) for ``wanted`` (uid, sql_hash): same text, same version, same dialect."""
    valid = cached.where((F.col("version") == version) & (F.col("dialect") == dialect))
    return migrated(valid.join(wanted, ["uid", "sql_hash"], "left_semi")), wanted.join(valid.select("uid", "sql_hash").distinct(), ["uid", "sql_hash"], "left_anti")


def failure_report(failures: DataFrame) -> DataFrame:
    """(line) of failed models (name, uid, error), by name, the error on one line."""
    return failures.orderBy("name", "uid").select(F.concat_ws(": ", "name", F.regexp_replace("error", r"\s+", " ")).alias("line"))
