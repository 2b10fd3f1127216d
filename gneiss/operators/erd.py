"""Entity relationships: cardinality inference, composition of tested and declared ones, partners and reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import reach

# Endpoints that a declared kind sets, (child, parent).
KINDS = {"one_to_one": ("one_and_only_one", "one_and_only_one"), "one_to_many": ("one_and_only_one", "one_or_many"), "many_to_many": ("one_or_many", "one_or_many")}


def relationship_id(source: str, source_column: str, target: str, target_column: str, origin: str) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", source, source_column, target, target_column, origin)), 1, 12)


def endpoints(child_not_null: Column, parent_unique: Column, kind: Column | None = None) -> tuple[Column, Column]:
    """(child, parent) endpoints from two facts, unless a declared kind sets them."""
    child = F.when(child_not_null, "one_and_only_one").otherwise("zero_or_one")
    parent = F.when(parent_unique, "one_or_many").otherwise("zero_or_many")
    for name, (c, p) in KINDS.items() if kind is not None else ():
        child, parent = F.when(kind == name, c).otherwise(child), F.when(kind == name, p).otherwise(parent)
    return child, parent


def key_facts(df: DataFrame, column: str) -> DataFrame:
    """(not_null, is_unique, rows, distinct_values) of a column, measured."""
    c = F.col(column)
    return df.groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("v").alias("distinct_values"),
        F.coalesce(F.bool_and(F.col("v").isNotNull()), F.lit(True)).alias("not_null"), F.coalesce(F.bool_and((F.col("n") == 1) | F.col("v").isNull()), F.lit(True)).alias("is_unique"),
    )


def missing_parents(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent, with their number of rows."""
    rows = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(parent.select(F.col(parent_key).alias("key")).distinct(), "key", "left_anti")


def tested_relationships(tests: DataFrame, facts: DataFrame, results: DataFrame) -> DataFrame:
    """Relationships from tests (test_id, child, child_column, parent, parent_column, severity) and column facts (uid, column_name, test_type)."""
    has = lambda kind, uid, column: facts.where(F.col("test_type").isin(*kind)).select(F.col("uid").alias(uid), F.lower("column_name").alias(f"{column}_key"), F.lit(True).alias(f"{uid}_has")).distinct()
    rows = tests.withColumns({"child_column_key": F.lower("child_column"), "parent_column_key": F.lower("parent_column")})
    rows = rows.join(has(["not_null", "primary_key"], "child", "child_column"), ["child", "child_column_key"], "left")
    rows = rows.join(has(["unique", "primary_key", "unique_key"], "parent", "parent_column"), ["parent", "parent_column_key"], "left")
    rows = rows.join(results.select("test_id", "status"), "test_id", "left")
    child, parent = endpoints(F.coalesce("child_has", F.lit(False)), F.coalesce("parent_has", F.lit(False)))
    return rows.select(
        F.col("child").alias("source"), F.col("child_column").alias("source_column"), F.col("parent").alias("target"), F.col("parent_column").alias("target_column"),
        child.alias("source_end"), parent.alias("target_end"), F.lower(F.coalesce("severity", F.lit("error"))).alias("severity"), F.coalesce("status", F.lit("not_run")).alias("status"), F.lit("test").alias("origin"),
    )


def test_ends(tests: DataFrame, names: DataFrame, columns: DataFrame) -> DataFrame:
    """Children and parents of relationship tests, ready for ``tested_relationships``, and whether the parent has the column.

    ``tests``: test_id, name, namespace, column_name, kwargs, refs (name, package; parent first), sources (schema and
    table), severity. The built-in test names the parent's column ``field``, or has a source as parent and the child as
    last ref; the constraint package's foreign key names it pk_column_name. Tests across packages, of several columns
    or with ends that ``names`` (name, uid) doesn't hold are left out. ``columns``: (uid, name).
    """
    plain = (F.col("name") == "relationships") & F.col("namespace").isNull()
    constraint = (F.col("name") == "foreign_key") & (F.col("namespace") == "dbt_constraints") & F.col("kwargs.pk_table_name").isNotNull()
    constraint = constraint & F.col("kwargs.fk_column_names").isNull() & F.col("kwargs.pk_column_names").isNull()
    by_source = plain & (F.coalesce(F.size("sources"), F.lit(0)) > 0)
    child = F.when(by_source, F.try_element_at("refs", F.lit(-1))).otherwise(F.get("refs", F.lit(1)))
    parent = F.get("refs", F.lit(0))
    rows = tests.where(plain | constraint).select(
        "test_id", F.col("column_name").alias("child_column"), F.when(plain, F.col("kwargs.field")).otherwise(F.col("kwargs.pk_column_name")).alias("parent_column"), "severity",
        F.when(by_source, F.get(F.get("sources", F.lit(0)), F.lit(1))).otherwise(parent["name"]).alias("parent_name"), child["name"].alias("child_name"),
        (child["package"].isNotNull() | ~by_source & parent["package"].isNotNull()).alias("across"),
    )
    rows = rows.where("NOT across AND coalesce(child_column, '') <> '' AND coalesce(parent_column, '') <> ''")
    rows = rows.join(names.toDF("parent_name", "parent"), "parent_name").join(names.toDF("child_name", "child"), "child_name")
    return _with_parent_column(rows, columns).select("test_id", "child", "child_column", "parent", "parent_column", "severity", "parent_column_exists")


def _with_parent_column(rows: DataFrame, columns: DataFrame) -> DataFrame:
    have = columns.select(F.col("uid").alias("parent"), F.lower("name").alias("_key"), F.lit(True).alias("_has")).distinct()
    rows = rows.withColumn("_key", F.lower("parent_column")).join(have, ["parent", "_key"], "left")
    return rows.withColumn("parent_column_exists", F.coalesce("_has", F.lit(False))).drop("_has", "_key")


def declared_relationships(columns: DataFrame, names: DataFrame, block: str) -> DataFrame:
    """Relationships that columns (uid, name, meta, resource_type) of models declare in the list ``relationships`` of a block of their meta.

    An entry needs the texts ``to`` and ``field``; a kind that is none is no kind, severity is warn unless given, and of
    entries with equal ``to`` and ``field`` the last one holds. A model that isn't known gives a ghost with an empty target.
    """
    entry = "struct<to:string,field:string,kind:string,label:string,severity:string>"
    declared = F.from_json(F.get_json_object("meta", f"$.{block}.relationships"), f"array<{entry}>")
    rows = columns.where("resource_type = 'model'").select(F.col("uid").alias("source"), F.col("name").alias("source_column"), F.posexplode(declared).alias("position", "e"))
    rows = rows.where("coalesce(e.to, '') <> '' AND coalesce(e.field, '') <> ''")
    last = F.row_number().over(Window.partitionBy("source", "source_column", "e.to", "e.field").orderBy(F.desc("position")))
    rows = rows.withColumn("place", last).where("place = 1").withColumn("to", F.col("e.to")).join(names.toDF("to", "parent"), "to", "left")
    rows = _with_parent_column(rows.withColumn("parent_column", F.col("e.field")), columns.select("uid", "name"))
    return rows.select(
        "source", "source_column", F.coalesce("parent", F.lit("")).alias("target"), F.col("parent_column").alias("target_column"), F.when(F.col("e.kind").isin(*KINDS), F.col("e.kind")).alias("kind"),
        F.col("e.label").alias("label"), F.lower(F.coalesce("e.severity", F.lit("warn"))).alias("severity"), "position", "parent_column_exists",
    )


def related_only(nodes: DataFrame, relationships: DataFrame) -> DataFrame:
    """The nodes that stand in a relationship."""
    return nodes.join(partner_stats(relationships).select(F.col("node").alias("uid")), "uid", "left_semi")


def compose(tested: DataFrame, declared: DataFrame) -> DataFrame:
    """Tested and declared (source, source_column, target, target_column, kind, label) relationships as one set with ids.

    Of equal declared ones the last by ``position`` holds. Found in both: origin both, test facts, declared label and kind.
    """
    keys = ["source", "source_column", "target", "target_column"]
    last = F.row_number().over(Window.partitionBy("source", "source_column", *[F.coalesce(c, F.lit("")) for c in keys[2:]]).orderBy(F.desc("position")))
    d = declared.withColumn("place", last).where("place = 1").select(*keys, "kind", "label", F.lit(True).alias("_d"))
    same = None
    for k in keys:
        one = F.coalesce(F.col(f"t.{k}"), F.lit("")) == F.coalesce(F.col(f"d.{k}"), F.lit(""))
        same = one if same is None else same & one
    rows = tested.alias("t").join(d.alias("d"), same, "full_outer")
    origin = F.when(F.col("t.origin").isNotNull() & F.col("d._d").isNotNull(), "both").when(F.col("d._d").isNotNull(), "meta").otherwise("test")
    child, parent = endpoints(F.lit(False), F.lit(False), F.col("d.kind"))
    pick = lambda made, own: F.when(F.col("d.kind").isin(*KINDS), made).otherwise(F.coalesce(own, made))
    out = rows.select(
        *[F.coalesce(f"t.{k}", f"d.{k}", F.lit("")).alias(k) for k in keys], pick(child, F.col("t.source_end")).alias("source_end"), pick(parent, F.col("t.target_end")).alias("target_end"),
        F.coalesce("t.severity", F.lit("warn")).alias("severity"), F.coalesce("t.status", F.lit("none")).alias("status"), origin.alias("origin"), F.coalesce("d.label", F.lit("")).alias("label"),
    )
    return out.withColumns({"is_ghost": F.col("target") == "", "relationship_id": relationship_id(*keys, "origin")})


def partner_stats(relationships: DataFrame, top: int = 3) -> DataFrame:
    """(node, total, partners): relationships of a node both ways, and its ``top`` partners by count, then id. A ghost only counts for its source."""
    real = relationships.where("coalesce(target, '') <> ''")
    ends = real.select(F.col("source").alias("node"), F.col("target").alias("partner")).union(real.select("target", "source"))
    counts = ends.groupBy("node", "partner").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "partner"))
    best = counts.withColumn("place", place).where(F.col("place") <= top).groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "partner"))), lambda x: x["partner"]), ",").alias("partners"))
    ghosts = relationships.where("coalesce(target, '') = ''").groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.select("node", "n").union(ghosts).groupBy("node").agg(F.sum("n").alias("total"))
    return total.join(best, "node", "left").select("node", "total", F.coalesce("partners", F.lit("")).alias("partners"))


def reachable(relationships: DataFrame, start: str, hops: int | None = None) -> DataFrame:
    """(node, depth) over relationships whatever their direction."""
    seed = relationships.sparkSession.createDataFrame([(start,)], "seed string")
    return reach(relationships.where("coalesce(target, '') <> ''").select("source", "target"), seed, "both", hops).select("node", "depth")


def key_columns(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """(uid, column_name, is_foreign, is_primary): ends of relationships, and columns both unique and not null."""
    foreign = relationships.select(F.col("source").alias("uid"), F.lower("source_column").alias("column_name")).distinct().withColumn("is_foreign", F.lit(True))
    kinds = facts.groupBy("uid", F.lower("column_name").alias("column_name")).agg(F.collect_set("test_type").alias("k"))
    primary = kinds.where((F.array_contains("k", "unique") & F.array_contains("k", "not_null")) | F.array_contains("k", "primary_key")).select("uid", "column_name", F.lit(True).alias("is_primary"))
    out = foreign.join(primary, ["uid", "column_name"], "full_outer")
    return out.select("uid", "column_name", F.coalesce("is_foreign", F.lit(False)).alias("is_foreign"), F.coalesce("is_primary", F.lit(False)).alias("is_primary"))
