"""Queries over lineage rows, references, join pairs, measures and project summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage, metadata
from .metadata import _ATTACHED, _COMPOSED, _REL, _attached, _coverage_sql, _covered, _relationships
from .project import oracle, table
from .registry import query


def _columns(spark, d):
    return table(spark, d, "model_columns").withColumnRenamed("col", "column")


@query(
    "table_resolution",
    oracle(
        """WITH n AS (SELECT uid, schema || '.' || name AS k FROM known UNION SELECT uid, source_name || '.' || name FROM known UNION SELECT uid, name FROM known), r AS (SELECT ref, regexp_replace(ref, '[`"\\[\\]]', '', 'g') AS p FROM "references"),
        c AS (SELECT ref, uid, 0 AS prio FROM r JOIN n ON k = p UNION ALL SELECT ref, uid, 1 FROM r JOIN n ON lower(k) = lower(p) UNION ALL SELECT ref, uid, 2 FROM r JOIN n ON lower(k) = lower(regexp_extract(p, '[^.]*\\.?[^.]*$')))
        SELECT ref, uid FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY prio, uid) AS i FROM c) WHERE i = 1""",
        "references", "known",
    ).replace("WITH references AS", 'WITH "references" AS'),
)
def table_resolution(spark, d):
    return lineage.resolved(table(spark, d, "references"), table(spark, d, "known"))


@query(
    "lineage_gap_backfill",
    oracle(
        """SELECT u.m AS target_model, u.c AS target_column, e.source AS source_model, u.c AS source_column, 'passthrough' AS transformation FROM (SELECT DISTINCT source_model AS m, lower(source_column) AS c FROM column_lineage WHERE source_model <> '') u
        JOIN model_edges e ON e.target = u.m JOIN (SELECT DISTINCT model, lower(col) AS c FROM model_columns) h ON h.model = e.source AND h.c = u.c WHERE NOT EXISTS (SELECT 1 FROM column_lineage l WHERE l.target_model = u.m AND lower(l.target_column) = u.c)""",
        "column_lineage", "model_edges", "model_columns",
    ),
)
def gap_backfill(spark, d):
    return lineage.gap_backfill(table(spark, d, "column_lineage"), table(spark, d, "model_edges"), _columns(spark, d))


_ORIENTED = "o AS (SELECT DISTINCT e.source, e.target, CASE WHEN e.source = left_model THEN left_column ELSE right_column END AS source_column, CASE WHEN e.source = left_model THEN right_column ELSE left_column END AS target_column FROM join_pairs JOIN model_edges e ON (e.source = left_model AND e.target = right_model) OR (e.source = right_model AND e.target = left_model))"


def _oriented(spark, d):
    return lineage.oriented(table(spark, d, "join_pairs"), table(spark, d, "model_edges"))


@query("join_pairs_oriented", oracle(f"WITH {_ORIENTED} SELECT * FROM o", "join_pairs", "model_edges"))
def join_pairs(spark, d):
    return _oriented(spark, d)


@query("join_pair_sets", oracle(f"WITH {_ORIENTED}, c AS (SELECT least(source, target) || '|' || greatest(source, target) AS pair, unnest([source || '.' || source_column, target || '.' || target_column]) AS c FROM o) SELECT pair, string_agg(DISTINCT c, ',' ORDER BY c) AS columns FROM c GROUP BY pair", "join_pairs", "model_edges"))
def pair_sets(spark, d):
    return lineage.pair_sets(_oriented(spark, d))


@query(
    "collapsed_ctes",
    oracle(
        """WITH RECURSIVE r AS (SELECT e.source AS s, e.target AS t FROM cte_edges e JOIN cte_nodes n ON n.node = e.target WHERE NOT n.passthrough
          UNION SELECT e.source, r.t FROM r JOIN cte_nodes n ON n.node = r.s JOIN cte_edges e ON e.target = r.s WHERE n.passthrough)
        SELECT s AS source, t AS target FROM r JOIN cte_nodes n ON n.node = s WHERE NOT n.passthrough AND s <> t""",
        "cte_nodes", "cte_edges",
    ),
)
def collapsed(spark, d):
    return lineage.collapsed(table(spark, d, "cte_nodes"), table(spark, d, "cte_edges"))


@query("exposure_components", oracle("WITH RECURSIVE s AS (SELECT measure FROM components UNION SELECT measure FROM measure_sources), r AS (SELECT measure, measure AS node FROM s UNION SELECT r.measure, c.component FROM r JOIN components c ON c.measure = r.node) SELECT DISTINCT r.measure, model, col AS column FROM r JOIN measure_sources m ON m.measure = r.node", "components", "measure_sources"))
def exposure_components(spark, d):
    return lineage.leaf_sources(table(spark, d, "components"), table(spark, d, "measure_sources").withColumnRenamed("col", "column"))


@query("lineage_nodes", oracle("SELECT model, CAST(sum(t) AS BIGINT) AS targets, CAST(sum(s) AS BIGINT) AS sources FROM (SELECT target_model AS model, 1 AS t, 0 AS s FROM column_lineage UNION ALL SELECT source_model, 0, 1 FROM column_lineage WHERE source_model <> '') GROUP BY model", "column_lineage"))
def lineage_nodes(spark, d):
    return lineage.lineage_nodes(table(spark, d, "column_lineage"))


@query("lineage_cost", oracle("SELECT count(DISTINCT model) AS models, count(*) AS columns, 2 * count(*) AS worst_seconds, count(DISTINCT model) >= 75 AS warn FROM model_columns", "model_columns"))
def cost(spark, d):
    return lineage.cost_estimate(_columns(spark, d))


@query("lineage_missing_columns", oracle("SELECT m AS model, c AS column FROM (SELECT target_model AS m, lower(target_column) AS c FROM column_lineage UNION SELECT source_model, lower(source_column) FROM column_lineage WHERE source_model <> '') EXCEPT SELECT model, lower(col) FROM model_columns", "column_lineage", "model_columns"))
def missing(spark, d):
    return lineage.missing_columns(table(spark, d, "column_lineage"), _columns(spark, d))


@query("test_status_histogram", oracle(f"WITH {_ATTACHED} SELECT uid, status, count(*) AS tests FROM a GROUP BY ALL", "tests", "results"))
def status_histogram(spark, d):
    return _attached(spark, d).groupBy("uid", "status").agg(F.count(F.lit(1)).alias("tests"))


@query("project_shape", oracle("SELECT resource_type, count(*) AS nodes, count(*) FILTER (is_package) AS from_packages FROM nodes GROUP BY 1", "nodes"))
def shape(spark, d):
    return table(spark, d, "nodes").groupBy("resource_type").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_package").alias("from_packages"))


_HALVES = "50 * (documented_model_rate + documented_column_rate) AS documentation, 50 * (tested_model_rate + tested_column_rate) AS testing"


@query("weakest_dimension", f"SELECT CASE WHEN testing < documentation THEN 'testing' ELSE 'documentation' END AS dimension FROM (SELECT {_HALVES} FROM ({_coverage_sql('')}))")
def weakest(spark, d):
    made = _covered(spark, d).select((50 * (F.col("documented_model_rate") + F.col("documented_column_rate"))).alias("documentation"), (50 * (F.col("tested_model_rate") + F.col("tested_column_rate"))).alias("testing"))
    return made.select(F.expr("stack(2, 'documentation', documentation, 'testing', testing) AS (dimension, score)")).agg(F.min_by("dimension", "score").alias("dimension"))


@query("erd_suggestions", oracle(f"WITH {_COMPOSED} SELECT node, count(*) AS relationships FROM (SELECT source AS node FROM cm UNION ALL SELECT target FROM cm WHERE target <> '') GROUP BY node ORDER BY 2 DESC, 1 LIMIT 12", *_REL))
def suggestions(spark, d):
    rows = _relationships(spark, d)
    ends = rows.select(F.col("source").alias("node")).union(rows.where("not is_ghost").select("target"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("relationships")).orderBy(F.desc("relationships"), "node").limit(12)


@query("tag_facet", oracle("SELECT tag, count(*) AS nodes FROM (SELECT unnest(string_split(tags, ',')) AS tag FROM nodes) WHERE tag <> '' GROUP BY tag", "nodes"))
def tags(spark, d):
    return table(spark, d, "nodes").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("nodes"))


@query("tag_tree", oracle("SELECT p AS folder, bool_or(list_contains(string_split(tags, ','), 'core')) AS tagged FROM (SELECT tags, unnest(CASE WHEN contains(folder, '/') THEN [split_part(folder, '/', 1), folder] ELSE [folder] END) AS p FROM nodes WHERE folder <> '') GROUP BY p", "nodes"))
def tag_tree(spark, d):
    parts = F.split("folder", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return table(spark, d, "nodes").where("folder <> ''").select("tags", F.explode(prefixes).alias("folder")).groupBy("folder").agg(F.bool_or(F.array_contains("tags", "core")).alias("tagged"))


@query("search_entries", oracle("SELECT node AS id, name, resource_type AS kind FROM nodes UNION ALL SELECT uid || '::' || name, name, 'column' FROM declared_columns", "nodes", "declared_columns"))
def entries(spark, d):
    columns = table(spark, d, "declared_columns").select(F.concat_ws("::", "uid", "name").alias("id"), "name", F.lit("column").alias("kind"))
    return table(spark, d, "nodes").select(F.col("node").alias("id"), "name", F.col("resource_type").alias("kind")).unionByName(columns)


@query("health_gate", f"SELECT testing < 90 AS failed FROM (SELECT {_HALVES} FROM ({_coverage_sql('')}))")
def gate(spark, d):
    made = _covered(spark, d).select((50 * (F.col("tested_model_rate") + F.col("tested_column_rate"))).alias("testing"))
    return made.select((F.col("testing") < 90).alias("failed"))


@query("slim_models", oracle("SELECT uid, name, '' AS sql FROM models", "models"))
def slim(spark, d):
    from ..sources.tables import slim as without_sql

    return without_sql(table(spark, d, "models").select("uid", "name", "sql"))


@query("sql_hashes", oracle("SELECT uid, substr(sha256(sql), 1, 16) AS sql_hash FROM models", "models"))
def hashes(spark, d):
    from ..functions.text import sql_hash

    return table(spark, d, "models").select("uid", sql_hash(F.col("sql")).alias("sql_hash"))


@query("model_catalog_stats", oracle("SELECT uid, CASE WHEN uid LIKE '%orders' THEN 12 END::BIGINT AS row_count FROM models", "models"))
def catalog_stats(spark, d):
    models = table(spark, d, "models").select("uid")
    stats = models.select("uid", F.lit("row_count").alias("stat_id"), F.when(F.col("uid").endswith("orders"), "12").otherwise("many").alias("value"))
    return metadata.with_stats(models, stats).select("uid", "row_count")
