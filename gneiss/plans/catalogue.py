"""Queries over a project derived from the driver tables, with thousands of nodes: selection, declared relationships, exposures, paths.

Every part is a model; its children are the parts of twice its number and one more. Suppliers are sources.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import erd, graph, lineage, metadata, search
from ..sources import tables
from .registry import dealt, query, table

NODES_SQL = "n AS (SELECT 'm.' || p_partkey AS node, 'part_' || p_partkey AS name, p_brand AS folder, 'models/' || p_brand || '/part_' || p_partkey || '.sql' AS path, lower(p_type) AS kind, p_partkey AS k FROM part)"
EDGES_SQL = "e AS (SELECT 'm.' || a.p_partkey AS source, 'm.' || b.p_partkey AS target FROM part a JOIN part b ON b.p_partkey // 2 = a.p_partkey AND b.p_partkey > 1)"


def nodes(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        F.concat(F.lit("m."), "p_partkey").alias("node"), F.concat(F.lit("part_"), "p_partkey").alias("name"), F.col("p_brand").alias("folder"),
        F.concat(F.lit("models/"), "p_brand", F.lit("/part_"), "p_partkey", F.lit(".sql")).alias("path"), F.split(F.lower("p_type"), " ").alias("tags"), F.col("p_partkey").alias("k"),
    )


def edges(spark, d) -> DataFrame:
    n = nodes(spark, d)
    parents = n.select(F.col("k").alias("p"), F.col("node").alias("source"))
    return n.where("k > 1").select(F.floor(F.col("k") / 2).alias("p"), F.col("node").alias("target")).join(parents, "p").select("source", "target")


@query(
    "lineage_subset_parts",
    f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL},
    up AS (SELECT node, 0 AS depth FROM n WHERE name LIKE 'part\\_100%' ESCAPE '\\' OR name = 'part_5' UNION SELECT e.source, depth + 1 FROM up JOIN e ON e.target = up.node WHERE depth < 3),
    down AS (SELECT node, 0 AS depth FROM n WHERE name IN ('part_7', 'part_5') OR folder = 'Brand#none' UNION SELECT e.target, depth + 1 FROM down JOIN e ON e.source = down.node WHERE depth < 3)
    SELECT node, CAST(min(depth) AS INT) AS depth FROM (SELECT * FROM up UNION ALL SELECT * FROM down) GROUP BY node""",
)
def lineage_subset(spark, d):
    return graph.lineage_subset(nodes(spark, d), edges(spark, d), "part_100*, part_7+ +part_5+ Brand#none+", 3)


@query(
    "select_expression_parts",
    f"""WITH {NODES_SQL}, h AS (
      SELECT 'tag:STEEL' AS term, node FROM n WHERE list_contains(string_split(kind, ' '), 'steel') UNION ALL SELECT 'PART_19*', node FROM n WHERE name LIKE 'part\\_19%' ESCAPE '\\'
      UNION ALL SELECT '+m.7', node FROM n WHERE node = 'm.7' UNION ALL SELECT 'part_8+', node FROM n WHERE name = 'part_8' UNION ALL SELECT 'Part_9', node FROM n WHERE name = 'part_9')
    SELECT t.term, h.node FROM (SELECT unnest(['tag:STEEL', 'PART_19*', '+m.7', 'part_8+', 'Part_9', 'nothing']) AS term) t LEFT JOIN h USING (term)""",
)
def select_expression(spark, d):
    return graph.select_expression(nodes(spark, d), "tag:STEEL PART_19* +m.7 part_8+ Part_9 nothing")


#: How the tests of the derived project differ, by the part's number modulo 7: built-in, from a source, of the constraint package, across packages, composite, without a field, of another package.
@query(
    "test_relationship_ends",
    """WITH t AS (SELECT p_partkey AS k, p_partkey // 2 AS h, p_partkey % 7 AS r FROM part WHERE p_partkey > 1),
    x AS (SELECT *, CASE WHEN r = 1 THEN 's.' || (1 + k % 5) ELSE 'm.' || h END AS parent, CASE WHEN r = 2 THEN 'pk' ELSE 'ID' END AS parent_column FROM t WHERE r IN (0, 1, 2))
    SELECT 'test.' || k AS test_id, 'm.' || k AS child, 'parent_id' AS child_column, parent, parent_column, CASE WHEN k % 2 = 0 THEN 'WARN' END AS severity, r <> 2 AND (r = 1 OR h % 3 <> 0) AS parent_column_exists
    FROM x WHERE EXISTS (SELECT 1 FROM part p WHERE r = 1 OR p.p_partkey = x.h) AND (r <> 1 OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = 1 + k % 5))""",
)
def test_ends(spark, d):
    half, r = F.floor(F.col("k") / 2), F.col("k") % 7
    ref = lambda name, package=None: F.struct(name.alias("name"), F.lit(package).cast("string").alias("package"))
    child = F.concat(F.lit("part_"), "k")
    parent = F.concat(F.lit("part_"), half.cast("string"))
    keys = {"field": F.when(r.isin(0, 1, 3, 6), "ID"), "pk_column_name": F.when(r.isin(2, 4), "pk"), "pk_table_name": F.when(r.isin(2, 4), parent), "fk_column_names": F.when(r == 4, "a,b"), "pk_column_names": F.lit(None).cast("string")}
    given = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in keys.items()]), lambda e: e["value"].isNotNull()))
    tests = nodes(spark, d).where("k > 1").select(
        F.concat(F.lit("test."), "k").alias("test_id"), F.when(r.isin(2, 4), "foreign_key").otherwise("relationships").alias("name"), F.when(r.isin(2, 4), "dbt_constraints").when(r == 6, "other").alias("namespace"),
        F.lit("parent_id").alias("column_name"), given.alias("kwargs"),
        F.when(r == 1, F.array(ref(child))).when(r == 3, F.array(ref(parent, "p"), ref(child))).otherwise(F.array(ref(parent), ref(child))).alias("refs"),
        F.when(r == 1, F.array(F.array(F.lit("raw"), F.concat(F.lit("supplier_"), (1 + F.col("k") % 5).cast("string"))))).otherwise(F.array().cast("array<array<string>>")).alias("sources"),
        F.when(F.col("k") % 2 == 0, "WARN").alias("severity"),
    )
    sources = table(spark, d, "supplier").select(F.concat(F.lit("supplier_"), "s_suppkey").alias("name"), F.concat(F.lit("s."), "s_suppkey").alias("uid"))
    names = nodes(spark, d).select("name", F.col("node").alias("uid")).unionByName(sources)
    columns = nodes(spark, d).where("k % 3 <> 0").select(F.col("node").alias("uid"), F.lit("id").alias("name")).unionByName(sources.select("uid", F.lit("Id").alias("name")))
    return erd.test_ends(tests, names, columns)


def _models(spark, d) -> DataFrame:
    """Columns of models with relationships in their meta: two entries for one target of which the last holds, a ghost, and one without a field."""
    meta = F.concat(
        F.lit('{"graph": {"relationships": [{"to": "part_'), F.floor(F.col("k") / 2).cast("string"), F.lit('", "field": "ID", "kind": "one_to_one"}, {"to": "part_'), F.floor(F.col("k") / 2).cast("string"),
        F.lit('", "field": "ID", "kind": "'), F.when(F.col("k") % 3 == 0, "odd").otherwise("one_to_many"), F.lit('", "label": "of '), F.col("folder"), F.lit('", "severity": "ERROR"}, {"to": "ghost", "field": "x"}, {"to": "part_1"}]}}'),
    )
    return nodes(spark, d).select(F.col("node").alias("uid"), F.lit("id").alias("name"), F.when(F.col("k") % 5 == 0, meta).alias("meta"), F.when(F.col("k") % 10 == 0, "seed").otherwise("model").alias("resource_type"))


@query(
    "declared_relationships_parts",
    """WITH m AS (SELECT *, p_partkey AS k FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 10 <> 0)
    SELECT 'm.' || k AS source, 'id' AS source_column, CASE WHEN k > 1 THEN 'm.' || (k // 2) ELSE '' END AS target, 'ID' AS target_column, CASE WHEN k % 3 <> 0 THEN 'one_to_many' END AS kind, 'of ' || p_brand AS label, 'error' AS severity, 1 AS position, true AS parent_column_exists FROM m
    UNION ALL SELECT 'm.' || k, 'id', '', 'x', NULL, NULL, 'warn', 2, false FROM m""",
)
def declared(spark, d):
    columns = _models(spark, d)
    return erd.declared_relationships(columns, nodes(spark, d).select("name", F.col("node").alias("uid")), "graph")


@query(
    "lookup_by_name",
    """WITH a AS (SELECT unnest(['m.3', 'part_4', 'raw.supplier_2', 'supplier_3', 's.1', 'nothing', 'PART_4']) AS identifier),
    e AS (SELECT 'm.' || p_partkey AS uid, 'part_' || p_partkey AS name, NULL AS source_name FROM part UNION ALL SELECT 's.' || s_suppkey, 'supplier_' || s_suppkey, 'raw' FROM supplier)
    SELECT identifier, coalesce((SELECT min(uid) FROM e WHERE uid = identifier), (SELECT min(uid) FROM e WHERE name = identifier), (SELECT min(uid) FROM e WHERE source_name || '.' || name = identifier)) AS uid FROM a""",
)
def lookup(spark, d):
    entries = nodes(spark, d).select(F.col("node").alias("uid"), "name", F.lit(None).cast("string").alias("source_name"))
    sources = table(spark, d, "supplier").select(F.concat(F.lit("s."), "s_suppkey").alias("uid"), F.concat(F.lit("supplier_"), "s_suppkey").alias("name"), F.lit("raw").alias("source_name"))
    asked = spark.createDataFrame([(x,) for x in ("m.3", "part_4", "raw.supplier_2", "supplier_3", "s.1", "nothing", "PART_4")], "identifier string")
    return metadata.looked_up(asked, entries.unionByName(sources))


@query(
    "sources_with_freshness",
    """WITH f AS (SELECT o_custkey AS c, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS seen, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
    SELECT 's.' || c_custkey AS uid, coalesce(status, 'unknown') AS status, seen AS max_loaded_at, seen AS snapshotted_at FROM customer LEFT JOIN f ON c = c_custkey AND place = 1""",
)
def sources_with_freshness(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    fresh = table(spark, d, "orders").select(F.concat(F.lit("s."), "o_custkey").alias("unique_id"), F.col("o_orderstatus").alias("status"), day.alias("max_loaded_at"), day.alias("snapshotted_at"), F.col("o_orderkey").alias("position"))
    return metadata.with_freshness(table(spark, d, "customer").select(F.concat(F.lit("s."), "c_custkey").alias("uid")), fresh)


def _fields(spark, d) -> DataFrame:
    dep = lambda m, c, t: F.struct(m.alias("model"), F.lit(c).alias("column"), F.lit(t).alias("transformation"))
    own, other = F.concat(F.lit("part_"), "c_custkey"), F.concat(F.lit("part_"), (F.col("c_custkey") + 1).cast("string"))
    both = F.array(dep(own, " t.amount ", "Cast"), dep(other, "sum(price) - 'x y' + price * 2", "odd"), dep(F.lit("nowhere"), "a", "rename"), dep(own, "amount", "rename"))
    return table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("exposure"), F.col("c_name").alias("field"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit(" f"), "c_custkey")).alias("expression"),
        F.when(F.col("c_custkey") % 3 == 0, F.array().cast(both_type)).otherwise(both).alias("depends_on"),
    )


both_type = "array<struct<model:string,column:string,transformation:string>>"


@query(
    "exposure_field_dependencies",
    """WITH c AS (SELECT c_mktsegment AS exposure, c_name AS field, c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN 'f' || c_custkey END AS expression FROM customer),
    r AS (SELECT c.*, 1 AS place, 'm.' || k AS source_model, 'amount' AS source_column, 'passthrough' AS transformation FROM c JOIN part ON p_partkey = k WHERE k % 3 <> 0
      UNION ALL SELECT c.*, 2, 'm.' || (k + 1), 'price', 'aggregated' FROM c JOIN part ON p_partkey = k + 1 WHERE k % 3 <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY exposure, field ORDER BY place) AS i FROM r)
    SELECT exposure, field, source_model, source_column, transformation, CASE WHEN i = 1 THEN expression END AS expression FROM o
    UNION ALL SELECT exposure, field, NULL, NULL, 'aggregated', expression FROM c WHERE expression IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.field = c.field AND o.exposure = c.exposure)""",
)
def exposure_fields(spark, d):
    names = nodes(spark, d).select("name", F.col("node").alias("uid"), F.lit(0).alias("place"))
    return lineage.field_dependencies(_fields(spark, d), names)


@query("exposure_marts", "SELECT DISTINCT 'part_' || (c_custkey + i) AS model FROM customer, (SELECT unnest([0, 1]) AS i) WHERE c_custkey % 3 <> 0 UNION SELECT 'nowhere' FROM customer WHERE c_custkey % 3 <> 0")
def exposure_marts(spark, d):
    return lineage.marts_of(_fields(spark, d))


def column_lineage(spark, d) -> DataFrame:
    """A column c that every model takes from its parent, and one that every third takes from the model before it."""
    n = nodes(spark, d)
    by_number = n.select(F.col("k").alias("p"), F.col("node").alias("source_model"))
    row = lambda f, c, t: n.where("k > 1").select(f.alias("p"), F.col("node").alias("target_model"), F.lit(c).alias("target_column"), F.lit(c.lower()).alias("source_column"), t.alias("transformation"))
    both = row(F.floor(F.col("k") / 2), "C", F.when(F.col("k") % 11 == 0, "constant").otherwise("passthrough")).unionByName(row(F.col("k") - 1, "D", F.lit("derived")).where("p % 3 = 0"))
    return both.join(by_number, "p").drop("p")


_LINEAGE_SQL = """l AS (SELECT 'm.' || (b.p_partkey // 2) AS sm, 'c' AS sc, 'm.' || b.p_partkey AS tm, 'c' AS tc FROM part b JOIN part a ON a.p_partkey = b.p_partkey // 2 WHERE b.p_partkey > 1 AND b.p_partkey % 11 <> 0
    UNION ALL SELECT 'm.' || (b.p_partkey - 1), 'd', 'm.' || b.p_partkey, 'd' FROM part b JOIN part a ON a.p_partkey = b.p_partkey - 1 WHERE b.p_partkey > 1 AND (b.p_partkey - 1) % 3 = 0)"""


def _path_sql(model: str, column: str) -> str:
    return f"""SELECT '{model}' AS model, '{column}' AS "column", 0 AS depth UNION SELECT l.sm, l.sc, p.depth + 1 FROM p_{column} p JOIN l ON l.tm = p.model AND l.tc = p."column" WHERE p.depth < 7"""


@query("field_path_parts", f"""WITH RECURSIVE {_LINEAGE_SQL}, p_c AS ({_path_sql('m.150', 'c')}) SELECT model, "column", CAST(min(depth) AS INT) AS depth FROM p_c GROUP BY ALL""")
def field_path(spark, d):
    return graph.field_path(column_lineage(spark, d), "m.150", "C")


@query(
    "combined_trace_parts",
    f"""WITH RECURSIVE {_LINEAGE_SQL}, p_c AS ({_path_sql('m.150', 'c')}), p_d AS ({_path_sql('m.37', 'd')}) SELECT model, array_to_string(list_sort(list(DISTINCT "column")), ',') AS columns FROM (SELECT * FROM p_c UNION ALL SELECT * FROM p_d) GROUP BY model""",
)
def combined_trace(spark, d):
    rows = column_lineage(spark, d)
    return graph.combined_trace(graph.field_path(rows, "m.150", "c"), graph.field_path(rows, "m.37", "d")).withColumn("columns", F.array_join("columns", ","))


@query(
    "path_subgraph_parts",
    f"""WITH RECURSIVE {EDGES_SQL}, {_LINEAGE_SQL}, p_c AS ({_path_sql('m.150', 'c')}), p_d AS ({_path_sql('m.37', 'd')}), p AS (SELECT model, "column" FROM p_c UNION SELECT model, "column" FROM p_d)
    SELECT source, target FROM e WHERE source IN (SELECT model FROM p) AND target IN (SELECT model FROM p)
    UNION SELECT sm, tm FROM l WHERE (sm, sc) IN (SELECT (model, "column") FROM p) AND (tm, tc) IN (SELECT (model, "column") FROM p)""",
)
def path_subgraph(spark, d):
    rows = column_lineage(spark, d)
    path = graph.field_path(rows, "m.150", "c").unionByName(graph.field_path(rows, "m.37", "d"))
    return graph.path_subgraph(edges(spark, d), path, rows)


@query(
    "templated_sql_parts",
    """SELECT p_partkey, 'select CONCAT(a, b), p from part_' || p_partkey || ' join raw.' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' where d = ''2020''' ELSE ' where e' END || ' and x = ''' || p_size || '''' AS plain,
      'part_' || p_partkey AS models, substr(sha256(p_name), 1, 16) AS hash FROM part""",
)
def templated_sql(spark, d):
    raw = F.concat(
        F.lit("{{ config(x='y') }}{# no #}{% set d = '2020' %}select {{ utils.surrogate_key(['a', 'b']) }}, p from {{ ref('part_"), F.col("p_partkey").cast("string"), F.lit("') }} join {{ source('raw', '"), F.col("p_brand"), F.lit("') }}"),
        F.when(F.col("p_size") % 2 == 0, "{% if a %}{% if b %} no{% endif %}{% else %} where d = {{ d }}{% endif %}").otherwise("{% if a %} where e{% elif b %} no{% endif %}"),
        F.lit(" and x = '{{ var('v', '"), F.col("p_size").cast("string"), F.lit("') }}'"),
    )
    part = dealt(table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_name"))
    return part.select("p_partkey", text.strip_templates(raw).alias("plain"), F.array_join(text.referenced_models(raw), ",").alias("models"), text.sql_hash(F.col("p_name")).alias("hash"))


_TOKENS = "SELECT p_partkey AS id, t AS token, count(*) AS tf FROM (SELECT p_partkey, unnest(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM part {1}) WHERE t <> '' GROUP BY ALL"


@query("refreshed_index_parts", f"{_TOKENS.format('p_type', 'WHERE p_partkey % 4 > 1')} UNION ALL {_TOKENS.format('p_name', 'WHERE p_partkey % 4 = 1')}")
def refreshed_index(spark, d):
    part = table(spark, d, "part")
    index = search.inverted_index(part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("text")))
    changed = part.where("p_partkey % 4 < 2").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 1, F.col("p_name")).alias("text"))
    return search.refreshed(index, changed)


@query(
    "indexed_search_parts",
    f"""WITH i AS (SELECT id, token, tf, false AS is_name FROM ({_TOKENS.format('p_type', '')}) UNION ALL SELECT id, token, tf, true FROM ({_TOKENS.format('p_name', '')})),
    h AS (SELECT id, tf * CASE WHEN is_name THEN 2 ELSE 1 END * CASE WHEN token = q THEN 1.0 WHEN starts_with(token, q) THEN 0.5 WHEN levenshtein(token, q) <= length(q) // 5 THEN 0.25 END AS s FROM i, (SELECT unnest(['mediun', 'widgets', 'bo', 'red']) AS q))
    SELECT id, CAST(sum(s) AS DOUBLE) AS score FROM h WHERE s IS NOT NULL GROUP BY id ORDER BY score DESC, id LIMIT 20""",
)
def indexed_search(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    index = search.inverted_index(part.select("id", F.col("p_type").alias("text"))).withColumn("is_name", F.lit(False))
    index = index.unionByName(search.inverted_index(part.select("id", F.col("p_name").alias("text"))).withColumn("is_name", F.lit(True)))
    return search.indexed_search(index, "Mediun widgets bo red")


@query(
    "health_explanations",
    """SELECT p_brand AS dimension, score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS reading, p_brand || ' is ' || CASE WHEN score >= 80 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END || ' at ' || CAST(score AS INT) || '%' AS text
    FROM (SELECT p_brand, CAST(max(p_size) * 2 - min(p_size) % 2 AS DOUBLE) AS score FROM part GROUP BY p_brand)""",
)
def health_explanations(spark, d):
    return metadata.explanations(table(spark, d, "part").groupBy(F.col("p_brand").alias("dimension")).agg((F.max("p_size") * 2 - F.min("p_size") % 2).cast("double").alias("score")))


@query("declared_questions_parts", "SELECT 'm.' || p_partkey AS uid, 'Is ' || p_name || '?' AS question, 'unique_' || p_partkey AS test_name FROM part WHERE p_partkey % 2 = 0")
def declared_questions(spark, d):
    meta = F.concat(F.lit('{"ask": {"questions": [{"question": "  Is '), "p_name", F.lit('? ", "test": " unique_'), F.col("p_partkey").cast("string"), F.lit('"}, {"question": "  ", "test": "t"}]}}'))
    models = table(spark, d, "part").select(F.concat(F.lit("m."), "p_partkey").alias("uid"), F.when(F.col("p_partkey") % 2 == 0, meta).alias("meta"))
    return metadata.declared_questions(models, "ask")


@query("test_sql_orders", "SELECT o_orderkey AS test_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE '' END AS sql FROM orders")
def test_sql(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("test_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise("").alias("run_sql"),
        F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).alias("compiled_sql"), F.when(F.col("o_orderkey") % 3 == 0, "raw").alias("raw_sql"),
    )
    return metadata.test_sql(rows)


@query("migrated_lineage_events", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'passthrough' ELSE event_type END AS transformation FROM events")
def migrated(spark, d):
    return lineage.migrated(table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "direct").otherwise(F.col("event_type")).alias("transformation")))


@query("sample_rows_nation", "SELECT 'main' AS schema, 'nation' AS table, 25 AS row_count, count(*) AS rows FROM nation")
def sample_rows(spark, d):
    made = tables.sample_payload(table(spark, d, "nation"), "main", "nation", 50)
    got = made.select(F.from_json("value", "schema string, table string, rows array<array<string>>, row_count int").alias("x"))
    return got.select("x.schema", "x.table", "x.row_count", F.size("x.rows").cast("bigint").alias("rows"))


def _pairs(spark, d) -> DataFrame:
    """Join keys of every part from 4 on with its parent and grandparent."""
    n, half = nodes(spark, d).where("k >= 4"), F.floor(F.col("k") / 2).cast("string")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("left", "", " Left  semi ", "cross")]), (F.col("k") % 4 + 1).cast("int"))
    return n.select(
        F.col("node").alias("model"), F.col("k").alias("position"), F.concat(F.lit("m."), half).alias("left_model"), F.lit("id").alias("left_column"),
        F.concat(F.lit("m."), F.floor(F.col("k") / 4).cast("string")).alias("right_model"), F.concat(F.lit("k"), (F.col("k") % 2).cast("string")).alias("right_column"), F.when(F.col("k") % 9 != 0, kind).alias("join_type"),
    )


@query(
    "join_role_badges_parts",
    """WITH f AS (SELECT p_partkey AS k, 'm.' || (p_partkey // 2) AS l, 'm.' || (p_partkey // 4) AS r, list_extract(['LEFT', 'INNER', 'LEFT-SEM', 'CROSS'], CAST(p_partkey % 4 + 1 AS INT)) AS badge FROM part WHERE p_partkey >= 4),
    d AS (SELECT l AS model, badge, 0 AS way, k, 0 AS side FROM f WHERE k % 9 <> 0 AND k % 3 = 0 AND k % 2 <> 0 UNION ALL SELECT r, badge, 0, k, 1 FROM f WHERE k % 9 <> 0 AND k % 3 = 0
      UNION ALL SELECT 'm.' || (k + 1), CASE WHEN k % 2 = 0 THEN 'AGG' ELSE 'CTE' END, 1, k, 0 FROM f WHERE k % 3 = 0)
    SELECT model, badge FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY way, k, side) AS place FROM d) WHERE place = 1""",
)
def join_roles(spark, d):
    n = nodes(spark, d).where("k >= 4")
    indirect = n.select(F.col("node").alias("model"), F.col("k").alias("position"), F.concat(F.lit("m."), (F.col("k") + 1).cast("string")).alias("parent"), F.when(F.col("k") % 2 == 0, "Agg").alias("kind"))
    bases = n.where("k % 2 = 0").select(F.col("node").alias("model"), F.concat(F.lit("m."), F.floor(F.col("k") / 2).cast("string")).alias("base"))
    return lineage.role_badges(_pairs(spark, d), indirect, bases, n.where("k % 3 = 0").select(F.col("node").alias("model"), F.col("k").alias("place")))


@query(
    "visible_join_endpoints_parts",
    """WITH f AS (SELECT p_partkey AS k, p_partkey // 2 AS l, p_partkey // 4 AS r FROM part WHERE p_partkey >= 4 AND (p_partkey // 2) % 5 <> 0 AND (p_partkey // 4) % 5 <> 0),
    g AS (SELECT *, min(k) OVER (PARTITION BY l, r) AS seen FROM f), e AS (SELECT 'm.' || l AS model, 'id' AS "column", k, seen FROM g UNION ALL SELECT 'm.' || r, 'k' || (k % 2), k, seen FROM g)
    SELECT model, "column", min_by(seen, k) AS relationship FROM e GROUP BY ALL""",
)
def endpoints(spark, d):
    visible = spark.range(0, 1_000_000).where("id % 5 <> 0").select(F.concat(F.lit("m."), "id").alias("model"))
    return lineage.visible_endpoints(_pairs(spark, d), visible)


@query("compact_sources", "SELECT 'raw.' || s_name AS name, '' AS description, 'main' AS schema, 'id,' || s_suppkey AS columns, CASE WHEN s_suppkey % 2 = 0 THEN 'pass' END AS freshness_status FROM supplier")
def compact_sources(spark, d):
    s = table(spark, d, "supplier").withColumn("uid", F.col("s_suppkey").cast("string"))
    sources = s.select("uid", F.lit("raw").alias("source_name"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("description"), F.lit("main").alias("schema"), F.when(F.col("s_suppkey") % 2 == 0, "pass").alias("freshness_status"))
    columns = s.select("uid", F.col("uid").alias("name"), F.lit(2).alias("pos")).unionByName(s.select("uid", F.lit("id").alias("name"), F.lit(1).alias("pos")))
    return metadata.compact_sources(sources, columns, 500).withColumn("columns", F.array_join("columns", ","))


@query("cached_lineage_parts", "SELECT 'm.' || p_partkey AS uid, CASE WHEN p_partkey % 2 = 0 THEN 'rename' ELSE 'passthrough' END AS transformation, false AS anew FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 5 <> 0 UNION ALL SELECT 'm.' || p_partkey, NULL, true FROM part WHERE NOT (p_partkey % 3 = 1 AND p_partkey % 5 <> 0)")
def cached_lineage(spark, d):
    n = nodes(spark, d)
    cached = n.select(F.col("node").alias("uid"), "k", F.col("name").alias("sql_hash"), F.when(F.col("k") % 3 == 1, 2).otherwise(1).alias("version"), F.lit("duckdb").alias("dialect"), F.when(F.col("k") % 2 == 0, "rename").otherwise("direct").alias("transformation"))
    wanted = n.select(F.col("node").alias("uid"), F.when(F.col("k") % 5 == 0, "changed").otherwise(F.col("name")).alias("sql_hash"))
    valid, anew = lineage.cached_lineage(cached, wanted, 2, "duckdb")
    return valid.select("uid", "transformation", F.lit(False).alias("anew")).unionByName(anew.select("uid", F.lit(None).cast("string").alias("transformation"), F.lit(True).alias("anew")))


@query(
    "columns_mode_parts",
    f"""WITH RECURSIVE {EDGES_SQL}, {_LINEAGE_SQL}, s AS (SELECT 'm.150' AS node, 0 AS depth UNION SELECT e.source, depth + 1 FROM s JOIN e ON e.target = s.node WHERE depth < 3),
    a AS (SELECT DISTINCT sm AS node FROM l WHERE tm IN (SELECT node FROM s) EXCEPT SELECT node FROM s), k AS (SELECT node FROM s UNION SELECT node FROM a),
    f AS (SELECT source, target, false AS implied FROM e UNION ALL SELECT sm, tm, true FROM l),
    {{path}} AS (SELECT * FROM p_c), q AS (SELECT 'm.1' AS node UNION SELECT model FROM p),
    g AS (SELECT * FROM f WHERE source IN (SELECT node FROM k) AND target IN (SELECT node FROM k) UNION ALL SELECT source, target, false FROM e
      UNION ALL SELECT sm, tm, true FROM l WHERE (sm, sc) IN (SELECT (model, "column") FROM p) AND (tm, tc) IN (SELECT (model, "column") FROM p))
    SELECT 'shown' AS mode, source, target, bool_and(implied) AS implied FROM f WHERE source <> target AND source IN (SELECT node FROM k) AND target IN (SELECT node FROM k) GROUP BY ALL
    UNION ALL SELECT 'path', source, target, bool_and(implied) FROM g WHERE source <> target AND source IN (SELECT node FROM q) AND target IN (SELECT node FROM q) GROUP BY ALL""".replace("{path}", f"p_c AS ({_path_sql('m.150', 'c')}), p"),
)
def columns_mode(spark, d):
    every, known, rows = nodes(spark, d), edges(spark, d), column_lineage(spark, d)
    shown = graph.distances(known, "m.150", "upstream", 3).select("node")
    inside = known.join(shown.toDF("source"), "source", "left_semi").join(shown.toDF("target"), "target", "left_semi")
    _, wide = graph.columns_mode(shown, inside, every, known, rows)
    _, path = graph.columns_mode(shown, inside, every, known, rows, selected=("m.150", "c"), direction="upstream", always=("m.1",))
    return wide.select(F.lit("shown").alias("mode"), "source", "target", "implied").unionByName(path.select(F.lit("path").alias("mode"), "source", "target", "implied"))


@query(
    "excluding_filters_parts",
    f"""WITH {NODES_SQL}, k AS (SELECT node FROM n WHERE NOT list_contains(string_split(kind, ' '), 'promo') AND folder NOT IN ('Brand#1', 'Brand#2') AND (n.k % 4 = 0 OR n.k % 4 <> 2)), {EDGES_SQL}
    SELECT source, target FROM e WHERE source IN (SELECT node FROM k) AND target IN (SELECT node FROM k)""",
)
def excluding(spark, d):
    layered = nodes(spark, d).withColumns({"layer": F.when(F.col("k") % 4 != 0, (F.col("k") % 4).cast("double")), "resource_type": F.lit("model")})
    keep = graph.chosen_by(types=("include", ["model"]), tags=("exclude", ["promo"]), folders=("exclude", ["Brand#1", "Brand#2"]), layers=("exclude", [2.0]))
    return graph.filter_lineage(layered, edges(spark, d), keep)[1]


@query(
    "waves_of_chains_parts",
    """WITH RECURSIVE c AS (SELECT p_partkey AS k, p_brand AS b, lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS back FROM part),
    w AS (SELECT k, CAST(row_number() OVER (PARTITION BY b ORDER BY k) - 1 AS INT) AS wave FROM c) SELECT 'm.' || k AS node, wave FROM w""",
)
def waves_of_chains(spark, d):
    """The parts of each brand as one chain, a few dozen to a few hundred nodes long."""
    n = nodes(spark, d)
    back = F.lag("node").over(Window.partitionBy("folder").orderBy("k"))
    return graph.depth_waves(n.select("node"), n.select(back.alias("source"), F.col("node").alias("target")).where("source IS NOT NULL"))


_NEAR = "SELECT q, token FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(p_name || ' ' || p_type || ' ' || replace(p_brand, '#', '')), '[^a-z0-9]+')) AS token FROM part), (SELECT unnest(['standar', 'widgte', 'meduim', 'brand11', 'economyy', 'prom']) AS q) WHERE levenshtein(token, q) <= length(q) // 5"


@query("near_tokens_parts", _NEAR)
def near_tokens(spark, d):
    text = F.concat_ws(" ", "p_name", "p_type", F.translate("p_brand", "#", ""))
    tokens = search.inverted_index(table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))).select("token").distinct()
    return search.near_tokens(tokens, ["standar", "widgte", "meduim", "brand11", "economyy", "prom"])


@query(
    "stored_index_refresh_parts",
    f"{_TOKENS.format('p_type', 'WHERE p_partkey % 50 > 1')} UNION ALL {_TOKENS.format('p_name', 'WHERE p_partkey % 50 = 1')}",
)
def stored_index_refresh(spark, d):
    """An index written in buckets, of which a refresh rewrites those of changed and withdrawn texts."""
    part, path = table(spark, d, "part"), f"{graph.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    search.write_index(part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("text")), path)
    search.refresh_index(spark, path, part.where("p_partkey % 50 < 2").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 == 1, F.col("p_name")).alias("text")))
    return search.read_index(spark, path)
