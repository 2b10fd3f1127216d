"""Metadata queries: columns, tests, coverage, health, relationships, insights and search over the project derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import erd, graph, insights, metadata, search
from ..sources.tables import profiled_models
from .project import oracle, table
from .registry import query
from .registry import table as data_table


def _attached(spark, d):
    tests = table(spark, d, "tests")
    return metadata.attached_tests(tests, table(spark, d, "results"))


_STATUS = "CASE status WHEN 'success' THEN 'pass' WHEN 'failure' THEN 'fail' WHEN 'warning' THEN 'warn' WHEN 'skipped' THEN 'not_run' ELSE status END"
_ATTACHED = f"""a AS (SELECT uid, test_id, lower(column_name) AS column_name, test_type, coalesce({_STATUS}, 'not_run') AS status, coalesce(failures, 0) AS failures
  FROM (SELECT DISTINCT test_id, test_type, column_name, unnest(string_split(depends_on, ',')) AS uid FROM tests) LEFT JOIN results USING (test_id))"""
_MERGED = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, lower(name) ORDER BY pos, name) AS r FROM declared_columns) WHERE r = 1),
  c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, lower(name) ORDER BY idx, name) AS r FROM catalog_columns) WHERE r = 1),
  m AS (SELECT coalesce(c.uid, d.uid) AS uid, coalesce(c.name, d.name) AS name, coalesce(c.type, d.data_type, '') AS data_type, coalesce(d.description, '') AS description, c.name IS NOT NULL AS in_catalog, d.name IS NOT NULL AS declared, c.idx, d.pos
    FROM d FULL JOIN c ON d.uid = c.uid AND lower(d.name) = lower(c.name))"""


@query("merged_columns", oracle(f"WITH {_MERGED} SELECT uid, CAST(row_number() OVER (PARTITION BY uid ORDER BY idx IS NULL, idx, pos, name) AS INT) AS ordinal, name, data_type, description, in_catalog, declared FROM m", "declared_columns", "catalog_columns"))
def merged_columns(spark, d):
    return metadata.merged_columns(table(spark, d, "declared_columns"), table(spark, d, "catalog_columns"))


@query("attached_tests", oracle(f"WITH {_ATTACHED} SELECT * FROM a", "tests", "results"))
def attached(spark, d):
    return _attached(spark, d)


@query(
    "model_test_rollup",
    oracle(
        f"""WITH {_ATTACHED} SELECT uid, count(*) AS test_count, count(*) FILTER (status IN ('fail', 'error')) AS failed, count(*) FILTER (status = 'warn') AS warned, count(*) FILTER (status = 'pass') AS passed,
        CASE WHEN count(*) FILTER (status IN ('fail', 'error')) > 0 THEN 'fail' WHEN count(*) FILTER (status = 'warn') > 0 THEN 'warn' WHEN count(*) FILTER (status = 'pass') > 0 THEN 'pass' ELSE 'none' END AS rollup FROM a GROUP BY uid""",
        "tests", "results",
    ),
)
def rollup(spark, d):
    return metadata.test_rollup(_attached(spark, d))


def _coverage_sql(group: str) -> str:
    rates = ", ".join(f"CASE WHEN {w}s > 0 THEN round({k}_{w}s / {w}s, 6) ELSE 1 END AS {k}_{w}_rate" for k in ("documented", "tested") for w in ("model", "column"))
    return oracle(
        f"""WITH {_ATTACHED}, {_MERGED}, t AS (SELECT uid, count(*) AS tests FROM a GROUP BY uid), ct AS (SELECT DISTINCT uid, column_name AS k FROM a WHERE column_name <> ''),
        pc AS (SELECT m.uid, count(*) AS cols, count(*) FILTER (trim(m.description) <> '') AS cols_doc, count(ct.k) AS cols_test FROM m LEFT JOIN ct ON ct.uid = m.uid AND ct.k = lower(m.name) GROUP BY m.uid),
        s AS (SELECT {group + "," if group else ""} count(*) AS models, count(*) FILTER (trim(description) <> '') AS documented_models, count(*) FILTER (coalesce(tests, 0) > 0) AS tested_models,
          CAST(coalesce(sum(cols), 0) AS BIGINT) AS columns, CAST(coalesce(sum(cols_doc), 0) AS BIGINT) AS documented_columns, CAST(coalesce(sum(cols_test), 0) AS BIGINT) AS tested_columns FROM models LEFT JOIN t USING (uid) LEFT JOIN pc USING (uid) {"GROUP BY " + group if group else ""})
        SELECT *, {rates} FROM s""",
        "tests", "results", "declared_columns", "catalog_columns", "models",
    )


def _covered(spark, d, by_folder=False):
    columns = metadata.merged_columns(table(spark, d, "declared_columns"), table(spark, d, "catalog_columns"))
    return metadata.coverage(table(spark, d, "models"), columns, _attached(spark, d), by_folder)


@query("coverage", _coverage_sql(""))
def coverage(spark, d):
    return _covered(spark, d)


@query("coverage_by_folder", _coverage_sql("folder"))
def coverage_by_folder(spark, d):
    return _covered(spark, d, True)


_COMPLEX = r"""SELECT uid, CAST(CASE WHEN trim(sql, E' \t\n') = '' THEN 0 ELSE len(string_split(trim(sql, E' \t\n'), chr(10))) END AS BIGINT) AS lines, len(regexp_extract_all(lower(sql), '\bjoin\b')) AS joins,
  CASE WHEN regexp_matches(lower(sql), '\bwith\b') THEN len(regexp_extract_all(lower(sql), '\b\w+\s+as\s*\(')) ELSE 0 END AS ctes, len(regexp_extract_all(lower(sql), '\(\s*select\b')) AS subqueries FROM models"""


@query("complexity", oracle(f"SELECT *, lines > 200 OR joins > 8 OR ctes > 10 OR subqueries > 5 AS is_high, lines + 10 * joins + 5 * ctes + 8 * subqueries AS score FROM ({_COMPLEX})", "models"))
def complexity(spark, d):
    return metadata.complexity(table(spark, d, "models"))


_NAMED = """SELECT uid, name, layer, regexp_matches(name, CASE layer WHEN 'staging' THEN '^stg_' WHEN 'intermediate' THEN '^int_' ELSE '^(fct_|dim_)' END) AS compliant FROM (
  SELECT uid, name, CASE WHEN list_contains(s, 'staging') THEN 'staging' WHEN list_contains(s, 'intermediate') THEN 'intermediate' WHEN list_contains(s, 'marts') THEN 'marts' END AS layer FROM (SELECT *, string_split(lower(path), '/') AS s FROM models)) WHERE layer IS NOT NULL"""


@query("naming_compliance", oracle(_NAMED, "models"))
def naming(spark, d):
    return metadata.naming(table(spark, d, "models"))


@query("freshness_score", oracle("SELECT count(*) AS monitored, round(100 * sum(CASE WHEN status IN ('pass', 'runtime error') THEN 1.0 WHEN status = 'warn' THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS score FROM freshness WHERE status IS NOT NULL", "freshness"))
def freshness(spark, d):
    return metadata.freshness_score(table(spark, d, "freshness"))


def _health(spark, d, fresh):
    models = table(spark, d, "models")
    edges = table(spark, d, "edges")
    return metadata.health(_covered(spark, d), metadata.complexity(models), metadata.naming(models), metadata.freshness_score(fresh), models, graph.orphans(models, edges, "uid"))


def _health_sql(fresh: str) -> str:
    return f"""WITH cov AS ({{cov}}), cx AS (SELECT 100.0 * count(*) FILTER (NOT (lines > 200 OR joins > 8 OR ctes > 10 OR subqueries > 5)) / count(*) AS complexity FROM ({_COMPLEX})),
      nm AS (SELECT 100.0 * count(*) FILTER (compliant) / count(*) AS naming FROM ({_NAMED})), fr AS ({fresh}),
      orph AS (SELECT 100.0 * (1 - count(*) FILTER (uid NOT IN (SELECT source FROM edges)) / count(*)) AS orphans FROM models),
      p AS (SELECT 50 * (documented_model_rate + documented_column_rate) AS documentation, 50 * (tested_model_rate + tested_column_rate) AS testing, freshness, complexity, naming, orphans FROM cov, cx, nm, fr, orph),
      o AS (SELECT *, (0.25 * documentation + 0.25 * testing + 0.15 * coalesce(freshness, 0) + 0.15 * complexity + 0.10 * naming + 0.10 * orphans) / CASE WHEN freshness IS NULL THEN 0.85 ELSE 1 END AS x FROM p)
      SELECT round(documentation + 1e-10, 4) AS documentation, round(testing + 1e-10, 4) AS testing, round(freshness + 1e-10, 4) AS freshness, round(complexity + 1e-10, 4) AS complexity, round(naming + 1e-10, 4) AS naming, round(orphans + 1e-10, 4) AS orphans, round(x + 1e-10, 1) AS overall,
        CASE WHEN x >= 90 THEN 'A' WHEN x >= 80 THEN 'B' WHEN x >= 70 THEN 'C' WHEN x >= 60 THEN 'D' ELSE 'F' END AS grade FROM o"""


for _n, _f, _w in (("health_score", "SELECT 100 * sum(CASE WHEN status IN ('pass', 'runtime error') THEN 1.0 WHEN status = 'warn' THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS freshness FROM freshness WHERE status IS NOT NULL", "true"), ("health_score_unmonitored", "SELECT CAST(NULL AS DOUBLE) AS freshness", "false")):
    query(_n, oracle(_health_sql(_f).replace("{cov}", _coverage_sql("")), "models", "edges", "freshness"))(lambda spark, d, w=_w: _health(spark, d, table(spark, d, "freshness").where(w)))


_LASTING = "FROM (SELECT * FROM models WHERE uid NOT IN (SELECT uid FROM ephemeral))"


@query("health_without_ephemeral", oracle(_health_sql("SELECT CAST(NULL AS DOUBLE) AS freshness").replace("{cov}", _coverage_sql("")).replace("FROM models", _LASTING), "models", "edges", "freshness", "ephemeral"))
def health_without_ephemeral(spark, d):
    kinds = table(spark, d, "ephemeral").withColumn("materialization", F.lit("ephemeral"))
    models = profiled_models(table(spark, d, "models").join(kinds, "uid", "left"))
    columns = metadata.merged_columns(table(spark, d, "declared_columns"), table(spark, d, "catalog_columns"))
    covered = metadata.coverage(models, columns, _attached(spark, d), False)
    return metadata.health(covered, metadata.complexity(models), metadata.naming(models), metadata.freshness_score(table(spark, d, "freshness").where("false")), models, graph.orphans(models, table(spark, d, "edges"), "uid"))


@query(
    "compact_models",
    oracle(
        f"""WITH {_ATTACHED}, {_MERGED}, k AS (SELECT count(*) AS many FROM models), o AS (SELECT uid, name, row_number() OVER (PARTITION BY uid ORDER BY idx IS NULL, idx, pos, name) AS i FROM m),
        cc AS (SELECT uid, string_agg(name, ',' ORDER BY i) AS columns FROM o GROUP BY uid), s AS (SELECT uid, string_agg(x, ',' ORDER BY x) AS test_status FROM (SELECT uid, status || ':' || count(*) AS x FROM a GROUP BY uid, status) GROUP BY uid)
        SELECT uid, name, CASE WHEN many <= 500 THEN description END AS description, CASE WHEN many <= 200 THEN columns END AS columns, test_status FROM models LEFT JOIN cc USING (uid) LEFT JOIN s USING (uid), k""",
        "tests", "results", "declared_columns", "catalog_columns", "models",
    ),
)
def compact_models(spark, d):
    columns = metadata.merged_columns(table(spark, d, "declared_columns"), table(spark, d, "catalog_columns"))
    return metadata.compact_models(table(spark, d, "models"), columns, _attached(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("columns", "test_status")})


_TYPED = """CASE WHEN data_type <> '' THEN upper(data_type) WHEN regexp_matches(lower(name), '(^|_)(id|uuid|key|name|title|description|text|label|slug|email|url|path|type|status|code|address|phone)$') THEN 'VARCHAR' WHEN regexp_matches(lower(name), '(^|_)date$') THEN 'DATE'
  WHEN regexp_matches(lower(name), '(^|_)((created|updated|deleted|started|ended)_at|timestamp)$|_(at|time)$') THEN 'TIMESTAMP_NTZ' WHEN regexp_matches(lower(name), '(^|_)count$|_(number|num)$') THEN 'NUMBER' WHEN regexp_matches(lower(name), '(^|_)(amount|total|price|cost)$') THEN 'NUMBER(38,2)'
  WHEN regexp_matches(lower(name), '(^|_)(rate|ratio|percent|percentage|score|weight)$') THEN 'FLOAT' WHEN regexp_matches(lower(name), '(^|_)(flag|enabled|active)$|^(is|has)_') THEN 'BOOLEAN' ELSE 'VARCHAR' END"""


@query("synthetic_catalog", oracle(f"WITH f AS (SELECT *, row_number() OVER (PARTITION BY model, upper(name) ORDER BY name) AS r FROM (SELECT model, name, CASE WHEN length(name) % 5 = 0 THEN lower(data_type) ELSE '' END AS data_type FROM insight_columns)) SELECT model AS uid, upper(name) AS name, {_TYPED} AS type, CAST(row_number() OVER (PARTITION BY model ORDER BY name) AS INT) AS idx FROM f WHERE r = 1", "insight_columns"))
def synthetic_catalog(spark, d):
    columns = table(spark, d, "insight_columns").select(F.col("model").alias("uid"), "name", F.lit(1).alias("pos"), F.when(F.length("name") % 5 == 0, F.lower("data_type")).otherwise("").alias("data_type"))
    return metadata.synthetic_catalog(columns)


_DOWN = "SELECT source AS uid, count(*) AS downstream FROM edges WHERE target NOT LIKE 'test.%' GROUP BY source"


def _downstream(spark, d):
    return metadata.referenced_by(table(spark, d, "edges")).select("uid", F.size("consumers").cast("bigint").alias("downstream"))


_UNDOCUMENTED = f"WITH w AS ({_DOWN}) SELECT uid, coalesce(downstream, 0) AS downstream, count(*) OVER () AS total FROM models LEFT JOIN w USING (uid) WHERE trim(description) = ''"


@query("undocumented_topk", oracle(_UNDOCUMENTED, "models", "edges"))
def undocumented(spark, d):
    return metadata.ranked(table(spark, d, "models"), F.trim("description") == "", _downstream(spark, d), limit=None)


@query("undocumented_first_fifty", oracle(f"{_UNDOCUMENTED} ORDER BY 2 DESC, 1 LIMIT 50", "models", "edges"))
def undocumented_first(spark, d):
    return metadata.ranked(table(spark, d, "models"), F.trim("description") == "", _downstream(spark, d))


@query("untested_topk", oracle(f"WITH w AS ({_DOWN}), x AS (SELECT DISTINCT unnest(string_split(depends_on, ',')) AS uid FROM tests) SELECT uid, coalesce(downstream, 0) AS downstream, count(*) OVER () AS total FROM models LEFT JOIN w USING (uid) WHERE uid NOT IN (SELECT uid FROM x) ORDER BY 2 DESC, 1 LIMIT 2", "models", "edges", "tests"))
def untested(spark, d):
    models = table(spark, d, "models").join(_attached(spark, d).select("uid").distinct(), "uid", "left_anti")
    return metadata.ranked(models, F.lit(True), _downstream(spark, d), limit=2)


@query("referenced_by", oracle("SELECT source AS uid, string_agg(DISTINCT target, ',' ORDER BY target) AS consumers FROM edges GROUP BY source", "edges"))
def referenced(spark, d):
    return metadata.referenced_by(table(spark, d, "edges")).withColumn("consumers", F.array_join("consumers", ","))


@query("question_verification", oracle(f"SELECT question, q.test_name, CASE WHEN t.test_id IS NULL THEN 'misconfigured' ELSE coalesce({_STATUS}, 'not_run') END AS verdict FROM questions q LEFT JOIN tests t USING (test_name) LEFT JOIN results r ON r.test_id = t.test_id", "questions", "tests", "results"))
def questions(spark, d):
    return metadata.verified_questions(table(spark, d, "questions"), table(spark, d, "tests"), table(spark, d, "results"))


_TESTED = """rt AS (SELECT child AS source, child_column AS source_column, parent AS target, parent_column AS target_column,
  CASE WHEN EXISTS (SELECT 1 FROM facts f WHERE f.uid = child AND lower(f.column_name) = lower(child_column) AND test_type = 'not_null') THEN 'one_and_only_one' ELSE 'zero_or_one' END AS source_end,
  CASE WHEN EXISTS (SELECT 1 FROM facts f WHERE f.uid = parent AND lower(f.column_name) = lower(parent_column) AND test_type = 'unique') THEN 'one_or_many' ELSE 'zero_or_many' END AS target_end,
  lower(coalesce(severity, 'error')) AS severity, coalesce(status, 'not_run') AS status, 'test' AS origin FROM relationship_tests LEFT JOIN relationship_results USING (test_id))"""
_COMPOSED = f"""{_TESTED}, dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_column, target, target_column ORDER BY position DESC) AS r FROM declared_relationships) WHERE r = 1),
  cm AS (SELECT coalesce(t.source, d.source) AS source, coalesce(t.source_column, d.source_column) AS source_column, coalesce(t.target, d.target) AS target, coalesce(t.target_column, d.target_column) AS target_column,
    CASE d.kind WHEN 'one_to_one' THEN 'one_and_only_one' WHEN 'one_to_many' THEN 'one_and_only_one' WHEN 'many_to_many' THEN 'one_or_many' ELSE coalesce(source_end, 'zero_or_one') END AS source_end,
    CASE d.kind WHEN 'one_to_one' THEN 'one_and_only_one' WHEN 'one_to_many' THEN 'one_or_many' WHEN 'many_to_many' THEN 'one_or_many' ELSE coalesce(target_end, 'zero_or_many') END AS target_end,
    coalesce(severity, 'warn') AS severity, coalesce(status, 'none') AS status, CASE WHEN t.source IS NOT NULL AND d.source IS NOT NULL THEN 'both' WHEN d.source IS NOT NULL THEN 'meta' ELSE 'test' END AS origin, coalesce(label, '') AS label
    FROM rt t FULL JOIN dr d ON t.source = d.source AND t.source_column = d.source_column AND t.target = d.target AND t.target_column = d.target_column)"""
_REL = ("relationship_tests", "relationship_results", "facts", "declared_relationships")


def _relationships(spark, d):
    tested = erd.tested_relationships(table(spark, d, "relationship_tests"), table(spark, d, "facts"), table(spark, d, "relationship_results"))
    return erd.compose(tested, table(spark, d, "declared_relationships"))


@query("erd_compose", oracle(f"WITH {_COMPOSED} SELECT *, target = '' AS is_ghost, substr(sha1(concat_ws('|', source, source_column, target, target_column, origin)), 1, 12) AS relationship_id FROM cm", *_REL))
def compose(spark, d):
    return _relationships(spark, d)


@query(
    "erd_partner_stats",
    oracle(
        f"""WITH {_COMPOSED}, e AS (SELECT source AS node, target AS partner FROM cm WHERE target <> '' UNION ALL SELECT target, source FROM cm WHERE target <> ''), c AS (SELECT node, partner, count(*) AS n FROM e GROUP BY ALL),
        p AS (SELECT node, string_agg(partner, ',' ORDER BY r) AS partners FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, partner) AS r FROM c) WHERE r <= 3 GROUP BY node)
        SELECT node, CAST(sum(n) AS BIGINT) AS total, coalesce(any_value(partners), '') AS partners FROM (SELECT node, n FROM c UNION ALL SELECT source, 1 FROM cm WHERE target = '') LEFT JOIN p USING (node) GROUP BY node""",
        *_REL,
    ),
)
def partners(spark, d):
    return erd.partner_stats(_relationships(spark, d))


@query(
    "erd_reachable",
    oracle(
        f"""WITH RECURSIVE {_COMPOSED}, e AS (SELECT source AS a, target AS b FROM cm WHERE target <> '' UNION SELECT target, source FROM cm WHERE target <> ''),
        r AS (SELECT 'customers' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN e ON a = node WHERE depth < 2) SELECT node, min(depth) AS depth FROM r GROUP BY node""",
        *_REL,
    ),
)
def reachable(spark, d):
    return erd.reachable(_relationships(spark, d), "customers", 2)


@query("erd_key_columns", oracle(f"WITH {_COMPOSED}, f AS (SELECT DISTINCT source AS uid, lower(source_column) AS c, true AS x FROM cm), p AS (SELECT uid, lower(f.column_name) AS c FROM facts f GROUP BY ALL HAVING count(DISTINCT test_type) FILTER (test_type IN ('unique', 'not_null')) = 2) SELECT coalesce(f.uid, p.uid) AS uid, coalesce(f.c, p.c) AS column_name, f.c IS NOT NULL AS is_foreign, p.c IS NOT NULL AS is_primary FROM f FULL JOIN p ON f.uid = p.uid AND f.c = p.c", *_REL))
def key_columns(spark, d):
    return erd.key_columns(_relationships(spark, d), table(spark, d, "facts"))


_SEM = """CASE WHEN regexp_matches(lower(name), '(_id|_key)$|^id$') THEN 'identifier' WHEN regexp_matches(lower(name), '(_at|_date|_time|_timestamp)$|^(created|updated)_') THEN 'timestamp' WHEN regexp_matches(lower(name), '^(is|has|was)_') THEN 'boolean'
  WHEN regexp_matches(lower(name), '_(amount|total|price|cost|revenue|fee)$') THEN 'amount' WHEN regexp_matches(lower(name), '_(count|num|qty|quantity)$') THEN 'count' WHEN regexp_matches(lower(name), '_(pct|percent|rate|ratio)$') THEN 'percentage'
  WHEN regexp_matches(lower(name), '_(status|state|type|category)$|^status$|^type$') THEN 'categorical' WHEN regexp_matches(lower(name), '_(name|title|label)$|^name$') THEN 'name' WHEN regexp_matches(lower(name), '_email$|^email$') THEN 'email'
  WHEN regexp_matches(lower(name), '_(url|uri|link)$') THEN 'url' WHEN data_type IN ('BOOLEAN', 'BOOL') THEN 'boolean' WHEN data_type LIKE '%TIMESTAMP%' OR data_type LIKE '%DATE%' THEN 'timestamp' END"""


@query("semantic_types", oracle(f"SELECT model, name, {_SEM} AS semantic_type FROM insight_columns", "insight_columns"))
def semantic(spark, d):
    return insights.enrich(table(spark, d, "insight_columns")).select("model", "name", "semantic_type")


_ROLE = f"""r AS (SELECT *, CASE WHEN list_contains(t, 'unique') AND list_contains(t, 'not_null') THEN 'primary_key' WHEN list_contains(t, 'relationships') OR (s = 'identifier' AND list_contains(u, 'join_key') AND NOT list_contains(t, 'unique')) THEN 'foreign_key' WHEN s = 'timestamp' THEN 'timestamp'
  WHEN s IN ('amount', 'count', 'percentage') OR list_contains(u, 'aggregated') THEN 'metric' WHEN s = 'categorical' OR list_contains(t, 'accepted_values') THEN 'categorical' WHEN s IN ('name', 'email', 'url') OR list_contains(u, 'group_by') THEN 'dimension' END AS role
  FROM (SELECT *, coalesce({_SEM}, '') AS s, string_split(tests, ',') AS t, string_split(usages, ',') AS u FROM insight_columns))"""


@query(
    "column_roles",
    oracle(
        f"""WITH {_ROLE} SELECT model, name, role, CASE WHEN role IS NULL THEN 0 ELSE round(least(1.0, 0.5 + CASE WHEN role = 'primary_key' OR (role = 'foreign_key' AND list_contains(t, 'relationships')) OR (role = 'categorical' AND list_contains(t, 'accepted_values')) THEN 0.2 ELSE 0 END
        + CASE WHEN (role = 'primary_key' AND list_contains(u, 'join_key')) OR (role = 'foreign_key' AND (list_contains(u, 'join_key') OR list_contains(u, 'filtered'))) OR (role = 'metric' AND list_contains(u, 'aggregated')) OR (role = 'categorical' AND list_contains(u, 'filtered')) OR (role = 'dimension' AND list_contains(u, 'group_by')) THEN 0.2 ELSE 0 END
        + CASE WHEN (role IN ('primary_key', 'foreign_key') AND s = 'identifier') OR (role = 'timestamp' AND s = 'timestamp') OR (role = 'metric' AND s IN ('amount', 'count', 'percentage')) OR (role = 'categorical' AND s = 'categorical') OR (role = 'dimension' AND s IN ('name', 'email', 'url')) THEN 0.1 ELSE 0 END), 2)::DOUBLE END AS confidence FROM r""",
        "insight_columns",
    ),
)
def roles(spark, d):
    return insights.enrich(table(spark, d, "insight_columns")).select("model", "name", "role", "confidence")


@query(
    "column_descriptions",
    oracle(
        f"""WITH {_ROLE} SELECT model, name, CASE WHEN trim(description) <> '' THEN description WHEN role = 'primary_key' THEN 'Unique identifier for each record in ' || model || '.' WHEN role = 'foreign_key' THEN 'References a related ' || replace(regexp_replace(lower(name), '_(id|key|fk)$', ''), '_', ' ') || ' record.'
        WHEN role = 'timestamp' THEN 'Timestamp recording when the ' || replace(regexp_replace(lower(name), '_(at|dttm|date|time|timestamp|ts)$', ''), '_', ' ') || ' occurred.' WHEN role = 'metric' THEN 'Numeric measure: ' || replace(lower(name), '_', ' ') || '.' WHEN role = 'categorical' THEN 'Category or classification: ' || replace(lower(name), '_', ' ') || '.'
        WHEN role = 'dimension' THEN 'Descriptive attribute: ' || replace(lower(name), '_', ' ') || '.' END AS description FROM r""",
        "insight_columns",
    ),
)
def descriptions(spark, d):
    return insights.enrich(table(spark, d, "insight_columns")).select("model", "name", "description")


def _entries(spark, d):
    nodes, columns = table(spark, d, "nodes"), table(spark, d, "declared_columns").groupBy(F.col("uid").alias("node")).agg(F.collect_set("name").alias("columns"))
    sql = table(spark, d, "models").select(F.col("uid").alias("node"), "sql")
    return nodes.join(columns, "node", "left").join(sql, "node", "left").withColumnRenamed("node", "id")


_SCORE = """CASE WHEN lower(n.name) = '{q}' THEN 100 WHEN contains(lower(n.name), '{q}') THEN 80 WHEN contains(lower(n.description), '{q}') THEN 50 WHEN len(list_filter(string_split(tags, ','), lambda x: contains(lower(x), '{q}'))) > 0 THEN 40
  WHEN EXISTS (SELECT 1 FROM declared_columns c WHERE c.uid = node AND contains(lower(c.name), '{q}')) THEN 30 WHEN contains(lower(coalesce(sql, '')), '{q}') THEN 10 END"""


@query("search_scored", oracle(f"SELECT node AS id, name, score, description FROM (SELECT node, n.name, n.description, {_SCORE.format(q='orders')} AS score FROM nodes n LEFT JOIN models m ON m.uid = node) WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 20", "nodes", "models", "declared_columns"))
def search_scored(spark, d):
    return search.scored(_entries(spark, d), "Orders")


@query("search_parts", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN lower(p_name) = 'red' THEN 100 WHEN contains(lower(p_name), 'red') THEN 80 WHEN contains(lower(p_type), 'red') THEN 50 END AS score, substr(p_type, 1, 200) AS description FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') ORDER BY score DESC, id LIMIT 20")
def search_parts(spark, d):
    none = F.array().cast("array<string>")
    parts = data_table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), none.alias("tags"), none.alias("columns"), F.lit("").alias("sql"))
    return search.scored(parts, "red")


_FUZZY = "len(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: starts_with(w, '{q}') OR levenshtein(w, '{q}') <= {k})) > 0"


@query("search_two_tier", oracle(f"WITH a AS (SELECT 1 AS tier, node AS id, name FROM nodes WHERE {_FUZZY.format(q='amount', k=1)}), b AS (SELECT 2 AS tier, uid || '::' || name AS id, name FROM declared_columns WHERE {_FUZZY.format(q='amount', k=1)}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE (SELECT count(*) FROM a) < 5", "nodes", "declared_columns"))
def two_tier(spark, d):
    columns = table(spark, d, "declared_columns").select(F.concat_ws("::", "uid", "name").alias("id"), "name")
    return search.two_tier(table(spark, d, "nodes").select(F.col("node").alias("id"), "name"), columns, "amount")


@query("inverted_index_parts", "SELECT token, id, count(*) AS tf FROM (SELECT p_partkey AS id, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS token FROM part) GROUP BY ALL")
def inverted(spark, d):
    return search.inverted_index(data_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")))


@query("column_occurrences", oracle("SELECT uid, name, data_type FROM declared_columns WHERE lower(name) = 'id'", "declared_columns"))
def occurrences(spark, d):
    return search.column_occurrences(table(spark, d, "declared_columns"), "ID").select("uid", "name", "data_type")


@query("list_models", oracle("SELECT node, name FROM nodes WHERE resource_type = 'model' AND name LIKE '%orders' AND folder LIKE 'models/%' AND NOT is_package AND list_contains(string_split(tags, ','), 'core')", "nodes"))
def list_models(spark, d):
    return search.list_models(table(spark, d, "nodes").where("resource_type = 'model'"), "*orders", "models/", "core").select("node", "name")
