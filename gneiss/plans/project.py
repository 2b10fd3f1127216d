"""A project derived from the driver tables, in SQL that Spark and DuckDB both read: one text for query and oracle alike.

Every part is a model with columns, tests, lineage and relationships of its own; its consumer is the part of half its
number, the last one's is ``summary``. Suppliers are sources. A few rows with names that queries ask for, and the cases that
numbers don't make, are added. Lists are comma-separated strings; use ``split`` in Spark and ``string_split`` in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "nodes": """SELECT * FROM (VALUES
      ('source.p.raw.orders', 'orders', 'source', 'raw', '', '', '', CAST(NULL AS VARCHAR(20)), false, 'raw orders'),
      ('source.p.raw.customers', 'customers', 'source', 'raw', '', '', '', NULL, false, ''),
      ('source.p.raw.events', 'events', 'source', 'raw', '', '', '', NULL, false, 'raw events'),
      ('seed.p.countries', 'countries', 'seed', NULL, 'seeds', 'seeds/countries.csv', 'ref', NULL, false, 'countries'),
      ('model.p.stg_orders', 'stg_orders', 'model', NULL, 'models/staging', 'models/staging/stg_orders.sql', 'core', NULL, false, 'staged orders'),
      ('model.p.stg_customers', 'stg_customers', 'model', NULL, 'models/staging', 'models/staging/stg_customers.sql', 'core', NULL, false, ''),
      ('model.p.events_clean', 'events_clean', 'model', NULL, 'models/staging', 'models/staging/events_clean.sql', 'core,events', NULL, false, 'cleaned events'),
      ('model.p.int_orders', 'int_orders', 'model', NULL, 'models/intermediate', 'models/intermediate/int_orders.sql', '', NULL, false, 'orders joined'),
      ('model.p.fct_orders', 'fct_orders', 'model', NULL, 'models/marts', 'models/marts/fct_orders.sql', 'core,finance', NULL, false, 'order facts'),
      ('model.p.dim_customers', 'dim_customers', 'model', NULL, 'models/marts', 'models/marts/dim_customers.sql', 'core', NULL, false, 'customer dimension'),
      ('model.p.summary', 'summary', 'model', NULL, 'models/marts', 'models/marts/summary.sql', 'finance', 'mart', false, ''),
      ('model.p.loose', 'loose', 'model', NULL, 'models/misc', 'models/misc/loose.sql', '', NULL, false, ''),
      ('model.p.helper', 'helper', 'model', NULL, 'models/misc', 'models/misc/helper.sql', '', NULL, false, 'helper'),
      ('model.q.pkg', 'pkg', 'model', NULL, 'models', 'models/pkg.sql', '', NULL, true, 'package model'),
      ('exposure.p.board', 'board', 'exposure', NULL, '', '', 'finance', NULL, false, 'board pack')
    ) AS t(node, name, resource_type, source_name, folder, path, tags, meta_layer, is_package, description)""",
    "edges": """SELECT * FROM (VALUES
      ('source.p.raw.orders', 'model.p.stg_orders'), ('source.p.raw.customers', 'model.p.stg_customers'), ('source.p.raw.events', 'model.p.events_clean'),
      ('model.p.stg_orders', 'model.p.int_orders'), ('model.p.stg_customers', 'model.p.int_orders'), ('seed.p.countries', 'model.p.int_orders'),
      ('model.p.int_orders', 'model.p.fct_orders'), ('model.p.stg_customers', 'model.p.dim_customers'), ('model.p.events_clean', 'model.p.helper'),
      ('model.p.fct_orders', 'model.p.summary'), ('model.p.dim_customers', 'model.p.summary'), ('model.p.helper', 'model.p.summary'),
      ('model.p.summary', 'exposure.p.board'), ('model.p.stg_orders', 'model.p.fct_orders')
    ) AS t(source, target)""",
    "cyclic": """SELECT * FROM (VALUES ('a', 'b'), ('b', 'c'), ('c', 'a'), ('c', 'd'), ('d', 'e'), ('e', 'e'), ('d', 'e'), ('x', 'y'), ('y', 'z'), ('x', 'z')) AS t(source, target)""",
    "models": """SELECT * FROM (VALUES
      ('model.p.stg_orders', 'stg_orders', 'models/staging', 'models/staging/stg_orders.sql', 'staged orders', 'select id, amount from raw.orders'),
      ('model.p.stg_customers', 'stg_customers', 'models/staging', 'models/staging/stg_customers.sql', '', 'select id, name from raw.customers'),
      ('model.p.events_clean', 'events_clean', 'models/staging', 'models/staging/events_clean.sql', 'cleaned events', 'with e as (select * from raw.events), f as (select * from e) select * from f'),
      ('model.p.int_orders', 'int_orders', 'models/intermediate', 'models/intermediate/int_orders.sql', 'orders joined', 'select * from a join b on a.id = b.id left join c on c.id = b.id join d on d.x = (select max(x) from e)'),
      ('model.p.fct_orders', 'fct_orders', 'models/marts', 'models/marts/fct_orders.sql', 'order facts', 'select 1 from a join b join c join d join e join f join g join h join i join j'),
      ('model.p.dim_customers', 'customers_dim', 'models/marts', 'models/marts/dim_customers.sql', 'customer dimension', 'select * from (select 1) x, ( select 2) y'),
      ('model.p.loose', 'loose', 'models/misc', 'models/misc/loose.sql', '', '')
    ) AS t(uid, name, folder, path, description, sql)""",
    "declared_columns": """SELECT * FROM (VALUES
      ('model.p.stg_orders', 'id', 1, 'order id', 'int'), ('model.p.stg_orders', 'amount', 2, '', 'double'), ('model.p.stg_orders', 'Note', 3, 'free text', 'string'),
      ('model.p.stg_customers', 'id', 1, '', 'int'), ('model.p.stg_customers', 'NAME', 2, 'full name', 'string'), ('model.p.fct_orders', 'id', 1, 'key', ''), ('model.p.fct_orders', 'ID', 2, 'again', '')
    ) AS t(uid, name, pos, description, data_type)""",
    "catalog_columns": """SELECT * FROM (VALUES
      ('model.p.stg_orders', 'ID', 'BIGINT', 1), ('model.p.stg_orders', 'AMOUNT', 'DOUBLE', 2), ('model.p.stg_orders', 'LOADED_AT', 'TIMESTAMP', 3),
      ('model.p.stg_customers', 'id', 'INTEGER', 2), ('model.p.stg_customers', 'name', 'VARCHAR', 1), ('model.p.dim_customers', 'customer_id', 'BIGINT', 1)
    ) AS t(uid, name, type, idx)""",
    "tests": """SELECT * FROM (VALUES
      ('test.p.unique_stg_orders_id', 'unique_stg_orders_id', 'unique', 'id', 'model.p.stg_orders'), ('test.p.not_null_stg_orders_id', 'not_null_stg_orders_id', 'not_null', 'ID', 'model.p.stg_orders'),
      ('test.p.rel_orders_customers', 'rel_orders_customers', 'relationships', 'customer_id', 'model.p.stg_customers,model.p.stg_orders'), ('test.p.unique_stg_customers_id', 'unique_stg_customers_id', 'unique', 'id', 'model.p.stg_customers'),
      ('test.p.values_fct', 'values_fct', 'accepted_values', 'state', 'model.p.fct_orders'), ('test.p.custom', 'custom', '', '', 'model.p.summary')
    ) AS t(test_id, test_name, test_type, column_name, depends_on)""",
    "results": """SELECT * FROM (VALUES
      ('test.p.unique_stg_orders_id', 'success', 0), ('test.p.not_null_stg_orders_id', 'failure', 3), ('test.p.rel_orders_customers', 'warning', 1), ('test.p.values_fct', 'error', 0), ('test.p.custom', 'skipped', 0)
    ) AS t(test_id, status, failures)""",
    "freshness": """SELECT * FROM (VALUES ('source.p.raw.orders', 'pass'), ('source.p.raw.customers', 'warn'), ('source.p.raw.events', 'error'), ('source.p.raw.other', 'runtime error'), ('source.p.raw.none', NULL)) AS t(uid, status)""",
    "questions": """SELECT * FROM (VALUES ('Are orders unique?', 'unique_stg_orders_id'), ('Any null ids?', 'not_null_stg_orders_id'), ('Do totals match?', 'no_such_test'), ('Unique customers?', 'unique_stg_customers_id')) AS t(question, test_name)""",
    "relationship_tests": """SELECT * FROM (VALUES
      ('t1', 'orders', 'customer_id', 'customers', 'id', 'ERROR'), ('t2', 'items', 'order_id', 'orders', 'id', NULL), ('t3', 'items', 'product_id', 'products', 'id', 'warn'), ('t4', 'orders', 'parent_id', 'orders', 'id', NULL)
    ) AS t(test_id, child, child_column, parent, parent_column, severity)""",
    "facts": """SELECT * FROM (VALUES ('orders', 'ID', 'unique'), ('orders', 'id', 'not_null'), ('orders', 'customer_id', 'not_null'), ('customers', 'id', 'unique'), ('items', 'order_id', 'not_null')) AS t(uid, column_name, test_type)""",
    "relationship_results": """SELECT * FROM (VALUES ('t1', 'pass'), ('t2', 'fail')) AS t(test_id, status)""",
    "declared_relationships": """SELECT * FROM (VALUES
      (1, 'orders', 'customer_id', 'customers', 'id', 'one_to_many', 'placed by'), (2, 'items', 'sku', 'skus', 'id', 'one_to_one', 'is'), (3, 'items', 'note', '', '', 'unknown', 'ghost'), (4, 'items', 'sku', 'skus', 'id', 'many_to_many', 'is one of')
    ) AS t(position, source, source_column, target, target_column, kind, label)""",
    "insight_columns": """SELECT * FROM (VALUES
      ('orders', 'order_id', 'BIGINT', '', 'unique,not_null', 'join_key'), ('orders', 'customer_id', 'BIGINT', 'who', 'relationships', ''), ('orders', 'product_key', 'BIGINT', '', '', 'join_key'),
      ('orders', 'created_at', 'TIMESTAMP', '', '', ''), ('orders', 'order_total', 'DOUBLE', '', '', 'aggregated'), ('orders', 'status', 'VARCHAR', '', 'accepted_values', 'filtered'), ('orders', 'is_paid', 'BOOLEAN', '', '', ''),
      ('orders', 'customer_email', 'VARCHAR', '', '', ''), ('orders', 'region', 'VARCHAR', '', '', 'group_by'), ('orders', 'blob', 'BINARY', '', '', ''), ('orders', 'loaded', 'DATE', '', '', 'filtered')
    ) AS t(model, name, data_type, description, tests, usages)""",
    "column_lineage": """SELECT * FROM (VALUES
      ('stg_orders', 'id', 'raw_orders', 'id', 'passthrough'), ('stg_orders', 'amount', 'raw_orders', 'cents', 'derived'), ('stg_orders', 'kind', '', '', 'constant'), ('int_orders', 'order_id', 'stg_orders', 'ID', 'rename'),
      ('int_orders', 'amount', 'stg_orders', 'amount', 'passthrough'), ('int_orders', 'name', 'stg_customers', 'name', 'passthrough'), ('fct_orders', 'total', 'int_orders', 'amount', 'aggregated'), ('fct_orders', 'total', 'int_orders', 'order_id', 'derived'),
      ('summary', 'total', 'fct_orders', 'total', 'passthrough'), ('summary', 'odd', 'fct_orders', 'x', 'untraced'), ('stg_customers', 'name', 'raw_customers', 'full_name', 'rename')
    ) AS t(target_model, target_column, source_model, source_column, transformation)""",
}
TABLES |= {
    "references": """SELECT * FROM (VALUES ('raw.orders'), ('RAW.Orders'), ('"db"."raw"."customers"'), ('stg_orders'), ('STG_ORDERS'), ('nowhere.x'), ('r.events')) AS t(ref)""",
    "known": """SELECT * FROM (VALUES ('source.orders', 'raw', 'orders', 'r'), ('source.customers', 'raw', 'customers', 'r'), ('source.events', 'raw', 'events', 'r'), ('model.stg_orders', 'main', 'stg_orders', 'none')) AS t(uid, schema, name, source_name)""",
    "model_edges": """SELECT * FROM (VALUES ('raw_orders', 'stg_orders'), ('raw_customers', 'stg_customers'), ('stg_orders', 'int_orders'), ('stg_customers', 'int_orders'), ('int_orders', 'fct_orders'), ('fct_orders', 'summary')) AS t(source, target)""",
    "model_columns": """SELECT * FROM (VALUES ('raw_orders', 'id'), ('raw_orders', 'cents'), ('raw_customers', 'full_name'), ('stg_orders', 'id'), ('stg_orders', 'amount'), ('int_orders', 'X'), ('int_orders', 'amount'), ('summary', 'total')) AS t(model, col)""",
    "join_pairs": """SELECT * FROM (VALUES ('stg_orders', 'id', 'int_orders', 'order_id'), ('int_orders', 'cid', 'stg_customers', 'id'), ('stg_orders', 'id', 'int_orders', 'order_id'), ('a', 'x', 'b', 'y')) AS t(left_model, left_column, right_model, right_column)""",
    "cte_nodes": """SELECT * FROM (VALUES ('src', false), ('p1', true), ('p2', true), ('calc', false), ('out', false)) AS t(node, passthrough)""",
    "cte_edges": """SELECT * FROM (VALUES ('src', 'p1'), ('p1', 'p2'), ('p2', 'calc'), ('calc', 'out'), ('p1', 'out')) AS t(source, target)""",
    "components": """SELECT * FROM (VALUES ('margin', 'revenue'), ('margin', 'cost'), ('cost', 'fees'), ('fees', 'cost')) AS t(measure, component)""",
    "measure_sources": """SELECT * FROM (VALUES ('revenue', 'fct_orders', 'total'), ('cost', 'fct_costs', 'amount'), ('fees', 'fct_fees', 'fee')) AS t(measure, model, col)""",
}

TABLES["ephemeral"] = "SELECT * FROM (VALUES ('model.p.loose'), ('model.p.int_orders')) AS t(uid)"
_K, _HALF = "p_partkey", "CAST(floor(p_partkey / 2) AS BIGINT)"


def _pick(by: str, *values: str) -> str:
    return f"CASE {_K} % {by} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


_FOLDER = _pick("4", "'models/staging'", "'models/intermediate'", "'models/marts'", "'models/' || replace(lower(p_brand), '#', '_')")
_NAME = f"({_pick('6', chr(39) + 'stg_' + chr(39), chr(39) + 'int_' + chr(39), chr(39) + 'fct_' + chr(39), chr(39) + 'dim_' + chr(39), chr(39) * 2)} || replace(p_name, ' ', '_') || '_' || {_K})"
_SQL = f"CASE WHEN {_K} % 9 = 0 THEN 'with e as (select 1 as orders),' || chr(10) || 'f as (select 2) select * from (select 3) x' WHEN {_K} % 10 = 0 THEN '' ELSE 'select *' || chr(10) || 'from a' || repeat(' join b on x = y' || chr(10), CAST({_K} % 12 AS INT)) END"

#: What the driver tables add to each table of the project.
DERIVED = {
    "nodes": f"""SELECT 'model.d.' || {_K}, {_NAME}, 'model', NULL, {_FOLDER}, {_FOLDER} || '/' || {_NAME} || '.sql', {_pick('3', "lower(p_type)", "'core,' || lower(p_type)", "''")}, CASE WHEN {_K} % 11 = 0 THEN 'mart' END, {_K} % 13 = 0, CASE WHEN {_K} % 5 = 0 THEN '' ELSE p_name END FROM {{part}}
      UNION ALL SELECT 'source.d.' || s_suppkey, lower(s_name), 'source', 'erp', '', '', '', NULL, false, '' FROM {{supplier}}""",
    "edges": f"""SELECT 'model.d.' || {_K}, 'model.d.' || {_HALF} FROM {{part}} WHERE {_K} > 1 UNION ALL SELECT 'model.d.1', 'model.p.summary' FROM {{part}} WHERE {_K} = 1
      UNION ALL SELECT 'model.p.stg_customers', 'model.d.' || {_K} FROM {{part}} WHERE {_K} % 50 = 49 UNION ALL SELECT 'model.p.stg_orders', 'model.d.' || {_K} FROM {{part}} WHERE {_K} % 100 = 7
      UNION ALL SELECT 'source.d.' || s_suppkey, 'model.d.' || {_K} FROM {{part}} JOIN {{supplier}} ON s_suppkey = {_K}""",
    "cyclic": f"SELECT 'd', 'y' || {_K} FROM {{part}} UNION ALL SELECT 'y' || {_K}, 'y' || {_HALF} FROM {{part}} UNION ALL SELECT 'y1', 'a' FROM {{part}} WHERE {_K} = 1",
    "models": f"SELECT 'model.d.' || {_K}, {_NAME}, {_FOLDER}, {_FOLDER} || '/' || {_NAME} || '.sql', CASE WHEN {_K} % 5 = 0 THEN ' ' ELSE p_name END, {_SQL} FROM {{part}}",
    "ephemeral": f"SELECT 'model.d.' || {_K} FROM {{part}} WHERE {_K} % 6 = 5",
    "declared_columns": f"SELECT 'model.d.' || {_K}, 'id', 1, CASE WHEN {_K} % 2 = 0 THEN 'key' ELSE '' END, 'int' FROM {{part}} UNION ALL SELECT 'model.d.' || {_K}, 'Col_' || ({_K} % 9), 2, CASE WHEN {_K} % 7 = 0 THEN p_name ELSE ' ' END, '' FROM {{part}}",
    "catalog_columns": f"SELECT 'model.d.' || {_K}, 'ID', 'BIGINT', 2 FROM {{part}} WHERE {_K} % 3 <> 2 UNION ALL SELECT 'model.d.' || {_K}, 'extra_' || ({_K} % 4), 'DOUBLE', 1 FROM {{part}} WHERE {_K} % 3 <> 2",
    "tests": f"""SELECT 'test.d.u' || {_K}, 'unique_' || {_K}, 'unique', 'ID', 'model.d.' || {_K} FROM {{part}} WHERE {_K} % 2 = 0 UNION ALL SELECT 'test.d.v' || {_K}, 'values_' || {_K}, 'accepted_values', 'col_' || ({_K} % 9), 'model.d.' || {_K} FROM {{part}} WHERE {_K} % 8 = 3
      UNION ALL SELECT 'test.d.r' || {_K}, 'rel_' || {_K}, 'relationships', 'id', 'model.d.' || {_HALF} || ',model.d.' || {_K} FROM {{part}} WHERE {_K} % 5 = 1 AND {_K} > 1""",
    "results": f"SELECT 'test.d.u' || {_K}, {_pick('5', chr(39) + 'success' + chr(39), chr(39) + 'failure' + chr(39), chr(39) + 'warning' + chr(39), chr(39) + 'pass' + chr(39), chr(39) + 'skipped' + chr(39))}, CAST({_K} % 3 AS INT) FROM {{part}} WHERE {_K} % 6 <> 4",
    "freshness": "SELECT 'source.d.' || s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'error' WHEN 3 THEN 'runtime error' END FROM {supplier}",
    "questions": f"SELECT 'Is ' || {_K} || ' unique?', 'unique_' || {_K} FROM {{part}} WHERE {_K} % 10 IN (0, 1, 4)",
    "relationship_tests": f"SELECT 'rt' || {_K}, 'd' || {_K}, 'parent_id', 'd' || {_HALF}, 'id', {_pick('3', chr(39) + 'WARN' + chr(39), chr(39) + 'Error' + chr(39), 'NULL')} FROM {{part}} WHERE {_K} > 1 UNION ALL SELECT 'rc' || {_K}, 'd' || {_K}, 'customer_id', 'customers', 'id', NULL FROM {{part}} WHERE {_K} % 20 = 3",
    "facts": f"SELECT 'd' || {_K}, 'id', 'unique' FROM {{part}} WHERE {_K} % 2 = 0 UNION ALL SELECT 'd' || {_K}, 'Parent_ID', 'not_null' FROM {{part}} WHERE {_K} % 3 = 0 UNION ALL SELECT 'd' || {_K}, 'ID', 'not_null' FROM {{part}} WHERE {_K} % 4 = 0",
    "relationship_results": f"SELECT 'rt' || {_K}, CASE WHEN {_K} % 4 = 0 THEN 'fail' ELSE 'pass' END FROM {{part}} WHERE {_K} % 2 = 0",
    "declared_relationships": f"""SELECT CAST(10 + {_K} AS INT), 'd' || {_K}, 'parent_id', 'd' || {_HALF}, 'id', {_pick('4', chr(39) + 'one_to_one' + chr(39), chr(39) + 'one_to_many' + chr(39), chr(39) + 'many_to_many' + chr(39), chr(39) + 'unknown' + chr(39))}, p_brand FROM {{part}} WHERE {_K} % 6 < 2 AND {_K} > 1
      UNION ALL SELECT CAST(10 + {_K} AS INT), 'd' || {_K}, 'note', '', '', 'unknown', 'ghost' FROM {{part}} WHERE {_K} % 10 = 5 UNION ALL SELECT CAST(10 + {_K} AS INT), 'd' || {_K}, 'other', 'd' || {_HALF}, 'id', 'one_to_one', '' FROM {{part}} WHERE {_K} % 9 = 5""",
    "insight_columns": f"""SELECT 'd' || {_K}, {_pick('13', *(chr(39) + n + chr(39) for n in ('order_id', 'Customer_Key', 'created_at', 'line_total', 'item_count', 'tax_rate', 'order_status', 'full_name', 'user_email', 'page_url', 'is_open', 'misc')), "'x_' || p_partkey")}, {_pick('4', *(chr(39) + n + chr(39) for n in ('BIGINT', 'TIMESTAMP', 'VARCHAR', 'BOOLEAN')))}, CASE WHEN {_K} % 8 = 0 THEN p_name ELSE ' ' END,
      {_pick('5', *(chr(39) + n + chr(39) for n in ('unique,not_null', 'relationships', 'accepted_values', 'unique', '')))}, {_pick('7', *(chr(39) + n + chr(39) for n in ('join_key', 'aggregated', 'filtered', 'group_by', 'join_key,filtered', '', 'aggregated,group_by')))} FROM {{part}}""",
    "column_lineage": f"""SELECT 'd' || {_HALF}, 'c', 'd' || {_K}, 'C', {_pick('8', *(chr(39) + n + chr(39) for n in ('passthrough', 'rename', 'derived', 'aggregated', 'constant', 'untraced', 'passthrough', 'unknown')))} FROM {{part}} WHERE {_K} > 1 UNION ALL SELECT 'summary', 'total', 'd1', 'c', 'passthrough' FROM {{part}} WHERE {_K} = 1
      UNION ALL SELECT 'd' || {_K}, 'C', 'stg_orders', 'Amount', 'rename' FROM {{part}} WHERE {_K} % 10 = 9 UNION ALL SELECT 'd' || {_K}, 'e', 'd' || {_HALF}, 'f' || ({_K} % 3), 'derived' FROM {{part}} WHERE {_K} % 4 = 2""",
    "references": "SELECT CASE s_suppkey % 6 WHEN 0 THEN 'raw.sup_' WHEN 1 THEN 'RAW.Sup_' WHEN 2 THEN '\"db\".\"raw\".\"sup_' WHEN 3 THEN 'erp.sup_' WHEN 4 THEN 'SUP_' ELSE 'nowhere.sup_' END || s_suppkey || CASE WHEN s_suppkey % 6 = 2 THEN '\"' ELSE '' END FROM {supplier}",
    "known": "SELECT 'source.d.' || s_suppkey, 'raw', 'sup_' || s_suppkey, 'erp' FROM {supplier}",
    "model_edges": f"SELECT 'd' || {_K}, 'd' || {_HALF} FROM {{part}} WHERE {_K} > 1",
    "model_columns": f"SELECT 'd' || {_K}, CASE WHEN {_K} % 2 = 0 THEN 'c' ELSE 'C' END FROM {{part}} WHERE {_K} % 4 <> 3 UNION ALL SELECT 'd' || {_K}, 'F' || ({_K} % 3) FROM {{part}}",
    "join_pairs": f"SELECT 'd' || {_K}, 'c', 'd' || {_HALF}, 'id' FROM {{part}} WHERE {_K} > 1 AND {_K} % 3 = 0 UNION ALL SELECT 'd' || {_HALF}, 'id', 'd' || {_K}, 'key' FROM {{part}} WHERE {_K} > 1 AND {_K} % 4 < 2",
    "cte_nodes": f"SELECT 'x' || {_K}, {_K} % 3 = 2 OR {_K} % 4 = 0 FROM {{part}}",
    "cte_edges": f"SELECT 'x' || {_HALF}, 'x' || {_K} FROM {{part}} WHERE {_K} > 1 UNION ALL SELECT 'x' || {_K}, 'x' || ({_K} + 1) FROM {{part}} WHERE {_K} % 5 = 1",
    "components": f"SELECT 'm' || {_K}, 'm' || {_HALF} FROM {{part}} WHERE {_K} > 1 UNION ALL SELECT 'm1', 'm7' FROM {{part}} WHERE {_K} = 7",
    "measure_sources": f"SELECT 'm' || {_K}, 'fct_' || {_K}, 'col' || ({_K} % 3) FROM {{part}} WHERE {_K} % 3 = 1",
}
LISTS = {"tags", "depends_on", "usages"}


def _text(name: str) -> str:
    return f"{TABLES[name]} UNION ALL {DERIVED[name]}"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of the project, its comma-separated lists as arrays."""
    given = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("part", "supplier") if f"{{{t}}}" in DERIVED[name]}
    df = spark.sql(_text(name).replace("AS VARCHAR(20)", "AS STRING"), **given)
    lists = [c for c in df.columns if c in LISTS or (c == "tests" and name == "insight_columns")]
    return df.withColumns({c: F.filter(F.split(c, ","), lambda x: x != "") for c in lists}) if lists else df


def oracle(sql: str, *names: str) -> str:
    """``sql`` with the named project tables in front of it."""
    parts = ", ".join(f"{n} AS ({_text(n).format(part='part', supplier='supplier')})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {parts}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {parts} {body}"
