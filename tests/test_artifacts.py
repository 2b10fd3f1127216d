import json
import random
import time

import pytest
from pyspark.sql import functions as F

from gneiss.functions import text
from gneiss.operators import metadata, profile
from gneiss.sources import artifacts, tables
from gneiss.streaming.watch import watch

MANIFEST = {
    "nodes": {
        "model.p.a": {"unique_id": "model.p.a", "name": "a", "resource_type": "model", "package_name": "p", "original_file_path": "models/staging/a.sql", "tags": ["x"], "depends_on": {"nodes": ["source.p.r.t"]}, "meta": {"k": 1}, "columns": {"id": {"name": "id", "description": "key"}, "Note": {"name": "Note"}}, "odd": {"kept": True}},
        "test.p.u": {"unique_id": "test.p.u", "name": "u", "resource_type": "test", "column_name": "id", "depends_on": {"nodes": ["model.p.a"]}, "test_metadata": {"name": "unique", "kwargs": {"column_name": "id"}}, "config": {"severity": "ERROR"}},
    },
    "sources": {"source.p.r.t": {"unique_id": "source.p.r.t", "name": "t", "source_name": "r"}},
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps(MANIFEST, indent=1))
    (tmp_path / "catalog.json").write_text(json.dumps({"nodes": {"model.p.a": {"unique_id": "model.p.a", "columns": {"ID": {"name": "ID", "type": "BIGINT", "index": 1}}, "stats": {"row_count": {"id": "row_count", "value": "12"}}}}, "sources": {}}))
    (tmp_path / "run_results.json").write_text(json.dumps({"results": [{"unique_id": "test.p.u", "status": "pass", "failures": 0, "timing": [{"name": "compile", "completed_at": "1"}, {"name": "execute", "completed_at": "2"}]}]}))
    return tmp_path


def test_load(spark, folder):
    p = artifacts.load(spark, str(folder))
    assert {r.unique_id for r in p.nodes.collect()} == {"model.p.a", "test.p.u"} and p.freshness.count() == 0
    assert [(r.uid, r.name, r.description) for r in artifacts.declared_columns(p.nodes).orderBy("pos").collect()] == [("model.p.a", "id", "key"), ("model.p.a", "Note", "")]
    merged = metadata.merged_columns(artifacts.declared_columns(p.nodes), artifacts.catalog_columns(p.catalog)).orderBy("ordinal").collect()
    assert [(r.name, r.data_type, r.description) for r in merged] == [("ID", "BIGINT", "key"), ("Note", "", "")]
    assert {(r.source, r.target) for r in artifacts.dependency_edges(p.nodes).collect()} == {("source.p.r.t", "model.p.a"), ("model.p.a", "test.p.u")}
    assert artifacts.tests(p.nodes).first().test_type == "unique" and artifacts.last_run(p.run_results).first().completed_at == "2"
    assert metadata.with_stats(p.nodes.select(F.col("unique_id").alias("uid")), artifacts.catalog_stats(p.catalog)).where("uid = 'model.p.a'").first().row_count == 12


def test_faults_are_told(spark, tmp_path):
    with pytest.raises(artifacts.ArtifactError, match="not found"):
        artifacts.load(spark, str(tmp_path))
    (tmp_path / "manifest.json").write_text('{\n "a": }')
    with pytest.raises(artifacts.ArtifactError, match="line 2, column 7"):
        artifacts.load(spark, str(tmp_path))
    (tmp_path / "manifest.json").write_text("[]")
    with pytest.raises(artifacts.ArtifactError, match="object"):
        artifacts.load(spark, str(tmp_path))


def split(text, size):
    splitter, out = artifacts.Splitter(), []
    for i in range(0, len(text), size):
        out += splitter.feed(text[i : i + size])
    splitter.finish()
    return [(a, b, c, json.loads(v)) for a, b, c, v in out]


WHOLE = {"metadata": {"a": 1, "b": {"c": [1, {"d": "}{]["}]}}, "version": 3, "none": None, "text": 'q"\\" , : }', "empty": {}, "list": [], "results": [{"x": "\\\\"}, [1, 2], "é\n日", 5, None, {}], "nodes": {"m.\"1": {"sql": "select '{{ x }}'"}, "m.2": [], "": 1}}


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", [1, 2, 7, 10_000])
def test_sections_are_split_like_json(size, indent):
    want = []
    for k, v in WHOLE.items():
        want += [(k, a, i, b) for i, (a, b) in enumerate(v.items())] if isinstance(v, dict) else [(k, None, i, b) for i, b in enumerate(v)] if isinstance(v, list) else [(k, None, 0, v)]
    assert split(json.dumps(WHOLE, indent=indent, ensure_ascii=False), size) == want
    assert split(" \n" + json.dumps(WHOLE, indent=indent) + "\n ", size) == want


@pytest.mark.parametrize("text", ['{"a": {"b": 1}', '{"a": {"b": 1', '{"a": {"b": }}', '{"a": [1,]}', '{"a": 1,, "b": 2}', '{"a": {"b" 1}}', '{"a": 1} x', '{"a": 1}}', '{"a": "x', "", " ", "[1]", "{a: 1}", '{"a": {"b": 1]}', '{"a": {"b": {"c": }}}', '{"a": nope}', '{"a": {"b": 1, , "c": 2}}', '{"a": tru}', '{"a": {"b": {"c": 1}, "d"}}'])
def test_what_is_no_json_is_told(text):
    for size in (1, 3, 100):
        with pytest.raises(ValueError, match="line 1, column"):
            split(text, size)
    with pytest.raises(json.JSONDecodeError):
        if isinstance(json.loads(text), list):
            raise json.JSONDecodeError("a list", text, 0)


def test_large_manifest_in_many_pieces(spark, tmp_path, monkeypatch):
    nodes = {f"model.p.m{i}": {"unique_id": f"model.p.m{i}", "name": f"m{i}", "resource_type": "model", "raw_code": "select '{' || a || '}' from {{ ref('x') }}\n" * (i % 7), "depends_on": {"nodes": [f"model.p.m{i // 2}"]}} for i in range(4000)}
    (tmp_path / "manifest.json").write_text(json.dumps({"metadata": {"v": "x}"}, "nodes": nodes, "child_map": {"model.p.m0": ["model.p.m1", "model.p.m2"]}}))
    monkeypatch.setattr(artifacts, "HELD", 5000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        p = artifacts.load(spark, str(tmp_path))
        got = {r.unique_id: (r.raw_code, r.depends_on.nodes) for r in p.nodes.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: (v["raw_code"], v["depends_on"]["nodes"]) for k, v in nodes.items()}
    assert {(r.source, r.target) for r in artifacts.consumer_edges(p.nodes, p.child_map).collect()} == {("model.p.m0", "model.p.m1"), ("model.p.m0", "model.p.m2")}
    assert artifacts.consumer_edges(p.nodes, p.child_map.limit(0)).count() == 4000


def test_exposures_metrics_and_accepted_values(spark, tmp_path):
    made = {
        "nodes": {"t": {"name": "t", "resource_type": "test", "depends_on": {"nodes": ["m"]}, "test_metadata": {"name": "accepted_values", "kwargs": {"values": ["a", "b"], "column_name": "c"}}}, "u": {"name": "u", "resource_type": "test", "test_metadata": {"name": "unique", "kwargs": {}}}},
        "exposures": {"e.1": {"name": "board", "type": "dashboard", "url": "u", "label": "Board", "maturity": "high", "owner": {"name": "n"}, "depends_on": {"nodes": ["m"]}, "meta": {"k": 1}}, "e.2": {"name": "bare"}},
        "metrics": {"x": {"name": "revenue", "type": "simple", "label": "Revenue", "depends_on": {"nodes": ["m"]}, "tags": ["kpi"]}},
    }
    (tmp_path / "manifest.json").write_text(json.dumps(made))
    p = artifacts.load(spark, str(tmp_path))
    assert {r.test_id: r.accepted for r in artifacts.tests(p.nodes).collect()} == {"t": ["a", "b"], "u": None}
    rows = {r.unique_id: r for r in artifacts.exposure_rows(p.exposures).collect()}
    assert (rows["e.1"].maturity, rows["e.1"].depends_on, rows["e.1"].columns, json.loads(rows["e.1"].meta)) == ("high", ["m"], [], {"k": 1}) and rows["e.2"].tags == []
    assert [tuple(r) for r in artifacts.metric_rows(p.metrics).collect()] == [("x", "revenue", None, "Revenue", "simple", ["m"], ["kpi"])]


def until(query, done):
    for _ in range(80):
        if done() or not query.isActive:
            return
        time.sleep(0.25)


def test_rewrites_deletions_failures_and_restarts_of_a_watch(spark, folder, tmp_path_factory):
    state, seen, broken = str(tmp_path_factory.mktemp("watch")), [], []

    def rebuild(df, number):
        if broken:
            raise RuntimeError("cannot rebuild")
        seen.append((number, sorted((r.path.rsplit("/", 1)[1], r.change) for r in df.collect())))

    start = lambda: watch(spark, str(folder), rebuild, state, seconds=0.2)
    query = start()
    try:
        until(query, lambda: len(seen) == 1)
        (folder / "manifest.json").write_text(json.dumps(MANIFEST) + "\n")
        (folder / "notes.txt").write_text("x")
        until(query, lambda: len(seen) == 2)
        (folder / "catalog.json").unlink()
        until(query, lambda: len(seen) == 3)
        query.stop()
        (folder / "sources.json").write_text("{}")  # while nobody looks
        broken.append(1)
        query = start()
        until(query, lambda: False)
        assert query.exception() is not None and len(seen) == 3
        broken.clear()
        query = start()
        until(query, lambda: len(seen) == 4)
        time.sleep(1)
    finally:
        query.stop()
    names = [("manifest.json", "new"), ("run_results.json", "new")]
    assert seen == [(0, [("catalog.json", "new"), *names]), (1, [("manifest.json", "rewritten")]), (2, [("catalog.json", "gone")]), (3, [("sources.json", "new")])]


def test_tables(spark):
    assert tables.connection_options("postgres", {"host": "h", "dbname": "d", "user": "u"})["url"] == "jdbc:postgresql://h:5432/d"
    with pytest.raises(ValueError, match="oracle9"):
        tables.connection_options("oracle9", {})
    df = spark.createDataFrame([(1, 2)], "A int, b int")
    assert tables.existing(df, ["a", "zz", "B"]).columns == ["A", "b"] and tables.schema_hash(df, 1) != tables.schema_hash(df, 2)
    assert json.loads(tables.to_payload(df, "t").first().value) == {"collection": "t", "row": {"A": 1, "b": 2}}


def test_samples_sidecars_and_selection_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "id int, name string")
    made = tables.sample_payload(df, "main", "t", 2).first().value
    (tmp_path / "good.json").write_text(made)
    (tmp_path / "bad.json").write_text('{"schema": "main"}')
    got = tables.read_samples(spark, str(tmp_path)).collect()
    assert [r.model for r in got] == ["good"] and got[0].sample.rows == [["1", "a"], ["2", "b"]] and got[0].sample.row_count == 2
    (tmp_path / "names.txt").write_text("a\n\n# no\n  c \n")
    nodes = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "node string, name string")
    assert sorted(r.name for r in tables.selected_by_file(nodes, str(tmp_path / "names.txt")).collect()) == ["a", "c"]
    (tmp_path / "side").write_text(json.dumps({"version": 1, "exposures": {"e": {"fields": [{"name": "m", "expression": "x", "depends_on": [{"model": "a", "column": "b", "transformation": "cast"}]}, {"name": "n", "components": ["m"]}]}}}))
    rows = {r.field: r for r in tables.read_exposure_fields(spark, str(tmp_path / "side")).collect()}
    assert rows["m"].kind == "measure" and rows["m"].depends_on[0].model == "a" and rows["n"].components == ["m"]
    (tmp_path / "old").write_text('{"version": 2, "exposures": {}}')
    with pytest.raises(ValueError, match="version 1"):
        tables.read_exposure_fields(spark, str(tmp_path / "old"))


def test_profile_cache_and_payload(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    stats, key = profile.table_stats(df), tables.schema_hash(df, 2)
    tables.write_profiles(stats, str(tmp_path / "cache"), "t", key)
    wanted = spark.createDataFrame([("t", key), ("u", "x")], "table_name string, schema_hash string")
    tables.write_profiles(stats, str(tmp_path / "cache"), "t", key)  # again: in place of the first
    valid, anew = tables.cached_profiles(spark, str(tmp_path / "cache"), wanted)
    assert valid.count() == 2 and [r.table_name for r in anew.collect()] == ["u"]
    made = json.loads(tables.profile_payload(stats, profile.profiling_meta(df)).first().value)
    assert [c["column_name"] for c in made["columns"]] == ["id", "name"] and made["meta"]["total_rows"] == 2


@pytest.mark.parametrize(
    ("raw", "plain", "models"),
    [
        ("{{ config(materialized='table') }}{# note #}select {{ utils.star(ref('z')) }}, x from {{ ref('pkg', 'a') }} join {{ source('s', 't') }}{% if is_incremental() %} where x{% else %} where y{% endif %}", "select *, x from a join s.t where y", ["z", "a"]),
        ("{% set d = '2020' %}select a from t {% macro m() %}b{% endmacro %} where c = {{ d }} and e = '{{ d }}' and f = '{{ g }}'", "select a from t  where c = '2020' and e = '2020' and f = 'g'", []),
        ("{% if a %}X{% if b %}Y{% else %}Z{% endif %}{% endif %}", "XZ", []),
        ("{% if a %}X{% else %}{% if b %}Y{%- else -%}Z{% endif %}{% endif %}", "Z", []),
        ("{% if a %}1{% elif b %}2{% endif %}3{% for x in y %}4{% else %}5{% endfor %}", "134", []),
        ("{{ var('x', 'd') }} '{{ var(\"x\", \"d\") }}' {{ var('x', true) }} {{ var('x') }} {{ var('x', 12) }}", "'d' 'd' TRUE NULL 12", []),
        ("{{ dbt_utils.surrogate_key(['a', 'b']) }} {{ dbt.date_trunc('day', 'c') }} {{ dbt.safe_cast('c', 'int') }} {{ dbt.current_timestamp() }}", "CONCAT(a, b) DATE_TRUNC('day', c) CAST(c AS int) CURRENT_TIMESTAMP", []),
        ("{{ dbt.datediff('s', 'e', 'day') }} {{ dbt.dateadd('day', -7, 'c') }} {{ type_string() }}", "DATEDIFF('day', s, e) DATEADD('day', -7, c) VARCHAR", []),
        ("{{ dbt_utils.union_relations(relations=[ref('a'), source('s', 'b')]) }}", "SELECT * FROM a\nUNION ALL\nSELECT * FROM s.b", ["a"]),
        ("{{ mac('col_a') }} {{ mac('a','b') }} {{ mac(1) }} {{ this }} {{ a + b }} {% set body %}zzz{% endset %}{- b {", "col_a (a AND b) NULL NULL NULL {- b {", []),
        ("{% raw %}{{ x }} {% if a %}{# n #}{% endraw %} {{ ref('a') }}", "{{ x }} {% if a %}{# n #} a", ["a"]),
        ("{% if a %}{%- raw -%}'{{ ref('no') }}'{%- endraw -%}{% else %}{% raw %}{{ b }}{% endraw %}{% endif %} {{ c }}", "{{ b }} NULL", []),
        ("'{{ x }}{% raw %}' }}{% endraw %} {% raw %}{% endraw %}", "'x' }} ", []),
        ("", "", []),
        (None, None, None),
    ],
)
def test_templates(spark, raw, plain, models):
    sql = F.lit(raw).cast("string")
    row = spark.range(1).select(text.strip_templates(sql).alias("a"), text.referenced_models(sql).alias("b")).first()
    assert (row.a, row.b) == (plain, models)


def kept_by_hand(pieces):
    """The pieces that stay, by a stack that holds the pieces themselves."""
    stack = [["", False, []]]
    for piece in pieces:
        word = piece[2:-2].split()[0] if piece.startswith("{%") else ""
        top = stack[-1]
        if piece.startswith("{#"):
            continue
        if word in ("if", "for", "macro", "docs") or word == "set" and "=" not in piece:
            stack.append([word, word not in ("if", "for"), []])
        elif len(stack) > 1 and word == "end" + top[0]:
            stack.pop()
            if word in ("endif", "endfor") and not stack[-1][1]:
                stack[-1][2] += top[2]
        elif word == "else" and top[0] == "if":
            stack[-1] = ["if", False, []]
        elif word == "elif" and top[0] == "if" or word == "else" and top[0] == "for":
            top[1] = True
        elif word in ("", "set") and not top[1]:
            top[2].append(piece)
    return [piece for frame in stack for piece in frame[2]]


def test_kept_pieces_by_hand(spark):
    words = "if a|elif b|else|endif|for x in y|endfor|macro f()|endmacro|set k = 'v'|set body|endset|docs d|enddocs|do z()".split("|")
    some = [f"{{% {w} %}}" for w in words] * 2 + ["{# c #}", "{{ x }}", "a", "b"] * 4
    draw = random.Random(7)
    texts = []
    for _ in range(400):
        pieces = [draw.choice(some) for _ in range(draw.randrange(25))]
        texts.append([p for i, p in enumerate(pieces) if not i or p not in "ab" or pieces[i - 1] not in "ab"])  # plain text is one piece
    rows = spark.createDataFrame([(i, "".join(t)) for i, t in enumerate(texts)], "i int, s string").select("i", text._kept_pieces(F.col("s")).alias("kept"))
    assert {r.i: r.kept for r in rows.collect()} == {i: kept_by_hand(t) for i, t in enumerate(texts)}


def test_long_templates(spark):
    sql = spark.range(1).select(F.repeat(F.lit("select {{ ref('m') }} "), 20_000).alias("s"))
    began = time.time()
    assert sql.select(F.length(text.strip_templates(F.col("s")))).first()[0] == 20_000 * len("select m ")
    assert time.time() - began < 30  # a minute where the pieces that stay are copied for every piece


def test_formulas_and_formats(spark):
    row = spark.range(1).select(
        text.formula_columns(F.lit("sum(case when kind = 'x' then amount else 0 end) / count(id)")).alias("c"),
        F.array(*[text.bytes_text(F.lit(n)) for n in (512, 1536, 3 << 30)]).alias("d"), F.array(*[text.number_text(F.lit(n)) for n in (999, 1500, 2_000_000, 3_100_000_000)]).alias("n"),
        text.percent_text(F.lit(0.1234)).alias("p"), F.array(*[text.duration_text(F.lit(s)) for s in (0.25, 12.34, 125.0)]).alias("t"),
    ).first()
    assert row.c == ["kind", "amount", "id"] and row.d == ["512 B", "1.5 KB", "3.0 GB"] and row.n == ["999", "1.5K", "2M", "3.1B"] and row.p == "12.3%" and row.t == ["250ms", "12.3s", "2m 5s"]


@pytest.fixture(scope="module")
def warehouse(spark):
    """A table of an embedded database, by JDBC."""
    options = {"url": "jdbc:derby:memory:gneiss;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(5000).selectExpr("IF(id % 50 = 0, NULL, IF(id < 3000, id % 7, id * id)) AS k", "id AS v")
    rows.write.format("jdbc").options(**options, dbtable='"APP"."facts"').save()
    spark.sql("SELECT 1D AS k, 2L AS v").limit(0).write.format("jdbc").options(**options, dbtable='"APP"."nothing"').save()
    return options


def test_warehouse_tables_are_read_in_ranges(spark, warehouse):
    df = tables.scan(spark, warehouse, "APP", "facts", key="k", partitions=6)
    sizes = [len(p) for p in df.rdd.glom().collect()]
    assert 2 <= len(sizes) <= 6 and sum(sizes) == 5000 and df.agg(F.count_distinct("v")).first()[0] == 5000
    assert max(sizes) < 3200  # most rows have one of seven keys, which lie in one step
    assert tables.scan(spark, warehouse, "APP", "facts").count() == 5000
    assert tables.scan(spark, warehouse, "APP", "facts", key="v", partitions=4).rdd.glom().map(len).collect() == [1250] * 4
    assert tables.scan(spark, warehouse, "APP", "nothing", key="k").count() == 0


def test_ephemeral_models_are_no_tables(spark):
    models = spark.createDataFrame([("a", "table"), ("b", "Ephemeral"), ("c", None)], "uid string, materialization string")
    assert sorted(r.uid for r in tables.profiled_models(models).collect()) == ["a", "c"]


def test_types_by_name(spark):
    cases = {"customer_id": "VARCHAR", "id": "VARCHAR", "created_at": "TIMESTAMP_NTZ", "seen_at": "TIMESTAMP_NTZ", "at": "VARCHAR", "order_date": "DATE", "item_count": "NUMBER", "serial_num": "NUMBER", "num": "VARCHAR", "Unit_Price": "NUMBER(38,2)", "tax_rate": "FLOAT", "is_open": "BOOLEAN", "is": "VARCHAR", "active": "BOOLEAN", "has_total": "NUMBER(38,2)", "odd": "VARCHAR"}
    rows = spark.createDataFrame([("m", n, i, None if i % 2 else "") for i, n in enumerate(cases)] + [("m", "ID", 99, "bigint"), ("n", "odd", 1, "bigint")], "uid string, name string, pos int, data_type string")
    got = metadata.synthetic_catalog(rows).collect()
    assert {r.name: r.type for r in got if r.uid == "m"} == {n.upper(): t for n, t in cases.items()} and [(r.type, r.idx) for r in got if r.uid == "n"] == [("BIGINT", 1)]


def test_tiers_of_compact_models(spark):
    for many, described, with_columns in ((3, True, True), (201, True, False), (501, False, False)):
        models = spark.range(many).selectExpr("string(id) AS uid", "concat('m', id) AS name", "'d' AS description")
        columns = spark.sql("SELECT '1' AS uid, 2 AS ordinal, 'b' AS name UNION ALL SELECT '1', 1, 'a'")
        attached = spark.sql("SELECT '1' AS uid, 'pass' AS status UNION ALL SELECT '1', 'pass' UNION ALL SELECT '1', 'fail'")
        row = metadata.compact_models(models, columns, attached).where("uid = '1'").first()
        assert (row.description == "d", row.columns == ["a", "b"], row.test_status) == (described, with_columns, ["fail:1", "pass:2"])
