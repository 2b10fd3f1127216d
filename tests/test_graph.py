import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from gneiss.operators import erd, graph, lineage


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def bfs(pairs, start, limit=None):
    seen, todo = {start: 0}, deque([start])
    while todo:
        v = todo.popleft()
        for a, b in pairs:
            if a == v and b not in seen and (limit is None or seen[v] < limit):
                seen[b] = seen[v] + 1
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(22)] + [("n0", "n1")]
    df = edges_of(spark, pairs)
    assert {r.node: r.depth for r in graph.distances(df, "n0", "downstream").collect()} == bfs(pairs, "n0")
    assert {r.node: r.depth for r in graph.distances(df, "n0", "upstream", 2).collect()} == bfs([(b, a) for a, b in pairs], "n0", 2)


def test_long_chain_self_loop_and_no_edges(spark):
    df = edges_of(spark, [(f"c{i}", f"c{i + 1}") for i in range(12)] + [("c3", "c3"), (None, "c1"), ("c1", None)])
    assert graph.distances(df, "c0", "downstream").count() == 13
    assert graph.distances(df, "c0", "downstream", 10).count() == 11
    assert [r.node for r in graph.distances(df.limit(0), "q", "both").collect()] == ["q"]


def test_focal_subgraph_keeps_monotone_edges(spark):
    df = edges_of(spark, [("a", "b"), ("b", "d"), ("a", "d"), ("d", "e"), ("a", "c"), ("c", "x")])
    got = {(r.source, r.target) for r in graph.focal_subgraph(df, "d").collect()}
    assert got == {("b", "d"), ("a", "d"), ("d", "e")}
    more = {(r.source, r.target) for r in graph.focal_subgraph(df, "d", siblings=True).collect()}
    assert more == got | {("a", "b"), ("a", "c")}


def test_waves_with_a_cycle(spark):
    df = edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")])
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "node string")
    assert {r.node: r.wave for r in graph.depth_waves(nodes, df).collect()} == {"a": 0, "b": 1, "c": 2, "x": 3, "y": 3, "z": 3}


@pytest.mark.parametrize(("glob", "text", "hit"), [("*staging*", "models/staging/a", True), ("stg_?", "stg_a", True), ("stg_?", "stg_ab", False), ("a.b", "axb", False), ("[ab]x", "bx", True)])
def test_globs(spark, glob, text, hit):
    assert spark.range(1).select(F.lit(text).rlike(graph.glob_regex(glob)).alias("x")).first().x is hit


def test_endpoints(spark):
    rows = spark.createDataFrame([(c, p, k) for c in (True, False) for p in (True, False) for k in (None, "one_to_one", "odd")], "c boolean, p boolean, k string")
    child, parent = erd.endpoints(F.col("c"), F.col("p"), F.col("k"))
    for r in rows.select("c", "p", "k", child.alias("x"), parent.alias("y")).collect():
        want = ("one_and_only_one", "one_and_only_one") if r.k == "one_to_one" else ("one_and_only_one" if r.c else "zero_or_one", "one_or_many" if r.p else "zero_or_many")
        assert (r.x, r.y) == want


def test_partners_of_self_and_ghost(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", ""), ("b", "c")], "source string, target string")
    got = {r.node: (r.total, r.partners) for r in erd.partner_stats(df).collect()}
    assert got == {"a": (4, "a,b"), "b": (2, "a,c"), "c": (1, "b")}


def with_chains(rng, n):
    """A random graph of which many steps are replaced by chains, some of them closed to cycles."""
    pairs = []
    for k in range(n):
        ends = [f"n{rng.randrange(n // 2)}", *[f"c{k}_{i}" for i in range(rng.choice([0, 0, 1, 3, 9]))], f"n{rng.randrange(n // 2)}"]
        pairs += zip(ends, ends[1:], strict=False)
    return pairs + [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "y")]


@pytest.mark.parametrize("seed", range(4))
def test_contraction_changes_no_distance(spark, seed, monkeypatch):
    monkeypatch.setattr(graph, "SHALLOW_JOBS", 0)
    rng = random.Random(seed)
    pairs = with_chains(rng, 24)
    df = edges_of(spark, pairs).repartition(3)
    back = [(b, a) for a, b in pairs]
    starts = ["n0", pairs[rng.randrange(len(pairs) - 4)][0], "x2", "y"]
    for direction, way in (("downstream", pairs), ("upstream", back)):
        for limit in (None, 6):
            got = graph.reach(df, spark.createDataFrame([(s,) for s in starts], "node string"), direction, limit)
            assert sorted(got.collect()) == sorted((s, v, d) for s in set(starts) for v, d in bfs(way, s, limit).items())


def test_seeds_of_one_label_are_one_seed(spark):
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(30)]
    seeds = spark.createDataFrame([("x", "c3"), ("x", "c20"), ("y", "c25")], "label string, node string")
    got = {(r.seed, r.node): r.depth for r in graph.reach(edges_of(spark, pairs), seeds).collect()}
    assert got == {**{("x", f"c{i}"): i - 3 if i < 20 else i - 20 for i in range(3, 31)}, **{("y", f"c{i}"): i - 25 for i in range(25, 31)}}


def tables_of(monkeypatch):
    made, write = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: made.append(0) or write(df))
    return made


def test_a_chain_of_thousands_takes_few_jobs(spark, monkeypatch):
    made = tables_of(monkeypatch)
    df = spark.range(2000).select(F.concat(F.lit("c"), "id").alias("source"), F.concat(F.lit("c"), F.col("id") + 1).alias("target"))
    got = graph.distances(df, "c0", "downstream")
    assert got.count() == 2001 and got.where("concat('c', depth) <> node").isEmpty()
    assert len(made) - 4 <= 12  # seeds, steps, and moves of both searches aside


def waves(nodes, pairs):
    """Waves by removing nodes without parents, one level after the other."""
    left, out, wave = set(nodes), {}, 0
    pairs = {(a, b) for a, b in pairs if a in left and b in left}
    while True:
        ready = {v for v in left if all(b != v for _, b in pairs)}
        if not ready:
            return out | dict.fromkeys(left, wave)
        out |= dict.fromkeys(ready, wave)
        left -= ready
        pairs = {(a, b) for a, b in pairs if a not in ready}
        wave += 1


@pytest.mark.parametrize("shallow", [0, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_waves_on_random_graphs(spark, seed, shallow, monkeypatch):
    monkeypatch.setattr(graph, "SHALLOW_JOBS", shallow)
    rng = random.Random(seed)
    pairs = with_chains(rng, 16)
    order = {v: rng.random() for p in pairs for v in p}
    for some in (pairs, [(a, b) for a, b in pairs if order[a] < order[b]]):
        nodes = sorted({v for p in pairs for v in p} - {"n1"} | {"alone"})
        got = graph.depth_waves(spark.createDataFrame([(v,) for v in nodes], "node string"), edges_of(spark, some))
        assert {r.node: r.wave for r in got.collect()} == waves(nodes, some)
    assert graph.depth_waves(spark.createDataFrame([], "node string"), edges_of(spark, pairs)).count() == 0


def test_waves_of_a_long_chain(spark, monkeypatch):
    made = tables_of(monkeypatch)
    df = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("source"), F.concat(F.lit("c"), F.col("id") + 1).alias("target"))
    got = graph.depth_waves(spark.range(5001).select(F.concat(F.lit("c"), "id").alias("node")), df)
    assert got.count() == 5001 and got.where("concat('c', wave) <> node").isEmpty()
    assert len(made) <= 22


def test_relaxation_takes_the_upper_median_of_all_neighbours(spark):
    rng = random.Random(5)
    layers = {f"a{i}": float(rng.randrange(5)) for i in range(200)}
    nodes = [(v, x) for v, x in layers.items()] + [("hub", None), ("even", None), ("far", None), ("alone", None)]
    pairs = [(v, "hub") if i % 3 else ("hub", v) for i, v in enumerate(layers)] + [("a0", "even"), ("a1", "even"), ("hub", "far")]
    hints = sorted(layers[v] + (1 if i % 3 else -1) for i, v in enumerate(layers))
    got = {r.node: (r.layer, r.layer_auto) for r in graph.relaxed_layers(spark.createDataFrame(nodes, "node string, layer double"), edges_of(spark, pairs)).collect()}
    assert got["hub"] == (max(hints[100], 0.0), True)
    assert got["even"] == (max(layers["a0"], layers["a1"]) + 1, True)
    assert got["far"] == (got["hub"][0] + 1, True) and got["alone"] == (2.0, True) and got["a5"] == (layers["a5"], False)


def test_relaxation_of_a_hub_gathers_no_edges(spark):
    n = 200_000
    nodes = spark.range(n).select(F.concat(F.lit("a"), "id").alias("node"), (F.col("id") % 5).cast("double").alias("layer")).union(spark.sql("SELECT 'hub', CAST(NULL AS DOUBLE)"))
    df = spark.range(n).select(F.concat(F.lit("a"), "id").alias("source"), F.lit("hub").alias("target"))
    assert graph.relaxed_layers(nodes, df).where("node = 'hub'").first().layer == 3.0


def test_selections_share_their_searches(spark, monkeypatch):
    pairs = [("s", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("q", "b")]
    nodes = spark.createDataFrame([(v, v, f"f_{v}", None) for v in "sabcdq"], "node string, name string, folder string, path string")
    df, calls, search = edges_of(spark, pairs), [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda *x: calls.append(x) or search(*x))
    assert sorted(r.node for r in graph.select_nodes(nodes, df, "+b, c+ f_q+", "d").collect()) == ["a", "b", "c", "q", "s"]
    assert {(r.node, r.depth) for r in graph.lineage_subset(nodes, df, "+b+ c, a+", 1).collect()} == {("b", 0), ("a", 0), ("q", 1), ("c", 0)}
    assert len(calls) == 4
    assert graph.lineage_subset(nodes, df, " , ").count() == 0


LINEAGE = [("mart", "total", "fct", "amount", "aggregated"), ("fct", "amount", "int", "amount", "passthrough"), ("int", "amount", "stg", "cents", "derived"), ("mart", "kind", "", "", "constant"), ("mart", "odd", "far", "x", "untraced"), ("mart", "name", "dim", "name", "rename"), ("board", "m", "mart", "total", "passthrough")]


def columns_mode(spark, shown, edges, **more):
    nodes = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    lineage = spark.createDataFrame(LINEAGE, "target_model string, target_column string, source_model string, source_column string, transformation string")
    every = ["mart", "fct", "int", "stg", "far", "board", "else"]
    known = [("stg", "int"), ("int", "fct"), ("stg", "else"), ("mart", "board")]
    n, e = graph.columns_mode(nodes(shown), edges_of(spark, edges), nodes(every), edges_of(spark, known), lineage, **more)
    return {r.node: r.injected for r in n.collect()}, {(r.source, r.target): r.implied for r in e.collect()}


def test_columns_mode_adds_what_lineage_names(spark):
    assert columns_mode(spark, ["mart", "int"], [("int", "mart")]) == ({"mart": False, "int": False, "fct": True, "stg": True}, {("int", "mart"): False, ("int", "fct"): False, ("stg", "int"): False, ("fct", "mart"): True})
    whole = ["mart", "fct", "int", "stg"]
    assert columns_mode(spark, whole, [("int", "fct")]) == (dict.fromkeys(whole, False), {("int", "fct"): False})  # nothing is missing: edges stay as shown


def test_columns_mode_narrows_to_a_path(spark):
    nodes, edges = columns_mode(spark, ["mart"], [], selected=("mart", "TOTAL"), direction="upstream", always=("else", "unknown"))
    assert nodes == {"mart": False, "fct": True, "int": True, "stg": True, "else": True}
    assert edges == {("fct", "mart"): True, ("int", "fct"): False, ("stg", "int"): False, ("stg", "else"): False}
    nodes, edges = columns_mode(spark, ["mart"], [], selected=("mart", "total"), direction="downstream")
    assert nodes == {"mart": False, "board": True} and edges == {("mart", "board"): False}
    nodes, _ = columns_mode(spark, ["mart", "int"], [], selected=("mart", "total"))
    assert nodes == {"mart": False, "int": False, "fct": True, "stg": True, "board": True}


def test_filters_include_and_exclude(spark):
    nodes = spark.createDataFrame([("a", "model", "f1", ["x"], 1.0), ("b", "source", "f2", [], None), ("c", "model", "f2", ["x", "y"], 2.0), ("d", "seed", None, None, 1.0)], "node string, resource_type string, folder string, tags array<string>, layer double")
    kept = lambda **f: "".join(sorted(r.node for r in graph.filter_lineage(nodes, edges_of(spark, [("a", "b")]), graph.chosen_by(**f))[0].collect()))
    assert kept() == kept(types=("include", [])) == "abcd"
    assert kept(types=("include", ["model"])) == "ac" and kept(types=("exclude", ["model"])) == "bd"
    assert kept(tags=("include", ["y"])) == "c" and kept(tags=("exclude", ["x"])) == "bd"
    assert kept(layers=("include", [1.0])) == "ad" and kept(layers=("exclude", [1.0])) == "bc"
    assert kept(folders=("include", ["f2"]), layers=("exclude", [2.0])) == "b" and kept(folders=("exclude", ["f2"])) == "ad"


def test_waves_leave_what_is_numbered_behind(spark, monkeypatch):
    """A tree to its root: half of the nodes are numbered at once, so later jobs may not read the moves of all again."""
    sizes, write = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: sizes.append((df.columns, (out := write(df)).count())) or out)
    df = spark.range(2, 4096).select(F.concat(F.lit("n"), "id").alias("source"), F.concat(F.lit("n"), F.floor(F.col("id") / 2)).alias("target"))
    got = graph.depth_waves(spark.range(1, 4096).select(F.concat(F.lit("n"), "id").alias("node")), df)
    assert {(int(r.node[1:]).bit_length(), r.wave) for r in got.collect()} == {(k, 12 - k) for k in range(1, 13)}
    states = [n for columns, n in sizes if "left" in columns]
    assert sum(states[2:]) < states[0] and min(n for columns, n in sizes if "own" in columns) < 64


def test_leaf_sources_search_only_what_they_return(spark, monkeypatch):
    """Twelve levels of measures of which few have sources: no table of the search is longer than the result."""
    sizes, write = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: sizes.append((df.columns, (out := write(df)).count())) or out)
    rests = spark.range(2, 4096).select(F.concat(F.lit("m"), "id").alias("measure"), F.concat(F.lit("m"), F.floor(F.col("id") / 2)).alias("component"))
    rests = rests.unionByName(spark.createDataFrame([("m1", "m7"), ("m5", None), (None, "m5")], "measure string, component string"))
    direct = spark.createDataFrame([("m4", "a", "x"), ("m4", "a", "x"), ("m9", "b", "y"), ("m9", "c", "z"), ("m7", "d", "x"), ("none", "e", "x"), (None, "f", "x")], "measure string, model string, column string")
    want, rows = {("none", "e", "x")}, direct.collect()
    for k in range(1, 4096):
        up = {k >> i for i in range(k.bit_length())}
        want |= {(f"m{k}", *row) for node, *row in rows if node in {f"m{j}" for j in up | {7, 3, 1}}}
    got = [tuple(r) for r in lineage.leaf_sources(rests, direct).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(n for columns, n in sizes if "depth" in columns) <= len(got) + 1


def test_a_deep_search_without_chains_goes_on(spark, monkeypatch):
    made = tables_of(monkeypatch)
    pairs = [(f"{a}{i}", f"{b}{i + 1}") for i in range(24) for a in "xy" for b in "xy"]
    got = {r.node: r.depth for r in graph.distances(edges_of(spark, pairs), "x0", "downstream").collect()}
    assert got == bfs(pairs, "x0")
    assert len(made) <= 10  # seeds, moves, links and at most seven jobs of four steps
