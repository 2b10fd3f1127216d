"""Graph queries over an edge table (source, target): bounded breadth-first search and what rests on it.

A search takes several steps in one job and stores what it reached after each; nodes reached before
never enter it again, so cycles end and depths are least distances. Where a graph turns out to be deep,
its unbranched chains are contracted into single weighted steps by pointer doubling, in a number of jobs that grows with
the logarithm of their length, searched, and unfolded again. Tables between jobs lie in the shared
checkpoint folder, so a lost executor costs a reread, not a replay.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables of a search that are kept apart.
MOST_ROUNDS = 8
#: Steps that one job takes, jobs after which a graph counts as deep, and how many times as far each job of a contraction looks.
HOPS, SHALLOW_JOBS, FOLDS = 4, 2, 4


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode, where all tasks share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written into the shared folder and read back, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "downstream", max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth) with depth 0 for the seed itself; upstream walks edges backwards, both ignores their direction.

    ``seeds`` has nodes in its only column, or in its last one if its first is a label: nodes of one label are
    one seed, and depth is the least distance from any of them. Chains are not contracted where direction is ignored.
    """
    forward, back = edges.select(F.col("source").alias("a"), F.col("target").alias("b")), edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    steps = {"downstream": forward, "upstream": back, "both": forward.union(back)}[direction].where("a <> b")
    start = stored(seeds.select(F.col(seeds.columns[0]).alias("seed"), F.col(seeds.columns[-1]).alias("node")).distinct().withColumn("depth", F.lit(0)))
    moves = _moves(steps.withColumn("w", F.lit(1)), start)
    found, begun = _search(moves, start, max_depth, SHALLOW_JOBS if direction != "both" else None)
    if begun is None:
        return found
    steps = moves.where("w > 0")
    members = _chains(steps, start.select("node"))
    if members is None:
        return _search(moves, start, max_depth, begun=begun)[0]
    heads, _ = _search(_moves(_contracted(steps, members), start), start, max_depth, weighted=True)
    inside = heads.join(members.select(F.col("head").alias("node"), F.col("node").alias("member"), "place"), "node").select("seed", F.col("member").alias("node"), (F.col("depth") + F.col("place")).alias("depth"))
    return heads.unionByName(inside if max_depth is None else inside.where(F.col("depth") <= max_depth))


def _moves(steps: DataFrame, start: DataFrame) -> DataFrame:
    """Steps (a, b, w), stored, and one of weight 0 from every node to itself."""
    own = F.inline(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("b"), F.lit(0).alias("w"))))
    begin = start.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("w"))
    return stored(steps.select(own).unionByName(begin).distinct())


def _search(moves: DataFrame, start: DataFrame, max_depth: int | None, jobs: int | None = None, weighted: bool = False, begun: tuple[list[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, tuple[list[DataFrame], DataFrame] | None]:
    """What ``start`` reaches over ``moves``, and if ``jobs`` jobs have left something to do, where to go on: given as ``begun``.

    What is found so far is carried along over the moves of weight 0, while only what the last step found goes on:
    one join and one grouping a step, however many steps a job takes.
    """
    (rounds, frontier), job = begun or ([start], start), 0
    while True:
        if jobs is not None and job == jobs:
            return _all(rounds), (rounds, frontier)
        job += 1
        now = frontier.select("seed", "node", "depth", F.lit(0).alias("hop"))
        for hop in range(1, HOPS + 1):
            now = now.join(moves, (F.col("node") == F.col("a")) & ((F.col("w") == 0) | (F.col("hop") == hop - 1)))
            now = now.select("seed", F.col("b").alias("node"), (F.col("depth") + F.col("w")).alias("depth"), F.when(F.col("w") == 0, F.col("hop")).otherwise(hop).alias("hop"))
            now = now if max_depth is None else now.where(F.col("depth") <= max_depth)
            now = now.groupBy("seed", "node").agg(F.min(F.struct("depth", "hop")).alias("best")).select("seed", "node", "best.depth", "best.hop")
        now, before = now.where("hop > 0"), _all(rounds)
        if weighted:  # a way of more steps may be the shorter one
            before = before.groupBy("seed", "node").agg(F.min("depth").alias("before"))
            fresh = now.join(before, ["seed", "node"], "left").where("before IS NULL OR depth < before").drop("before")
        else:
            fresh = now.join(before, ["seed", "node"], "left_anti")
        fresh = stored(fresh)
        rounds.append(fresh.drop("hop"))
        frontier = fresh.where(F.col("hop") == HOPS)
        if frontier.isEmpty():
            return _least(rounds) if weighted else _all(rounds), None
        if len(rounds) > MOST_ROUNDS:  # keep the plans of long searches short
            rounds = [stored(_least(rounds) if weighted else _all(rounds))]


def _all(rounds: list[DataFrame]) -> DataFrame:
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def _least(rounds: list[DataFrame]) -> DataFrame:
    return _all(rounds).groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def _chains(steps: DataFrame, cut: DataFrame) -> DataFrame | None:
    """(node, head, place) of the nodes of unbranched chains after their heads, or None if there are none.

    A link is a step that is the only one from its node and the only one to the next, unless that one is in ``cut``.
    Every job looks FOLDS times as far back as the one before. What is then still open lies on a cycle of links, which no
    other step leads to or leaves; such nodes belong to no chain.
    """
    single = steps.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.first("b").alias("b")).where("n = 1").select("a", "b")
    entered = steps.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("b")
    links = single.join(entered, "b").join(cut.select(F.col("node").alias("b")).distinct(), "b", "left_anti")
    links = stored(links.select(F.col("b").alias("node"), F.col("a").alias("head"), F.lit(1).alias("place")))
    many, far = links.count(), 1
    if not many:
        return None
    while True:
        jump = links.select(F.col("node").alias("at"), F.col("head").alias("further"), F.col("place").alias("more"))
        for _ in range(FOLDS - 1):
            links = links.join(jump, F.col("head") == F.col("at"), "left")
            links = links.select("node", F.coalesce("further", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
        links = links.join(jump.select("at"), F.col("head") == F.col("at"), "left").select("node", "head", "place", F.col("at").isNotNull().alias("open"))
        links, far = stored(links), far * FOLDS
        if far > many or links.where("open").isEmpty():
            return links.where("NOT open").drop("open")
        links = links.drop("open")


def _contracted(steps: DataFrame, members: DataFrame) -> DataFrame:
    """The steps between heads of chains, with what they weigh: those from inside a chain begin at its head."""
    rest = steps.join(members.select(F.col("node").alias("b")), "b", "left_anti")
    rest = rest.join(members.select(F.col("node").alias("a"), "head", "place"), "a", "left")
    return rest.select(F.coalesce("head", "a").alias("a"), "b", (F.coalesce("place", F.lit(0)) + F.col("w")).alias("w"))


def distances(edges: DataFrame, focal: str, direction: str, max_depth: int | None = None) -> DataFrame:
    """(node, depth) from one focal node."""
    seed = edges.sparkSession.createDataFrame([(focal,)], "seed string")
    return reach(edges, seed, direction, max_depth).select("node", "depth")


def focal_subgraph(edges: DataFrame, focal: str, up: int | None = None, down: int | None = None, siblings: bool = False) -> DataFrame:
    """Edges on which the distance from the focal node grows by one, above and below; with ``siblings``, the other children of its direct parents too."""
    above, below = distances(edges, focal, "upstream", up), distances(edges, focal, "downstream", down)
    end = lambda d, c: d.select(F.col("node").alias(c), F.col("depth").alias(f"d_{c}"))
    upward = edges.join(end(above, "source"), "source").join(end(above, "target"), "target").where("d_source = d_target + 1")
    downward = edges.join(end(below, "source"), "source").join(end(below, "target"), "target").where("d_target = d_source + 1")
    kept = upward.select("source", "target").union(downward.select("source", "target"))
    if siblings:
        parents = above.where("depth = 1").select(F.col("node").alias("source"))
        kept = kept.union(edges.join(parents, "source", "left_semi").select("source", "target"))
    return kept.distinct()


def union_subgraph(edges: DataFrame, pins: DataFrame, up: int | None = None, down: int | None = None) -> DataFrame:
    """Edges between nodes that any pin reaches upstream, or between those that any reaches downstream."""
    out = None
    for direction, depth in (("upstream", up), ("downstream", down)):
        nodes = reach(edges, pins.select(F.lit("").alias("seed"), F.col(pins.columns[0]).alias("node")), direction, depth).select("node")
        part = edges.join(nodes.withColumnRenamed("node", "source"), "source", "left_semi").join(nodes.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target")
        out = part if out is None else out.union(part)
    return out.distinct()


def depth_waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, wave): a node's wave is one more than its parents' last; nodes on or behind cycles share a final wave."""
    every = stored(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct())
    steps = edges.join(every.toDF("source"), "source", "left_semi").join(every.toDF("target"), "target", "left_semi")
    moves = _own_moves(steps.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(1).alias("w")).distinct(), every)
    parents = moves.where("NOT own").groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    left = F.coalesce("n", F.lit(0))
    state = stored(every.join(parents, "node", "left").select("node", left.alias("left"), F.lit(0).alias("wave"), (left == 0).alias("ready")))
    done, state, moves, deep = _waves(state, moves, SHALLOW_JOBS)
    steps = moves.where("NOT own").select("a", "b", "w")
    members = _chains(steps, state.where("wave > 0")) if deep else None  # who has heard from a parent already is no one's only child
    if members is not None:
        heads = stored(state.join(members.select("node"), "node", "left_anti"))
        more, state, _, _ = _waves(heads, _own_moves(_contracted(steps, members), heads))
        state = _all([*more, state])
        inside = state.join(members.select(F.col("head").alias("node"), F.col("node").alias("member"), "place"), "node")
        state = state.unionByName(inside.select(F.col("member").alias("node"), "left", (F.col("wave") + F.col("place")).alias("wave"), "ready"))
    elif deep:
        more, state, _, _ = _waves(state, moves)
        done = [*done, *more]
    state = _all([*done, state])
    last = state.agg(F.coalesce(F.max(F.when(F.col("left") == 0, F.col("wave") + 1)), F.lit(0)).alias("last"))
    return state.crossJoin(F.broadcast(last)).select("node", F.when(F.col("left") == 0, F.col("wave")).otherwise(F.col("last")).alias("wave"))  # one row


def _own_moves(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Steps (a, b, w), and an own one from every node to itself, stored."""
    return stored(steps.withColumn("own", F.lit(False)).unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("w"), F.lit(True).alias("own"))))


def _waves(state: DataFrame, moves: DataFrame, jobs: int | None = None) -> tuple[list[DataFrame], DataFrame, DataFrame, bool]:
    """Nodes that are numbered and have told their children, the other nodes, the moves of these at least, and whether ``jobs`` jobs have left something to do.

    All are (node, left, wave, ready): the parents that are not numbered, one more than the last of those that are, and whether
    the node has just no parents left. Such a node tells its children; all carry what they know along over a step to themselves.
    Who has told leaves the search after the job, and its moves do as soon as half of the nodes have left, so a job costs what is still open.
    """
    done, job, held = [], 0, state.count()
    while not state.where("ready").isEmpty():
        if jobs is not None and job == jobs:
            return done, state, moves, True
        job += 1
        for _ in range(HOPS):
            told = state.join(moves, (F.col("node") == F.col("a")) & (F.col("own") | F.col("ready")))
            had = F.max(F.when(F.col("own"), F.col("left")))
            state = told.groupBy(F.col("b").alias("node")).agg(had.alias("had"), F.count_if(~F.col("own")).alias("told"), F.max(F.col("wave") + F.col("w")).alias("wave"))
            state = state.select("node", (F.col("had") - F.col("told")).alias("left"), "wave", ((F.col("told") > 0) & (F.col("had") == F.col("told"))).alias("ready"))
        state = stored(state)
        done.append(state.where("left = 0 AND NOT ready"))
        state = state.where("left > 0 OR ready")
        if len(done) > MOST_ROUNDS:  # keep the plans of long searches short
            done = [stored(_all(done))]
        many = state.count()
        if 2 * many < held:
            held, moves = many, stored(moves.join(state.select(F.col("node").alias("a")), "a", "left_semi"))
    return done, state, moves, False


def orphans(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """Nodes that no edge leaves."""
    return nodes.join(edges.select(F.col("source").alias(key)).distinct(), key, "left_anti")


def folder_of(node: DataFrame) -> Column:
    """A node's folder; sources go to sources/<source name>, nodes without a folder to _ungrouped."""
    named = F.when(F.col("resource_type") == "source", F.concat(F.lit("sources/"), F.coalesce("source_name", F.lit("unknown"))))
    return named.otherwise(F.when(F.coalesce("folder", F.lit("")) == "", F.lit("_ungrouped")).otherwise(F.col("folder")))


def folder_edges(nodes: DataFrame, edges: DataFrame, expanded: list[str] | None = None) -> DataFrame:
    """(source, target, edge_count) between folders; nodes of the ``expanded`` folders stay themselves."""
    group = folder_of(nodes)
    if expanded:
        group = F.when(group.isin(*expanded), F.col("node")).otherwise(group)
    at = nodes.select("node", group.alias("g"))
    rows = edges.join(at.toDF("source", "gs"), "source").join(at.toDF("target", "gt"), "target").where("gs <> gt")
    return rows.groupBy(F.col("gs").alias("source"), F.col("gt").alias("target")).agg(F.count_distinct("source", "target").alias("edge_count"))


def folder_nodes(nodes: DataFrame) -> DataFrame:
    """(folder, node_count, model_count)."""
    return nodes.groupBy(folder_of(nodes).alias("folder")).agg(F.count(F.lit(1)).alias("node_count"), F.count_if(F.col("resource_type") == "model").alias("model_count"))


#: Ranks of the default layers, and the ordered default rules (kind, pattern, layer).
LAYERS = {"source": 0, "staging": 1, "intermediate": 2, "mart": 3, "exposure": 4}
# Which layer a folder, prefix or suffix of a name stands for.
LAYER_RULES = [
    ("folder", "staging", "staging"), ("folder", "prep", "staging"), ("folder", "intermediate", "intermediate"), ("folder", "mart", "mart"),
    ("prefix", "stg_", "staging"), ("prefix", "int_", "intermediate"), ("prefix", "fct_", "mart"), ("prefix", "dim_", "mart"), ("prefix", "fact_", "mart"), ("prefix", "mart_", "mart"),
    ("suffix", "_prep", "staging"),
]


def layer_by_rules(rules=tuple(LAYER_RULES), layers: dict[str, float] | None = None) -> Column:
    """The layer rank by meta, then the first rule that matches, then the resource type; else null."""
    ranks = layers or LAYERS
    table = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(float(v)))])
    chosen = F.coalesce(F.try_element_at(table, F.col("meta_layer")), F.col("meta_layer").try_cast("double"))
    out = F.when(chosen.isNotNull(), chosen)
    test = {
        "folder": lambda p: F.contains(F.lower(F.coalesce("folder", F.lit(""))), F.lit(p)),
        "prefix": lambda p: F.startswith(F.lower("name"), F.lit(p)), "suffix": lambda p: F.endswith(F.lower("name"), F.lit(p)),
        "schema": lambda p: F.lower("schema") == p, "tag": lambda p: F.array_contains("tags", p), "glob": lambda p: F.col("name").rlike(glob_regex(p)),
    }
    for kind, pattern, layer in rules:
        if layer in ranks:
            out = out.when(test[kind](pattern), F.lit(float(ranks[layer])))
    out = out.when(F.col("resource_type").isin("source", "seed"), F.lit(float(ranks.get("source", 0))))
    return out.when(F.col("resource_type") == "exposure", F.lit(float(max(ranks.values()))))


def relaxed_layers(nodes: DataFrame, edges: DataFrame, layers: dict[str, float] | None = None, sweeps: int = 3) -> DataFrame:
    """(node, layer, layer_auto): unlayered nodes take the upper median of parents' + 1 and children's - 1, all at once in each sweep, then the middle rank."""
    ranks = sorted((layers or LAYERS).values())
    state = nodes.select("node", "layer", F.lit(False).alias("auto"))
    for _ in range(sweeps):
        known = state.where("layer IS NOT NULL").select("node", "layer")
        hints = edges.join(known.toDF("source", "l"), "source").select(F.col("target").alias("node"), (F.col("l") + 1).alias("h"))
        hints = hints.union(edges.join(known.toDF("target", "l"), "target").select(F.col("source").alias("node"), (F.col("l") - 1).alias("h")))
        counts = hints.groupBy("node", "h").agg(F.count(F.lit(1)).alias("n"))  # a hub has as many rows as its neighbours have layers
        upto = F.sum("n").over(Window.partitionBy("node").orderBy("h"))
        counts = counts.select("node", "h", upto.alias("upto"), F.sum("n").over(Window.partitionBy("node")).alias("total"))
        middle = counts.where("upto > floor(total / 2)").groupBy("node").agg(F.greatest(F.min("h"), F.lit(0.0)).alias("h"))
        state = stored(state.join(middle, "node", "left").select("node", F.coalesce("layer", "h").alias("layer"), (F.col("auto") | (F.col("layer").isNull() & F.col("h").isNotNull())).alias("auto")))
    last = F.lit(float(ranks[len(ranks) // 2]))
    return state.select("node", F.coalesce("layer", last).alias("layer"), (F.col("auto") | F.col("layer").isNull()).alias("layer_auto"))


def glob_regex(pattern: str) -> str:
    """A shell glob, in which * crosses slashes, as an anchored regular expression."""
    out = "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if not c.isalnum() and c not in "_[]-" else c for c in pattern)
    return f"^(?:{out})$"


def matching(term: str) -> Column:
    """Whether a node's name, folder or path matches the glob of a term, its pluses aside."""
    glob = glob_regex(term.strip("+"))
    hit = F.col("name").rlike(glob)
    for c in ("folder", "path"):
        hit = hit | F.coalesce(F.col(c).rlike(glob), F.lit(False))
    return hit


def _nearest(nodes: DataFrame, edges: DataFrame, terms: list[str], direction: str, max_depth: int | None = None) -> DataFrame | None:
    """(node, depth): least distance from any match of any of the terms, by one search; None without terms."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | matching(term)
    return reach(edges, nodes.where(hit).select(F.lit("").alias("seed"), "node"), direction, max_depth).select("node", "depth") if terms else None


def select_nodes(nodes: DataFrame, edges: DataFrame, select: str | None, exclude: str | None = None) -> DataFrame:
    """Nodes by globs on name, folder or path; ``+x`` adds what is upstream, ``x+`` downstream; exclude is taken off afterwards."""

    def chosen(expression: str) -> DataFrame:
        terms = expression.replace(",", " ").split()
        hit = F.lit(False)
        for term in terms:
            hit = hit | matching(term)
        out = nodes.where(hit).select("node")
        for direction, some in (("upstream", [t for t in terms if t.startswith("+")]), ("downstream", [t for t in terms if t.endswith("+")])):
            more = _nearest(nodes, edges, some, direction)
            out = out if more is None else out.union(more.select("node"))
        return out.distinct()

    kept = nodes if not select else nodes.join(chosen(select), "node", "left_semi")
    return kept if not exclude else kept.join(chosen(exclude), "node", "left_anti")


def lineage_subset(nodes: DataFrame, edges: DataFrame, pattern: str, max_depth: int | None = None) -> DataFrame:
    """(node, depth): what is to be traced for the terms of ``pattern``, between commas or blanks, by globs on name, folder or path.

    A term stands for its nodes and what is upstream of them; ``x+`` for them and what is downstream, ``+x+`` for both.
    Depth is the least distance from any match.
    """
    terms = pattern.replace(",", " ").split()
    up = _nearest(nodes, edges, [t for t in terms if not t.endswith("+") or t.startswith("+")], "upstream", max_depth)
    down = _nearest(nodes, edges, [t for t in terms if t.endswith("+")], "downstream", max_depth)
    parts = [p for p in (up, down) if p is not None]
    if not parts:
        return edges.sparkSession.createDataFrame([], "node string, depth int")
    return _all(parts).groupBy("node").agg(F.min("depth").alias("depth"))


def select_expression(nodes: DataFrame, expression: str) -> DataFrame:
    """(term, node) of every term of a selection and what it matches; a term without a match has a null node.

    Terms are tag:x, name globs, ids, names, and names whatever their case: of the last three the first that matches.
    A plus before or after a term is taken as read.
    """
    terms = expression.split()
    if not terms:
        return nodes.sparkSession.createDataFrame([], "term string, node string")
    rows = []
    for raw in terms:
        term = raw.removeprefix("+").removesuffix("+")
        if term.startswith("tag:"):
            hit = F.when(F.array_contains(F.transform("tags", F.lower), term[4:].lower()), 0)
        elif "*" in term:
            hit = F.when(F.lower("name").rlike(glob_regex(term.lower())), 0)
        else:
            hit = F.when(F.col("node") == term, 0).when(F.col("name") == term, 1).when(F.lower("name") == term.lower(), 2)
        rows.append(F.struct(F.lit(raw).alias("term"), hit.alias("place")))
    hits = nodes.select("node", F.inline(F.array(*rows))).where("place IS NOT NULL")
    best = hits.groupBy("term").agg(F.min("place").alias("place"))
    asked = nodes.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    return asked.join(hits.join(F.broadcast(best), ["term", "place"]).select("term", "node"), "term", "left")  # a row for each term is few


def combined_trace(*traces: DataFrame) -> DataFrame:
    """(model, columns): of several traces (model, column) the columns to highlight of every model, sorted."""
    out = traces[0].select("model", "column")
    for t in traces[1:]:
        out = out.unionByName(t.select("model", "column"))
    return out.groupBy("model").agg(F.array_sort(F.collect_set("column")).alias("columns"))


def field_path(lineage: DataFrame, model: str, field: str, max_depth: int = 6) -> DataFrame:
    """(model, column, depth) of a field's path: one step from the field to its leaves, and from these all the way upstream."""
    key = lambda m, c: F.concat(F.col(m), F.lit("\x1f"), F.lower(c))
    real = lineage.where(~F.col("transformation").isin("constant", "untraced", "unknown"))
    own = real.where((F.col("target_model") == model) & (F.lower("target_column") == field.lower()))
    leaves = own.select(F.lit("").alias("seed"), key("source_model", "source_column").alias("node")).distinct()
    rest = real.where(F.col("target_model") != model).select(key("source_model", "source_column").alias("source"), key("target_model", "target_column").alias("target"))
    above = reach(rest, leaves, "upstream", max_depth).groupBy("node").agg((F.min("depth") + 1).alias("depth"))
    at = lambda k: F.split_part("node", F.lit("\x1f"), F.lit(k))
    start = lineage.sparkSession.createDataFrame([(model, field.lower(), 0)], "model string, column string, depth int")
    return start.unionByName(above.select(at(1).alias("model"), at(2).alias("column"), "depth"))


def path_subgraph(edges: DataFrame, path: DataFrame, lineage: DataFrame) -> DataFrame:
    """(source, target): the edges between models of a path, and those that only the lineage of its columns shows."""
    models = path.select("model").distinct()
    kept = edges.join(models.toDF("source"), "source", "left_semi").join(models.toDF("target"), "target", "left_semi").select("source", "target")
    on = path.select("model", "column").distinct()
    shown = lineage.select(F.col("source_model"), F.lower("source_column").alias("source_column"), F.col("target_model"), F.lower("target_column").alias("target_column"))
    shown = shown.join(on.toDF("source_model", "source_column"), ["source_model", "source_column"], "left_semi").join(on.toDF("target_model", "target_column"), ["target_model", "target_column"], "left_semi")
    return kept.unionByName(shown.select(F.col("source_model").alias("source"), F.col("target_model").alias("target"))).where("source <> target").distinct()


def columns_mode(nodes: DataFrame, edges: DataFrame, all_nodes: DataFrame, all_edges: DataFrame, lineage: DataFrame, selected: tuple[str, str] | None = None, direction: str = "both", always: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The shown nodes and edges with what the lineage of columns adds, and of these only a field's path if one is selected.

    Nodes (node, injected): those shown, and models that columns of shown ones come from though nothing declares it. Edges
    (source, target, implied): if any model was added, all known ones between them and those that only lineage shows, else those
    shown. With ``selected`` (model, column) the models of its path, up, down or both, and of ``always`` stay, whether shown or not.
    """
    real = lineage.where(~F.col("transformation").isin("constant", "untraced") & (F.coalesce("source_model", F.lit("")) != ""))
    used = real.join(nodes.select(F.col("node").alias("target_model")), "target_model", "left_semi").select(F.col("source_model").alias("node")).distinct()
    added = stored(used.join(nodes, "node", "left_anti").join(all_nodes.select("node"), "node", "left_semi"))
    shown = nodes.select("node", F.lit(False).alias("injected")).unionByName(added.withColumn("injected", F.lit(True)))
    plain, known = edges.select("source", "target"), all_edges.select("source", "target")
    traced = real.select(F.col("source_model").alias("source"), F.col("target_model").alias("target"))
    if added.isEmpty():
        pairs = plain.withColumn("implied", F.lit(False))
    else:
        pairs = plain.unionByName(known).withColumn("implied", F.lit(False)).unionByName(traced.withColumn("implied", F.lit(True)))
    if selected is not None:
        path = None
        for way in ("upstream", "downstream"):
            if direction in (way, "both"):
                turned = lineage if way == "upstream" else lineage.select(*[F.col(f"{a}_{c}").alias(f"{b}_{c}") for a, b in (("source", "target"), ("target", "source")) for c in ("model", "column")], "transformation")
                part = field_path(turned, *selected)
                path = part if path is None else path.unionByName(part)
        path = stored(path)
        models = path.select(F.col("model").alias("node")).unionByName(path.sparkSession.createDataFrame([(x,) for x in always], "node string")).distinct()
        shown = models.join(shown, "node", "left").join(all_nodes.select("node", F.lit(True).alias("known")), "node", "left").where("known OR injected IS NOT NULL").select("node", F.coalesce("injected", F.lit(True)).alias("injected"))
        on_path = path_subgraph(known.limit(0), path, lineage)
        pairs = pairs.unionByName(known.withColumn("implied", F.lit(False))).unionByName(on_path.withColumn("implied", F.lit(True)))
    ends = stored(shown.select("node").distinct())
    pairs = pairs.where("source <> target").join(ends.toDF("source"), "source", "left_semi").join(ends.toDF("target"), "target", "left_semi")
    return shown, pairs.groupBy("source", "target").agg(F.min("implied").alias("implied"))


def chosen_by(types=None, tags=None, folders=None, layers=None) -> Column:
    """A condition for ``filter_lineage`` from a filter (mode, values) each, include or exclude; a filter without values keeps all.

    Nodes without a layer are left out by an include and kept by an exclude.
    """
    out = F.lit(True)
    tests = {"resource_type": types, "folder": folders, "layer": layers}
    for c, given in tests.items():
        if given and given[1]:
            hit = F.coalesce(F.col(c).cast("string").isin(*map(str, given[1])), F.lit(False))
            out = out & (hit if given[0] == "include" else ~hit)
    if tags and tags[1]:
        hit = F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags[1]])), F.lit(False))
        out = out & (hit if tags[0] == "include" else ~hit)
    return out


def filter_lineage(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes that ``keep`` holds for, and the edges with both ends among them."""
    kept = nodes.where(F.coalesce(keep, F.lit(False)))
    ids = kept.select("node")
    return kept, edges.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi")


def facets(nodes: DataFrame) -> DataFrame:
    """(facet, value): sorted distinct tags, folders, resource types and layers."""
    parts = [nodes.select(F.lit("tag").alias("facet"), F.explode("tags").alias("value"))]
    parts += [nodes.select(F.lit(k).alias("facet"), F.col(c).cast("string").alias("value")) for k, c in (("folder", "folder"), ("resource_type", "resource_type"), ("layer", "layer"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("coalesce(value, '') <> ''").distinct()


def columns_trace(lineage: DataFrame, model: str, column: str, direction: str = "upstream", max_depth: int = 6) -> DataFrame:
    """(model, column, depth) reached from one column over the lineage rows that carry data (no constants, no untraced ones)."""
    key = lambda m, c: F.concat(F.col(m), F.lit("\x1f"), F.lower(c))
    real = lineage.where(~F.col("transformation").isin("constant", "untraced", "unknown"))
    edges = real.select(key("source_model", "source_column").alias("source"), key("target_model", "target_column").alias("target"))
    got = distances(edges, f"{model}\x1f{column.lower()}", direction, max_depth)
    return got.select(F.split_part("node", F.lit("\x1f"), F.lit(1)).alias("model"), F.split_part("node", F.lit("\x1f"), F.lit(2)).alias("column"), "depth")
