"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard verification, components.

Every shingle is mapped by one permutation-like hash to a place in a universe of UNIVERSE; a second,
fixed permutation, shifted circularly by k, gives coordinate k. So all coordinates of a shingle are
one contiguous run of the permutation table, and a signature is the minimum over such runs.

1. Documents with the same shingle set (128-bit fingerprint) are one class, whose representative is
   the smallest doc_id; only representatives go on. A group of exact copies is thus one row.
2. Signatures are cut into bands. Representatives that share a band belong to one family (the
   connected components of sharing), so every pair that banding proposes lies within a family.
   Components are found by contraction: every round merges vertices into the roots of the forest of
   least neighbours and goes on with the edges between roots, of which ever fewer are left.
3. Families are verified exactly on full shingle sets: an inverted index of a family's shingles
   counts the common ones of each member with all others at once, and only links that join two
   parts are passed on. A family larger than a block (BLOCK_ROWS rows or BLOCK_SHINGLES shingles)
   is dealt into blocks, and every pair of its blocks is verified by a task of its own; no pair is
   left out, no family is capped, and no pairs are written.
4. The links' connected components are the result.

Defined results: null or wordless text has an empty set, is linked with nothing and kept; fewer
words than a shingle make the whole sequence the one shingle; a null doc_id is linked with nothing
and kept; a document is a doc_id with a text (``key``, a hash of it), so that rows that share a doc_id
but not the text are told apart, the smaller key being the earlier one, and repeated rows are one
document; an empty table stays empty. Other columns can have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import join_back, stored, text_key

UNIVERSE, COORDINATES, BANDS = 1 << 20, 128, 32
#: Rows and shingles in a block.
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 1 << 20
#: Shingles whose runs are gathered at once.
GATHERED = 1 << 13

_tables: dict[int, np.ndarray] = {}


def _runs(seed: int) -> np.ndarray:
    """Row v holds coordinates 0..K-1 of place v: overlapping views of one shifted permutation."""
    if seed not in _tables:
        once = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.uint32)
        _tables[seed] = np.lib.stride_tricks.sliding_window_view(np.concatenate((once, once[: COORDINATES - 1])), COORDINATES)
    return _tables[seed]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (row, shingle hash) of the distinct shingles of every row of a lower-cased chunk."""
    starts, ends, row = H.spans(data, offsets)
    words = H.word_hashes(data, starts, ends)
    found = H.window_hashes(words, size)
    whole = row[: len(found)] == row[size - 1 :] if len(found) else np.empty(0, bool)
    rows, hashes = row[: len(found)][whole], found[whole]
    count = np.bincount(row, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1, np.int64)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        first = np.searchsorted(row, few)
        whole_text = [H.window_hashes(words[a : a + n], int(n), 1)[0] ^ np.uint64(n) for a, n in zip(first, count[few], strict=True)]
        rows, hashes = np.concatenate((rows, few)), np.concatenate((hashes, np.array(whole_text, dtype=np.uint64)))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def signatures(rows: np.ndarray, hashes: np.ndarray, count: int, seed: int) -> np.ndarray:
    """The circulant MinHash signature of each of ``count`` rows (all ones for an empty set)."""
    runs, place = _runs(seed), (H.mix(hashes, 1) & np.uint64(UNIVERSE - 1)).astype(np.int64)
    out = np.full((count, COORDINATES), UNIVERSE, dtype=np.uint32)
    for at in range(0, len(rows), GATHERED):
        part = rows[at : at + GATHERED]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1))
        owner = part[cuts]
        out[owner] = np.minimum(out[owner], np.minimum.reduceat(runs[place[at : at + GATHERED]], cuts, axis=0))
    return out


def signed(docs: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """doc_id, key, n (shingles), the set's fingerprint (s1, s2) and its band hashes."""
    each = COORDINATES // BANDS
    weights = H.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in H.chunks(batch.column(1), lower=True):
                rows, hashes = shingle_sets(data, offsets, size)
                n = np.bincount(rows, minlength=hi - lo).astype(np.int64)
                sums = np.zeros((2, hi - lo), dtype=np.uint64)
                if len(rows):
                    cuts = np.concatenate(([0], np.flatnonzero(np.diff(rows)) + 1))
                    for k in (0, 1):
                        sums[k, rows[cuts]] = np.add.reduceat(H.mix(hashes, k), cuts)
                bands = (signatures(rows, hashes, hi - lo, seed).astype(np.uint64) * weights).reshape(hi - lo, BANDS, each).sum(axis=2, dtype=np.uint64)
                bands = H.mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                columns = [*(batch.column(c).slice(lo, hi - lo) for c in (0, 2)), pa.array(n), *(pa.array(s.view(np.int64)) for s in sums), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "s1", "s2", "bands"])

    schema = "doc_id bigint, key bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key("text").alias("key")).mapInArrow(run, schema)


def shingled(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` (text, d, k and other columns of numbers) with the text's distinct shingle hashes in place of the text.

    Rows are taken once for each d and k that a task meets.
    """
    others = [f"{c} {kind}" for c, kind in docs.dtypes if c != "text"]
    names = [c.split()[0] for c in others]

    def run(batches):
        met: set[tuple] = set()
        for batch in batches:
            new = []
            for x in zip(batch.column("d").to_pylist(), batch.column("k").to_pylist(), strict=True):
                new.append(x not in met)
                met.add(x)
            batch = batch.filter(pa.array(new, pa.bool_()))
            for lo, hi, data, offsets in H.chunks(batch.column("text"), lower=True):
                rows, hashes = shingle_sets(data, offsets, size)
                cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
                raw = pa.array([hashes[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names), raw], [*names, "shingles"])

    return docs.mapInArrow(run, ", ".join([*others, "shingles binary"]))


def joined(side: np.ndarray | None, sets: list[np.ndarray], percent: int):
    """Links (x, y), as places in ``sets``, that join parts of a block (side None) or of two (only pairs across sides), by an inverted index."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(shingle, kind="stable")
    postings, first = owner[order], np.searchsorted(shingle[order], np.arange(shingle.max() + 2))
    begin = np.cumsum(size) - size
    root = np.arange(len(sets))
    for y in range(1, len(sets)):
        own = shingle[begin[y] : begin[y] + size[y]]
        times = first[own + 1] - first[own]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        both = np.bincount(postings[np.repeat(first[own], times) + inner], minlength=y)[:y]
        near = np.flatnonzero((both > 0) & (100 * both >= percent * (size[:y] + size[y] - both)))
        if side is not None:
            near = near[side[near] != side[y]]
        for r, x in zip(*np.unique(root[near], return_index=True), strict=True):
            if r != root[y]:
                yield int(near[x]), y
                root[root == r] = root[y]


def _families(batches):
    """Runs of equal (fd, fk, i, j) in batches sorted by them; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    keys = ("fd", "fk", "i", "j")

    def split(last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(max(0, table.num_rows - 1), dtype=bool)
        for k in keys:
            column = table[k].to_numpy()
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), *([table.num_rows] if last else [])]
        held[:] = [] if last else table.slice(cuts[-1]).combine_chunks().to_batches()
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, b - a)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            yield from split(False)
    if held:
        yield from split(True)


def verified(families: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join the members of each family (rep, family, blocks) wherever their full sets reach the threshold."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("d"), text_key("text").alias("k"), F.col("text").cast("string").alias("text"))
    parts = families.select("rep.d", "rep.k", F.col("family.d").alias("fd"), F.col("family.k").alias("fk"), "blocks")
    rows = shingled(texts.join(parts.hint("shuffle_hash"), ["d", "k"]), size)
    own = F.pmod(F.xxhash64("d", "k"), F.col("blocks"))
    rows = rows.select("fd", "fk", "d", "k", "shingles", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("fd", "fk", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "d", "k", "own", "shingles")
    names = ["ad", "ak", "bd", "bk"]

    def run(batches):
        out = []
        for group in _families(batches):
            if group.num_rows > 1:
                sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group["shingles"]]
                across = group["i"][0].as_py() != group["j"][0].as_py()
                d, k = group["d"].to_numpy(), group["k"].to_numpy()
                out += [(d[x], k[x], d[y], k[y]) for x, y in joined(group["own"].to_numpy() if across else None, sets, percent)]
            if len(out) > 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    keys = ["fd", "fk", "i", "j"]
    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join(f"{x} bigint" for x in names))
    return found.select(vertex("ad", "ak").alias("a"), vertex("bd", "bk").alias("b"))


def vertex(d: str, k: str) -> Column:
    return F.struct(F.col(d).alias("d"), F.col(k).alias("k"))


def between(edges: DataFrame) -> DataFrame:
    """The edges (a, b) once each, from the smaller end to the larger, without loops; stored."""
    return stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex that reaches a smaller one, the smallest being its label.

    A round merges each vertex into the root of its tree in the forest of least neighbours. Of the
    vertices at least half go with every round, and only edges between different roots stay.
    """
    edges, merged = between(edges), []
    while not edges.isEmpty():
        # the larger end of an edge has a smaller neighbour; the smaller end may have one by other edges
        moved = stored(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), "moved")
        while True:
            above = moved.select(F.col("v").alias("p"), F.col("p").alias("q"))
            if moved.join(above, "p", "left_semi").isEmpty():
                break
            moved = stored(moved.join(above, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "moved")
        merged.append(moved)
        for end in ("a", "b"):
            edges = edges.join(moved.withColumnRenamed("v", end), end, "left").withColumn(end, F.coalesce("p", end)).drop("p")
        edges = between(edges)
    if not merged:
        return edges.toDF("v", "label")
    labels = merged.pop().withColumnRenamed("p", "label")
    for moved in reversed(merged):
        onward = labels.select(F.col("v").alias("p"), "label")
        labels = moved.join(onward, "p", "left").select("v", F.coalesce("label", "p").alias("label")).unionByName(labels)
    return stored(labels, "labels")


def link(classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Components (v, label) of the representatives in ``classes`` (rep, n, bands) that reach a smaller one."""
    total = classes.count()
    members = classes.select("rep", "n", F.explode("bands").alias("key"))
    buckets = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("hub")).where("c > 1"), "buckets")
    # a bucket's hub is its least member; of a representative's hubs the least stands for it, and the others are linked with that one
    hubs = join_back(members, buckets, ["key"], "c", total).groupBy("rep", "n").agg(F.collect_set("hub").alias("hubs"))
    hubs = stored(hubs.select("rep", "n", F.array_min("hubs").alias("m"), "hubs"), "hubs")
    labels = components(hubs.select(F.col("m").alias("a"), F.explode("hubs").alias("b")))
    named = hubs.groupBy("m").agg(F.count(F.lit(1)).alias("c")).join(labels.withColumnRenamed("v", "m"), "m", "left")
    named = stored(named.select("m", "c", F.coalesce("label", "m").alias("family")), "named")
    family = stored(join_back(hubs.select("rep", "n", "m"), named, ["m"], "c", total).select("rep", "n", "family"), "family")
    weight = family.groupBy("family").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK_ROWS, F.col("s") / BLOCK_SHINGLES)).alias("blocks")
    weight = stored(weight.select("family", "c", blocks), "families")
    families = join_back(family.select("rep", "family"), weight, ["family"], "c", total).select("rep", "family", "blocks")
    return components(verified(families, docs, size, percent))


def decisions(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n_shingles and first, the first document (d, k) reachable (null: none)."""
    all_rows = stored(signed(docs, size), "signatures")
    rows = all_rows.where("doc_id IS NOT NULL AND n > 0").withColumn("v", vertex("doc_id", "key"))
    classes = rows.groupBy("s1", "s2", "n").agg(F.min("v").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")
    labels = link(classes.select("rep", "n", "bands"), docs, size, percent)
    labelled = classes.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("s1", "s2", "n", "copies", F.coalesce("label", "rep").alias("first"))
    many = stored(labelled, "labelled")
    done = join_back(rows.drop("bands", "v"), many, ["s1", "s2", "n"], "copies", all_rows.count()).select("doc_id", "key", "n", "first")
    alone = all_rows.where("doc_id IS NULL OR n = 0").select("doc_id", "key", "n", F.when(F.col("doc_id").isNotNull(), vertex("doc_id", "key")).alias("first"))
    return done.unionByName(alone).withColumnRenamed("n", "n_shingles")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (is that document)."""
    component = F.col("first.d")
    return decisions(docs, size, percent).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` (all its columns) with one row for each group of near-duplicates: its first document, and of repeated rows one.

    Rows without doc_id are all kept. Which of the rows that share doc_id and text stays is settled by the other columns.
    """
    is_first = vertex("doc_id", "key").eqNullSafe(F.col("first")) | F.col("doc_id").isNull()
    known = decisions(docs, size, percent).where("doc_id IS NOT NULL").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("c"), F.bool_and(is_first).alias("stays"))
    known = stored(known, "decided")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), text_key("text").alias("k"))
    names = known.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "c", "stays")
    once = own.join(names.where("c > 1 OR NOT stays"), ["d", "k"], "left_anti").select("row.*")
    again = own.join(names.where("c > 1 AND stays"), ["d", "k"]).groupBy("d", "k").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return once.unionByName(again)
