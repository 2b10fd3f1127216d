"""Prediction by partial matching: a byte-context trie, pretrained on a corpus, codes every document.

Training counts, over all training texts, each byte with the ORDER bytes before it (a document is
preceded by ORDER start marks and followed by an end mark). The counts are summed by a grouped job;
shorter contexts are sums of longer ones, so a symbol seen in a context is seen in all its suffixes.
That nesting makes symbol exclusion exact with one number per context: what its symbols count for in
the next shorter context. Escapes are estimated by the number of distinct symbols (method C), and
after the shortest context the symbols not yet excluded are equally likely.

The trie keeps every node, however many there are: it is a table for each order. A gram that was seen
in training is coded in its longest context, which prices it once for all (``model``). Prices of
grams that are one in MAX_GRAMS of the corpus or more (so there are no more than MAX_GRAMS of them),
and counts of words that are one in MAX_HEAD of it or more, are broadcast; the other grams and words of
a document are joined to theirs by a shuffle, so results don't depend on these two numbers. Grams that
training didn't see go down the orders by joins with the contexts; of these the orders up to LOW, at
most 256 ** (LOW + 1) nodes whatever the corpus, are broadcast.

Defined results: null text is the end mark alone; a null doc_id has the empty text as its number and
trains; repeated rows train and are scored each; without training rows every symbol is uniform and
the base is log10((0 + 0.5) / (0 + 0.5)). Words are told apart by 64-bit hashes. Other columns of
the input can have any name; an empty table stays empty.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing as H
from .common import stored

ORDER = 5
MARK, SYMBOLS = 255, 256
LOW, MAX_GRAMS, MAX_HEAD = 2, 1 << 22, 1 << 21
#: Counted words or grams that a training task holds before it passes them on.
HELD = 1 << 21
_END = np.uint64(0x243F6A8885A308D3)


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def gram_keys(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end mark of every row its context and itself as one number; and the rows' first positions."""
    sizes, rows = np.diff(offsets), len(offsets) - 1
    padded = np.full(len(data) + rows * (order + 1), MARK, dtype=np.uint8)
    first = offsets[:-1] + np.arange(1, rows + 1) * order + np.arange(rows)
    padded[np.arange(len(data)) + np.repeat(first - offsets[:-1], sizes)] = data
    target = np.ones(len(padded), dtype=bool)
    target[(first[:, None] - np.arange(1, order + 1)).ravel()] = False
    key = np.zeros(len(padded) - order, dtype=np.uint64)
    for j in range(order + 1):
        key = (key << np.uint64(8)) | padded[j : len(padded) - order + j]
    return key[target[order:]], offsets[:-1] + np.arange(rows)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=n).astype(np.int64)


def corpus_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(is_gram, key, n): words and grams of the training documents with their counts, stored."""

    def run(batches):
        held: tuple[list, list] = ([], [])

        def passed(kind):
            keys, n = _merged(held[kind])
            held[kind].clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), bool(kind))), pa.array(keys.view(np.int64)), pa.array(n)], ["is_gram", "key", "n"])

        for batch in batches:
            train = pa.array([not is_held_out(x) for x in batch.column(0).to_pylist()], pa.bool_())
            batch = batch.filter(train)
            for lo, hi, data, offsets in H.chunks(batch.column(1), lower=True):
                starts, ends, _ = H.spans(data, offsets)
                found, n = np.unique(H.word_hashes(data, starts, ends), return_counts=True)
                held[0].append((np.append(found, _END), np.append(n, hi - lo)))
                held[1].append(np.unique(gram_keys(data, offsets, order)[0], return_counts=True))
                for kind in (0, 1):
                    if sum(len(x[0]) for x in held[kind]) >= HELD:
                        yield passed(kind)
        for kind in (0, 1):
            if held[kind]:
                yield passed(kind)

    rows = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "is_gram boolean, key bigint, n bigint")
    return stored(rows.groupBy("is_gram", "key").agg(F.sum("n").alias("n")), "counts")


def _arrays(table: DataFrame, value: str = "n") -> tuple[np.ndarray, np.ndarray]:
    """A bounded (key, value) table as arrays sorted by key."""
    got = table.select("key", value).toArrow()
    key, n = got["key"].to_numpy().astype(np.int64).view(np.uint64), got[value].to_numpy().astype(np.float64)
    order = np.argsort(key)
    return key[order], n[order]


def _lookup(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in a sorted table, and for those that are, where."""
    if not len(table):
        return np.zeros(len(keys), dtype=bool), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    here = table[at] == keys
    return here, at[here]


class Trie:
    """Sorted gram and context tables of the orders from 0 up, ready for vector lookups."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.keys, self.n = [k for k, _ in levels], [n for _, n in levels]
        self.contexts, self.total, self.distinct, self.excluded = [], [], [], []
        for d, (key, n) in enumerate(levels):
            context, at = np.unique(key >> np.uint64(8), return_inverse=True)
            self.contexts.append(context)
            self.total.append(np.bincount(at, weights=n, minlength=len(context)))
            self.distinct.append(np.bincount(at, minlength=len(context)).astype(np.float64))
            if d:
                shorter = np.searchsorted(self.keys[d - 1], key & np.uint64((1 << 8 * d) - 1))
                self.excluded.append(np.bincount(at, weights=self.n[d - 1][shorter], minlength=len(context)))
            else:
                self.excluded.append(np.zeros(len(context)))

    def log10(self, keys: np.ndarray, gone_n: np.ndarray | None = None, gone_q: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each gram's last byte after the bytes before it.

        gone_n, gone_q: symbols that longer contexts have excluded, as their counts here and their number.
        """
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        gone_n, gone_q = (np.zeros(len(keys)) if x is None else x.astype(np.float64) for x in (gone_n, gone_q))
        for d in range(len(self.keys) - 1, -1, -1):
            if not len(self.keys[d]):
                continue
            key = keys[todo] & np.uint64((1 << 8 * (d + 1)) - 1)
            at = np.minimum(np.searchsorted(self.contexts[d], key >> np.uint64(8)), len(self.contexts[d]) - 1)
            known = self.contexts[d][at] == key >> np.uint64(8)
            symbol = np.minimum(np.searchsorted(self.keys[d], key), len(self.keys[d]) - 1)
            hit = self.keys[d][symbol] == key
            rest, fresh = self.total[d][at] - gone_n[todo], self.distinct[d][at] - gone_q[todo]
            out[todo[hit]] += np.log10(self.n[d][symbol[hit]] / (rest[hit] + fresh[hit]))
            escape = known & ~hit
            paid = escape & (fresh > 0)
            out[todo[paid]] += np.log10(fresh[paid] / (rest[paid] + fresh[paid]))
            gone_n[todo[escape]], gone_q[todo[escape]] = self.excluded[d][at[escape]], self.distinct[d][at[escape]]
            todo = todo[~hit]
        out[todo] -= np.log10(np.maximum(SYMBOLS - gone_q[todo], 1))
        return out


def orders(grams: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """(key, n) tables of the trie's nodes for the orders 0 to ``order``, from a stored one of the longest grams."""
    levels = [grams.select("key", "n")]
    for d in range(order, 0, -1):
        shorter = levels[0].groupBy(F.col("key").bitwiseAND((1 << 8 * d) - 1).alias("key")).agg(F.sum("n").alias("n"))
        levels.insert(0, stored(shorter, f"grams-{d}"))
    return levels


def model(grams: DataFrame) -> DataFrame:
    """(key, n, price): every gram seen with the log10 probability of its last byte; a window holds 256 rows at most."""
    context = Window.partitionBy(F.shiftright("key", 8))
    room = F.sum("n").over(context) + F.count(F.lit(1)).over(context)
    return stored(grams.select("key", "n", F.log10(F.col("n") / room).alias("price")), "model")


def contexts(level: DataFrame, shorter: DataFrame, d: int) -> DataFrame:
    """One row per context of d bytes: total, distinct, excluded (as in Trie), and its symbols with their counts."""
    below = shorter.select(F.col("key").alias("short"), F.col("n").alias("m"))
    nodes = level.withColumn("short", F.col("key").bitwiseAND((1 << 8 * d) - 1)).join(below, "short")
    return nodes.groupBy(F.shiftright("key", 8).alias("context")).agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("distinct"),
        F.sum("m").alias("excluded"),
        F.map_from_entries(F.collect_list(F.struct(F.col("key").bitwiseAND(255), "n"))).alias("counts"),
    )


def unseen_prices(keys: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(key, price) of distinct grams that training didn't see: escapes down the orders until one knows the byte."""
    zero = F.lit(0).cast("long")
    rows = keys.select("key", F.lit(0.0).alias("price"), zero.alias("gone_n"), zero.alias("gone_q"), F.lit(False).alias("done"))
    for d in range(len(levels) - 1, LOW, -1):
        context = F.shiftright(F.col("key").bitwiseAND((1 << 8 * (d + 1)) - 1), 8)
        rows = rows.withColumn("context", context).join(contexts(levels[d], levels[d - 1], d), "context", "left")
        n = F.try_element_at("counts", F.col("key").bitwiseAND(255))
        rest, fresh = F.col("total") - F.col("gone_n"), F.col("distinct") - F.col("gone_q")
        hit, missed = ~F.col("done") & n.isNotNull(), ~F.col("done") & F.col("total").isNotNull() & n.isNull()
        paid = F.when(hit, F.log10(n / (rest + fresh))).when(missed & (fresh > 0), F.log10(fresh / (rest + fresh))).otherwise(0.0)
        rows = rows.select(
            "key",
            (F.col("price") + paid).alias("price"),
            F.when(missed, F.col("excluded")).otherwise(F.col("gone_n")).alias("gone_n"),
            F.when(missed, F.col("distinct")).otherwise(F.col("gone_q")).alias("gone_q"),
            (F.col("done") | hit).alias("done"),
        )
    shared = keys.sparkSession.sparkContext.broadcast(Trie([_arrays(x) for x in levels[: LOW + 1]]))

    def run(batches):
        for batch in batches:
            key, price, gone_n, gone_q, done = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            todo, price = ~done.astype(bool), price.copy()
            price[todo] += shared.value.log10(key[todo].astype(np.int64).view(np.uint64), gone_n[todo], gone_q[todo])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(price)], ["key", "price"])

    return stored(rows.mapInArrow(run, "key bigint, price double"), "unseen")


def _by_row(rows: np.ndarray, n_rows: int, *values: np.ndarray) -> list[pa.Array]:
    """Values as lists, one for each row."""
    order = np.argsort(rows, kind="stable")
    cuts = pa.array(np.searchsorted(rows[order], np.arange(n_rows + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(cuts, pa.array(x[order])) for x in values]


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    counts = corpus_counts(docs, order)
    vocabulary, grams = (counts.where(x).select("key", "n") for x in ("not is_gram", "is_gram"))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    seen = model(grams)
    positions = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent_word, frequent_gram = F.col("n") * MAX_HEAD >= int(total), F.col("n") * MAX_GRAMS >= positions
    shared = spark.sparkContext.broadcast((_arrays(vocabulary.where(frequent_word)), _arrays(seen.where(frequent_gram), "price")))
    room = total + 0.5 * (distinct + 1)
    unknown = float(np.log10(0.5 / room))
    schema = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, tail array<bigint>, score double, grams array<bigint>, times array<bigint>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        (head, times), (frequent, price) = shared.value
        worth, row_id = np.log10((times + 0.5) / room), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in H.chunks(batch.column(1), lower=True):
                n_rows, own = hi - lo, ids[lo:hi]
                starts, ends, row = H.spans(data, offsets)
                words, rows = np.append(H.word_hashes(data, starts, ends), np.full(n_rows, _END)), np.append(row, np.arange(n_rows))
                here, at = _lookup(words, head)
                base = np.bincount(rows[here], weights=worth[at], minlength=n_rows).astype(np.float64)
                keys, first = gram_keys(data, offsets, order)
                found, back = np.unique(keys, return_inverse=True)
                known, at = _lookup(found, frequent)
                prices = np.zeros(len(found))
                prices[known] = price[at]
                rare = np.flatnonzero(~known[back])  # counted once for each row and gram
                pairs, n = np.unique((np.searchsorted(first, rare, side="right") - 1) * len(found) + back[rare], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row_id, row_id + n_rows)), pa.array(own, pa.int64()), pa.array([is_held_out(x) for x in own], pa.bool_()),
                        pa.array(np.bincount(rows, minlength=n_rows)), pa.array(np.bincount(rows[here], minlength=n_rows)), pa.array(base),
                        *_by_row(rows[~here], n_rows, words[~here].view(np.int64)), pa.array(np.add.reduceat(prices[back], first)),
                        *_by_row(pairs // len(found), n_rows, found[pairs % len(found)].view(np.int64), n.astype(np.int64)),
                    ],
                    names,
                )
                row_id += n_rows

    rows = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema), "scored")
    tail = rows.select("row", F.explode("tail").alias("key")).join(vocabulary.where(~frequent_word), "key")
    tail = tail.groupBy("row").agg(F.count(F.lit(1)).alias("m"), F.sum(F.log10((F.col("n") + 0.5) / room)).alias("s"))
    rest = rows.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", F.col("g.grams").alias("key"), F.col("g.times").alias("times"))
    rare = seen.where(~frequent_gram).select("key", "price")
    unseen = unseen_prices(rest.select("key").distinct().join(rare, "key", "left_anti"), orders(grams, order))
    rest = rest.join(rare.unionByName(unseen), "key").groupBy("row").agg(F.sum(F.col("times") * F.col("price")).alias("more"))
    out = rows.withColumn("t", F.size("tail")).drop("tail", "grams", "times").join(tail, "row", "left").join(rest, "row", "left")
    m = F.coalesce("m", F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + m).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("s", F.lit(0.0)) + (F.col("t") - m) * unknown).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
