"""Target-distribution importance resampling: documents are drawn by how much likelier their words are in the target.

Features are runs of one or two words, hashed into a fixed number of buckets. One pass over each corpus
counts the buckets in arrays of that fixed size; the log ratio of the two is a gain for each bucket, and
a document's weight is the floored mean of its features' gains, looked up in that array. Gumbel noise
from the document's number makes the highest scores a sample without replacement by weight.

Scores are whole numbers in a range that no corpus widens, so the ranks need no sort of all documents:
a histogram of the scores, summed from the top, gives the rank at which each score begins and the score
at which the draw ends; documents of that score or more are numbered by doc_id within their score. The
noise spreads documents over thousands of scores; only rows that repeat a document share its score however
many they are, so equal rows are counted first, are numbered as one, and take as many numbers as they are.

Defined results: null text has no words, weight 0 and no rank; a null doc_id has the empty text as its
number and comes before other ids; rows that repeat a doc_id are drawn each, ties of one doc_id by the
other columns. Without documents or target texts the sums are 0. Other columns of the input can have any
name; an empty table stays empty.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Features that are held before they are counted, and equal rows that are numbered at once.
RUN, COPIES = 1 << 18, 1 << 16


def features(text: bytes, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The buckets of all words and pairs of neighbouring words of a text in UTF-8, in arrays of about RUN."""
    crc, run, last = zlib.crc32, [], None
    add = run.append
    for found in WORD.finditer(text.translate(_LOWER)):
        word = found[0]
        if last is not None:
            add(crc(word, last))  # goes on where the word before and a space ended
        own = crc(word)
        add(own)
        last = crc(b" ", own)
        if len(run) >= RUN:
            yield np.array(run, dtype=np.int64) % buckets
            run.clear()
    if run:
        yield np.array(run, dtype=np.int64) % buckets


def _texts(column: pa.Array) -> Iterator[bytes]:
    for cell in column.cast(pa.large_binary()):
        yield cell.as_py() or b""


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds; every task sends one array of counts."""

    def run(batches):
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                for part in features(text, buckets):
                    counts += np.bincount(part, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of each bucket's smoothed shares in target and raw corpus, floored."""
    ratio = ((target + 1) * float(raw.sum() + len(raw))) / ((raw + 1) * float(target.sum() + len(raw)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def scored(docs: DataFrame, table: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score)."""
    buckets = len(table)

    def run(batches):
        for batch in batches:
            n, total = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
            for i, text in enumerate(_texts(batch.column(1))):
                for part in features(text, buckets):
                    n[i] += len(part)
                    total[i] += table[part].sum()
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            noise = np.floor(-1000 * np.log(-np.log((batch.column(2).to_numpy() + 0.5) / 4294967296))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(weight + noise)], ["doc_id", "n_features", "weight", "score"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").alias("h"))
    return rows.mapInArrow(run, "doc_id bigint, n_features bigint, weight bigint, score bigint")


def drawn(rows: DataFrame, eligible, percent: int = PERCENT) -> DataFrame:
    """``rows`` with their rank among the eligible ones by score, then doc_id; null beyond the draw. ``rows`` should be stored."""
    spark, rows = rows.sparkSession, rows.withColumn("_may", F.coalesce(eligible, F.lit(False)))
    found = rows.where("_may").groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row for each score; their range is bounded
    score, n = found["score"].to_numpy(), found["n"].to_numpy().astype(np.int64)
    order = np.argsort(-score)
    score, n = score[order], n[order]
    before = np.cumsum(n) - n
    draw = int(n.sum()) * percent // 100
    kept = before < draw
    cutoff = int(score[kept][-1]) if kept.any() else None
    none = F.lit(None).cast("bigint").alias("rank")
    columns = [c for c in rows.columns if c != "_may"]
    if cutoff is None:
        return rows.select(*columns, none)
    offsets = spark.createDataFrame([(int(s), int(b)) for s, b in zip(score[kept], before[kept], strict=True)], "score bigint, before bigint")
    survivor = F.col("_may") & (F.col("score") >= cutoff)
    order = [F.col("doc_id").asc_nulls_first(), *[c for c in columns if c not in ("doc_id", "score")]]
    upto = F.sum("copies").over(Window.partitionBy("score").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))  # a row_number that counts copies
    ranked = rows.where(survivor).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    ranked = ranked.withColumn("upto", F.coalesce(upto, F.lit(0))).join(F.broadcast(offsets), "score")
    ranked = ranked.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
    number = F.sequence(F.col("block") * COPIES + 1, F.least("copies", (F.col("block") + 1) * COPIES))
    ranked = ranked.withColumn("number", F.explode(number)).withColumn("place", F.col("before") + F.col("upto") + F.col("number"))
    ranked = ranked.select(*columns, F.when(F.col("place") <= draw, F.col("place")).alias("rank"))
    return ranked.unionByName(rows.where(~survivor).select(*columns, none))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``percent`` of those with ``least_words`` words have a rank."""
    table = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = stored(scored(docs, table, seed), "scores")
    return drawn(rows, F.col("n_features") >= 2 * least_words - 1, percent)  # w words have 2 w - 1 features
