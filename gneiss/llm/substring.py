"""Substring deduplication: words covered by a window of words that starts earlier elsewhere go.

Texts are dealt over buckets by doc_id once (a bucketed table), so that what is found for a document
meets its text again without moving it.

1. Every partition sketches its windows. Windows hash by their anchor: the least hash among the short
   word runs that a window holds. Neighbouring windows share an anchor, so a sketch gets one count
   per anchor position, about a seventh of the windows, and a cell's count is never below the count
   of any window that hashes to it. Only "once" and "more" are told apart. A sketch is cut into blocks
   of cells, and their number is in proportion to the text, at every size.
2. The partitions' sketches are merged block by block as a grouped job. A partition sends a block the
   residues of its anchors, from which all its cells come, each with the document that asks; the answer
   is those of them whose cells are repeated in every row. An anchor that repeats within the partition
   is sent once and without documents, which have their answer there, so that no anchor is hot.
3. A second pass takes each document's windows with repeated anchors and groups these alone,
   exactly, by a 128-bit fingerprint. A partition settles its own repeats first, so that a very
   frequent window is at most one row per partition in the shuffle.
4. The starts to remove are gathered per document and applied to the text.

Defined results: null text has no words; rows with a null doc_id are kept as they are and count for
nobody; rows that share a doc_id but not the text are documents of their own, in an order that the
texts' hashes give; repeated rows are one document and judged alike; a document shorter than a window
is untouched; an empty table stays empty. Other columns can have any name.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing as H
from .common import scratch, text_key

#: Words in an anchor; sketch rows; cells of a row in a block; bytes of text for each cell.
ANCHOR, ROWS, CELLS_IN_BLOCK, BYTES_A_CELL = 8, 2, 1 << 19, 10
#: Anchors or windows that a task holds before it passes them on; bytes of text in a bucket.
HELD, BUCKET = 1 << 21, 1 << 26
#: Bits of a window's place that hold its start; those above number the texts of one doc_id.
START_BITS = 32


def bucketed(docs: DataFrame, columns: list[str]) -> DataFrame:
    """_c0, _c1, ... (``columns``), _id, _text, _nth (number of the text among those of its doc_id) and _key, in buckets by _key.

    _key is the doc_id, or a number from the text where that is null, so that rows without one are spread.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)], F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))  # Spark allows no more; buckets are larger then
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET)), most)
    name = f"gneiss_texts_{uuid.uuid4().hex}"
    place = F.dense_rank().over(Window.partitionBy("_key").orderBy(text_key("_text")))
    rows = rows.withColumn("_key", F.coalesce("_id", text_key("_text"))).repartition(buckets, "_key").withColumn("_nth", (place - 1).cast("int"))
    rows.write.bucketBy(buckets, "_key").sortBy("_key").option("compression", "zstd").option("path", f"{scratch(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay where they are and are what ``table`` reads
    return table


def _windows(data: np.ndarray, offsets: np.ndarray, size: int):
    """Word hashes, rows of the words, starts of whole windows and the anchor of every window position."""
    starts, ends, row = H.spans(data, offsets)
    words = H.word_hashes(data, starts, ends)
    whole = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :]) if len(row) >= size else np.empty(0, np.int64)
    short = min(ANCHOR, size)
    grams = H.window_hashes(words, short)
    return (starts, ends), words, row, whole, grams, H.rolling(grams, size - short + 1, np.minimum)


def _blocks(total: int) -> int:
    """Blocks of a sketch for so many bytes of text."""
    return 1 + total // (BYTES_A_CELL * CELLS_IN_BLOCK)


def _residues(anchors: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each anchor, and the 32 bits from which its cells in that block come."""
    mixed = H.mix(anchors, 0)
    return ((mixed >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32), (H.mix(anchors, 1) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _cells(residues: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (H.mix(residues.astype(np.uint64) + np.uint64(1 + row), row) & np.uint64(cells - 1)).astype(np.int64)


def _sketches(texts: DataFrame, size: int, blocks: int) -> DataFrame:
    """Per partition and block the residues met once, with their documents, and those met more often; and, under the block of
    the document, the residues of a document that are surely repeated."""
    names, types = ["block", "docs", "once", "more", "doc_id", "known"], [pa.int32(), *[pa.binary()] * 3, pa.int64(), pa.binary()]

    def packed(held: list[tuple]):
        anchors, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        block, residue = _residues(anchors, blocks)
        order = np.lexsort((doc, residue, block))
        block, residue, doc = block[order], residue[order], doc[order]
        new = np.ones(len(block), dtype=bool)
        new[1:] = (block[1:] != block[:-1]) | (residue[1:] != residue[:-1])
        alone = new & np.append(new[1:], True)
        more = new & ~alone
        rows, cuts = [], np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        for a, b in zip(cuts, cuts[1:], strict=False):
            one = alone[a:b]
            rows.append((int(block[a]), doc[a:b][one].tobytes(), residue[a:b][one].tobytes(), residue[a:b][more[a:b]].tobytes(), None, None))
        if not alone.all():
            pair = np.unique(np.stack((doc[~alone], residue[~alone].astype(np.int64))), axis=1)
            cuts = np.append(np.flatnonzero(np.diff(pair[0], prepend=pair[0][0] - 1)), pair.shape[1])
            rows += [(int(pair[0][a] % blocks), None, None, None, int(pair[0][a]), pair[1][a:b].astype(np.uint32).tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        held, count = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in H.chunks(batch.column(1)):
                _, _, row, whole, grams, least = _windows(data, offsets, size)
                if not len(whole):
                    continue
                span = len(grams) - len(least) + 1
                counted = np.zeros(len(least), dtype=np.uint64)
                counted[whole] = least[whole]
                # a position is an anchor if it is the least of any whole window around it
                padded = np.concatenate((np.zeros(span - 1, np.uint64), counted, np.zeros(span - 1, np.uint64)))
                at = np.flatnonzero(H.rolling(padded, span, np.maximum) == grams)
                held.append((grams[at], ids[lo + row[at]]))
                count += len(at)
                if count >= HELD:
                    yield packed(held)
                    held, count = [], 0
        if count:
            yield packed(held)

    rows = texts.where("_id IS NOT NULL").select("_id", "_text")
    return rows.mapInArrow(run, "block int, docs binary, once binary, more binary, doc_id bigint, known binary")


def _answered(pdf: pd.DataFrame, cells: int) -> pd.DataFrame:
    """(doc_id, residues): the merged sketch of a block asked for every residue sent once; what was known stays."""
    counts = np.zeros((ROWS, cells), dtype=np.uint8)
    sent = [(np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.uint32)) for x, y in zip(pdf["docs"], pdf["once"], strict=True) if x is not None]
    for k in range(ROWS):
        for raw, n in [*((x, 2) for x in pdf["more"] if x is not None), *((y, 1) for _, y in sent)]:
            at, times = np.unique(_cells(np.frombuffer(raw, dtype=np.uint32), k, cells), return_counts=True)
            counts[k, at] = np.minimum(counts[k, at] + n * times, 2)
    docs, residues = [], []
    for doc, residue in sent:
        repeated = np.ones(len(doc), dtype=bool)
        for k in range(ROWS):
            repeated &= counts[k, _cells(residue, k, cells)] > 1
        docs.append(doc[repeated])
        residues.append(residue[repeated])
    doc, residue = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((docs, np.int64), (residues, np.uint32)))
    order = np.argsort(doc, kind="stable")
    doc, residue = doc[order], residue[order]
    cuts = np.append(np.flatnonzero(np.diff(doc, prepend=doc[0] - 1)), len(doc)) if len(doc) else np.zeros(1, np.int64)
    got = pd.DataFrame({"doc_id": doc[cuts[:-1]] if len(doc) else doc, "residues": [residue[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]})
    known = pdf.loc[pdf["known"].notna(), ["doc_id", "known"]].rename(columns={"known": "residues"})
    return pd.concat([got, known.astype({"doc_id": "int64"})]) if len(known) else got


def repeated_anchors(texts: DataFrame, size: int) -> DataFrame:
    """doc_id and the residues of its anchors that may stand elsewhere too: a list of packed numbers."""
    total = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    cells = CELLS_IN_BLOCK
    answers = _sketches(texts, size, _blocks(total)).groupBy("block").applyInPandas(lambda pdf: _answered(pdf, cells), "doc_id bigint, residues binary")
    return answers.groupBy("doc_id").agg(F.collect_list("residues").alias("residues"))


def _settle(held: list[tuple]) -> tuple[list, list]:
    """Within a partition: the first place of each window, and per document the starts that are surely later."""
    h1, h2, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((start, doc, h2, h1))
    h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
    new = np.ones(len(h1), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
    later = (doc != doc[first]) | (start != start[first])
    at = np.lexsort((start[later], doc[later]))
    d, s = doc[later][at], start[later][at]
    cuts = np.flatnonzero(np.diff(d)) + 1
    gone = [(int(x[0]), y.astype("<i8").tobytes()) for x, y in zip(np.split(d, cuts), np.split(s, cuts), strict=True)] if len(d) else []
    return [h1[new].view(np.int64), h2[new].view(np.int64), doc[new], start[new]], gone


def later_starts(texts: DataFrame, size: int) -> DataFrame:
    """doc_id and the places (text number and start) of its windows that also start earlier: lists ``one`` (numbers) and ``many`` (packed numbers)."""
    names, types = ["h1", "h2", "doc_id", "start", "starts"], [pa.int64()] * 4 + [pa.binary()]
    blocks = _blocks(texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0)

    def batches_of(held):
        firsts, gone = _settle(held)
        n = len(firsts[0])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(firsts, types, strict=False)] + [pa.nulls(n, pa.binary())], names)
        if gone:  # settled here: passed on under a key of its own
            ids, raw = zip(*gone, strict=True)
            key = H.mix(np.array(ids, dtype=np.int64).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.int64()), pa.array(raw, pa.binary())], names)

    def run(batches):
        held, count = [], 0
        for batch in batches:
            ids, nth = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            residues = batch.column(3).to_pylist()
            for lo, hi, data, offsets in H.chunks(batch.column(1)):
                (starts, ends), words, row, whole, _, least = _windows(data, offsets, size)
                asked = [np.frombuffer(b"".join(x), dtype=np.uint32) for x in residues[lo:hi]]
                repeated = np.concatenate(asked).astype(np.uint64) | np.repeat(np.arange(hi - lo, dtype=np.uint64) << np.uint64(32), [len(x) for x in asked])
                repeated.sort()
                whole = whole[_in_sorted(_residues(least[whole], blocks)[1].astype(np.uint64) | row[whole].astype(np.uint64) << np.uint64(32), repeated)]
                if not len(whole):
                    continue
                second = H.window_hashes(H.word_hashes(data, starts, ends, 1), size, 1)[whole]
                first_word = np.searchsorted(row, np.arange(len(offsets)))
                doc = row[whole]
                place = (whole - first_word[doc]) | nth[lo + doc].astype(np.int64) << START_BITS
                held.append((H.window_hashes(words, size)[whole], second, ids[lo + doc], place))
                count += len(whole)
                if count >= HELD:
                    yield from batches_of(held)
                    held, count = [], 0
        if count:
            yield from batches_of(held)

    asked = repeated_anchors(texts, size).withColumnRenamed("doc_id", "_doc")
    rows = texts.where("_id IS NOT NULL").join(asked.hint("shuffle_hash"), F.col("_key") == F.col("_doc"))
    rows = rows.select("_id", "_text", "_nth", "residues").mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, start bigint, starts binary")
    place = F.rank().over(Window.partitionBy("h1", "h2").orderBy("doc_id", "start"))
    gone = rows.withColumn("place", place).where("starts IS NOT NULL OR place > 1")
    return gone.groupBy("doc_id").agg(F.collect_list("start").alias("one"), F.collect_list("starts").alias("many"))


def _in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x if len(table) else np.zeros(len(x), dtype=bool)


def _cut(nth: int, text: str | None, one, many, size: int) -> tuple[int, int, bytes, str | None]:
    """Words, words removed, the kept words joined by one space, and the text without the removed words."""
    words = (text or "").encode().split()
    starts = np.empty(0, np.int64)
    if one or many:
        starts = np.concatenate([np.array(one or [], dtype=np.int64), *(np.frombuffer(x, dtype="<i8") for x in many or [])])
        starts = starts[starts >> START_BITS == nth] & ((1 << START_BITS) - 1)
    if not len(starts):
        return len(words), 0, b" ".join(words), text
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    keep = np.cumsum(change[:-1]) == 0
    kept = b" ".join(compress(words, keep))
    return len(words), int(len(words) - keep.sum()), kept, kept.decode()


MADE = "n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def cut_texts(docs: DataFrame, columns: list[str], size: int) -> DataFrame:
    """_c0, _c1, ... (the columns of docs) and the columns of MADE."""
    texts = bucketed(docs, columns)
    found = later_starts(texts, size).withColumnRenamed("doc_id", "_doc")
    own, width = [f"_c{i}" for i in range(len(columns))], len(columns)
    own_id = F.col("_id").isNotNull() & (F.col("_key") == F.col("_doc"))
    rows = texts.join(found.hint("shuffle_hash"), own_id, "left").select(*own, "_nth", "_text", "one", "many")
    schema = T.StructType([*rows.select(*own).schema.fields, *T.StructType.fromDDL(MADE).fields])
    names = schema.names

    def run(batches):
        for batch in batches:
            done = [_cut(*x, size) for x in zip(*(batch.column(width + k).to_pylist() for k in range(4)), strict=True)]
            made = [
                pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()),
                pa.array([hashlib.sha256(x[2]).hexdigest() for x in done], pa.string()), pa.array([x[3] for x in done], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=names)

    return rows.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row."""
    return cut_texts(docs, ["doc_id"], size).withColumnRenamed("_c0", "doc_id")


def without_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """``docs`` (all its columns) with the kept text as text and its length as n_chars; rows of which nothing is left go."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = cut_texts(docs, others, size).where("n_words > n_removed")
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")} | {c: F.col(f"_c{i}") for i, c in enumerate(others)}
    return rows.select(*[new[c].alias(c) for c in docs.columns])
