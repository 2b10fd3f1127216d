"""Fill-in-middle: a text is cut at two places between units and its parts are put in another order.

A unit is a word with the white space before it, or the white space at the end. Both cuts are ranks of
units that are drawn from the document's number, so the number of units is needed before a place is:
a first pass over the matches only counts them, a second advances a lazy iterator of matches to the
smaller rank and on to the larger one. Neither keeps a match, so a text costs no memory but itself.
Only the three numbers leave Python; texts are put together by column functions.

Defined results: null text is empty; a null doc_id has the empty text as its number; rows that repeat
a doc_id are drawn alike; an empty text, and one that holds a mark, stays plain, as it could not be
rebuilt otherwise. Other columns of the input can have any name; an empty table stays empty.
"""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def cut(text: str, first: int, second: int, wanted: bool = True) -> tuple[int, int, int]:
    """Units of ``text`` and, if ``wanted``, the code points before the cuts that the two drawn numbers give."""
    n = sum(1 for _ in UNIT.finditer(text))
    if not wanted:
        return n, 0, 0
    low, high = sorted((first % (n + 1), second % (n + 1)))
    units = UNIT.finditer(text)
    start = next(islice(units, low - 1, None)).end() if low else 0
    stop = next(islice(units, high - low - 1, None)).end() if high > low else start
    return n, start, stop


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
def _cuts(text: pa.Array, first: pa.Array, second: pa.Array, wanted: pa.Array) -> pa.Array:
    cells = zip(text, first, second, wanted, strict=True)
    n, start, stop = zip(*(cut(t.as_py(), a.as_py(), b.as_py(), w.as_py()) for t, a, b, w in cells), strict=True) if len(text) else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["n", "start", "stop"])


def drawn(seed: int, group: int) -> Column:
    """The ``group``-th eight hex digits of the digest of seed and doc_id as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("bigint")


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the document's units, and its text as plain, psm or spm.

    ``percent`` of the texts are transformed, ``spm_percent`` of these into spm.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), *[drawn(seed, k).alias(f"h{k}") for k in (1, 2, 3, 4)])
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= percent)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(mark))
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    rows = rows.withColumn("cuts", _cuts("text", "h1", "h2", F.col("form") != "plain"))
    start, stop = F.col("cuts.start"), F.col("cuts.stop")
    prefix = F.concat(F.lit(PREFIX), F.substring("text", F.lit(1), start))
    middle = F.concat(F.lit(MIDDLE), F.substring("text", start + 1, stop - start))
    suffix = F.concat(F.lit(SUFFIX), F.substring("text", stop + 1, F.char_length("text")))
    output = F.when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).when(F.col("form") == "spm", F.concat(suffix, prefix, middle)).otherwise(F.col("text"))
    moved = F.col("form") != "plain"
    return rows.select(
        "doc_id", F.col("cuts.n").alias("n"), "form", F.when(moved, start).cast("bigint").alias("prefix_chars"), F.when(moved, stop - start).cast("bigint").alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; it holds no mark but the three, so that each splits it once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
