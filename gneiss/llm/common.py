"""Shared pieces: tables in the cluster's shared folder, word splitting, joins that a hot group can't skew."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java regex class; words are maximal runs of anything else.
SPACE = r"[\x20\x09-\x0D]"


def scratch(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``; a temporary one only in local mode, where all tasks share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the maximal runs of non-ASCII-white-space characters; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def text_key(text: str) -> Column:
    """A number that tells texts of one doc_id apart; null and empty are the same text."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


#: A group with one of so many rows or more is hot; there can be no more hot groups than this times the groups that a row is in.
HOT_PART = 1000


def join_back(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """``rows`` inner-joined to one row per group, whose number of rows is in column ``size``.

    Groups of at least a thousandth of ``total`` are few by that bound and are broadcast, so that
    their rows stay where they are; the others are joined by a shuffle that no such group can skew.
    ``groups`` should be stored, as it is read three times.
    """
    is_hot = F.col(size) * HOT_PART >= total
    hot = F.broadcast(groups.where(is_hot))
    common = rows.join(F.broadcast(groups.where(is_hot).select(*key)), key, "left_anti")
    return rows.join(hot, key).unionByName(common.join(groups.where(~is_hot), key))
