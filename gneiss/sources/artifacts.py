"""Project artifacts (manifest, catalog, run results, source freshness) as DataFrames with fixed schemas.

The manifest is required and its faults are told by file, line and column; the others are optional
and give empty tables of the same schema when missing or damaged. Artifacts are read as text through
Spark, so they can lie in any store that Spark reads. A task takes a file apart as it streams by, in
pieces that end with a closing brace: it holds one entry of a section at a time, however long the file
is, and no more than a fault's place reaches the driver. The entries lie in a table in the shared folder.
"""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import stored

log = logging.getLogger(__name__)

NODE = """unique_id STRING, name STRING, resource_type STRING, package_name STRING, original_file_path STRING, database STRING, schema STRING, description STRING, raw_code STRING, compiled_code STRING,
  relation_name STRING, tags ARRAY<STRING>, column_name STRING, depends_on STRUCT<nodes: ARRAY<STRING>>, config STRUCT<materialized: STRING, severity: STRING>, meta STRING,
  columns MAP<STRING, STRUCT<name: STRING, description: STRING, data_type: STRING>>, test_metadata STRUCT<name: STRING, namespace: STRING, kwargs: MAP<STRING, STRING>>"""
SOURCE = """unique_id STRING, name STRING, source_name STRING, package_name STRING, database STRING, schema STRING, description STRING, loader STRING, loaded_at_field STRING, tags ARRAY<STRING>, meta STRING,
  columns MAP<STRING, STRUCT<name: STRING, description: STRING, data_type: STRING>>"""
EXPOSURE = "unique_id STRING, name STRING, type STRING, description STRING, url STRING, label STRING, maturity STRING, depends_on STRUCT<nodes: ARRAY<STRING>>, owner STRUCT<name: STRING, email: STRING>, tags ARRAY<STRING>, meta STRING"
METRIC = "unique_id STRING, name STRING, description STRING, label STRING, type STRING, depends_on STRUCT<nodes: ARRAY<STRING>>, tags ARRAY<STRING>"
CATALOG = """unique_id STRING, metadata STRUCT<type: STRING, schema: STRING, name: STRING, database: STRING, comment: STRING, owner: STRING>, columns MAP<STRING, STRUCT<name: STRING, type: STRING, index: INT, comment: STRING>>,
  stats MAP<STRING, STRUCT<id: STRING, value: STRING, include: BOOLEAN>>"""
RESULT = "unique_id STRING, status STRING, execution_time DOUBLE, failures BIGINT, message STRING, compiled_code STRING, timing ARRAY<STRUCT<name: STRING, started_at: STRING, completed_at: STRING>>"
FRESHNESS = "unique_id STRING, status STRING, max_loaded_at STRING, snapshotted_at STRING"


class ArtifactError(ValueError):
    """A required artifact is missing or is no JSON object."""


#: What a piece ends with, and what matters outside and inside of texts.
END = "}"
_MARK = re.compile(r'["{}\[\],:]')
_IN_TEXT = re.compile(r'["\\]')


class Splitter:
    """Takes an object of sections apart, piece by piece: (section, key, position, value) of each entry of an object or list, and of any other section.

    Only the marks are looked at; the value of an entry is checked as a whole by the JSON reader, when its end is seen.
    """

    def __init__(self) -> None:
        self.depth, self.in_text, self.began = 0, False, False
        self.held, self.seen, self.lines, self.width = "", 0, 1, 0  # what is not passed on yet, how much of it was looked at, and where it begins
        self.section: str | None = None
        self.key: str | None = None
        self.mark, self.position, self.closed = "", 0, False

    def fault(self, at: int, message: str) -> ValueError:
        before = self.held[:at]
        line = self.lines + before.count("\n")
        column = at - before.rfind("\n") if "\n" in before else self.width + at + 1
        return ValueError(f"line {line}, column {column}: {message}")

    def _drop(self, upto: int) -> None:
        gone, self.held = self.held[:upto], self.held[upto:]
        self.lines += gone.count("\n")
        self.width = len(gone) - gone.rfind("\n") - 1 if "\n" in gone else self.width + len(gone)
        self.seen -= upto

    def _value(self, upto: int, what: str = "value") -> str:
        """The text before ``upto`` as a checked value; it is dropped with the mark after it."""
        text = self.held[:upto]
        try:
            json.loads(text)
        except json.JSONDecodeError as e:
            raise self.fault(e.pos, e.msg if text.strip() else f"Expecting {what}") from None
        self._drop(upto + 1)
        return text.strip()

    def feed(self, piece: str) -> Iterator[tuple[str, str | None, int, str]]:
        self.held += piece
        while True:
            found = (_IN_TEXT if self.in_text else _MARK).search(self.held, self.seen)
            if not found:
                self.seen = len(self.held)
                return
            at, mark = found.start(), found[0]
            if mark == "\\":
                if at + 1 == len(self.held):
                    self.seen = at
                    return
                self.seen = at + 2
                continue
            self.seen = at + 1
            if mark == '"':
                self.in_text = not self.in_text
                continue
            yield from self._take(mark, at)

    def _take(self, mark: str, at: int) -> Iterator[tuple[str, str | None, int, str]]:
        inner = self.depth == 2 and self.mark in "{[" and self.section is not None
        if not self.began:
            if mark != "{" or self.held[:at].strip():
                raise self.fault(len(self.held) - len(self.held.lstrip()), "an object is expected")
            self.began, self.depth = True, 1
            self._drop(at + 1)
        elif self.closed:
            raise self.fault(at, "Extra data")
        elif self.depth == 1:
            if mark == ":" and self.section is None:
                self.section, self.mark = json.loads(self._value(at, "property name enclosed in double quotes")), ""
            elif mark in "{[" and self.section is not None and not self.held[:at].strip():
                self.depth, self.mark, self.position, self.key = 2, mark, 0, None
                self._drop(at + 1)
            elif mark in ",}":
                if self.section is not None and not self.mark:
                    yield self.section, None, 0, self._value(at)
                elif self.held[:at].strip() or (mark == "," and self.section is None):
                    raise self.fault(at, "Expecting ',' delimiter")
                else:
                    self._drop(at + 1)
                self.section, self.mark, self.closed = None, "", mark == "}"
            else:
                raise self.fault(at, "Expecting value")
        elif inner and self.mark == "{" and mark == ":" and self.key is None:
            self.key = json.loads(self._value(at, "property name enclosed in double quotes"))
        elif inner and mark in ",}]":
            if mark != "," and mark != {"{": "}", "[": "]"}[self.mark]:
                raise self.fault(at, "Expecting value")
            if self.held[:at].strip() or self.key is not None:
                if self.mark == "{" and self.key is None:
                    raise self.fault(at, "Expecting ':' delimiter")
                yield self.section, self.key, self.position, self._value(at)
                self.position += 1
            elif mark == "," or self.position:
                raise self.fault(at, "Expecting value")
            else:
                self._drop(at + 1)
            self.key = None
            if mark != ",":
                self.depth = 1
        elif mark in "{[":
            self.depth += 1
        elif mark in "}]":
            self.depth -= 1

    def finish(self) -> None:
        if not self.began:
            raise self.fault(len(self.held), "an object is expected" if self.held.strip() else "Expecting value")
        if not self.closed or self.in_text:
            raise self.fault(len(self.held), "unexpected end of file")
        if self.held.strip():
            raise self.fault(len(self.held) - len(self.held.lstrip()), "Extra data")


#: Characters of entries that are passed on at once.
HELD = 1 << 22
ENTRY = "section string, key string, position bigint, value string, fault string"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the pieces of one file, which come in order; a fault ends them."""
    splitter, read, last, out, held, fault = Splitter(), 0, -1, [], 0, None
    kinds = pa.struct([("section", pa.string()), ("key", pa.string()), ("position", pa.int64()), ("value", pa.string()), ("fault", pa.string())])
    try:
        for batch in batches:
            pieces = []
            for text, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if start < last:
                    raise RuntimeError("the pieces of the file are out of order")
                last = start
                read += len(text.encode()) + 1
                pieces += [text, END if read <= size else ""]  # the last piece may end with the file
            for section, key, position, value in splitter.feed("".join(pieces)):
                out.append((section, key, position, value, None))
                held += len(value)
                if held > HELD:
                    yield pa.RecordBatch.from_struct_array(pa.array([dict(zip(kinds.names, x, strict=True)) for x in out], kinds))
                    out, held = [], 0
        splitter.finish()
    except ValueError as e:
        fault = str(e)
    out += [(None, None, None, None, fault)] if fault else []
    yield pa.RecordBatch.from_struct_array(pa.array([dict(zip(kinds.names, x, strict=True)) for x in out], kinds))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, position, value) of all entries of an artifact, stored; raises with file, line and column if it can't be used."""
    try:
        pieces = spark.read.option("lineSep", END).text(path).select("value", F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"))
        rows = stored(pieces.coalesce(1).mapInArrow(_split, ENTRY))  # what a quote means depends on all before it
    except PySparkException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise ArtifactError(f"{path}: not found") from e
        raise
    fault = rows.where("fault IS NOT NULL").first()
    if fault:
        raise ArtifactError(f"{path}: {fault.fault}")
    return rows.drop("fault")


def optional(spark: SparkSession, path: str) -> DataFrame:
    """The entries of an artifact, or none with a warning."""
    try:
        return entries(spark, path)
    except ArtifactError as e:
        log.warning("left out: %s", e)
        return spark.createDataFrame([], ENTRY).drop("fault")


def section(rows: DataFrame, name: str, schema: str) -> DataFrame:
    """The entries of one section by a schema; unique_id is the key where an entry has none."""
    out = rows.where(F.col("section") == name).select("key", F.from_json("value", schema).alias("x")).select("key", "x.*")
    return out.withColumn("unique_id", F.coalesce("unique_id", "key")).drop("key")


def declared_columns(nodes: DataFrame) -> DataFrame:
    """(uid, name, pos, description, data_type) as declared, in the order of declaration."""
    rows = nodes.select(F.col("unique_id").alias("uid"), F.posexplode(F.map_entries("columns")).alias("pos", "e"))
    return rows.select("uid", F.coalesce("e.value.name", "e.key").alias("name"), (F.col("pos") + 1).alias("pos"), F.coalesce("e.value.description", F.lit("")).alias("description"), F.coalesce("e.value.data_type", F.lit("")).alias("data_type"))


def catalog_columns(catalog: DataFrame) -> DataFrame:
    rows = catalog.select(F.col("unique_id").alias("uid"), F.explode("columns").alias("key", "c"))
    return rows.select("uid", F.coalesce("c.name", "key").alias("name"), "c.type", F.col("c.index").alias("idx"))


def catalog_stats(catalog: DataFrame) -> DataFrame:
    rows = catalog.select(F.col("unique_id").alias("uid"), F.explode("stats").alias("stat_id", "s"))
    return rows.where("s.value IS NOT NULL").select("uid", "stat_id", "s.value")


def dependency_edges(nodes: DataFrame) -> DataFrame:
    """(source, target) from every node to those that depend on it."""
    return nodes.select(F.explode("depends_on.nodes").alias("source"), F.col("unique_id").alias("target")).distinct()


def consumer_edges(nodes: DataFrame, child_map: DataFrame) -> DataFrame:
    """(source, target) as the manifest's own map of children has it; without one from what nodes depend on, tests and operations left out."""
    declared = child_map.select(F.col("key").alias("source"), F.explode(F.from_json("value", "ARRAY<STRING>")).alias("target")).distinct()
    made = dependency_edges(nodes.where("resource_type NOT IN ('test', 'operation')"))
    has_map = child_map.select(F.lit(True).alias("has_map")).limit(1)
    return declared.unionByName(made.join(F.broadcast(has_map), F.lit(True), "left_anti"))  # one row


def exposure_rows(exposures: DataFrame) -> DataFrame:
    """Exposures as a project shows them; they have no columns of their own."""
    return exposures.select("unique_id", "name", "type", "description", "url", "label", "maturity", F.coalesce("depends_on.nodes", F.array().cast("array<string>")).alias("depends_on"), "owner", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "meta", F.array().cast("array<string>").alias("columns"))


def metric_rows(metrics: DataFrame) -> DataFrame:
    return metrics.select("unique_id", "name", "description", "label", "type", F.coalesce("depends_on.nodes", F.array().cast("array<string>")).alias("depends_on"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def tests(nodes: DataFrame) -> DataFrame:
    """(test_id, test_name, test_type, column_name, depends_on, severity, kwargs, accepted); unit tests are of type unit_test; only tests of accepted values have these."""
    kind = F.when(F.col("resource_type") == "unit_test", "unit_test").otherwise(F.coalesce("test_metadata.name", F.lit("")))
    rows = nodes.where(F.col("resource_type").isin("test", "unit_test"))
    return rows.select(F.col("unique_id").alias("test_id"), F.col("name").alias("test_name"), kind.alias("test_type"), F.coalesce("column_name", F.lit("")).alias("column_name"), F.col("depends_on.nodes").alias("depends_on"), F.col("config.severity").alias("severity"), F.col("test_metadata.kwargs").alias("kwargs"), F.when(kind == "accepted_values", F.coalesce(F.from_json(F.col("test_metadata.kwargs")["values"], "ARRAY<STRING>"), F.array().cast("array<string>"))).alias("accepted"))


def last_run(results: DataFrame) -> DataFrame:
    """(uid, status, execution_time, completed_at): when the last timed step ended."""
    return results.select(F.col("unique_id").alias("uid"), "status", "execution_time", F.get(F.col("timing"), F.size("timing") - 1)["completed_at"].alias("completed_at"))


def is_package(root: str) -> Column:
    return F.col("package_name") != root


@dataclass(frozen=True)
class Project:
    """The project's tables, each read when it is used."""

    nodes: DataFrame
    sources: DataFrame
    exposures: DataFrame
    metrics: DataFrame
    child_map: DataFrame
    catalog: DataFrame
    run_results: DataFrame
    freshness: DataFrame


def load(spark: SparkSession, folder: str) -> Project:
    """All artifacts of a target folder."""
    manifest, catalog = entries(spark, f"{folder}/manifest.json"), optional(spark, f"{folder}/catalog.json")
    results, fresh = optional(spark, f"{folder}/run_results.json"), optional(spark, f"{folder}/sources.json")
    return Project(
        nodes=section(manifest, "nodes", NODE), sources=section(manifest, "sources", SOURCE), exposures=section(manifest, "exposures", EXPOSURE), metrics=section(manifest, "metrics", METRIC),
        child_map=manifest.where("section = 'child_map'").select("key", "value"), catalog=section(catalog, "nodes", CATALOG).unionByName(section(catalog, "sources", CATALOG)),
        run_results=section(results, "results", RESULT), freshness=section(fresh, "results", FRESHNESS),
    )
