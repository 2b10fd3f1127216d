"""Rebuild when artifacts change: a streaming source whose offset is what files there are, with their times and lengths.

Artifacts are rewritten under their old names, which a stream over files takes for no news. Here an offset is the
whole listing, so what lies between two offsets are the files that are new, rewritten or gone; Spark's own log holds
what was seen, and a batch that failed is run again between the same offsets after a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

ARTIFACTS = ("manifest.json", "catalog.json", "run_results.json", "sources.json")


def listing(folder: str, names: tuple[str, ...] = ARTIFACTS) -> dict[str, list[int]]:
    """Path to modification time in nanoseconds and length of the files of these names below ``folder``, in order."""
    fs, root = pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return {f.path: [f.mtime_ns or 0, f.size] for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name in names}


class Changes(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(0)
        self.rows = rows


class ArtifactStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.names = tuple(options["names"].split(",")) if "names" in options else ARTIFACTS

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return listing(self.folder, self.names)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        changed = [(p, *end[p], "new" if p not in start else "rewritten") for p in end if start.get(p) != end[p]]
        gone = [(p, None, None, "gone") for p in start if p not in end]
        return [Changes(changed + gone)]

    def read(self, partition: Changes) -> Iterator[tuple]:
        yield from partition.rows


class ArtifactSource(DataSource):
    """``spark.readStream.format("project_artifacts").option("path", folder)``: path, modified_ns, length and change (new, rewritten, gone) of files."""

    @classmethod
    def name(cls) -> str:
        return "project_artifacts"

    def schema(self) -> str:
        return "path string, modified_ns bigint, length bigint, change string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ArtifactStream(self.options)


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of changes of a folder's artifacts."""
    spark.dataSource.register(ArtifactSource)
    return spark.readStream.format("project_artifacts").option("path", folder).load()


def watch(spark: SparkSession, folder: str, rebuild: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 2.0) -> StreamingQuery:
    """Calls ``rebuild(changes, number of the batch)`` whenever there are any, looking every two seconds.

    A rebuild that raises ends the query; started again with the same checkpoint, it sees the same changes under the same number.
    """
    writer = changes(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(rebuild)
    return writer.trigger(processingTime=f"{seconds} seconds").start()
