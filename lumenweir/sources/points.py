"""A transactional sink for vector points as a Spark data source: format "point_batches".

Points (columns id, vector, and any others as payload) are written in requests of `batch` points at most, a JSON line each;
points without a vector are left out. A task writes one file into a folder of its job; the commit puts the list of the files
that succeeded tasks have written beside them, as one small file and as its last act. Readers see what such lists name and
nothing else, so that a failed job, a failed or a repeated task leaves nothing to be seen; aborting a job removes its folder.
Overwriting replaces all lists by the new one. The path may be any that pyarrow's file systems reach from all executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

BATCH = 64


def _at(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    points: int
    requests: int


class PointBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "point_batches"

    def schema(self) -> str:
        return "id long, vector array<double>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.batch, self.overwrite = options["path"].rstrip("/"), int(options.get("batch", BATCH)), overwrite
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        system, path = _at(self.path)
        system.create_dir(f"{path}/{self.job}", recursive=True)
        name, held, points, requests = f"{self.job}/{uuid.uuid4().hex}.json", [], 0, 0
        with system.open_output_stream(f"{path}/{name}") as out:

            def send() -> None:
                nonlocal points, requests
                if held:
                    out.write(json.dumps({"points": held}, ensure_ascii=False, default=str).encode() + b"\n")
                    points, requests = points + len(held), requests + 1
                    held.clear()

            for r in rows:
                own = r.asDict(recursive=True)
                i, vector = own.pop("id"), own.pop("vector")
                if vector:
                    held.append({"id": i, "vector": [float(x) for x in vector], "payload": own})
                    if len(held) == self.batch:
                        send()
            send()
        if not points:
            system.delete_file(f"{path}/{name}")
        return Written(name if points else None, points, requests)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _at(self.path)
        system.create_dir(path, recursive=True)
        from pyarrow import fs

        old = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".list")] if self.overwrite else []
        named = {"files": [m.file for m in messages if m and m.file], "points": sum(m.points for m in messages if m), "requests": sum(m.requests for m in messages if m)}
        with system.open_output_stream(f"{path}/{self.job}.part") as out:
            out.write(json.dumps(named).encode())
        system.move(f"{path}/{self.job}.part", f"{path}/{self.job}.list")
        for f in old:
            system.delete_file(f)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, path = _at(self.path)
        if system.get_file_info(f"{path}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.job}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PointBatches)


def write(points: DataFrame, path: str, batch: int = BATCH, mode: str = "append") -> None:
    """Points (id, vector, ...) through the sink."""
    register(points.sparkSession)
    points.write.format("point_batches").mode(mode).option("path", path).option("batch", batch).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, payload, request, in_request) of the committed points: which request each came in, and how many came in it."""
    schema = "points array<struct<id: long, vector: array<double>, payload: map<string, string>>>"
    listed = spark.read.schema("files array<string>").option("pathGlobFilter", "*.list").json(path)
    files = [f"{path.rstrip('/')}/{r['file']}" for r in listed.select(F.explode("files").alias("file")).collect()]  # one for each writing task
    rows = spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
    rows = rows.select(F.xxhash64(F.to_json("points")).alias("request"), F.size("points").alias("in_request"), F.explode("points").alias("p"))
    return rows.select("p.*", "request", "in_request")
