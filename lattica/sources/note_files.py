"""A sink that stores one file a note: a Python data source whose tasks write aside and whose commit puts files in place.

``write.format("notefiles").option("path", ...)`` takes rows (file_name, body). Each task writes to a folder of its own below
``_parts``; a task that fails or runs twice leaves nothing in place. Committing moves the files of the tasks that count and
writes ``_SUCCESS``; aborting removes what was written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class NoteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notefiles"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"file_name", "body"} - set(schema.names)
        if missing:
            raise ValueError(f"notefiles needs the columns {', '.join(sorted(missing))}")
        return NoteFileWriter(self.options["path"], overwrite)


class NoteFileWriter(DataSourceWriter):
    """Paths may be of any file system that Arrow opens: local, HDFS, object stores."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.removeprefix("file://") if path.startswith("file:///") else path, overwrite

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> Written:
        files, root = self._folder()
        folder = f"{root}/_parts/{uuid.uuid4().hex}"
        files.create_dir(folder)
        names = []
        for row in iterator:
            name = row["file_name"]
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"no file name: {name!r}")
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write((row["body"] or "").encode())
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = self._folder()
        files.create_dir(root)
        if self.overwrite:
            for x in files.get_file_info(fs.FileSelector(root)):
                if x.base_name != "_parts":
                    files.delete_dir(x.path) if x.type == fs.FileType.Directory else files.delete_file(x.path)
        for m in messages:
            for name in m.names if m else ():
                files.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear()
        with files.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, root = self._folder()
        if files.get_file_info(f"{root}/_parts").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_parts")


def with_own_names(files: DataFrame, kind: str) -> DataFrame:
    """(file_name, body) of rows (note_id, file_name, body): names that several notes have get the note's id.

    A stem holds no dot, so a name with an id is no other note's name.
    """
    many = files.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    stem = F.when(F.col("n") > 1, F.concat_ws(".", "file_name", F.col("note_id").cast("string"))).otherwise(F.col("file_name"))
    return files.join(many, "file_name").select(F.concat(stem, F.lit(f".{kind}")).alias("file_name"), "body")


def write_files(files: DataFrame, path: str, kind: str = "md", mode: str = "append") -> None:
    """Store rows (note_id, file_name, body) as files of ``kind`` below ``path``, a file a note."""
    files.sparkSession.dataSource.register(NoteFiles)
    with_own_names(files, kind).write.format("notefiles").option("path", path).mode(mode).save()


def read_back(spark: SparkSession, path: str, kind: str = "md") -> DataFrame:
    """(file_name, body) of the files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file_name"), F.decode("content", "UTF-8").alias("body"))
