"""Many small text files of one folder, one for each name, written by a data source with a commit.

A partition writes its files under hidden names and renames each one when it is whole; what it wrote is listed in a note of
its own. A task that fails removes what it wrote; a job that fails removes what the notes of its other tasks list. Paths
are anything that `pyarrow.fs` opens on the executors.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NOTES = "_notes"


@dataclass
class Written(WriterCommitMessage):
    note: str
    files: int


class NamedFilesWriter(DataSourceWriter):
    """Rows (name, line), the rows of a name next to each other; `name` may hold folders."""

    def __init__(self, path: str, overwrite: bool):
        self.path = path
        store, root = fs.FileSystem.from_uri(path)
        if overwrite and store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir_contents(root)
        store.create_dir(f"{root}/{NOTES}", recursive=True)

    def write(self, rows):
        store, root = fs.FileSystem.from_uri(self.path)
        done, name, out, folders = [], None, None, set()

        def finish():
            out.close()
            store.move(hidden(name), f"{root}/{name}")
            done.append(name)

        def hidden(n):
            folder, _, last = n.rpartition("/")
            return f"{root}/{folder}/.{last}.part" if folder else f"{root}/.{last}.part"

        try:
            for r in rows:
                if r["name"] != name:
                    if out is not None:
                        finish()
                        out = None
                    name = r["name"]
                    folder = name.rpartition("/")[0]
                    if folder and folder not in folders:
                        store.create_dir(f"{root}/{folder}", recursive=True)
                        folders.add(folder)
                    out = store.open_output_stream(hidden(name))
                out.write((r["line"] or "").encode() + b"\n")
            if out is not None:
                finish()
                out = None
        except BaseException:
            if out is not None:
                out.close()
                done_hidden = hidden(name)
                if store.get_file_info(done_hidden).type == fs.FileType.File:
                    store.delete_file(done_hidden)
            _remove(store, root, done)
            raise
        note = f"{NOTES}/{uuid.uuid4().hex}"
        with store.open_output_stream(f"{root}/{note}") as f:
            f.write("".join(f"{n}\n" for n in done).encode())
        return Written(note, len(done))

    def commit(self, messages):
        store, root = fs.FileSystem.from_uri(self.path)
        store.delete_dir(f"{root}/{NOTES}")
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages):
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                with store.open_input_stream(f"{root}/{m.note}") as f:
                    _remove(store, root, f.read().decode().split("\n")[:-1])
        store.delete_dir(f"{root}/{NOTES}")


def _remove(store, root: str, names: list[str]) -> None:
    for n in names:
        if store.get_file_info(f"{root}/{n}").type == fs.FileType.File:
            store.delete_file(f"{root}/{n}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls):
        return "named_files"

    def schema(self):
        return "name string, line string"

    def writer(self, schema, overwrite):
        return NamedFilesWriter(self.options["path"], overwrite)


def write_named(rows: DataFrame, order: list[str], path: str) -> None:
    """rows(name, line, *order): a text file for each name, its lines in order; null lines are empty ones. A name is one
    stream through one task, however long."""
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    laid = rows.repartition("name").sortWithinPartitions("name", *order).select("name", "line")
    laid.write.format("named_files").mode("overwrite").save(path)


def read_named(spark, path: str) -> DataFrame:
    """(name, value, at): lines of files that `write_named` made, with the place of each line in the read block order."""
    root = fs.FileSystem.from_uri(path)[1]
    at = F.col("_metadata.file_path")
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.regexp_replace(F.substring_index(at, f"{root}/", -1), "%20", " ").alias("name"), "value")
