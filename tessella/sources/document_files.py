"""A data source writer of one file per row, made visible by a commit: ``df.write.format("document_files")``.

Rows are (name, content). Every task writes below a hidden staging folder of its own attempt; the commit moves the files of the attempts that
counted to their places, an abort removes the staging folder. So nothing is visible of a job that failed, of a task that ran twice, or of
one whose executor was lost. File systems are those of pyarrow (local, shared mounts, S3, GCS, Azure, HDFS); names must be distinct, which
``distinct_names`` sees to.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tessella.functions import text as T
from tessella.tables import Scratch, carried, in_order

#: Files that the commit moves at a time.
MOVERS = 16


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1) if path.startswith("file:") else path)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{place(self.path)[1]}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        store, _ = place(self.path)
        folder, n = f"{self.staging}/{uuid.uuid4().hex}", 0
        store.create_dir(folder, recursive=True)
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not name or "/" in name or name.startswith(("_", ".")):
                    raise ValueError(f"not a file name: {name!r}")
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write((content or "").encode())
                n += 1
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, base = place(self.path)
        made = [m for m in messages if m is not None]
        if self.overwrite:
            old = [f for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.is_file]
            self._all(store.delete_file, [(f.path,) for f in old])
        for m in made:
            found = store.get_file_info(fs.FileSelector(m.folder))
            if len(found) != m.files:
                raise ValueError(f"{m.files} files written, {len(found)} found: names are not distinct")
            self._all(store.move, [(f.path, f"{base}/{f.base_name}") for f in found])
        self._clean()

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clean()

    def _all(self, f, calls: list[tuple]) -> None:
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda c: f(*c), calls))

    def _clean(self) -> None:
        store, _ = place(self.path)
        if store.get_file_info(self.staging).type != fs.FileType.NotFound:
            store.delete_dir(self.staging)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def distinct_names(df: DataFrame, title: Column, key: str, scratch: Scratch, fallback: str = "report") -> DataFrame:
    """``df`` with ``name``: a safe file name of the title. Of rows with one name (in any case), the first by ``key`` has it, the n-th has ``--n`` behind it.

    Safe names have no two dashes in a row, so no title can be taken for such a name. Numbers are running counts carried from part to part, so a
    title that most rows have is no single task.
    """
    x = df.withColumn("name", T.safe_filename(title, fallback)).withColumn("_name", F.lower("name"))
    order = ["_name", key]
    n = carried(in_order(x, order, scratch, "names"), ["_name"], order, {"_n": F.lit(1).cast("long")}, {"_n": "sum"})
    return n.withColumn("name", F.when(F.col("_n") > 1, F.concat("name", F.lit("--"), F.col("_n").cast("string"))).otherwise(F.col("name"))).drop("_name", "_n", "_part")


def write_files(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """Rows (name, content) as files below ``path``."""
    df.sparkSession.dataSource.register(DocumentFiles)
    df.select("name", "content").write.format("document_files").mode("overwrite" if overwrite else "append").save(path)
