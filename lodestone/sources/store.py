"""Tables that several steps read, written once in the folder that the cluster shares, and files.

What is decoded from archives is read by many queries; as a Parquet table it is decoded once, its columns are read
alone, and a lost executor costs a task and not the decoding.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of this application in spark.checkpoint.dir; a temporary one if that is unset and there is only this machine."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = spark.conf.get("lodestone.shared.dir", None) or "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("lodestone.shared.dir", place)
    return f"{place.rstrip('/')}/lodestone/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table and read again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt by its keys over as many tasks as a shuffle has.

    Adaptive execution would put few bytes into few tasks, which is wrong for rows from which archives are made and decoded.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def release(spark: SparkSession) -> None:
    """Deletes the tables that this application has stored."""
    Files(spark, folder(spark)).delete(folder(spark))


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if re.match(r"\w+://", folder) else (pafs.LocalFileSystem(), folder)


def opened(folder: str) -> Callable[[str], pa.NativeFile]:
    """Opens files of a folder to be written, for use inside tasks; through Arrow's file systems, so any store that the executors share will do."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    return lambda name: store.open_output_stream(f"{path}/{name}", compression=None)


class Files:
    """What the driver does with files, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.store = self.jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def rename(self, old: str, new: str) -> None:
        """Gives a file its final name; one of that name that an earlier run has left goes."""
        a, b = (self.jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
        if self.store.exists(b):
            self.store.delete(b, False)
        if not self.store.rename(a, b):
            raise OSError(f"{old} can't be renamed to {new}")

    def delete(self, path: str) -> None:
        self.store.delete(self.jvm.org.apache.hadoop.fs.Path(path), True)


def save_blobs(blobs: DataFrame, folder: str) -> None:
    """Writes each of blobs (path, content) to a file of folder, path.bin; a file appears whole or not at all, and a repeated attempt writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                draft = f"{at}/_{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft, compression=None) as out:
                    out.write(content)
                if store.get_file_info(f"{at}/{path}.bin").type == pafs.FileType.NotFound:
                    store.move(draft, f"{at}/{path}.bin")
                else:
                    store.delete_file(draft)
            yield batch.select(["path"])

    blobs.select("path", "content").mapInArrow(run, "path string").count()
