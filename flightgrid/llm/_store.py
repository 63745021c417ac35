"""Shared scratch space: the folder that all executors and the driver see."""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import Any, BinaryIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset (tests on one
    machine), a new temporary folder, which is then also set for checkpoints."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = got.get() if got.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="flightgrid-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/flightgrid/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: the
    lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system interface."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



class Files:
    """Files of a folder that is local or mounted (file:), else pyarrow's."""

    def __init__(self, uri: str):
        scheme = uri.partition(":")[0] if ":" in uri else "file"
        self.local = scheme == "file"
        if self.local:
            self.base = "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri
        else:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(uri)

    def create(self, name: str) -> Any:
        if self.local:
            os.makedirs(self.base, exist_ok=True)
            return open(f"{self.base}/{name}", "wb")
        self.fs.create_dir(self.base)
        return self.fs.open_output_stream(f"{self.base}/{name}")

    def rename(self, a: str, b: str) -> None:
        if self.local:
            os.replace(f"{self.base}/{a}", f"{self.base}/{b}")
        else:
            self.fs.move(f"{self.base}/{a}", f"{self.base}/{b}")

    def open(self, name: str) -> BinaryIO:
        return open(f"{self.base}/{name}", "rb") if self.local else self.fs.open_input_stream(f"{self.base}/{name}")

    def save(self, name: str, raw: bytes) -> None:
        """Whole or not at all; a second writer of the same bytes does no harm."""
        temp = f".{uuid.uuid4().hex}.tmp"
        with self.create(temp) as f:
            f.write(raw)
        self.rename(temp, name)

    def view(self, name: str) -> np.ndarray:
        """The bytes of a file: mapped into memory where it is local or mounted."""
        if self.local:
            return np.memmap(f"{self.base}/{name}", np.uint8, "r")
        with self.open(name) as f:
            return np.frombuffer(f.read(), np.uint8)
