"""Tables and model files in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame

from gridloom.sources.tables import shared_dir


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """The rows of df, written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)


def free(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def mounted(path: str) -> str:
    """The path by which Python workers open a shared folder's files, for memory maps.

    Memory maps need a mounted file system (NFS, Lustre, FUSE and the like).
    """
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{path}: memory-mapped models need spark.checkpoint.dir on a file system mounted on all executors (file://)")
    return parsed.path


def put(path: str, content: bytes) -> None:
    """Writes a file whole or not at all; a repeated task replaces it by the same bytes."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(content)
    os.replace(part, path)


def begin(path: str):
    """A file to be written in pieces, under another name until end()."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(f"{path}.{uuid.uuid4().hex}.part", "wb")


def end(file, path: str) -> None:
    file.close()
    os.replace(file.name, path)
