"""Files that Python tasks write and read in the shared folder."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that driver and executors share, and the path in it.

    Spark's names of object stores become those of pyarrow: ``s3a`` and ``s3n`` are ``s3``; ``dbfs`` is the folder
    under which it is mounted. ``hdfs`` needs libhdfs on the executors. Other schemes raise.
    """
    if "://" not in path and ":/" not in path:
        return pafs.FileSystem.from_uri(f"file://{path}")
    scheme, rest = path.split(":", 1)
    if scheme in ("s3a", "s3n"):
        return pafs.FileSystem.from_uri(f"s3:{rest}")
    if scheme == "dbfs":
        return pafs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(path if rest.startswith("//") else f"{scheme}://{rest}")


def parts_for(df: DataFrame, text_col: str, bytes_a_part: int) -> int:
    """How many parts hold about so many bytes of text each; at least as many as Spark shuffles to."""
    total = df.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`"))), F.lit(0))).first()[0]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_a_part))
