"""Files that tasks write to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


_SCRATCH: dict[str, str] = {}  # application -> its scratch folder, where the setting is unset


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a scratch folder of the application only where it is unset in
    local mode (Spark refuses to change the setting of a running session)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    master = context.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    if context.applicationId not in _SCRATCH:
        _SCRATCH[context.applicationId] = tempfile.mkdtemp(prefix="ledgerlens-shared-")
    return _SCRATCH[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root, not used by any other run."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df, name: str):
    """Write ``df`` to the shared folder and read it back: the plan before it is run once and
    later failures restart from the written table."""
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def commit_file(folder: str, name: str, content: bytes) -> None:
    """Write under a temporary name and rename: readers see a whole file or none, and a retry
    of the same task replaces it by the same bytes."""
    store, path = filesystem(folder)
    temporary = f"{path}/_temporary/{uuid.uuid4().hex}"
    store.create_dir(f"{path}/_temporary", recursive=True)
    with store.open_output_stream(temporary, compression=None) as f:
        f.write(content)
    store.move(temporary, f"{path}/{name}")
