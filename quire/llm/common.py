"""What the operators of this subpackage share: reading tables, the shared folder, tables cut off from their lineage."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, whatever else there is; a null text is empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share.

    Where that is unset, a local session gets a folder of its own; on a cluster others could not read it, so that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("quire.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = Path(tempfile.mkdtemp(prefix="quire-")).as_uri()
        spark.conf.set("quire.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: computed once, and no executor's loss undoes them."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(path)
    tidy()
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or a plain path; works on executors for any store that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file://" + uri[5:].replace("///", "/", 1) if uri.startswith("file:///") else "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def put_file(folder: str, name: str, data: bytes) -> str:
    """Writes a file whole or not at all: tasks that run twice leave one complete copy under the same name."""
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, f"{path}/{name}")
    return f"{folder}/{name}"


_KEPT: dict[tuple, object] = {}


def kept(kind: type, *args):
    """One of these for each worker process, kept from task to task."""
    if (kind, *args) not in _KEPT:
        _KEPT[kind, *args] = kind(*args)
    return _KEPT[kind, *args]


def forget() -> None:
    """Gives up what this worker has kept, when it turns to work that needs none of it."""
    if _KEPT:
        _KEPT.clear()
        tidy()


def tidy() -> None:
    """Gives free memory back to the system. Workers live on between tasks, and an executor has several of them."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
