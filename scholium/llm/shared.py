"""Shared-folder helpers: where jobs cut lineage and where binary files go."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        own = tempfile.mkdtemp(prefix="scholium-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, removed when this interpreter ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = file_system(at)
    fs.create_dir(path, recursive=True)

    def gone() -> None:
        try:
            fs.delete_dir(path)
        except OSError:
            pass  # already removed together with the shared folder

    atexit.register(gone)
    return at


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def file_system(uri: str):
    """(pyarrow file system, path) of a shared-folder URI."""
    from pyarrow import fs

    if re.match(r"file:/*", uri):
        uri = "/" + re.sub(r"^file:/*", "", uri)
    return fs.FileSystem.from_uri(uri)


@contextmanager
def local_copy(uri: str):
    """A path that can be memory-mapped: the file itself if mounted, else a copy that goes afterwards."""
    from pyarrow import fs

    store, path = file_system(uri)
    if isinstance(store, fs.LocalFileSystem):
        yield path
        return
    handle, name = tempfile.mkstemp(prefix="scholium-")
    os.close(handle)
    try:
        fs.copy_files(path, name, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        yield name
    finally:
        os.unlink(name)


#: Stands for a null id inside Python tasks, where a null would turn a batch of ids into floats.
NULL_ID = -(1 << 63)


def sent_id(name: str) -> Column:
    """An id column without nulls, for tasks."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID)).alias(name)


def given_back(df: DataFrame, name: str) -> DataFrame:
    """Nulls in the place of NULL_ID."""
    return df.withColumn(name, F.nullif(F.col(name), F.lit(NULL_ID)))


def release() -> None:
    """Give memory that earlier tasks of this Python worker freed back to the system.

    Workers serve task after task, and the C allocator and Arrow's pool keep what was freed.
    """
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def bounded_join(docs: DataFrame, ids: DataFrame, on: list[str], how: str, limit: int = 500_000) -> DataFrame:
    """Semi or anti join of documents with a checkpointed id table, null-safe on ``on``.

    The id table is broadcast only when its counted rows are at most ``limit`` (8 bytes and
    overhead a row, so below 32 MB); beyond that both sides are shuffled.
    """
    small = ids.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
    if ids.count() <= limit:
        small = F.broadcast(small)
    held = F.lit(True)
    for c in on:
        held = held & docs[c].eqNullSafe(small[f"__{c}"])
    return docs.join(small, held, how)
