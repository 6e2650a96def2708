"""Small files of the driver, and working tables, on any store that Hadoop reads: local folders, HDFS, object stores.

A path without a scheme means what Spark takes it for. Nothing here is for data: rows go through DataFrames.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Where working tables go in a local session that names no shared folder.
LOCAL_FOLDER = "/tmp/checkpoints/tiltmeter"


def _at(path: str) -> tuple[Any, Any, Any]:
    """The file system of a path, the path and the gateway's classes."""
    spark = SparkSession.active()
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where, jvm


def exists(path: str) -> bool:
    fs, where, _ = _at(path)
    return fs.exists(where)


def names(folder: str) -> list[str]:
    """Names of the visible files right under a folder, sorted; none where there is no folder."""
    fs, where, _ = _at(folder)
    if not fs.exists(where):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(where) if s.isFile()]
    return sorted(n for n in found if n[0] not in "._")


def read_text(path: str) -> str:
    """The whole of a small file; OSError where it can't be read."""
    fs, where, jvm = _at(path)
    if not fs.exists(where) or not fs.getFileStatus(where).isFile():
        raise FileNotFoundError(path)
    stream = fs.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put(path: str, text: str, replace: bool) -> bool:
    """Write beside the place, then rename: readers see the old file or the new one, never a part. False where it is taken."""
    fs, where, jvm = _at(path)
    beside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
    fs.mkdirs(where.getParent())
    stream = fs.create(beside, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    how = SparkSession.active().sparkContext._gateway.new_array(kinds, int(replace))
    if replace:
        how[0] = kinds.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(where), how)
    except Exception:
        fs.delete(beside, False)
        if replace or not fs.exists(where):
            raise
        return False
    # A local checksum beside it would make the file unreadable once somebody edits it by hand.
    fs.delete(jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.crc"), False)
    return True


def write_text(path: str, text: str) -> None:
    _put(path, text, True)


def write_new(path: str, text: str) -> bool:
    """As ``write_text``, but what lies there stays; whether the file was written."""
    fs, where, _ = _at(path)
    return not fs.exists(where) and _put(path, text, False)


def set_aside(path: str) -> str:
    """Rename what lies at a path, so that nothing that was paid for is lost; the new name."""
    fs, where, jvm = _at(path)
    other = f"{path.rstrip('/')}.replaced-{uuid.uuid4().hex[:12]}"
    if not fs.rename(where, jvm.org.apache.hadoop.fs.Path(other)):
        raise OSError(f"can't rename {path}")
    return other


def remove(path: str) -> None:
    """Delete a working folder of one's own."""
    fs, where, _ = _at(path)
    fs.delete(where, True)


def set_times(folder: str, millis: int) -> None:
    """Give all files under a folder one modification time, as a copy of the folder may."""
    fs, where, _ = _at(folder)
    found = fs.listFiles(where, True)
    while found.hasNext():
        fs.setTimes(found.next().getPath(), millis, -1)


def sha256(path: str) -> str:
    """Hash of a file's bytes; of a folder, of its visible files' names and hashes; empty where nothing can be read."""
    fs, where, jvm = _at(path)

    def of(file: Any) -> str:
        stream = fs.open(file)
        try:
            return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    if not fs.exists(where):
        return ""
    if fs.getFileStatus(where).isFile():
        return of(where)
    own = [f"{n}:{of(jvm.org.apache.hadoop.fs.Path(where, n))}\n" for n in names(path)]
    return hashlib.sha256("".join(own).encode()).hexdigest() if own else ""


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the cluster names; a local one only for a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = LOCAL_FOLDER
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several plans need to the shared folder, and read it back."""
    at = working_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
