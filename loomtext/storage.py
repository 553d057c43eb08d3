"""Tables in the folder that the cluster shares, so that lineage ends at files which outlive any executor."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset a local master gets a temporary one; a cluster has to name its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/loomtext/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns it reread."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what ``settle`` wrote, once nothing reads it any more."""
    path = getattr(df, "settled_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables that an operator settles on its way, dropped together once its result is settled."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(settle(df, name))
        return self.held[-1]

    def drop(self) -> None:
        for df in self.held:
            discard(df)
        self.held.clear()


def hadoop_path(spark: SparkSession, path: str):
    """The file system and the path of a uri, as Spark itself reads it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def latest_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of highest version under a path, if there is one."""
    fs, where = hadoop_path(spark, f"{path}/manifest")
    names = sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []
    if not names:
        return None
    stream = fs.open(hadoop_path(spark, f"{path}/manifest/{names[-1]}")[1])
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit_manifest(spark: SparkSession, path: str, manifest: dict) -> dict:
    """Writes a manifest as the next version: a file that is created once. Raises RuntimeError if another writer has made that version."""
    manifest = manifest | {"version": manifest["version"] + 1}
    fs, where = hadoop_path(spark, f"{path}/manifest/{manifest['version']:08d}.json")
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        raise RuntimeError(f"version {manifest['version']} at {path} has been written by another") from e
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return manifest
