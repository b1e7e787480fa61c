"""The cluster's shared folder, and written intermediates in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, with its scheme.

    The session's `spark.checkpoint.dir`; a path without a scheme lies on the
    default file system. Where the setting is missing, a new temporary folder is
    set and used if driver and executors are one process, and nothing else is.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="framewise-")
        spark.conf.set("spark.checkpoint.dir", found)
    if "://" not in found:
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())
        found = re.sub(r"^([a-z0-9+.-]+):/(?!/)", r"\1:///", found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again.

    It cuts the lineage: a lost executor costs at most the tasks after this
    point, and what is used twice is computed once.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    # Small row groups: a writer keeps one in memory, and intermediates are read whole anyway.
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _folders[id(found)] = found, path
    return found


#: Tables that `written` returned, and their folders.
_folders: dict[int, tuple[DataFrame, str]] = {}


def discard(df: DataFrame) -> None:
    """Remove the files of a table that `written` returned and that nothing reads any more."""
    found, path = _folders.pop(id(df), (None, None))
    if found is df:
        _remove(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Remove all that `written` wrote in this process; results not yet read are lost."""
    for _, path in _folders.values():
        _remove(spark, path)
    _folders.clear()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
