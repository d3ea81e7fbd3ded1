"""Results written to the shared folder, to cut lineage and to compute rows once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own_root: list[str] = []
_written: list[str] = []
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where it is unset, a temporary one serves a local session (tests); on a cluster that is an error,
    as executors don't share their disks."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="codeprint-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return _own_root[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage without depending on any executor, and computes the rows once."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/codeprint-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Remove what ``materialize`` wrote for these frames; nothing that still reads them may be evaluated later."""
    for df in frames:
        path = _folders.pop(df)
        _written.remove(path)
        _remove(df.sparkSession, path)


def written() -> int:
    """How many folders this process has written and not removed."""
    return len(_written)


def clear_scratch(spark: SparkSession, first: int = 0, last: int | None = None) -> int:
    """Remove the folders numbered from ``first`` up to, but without, ``last``; results that still read them are void.  Their number."""
    gone = _written[first:last]
    for path in gone:
        _remove(spark, path)
    del _written[first:last]
    return len(gone)
