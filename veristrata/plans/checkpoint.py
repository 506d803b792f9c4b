"""Tables in the shared folder that spark.checkpoint.dir names: how lineage is cut and what lost executors need not repeat.

All tables of an application lie in one folder of its own, which goes when the driver ends or `release` is called.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder of this process's tables, by application, and what deletes each.
_OWN: dict[str, str] = {}
_FOLDERS: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary folder
    serves a local master; a cluster's executors would not see each other's, so there it is an error."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="veristrata-")
        _OWN[app] = f"{base.rstrip('/')}/veristrata-{app}"
        _remember(spark, _OWN[app])
    return _OWN[app]


def _remember(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    _FOLDERS[path] = (folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder)


def release(path: str | None = None) -> None:
    """Deletes the stored tables (of all applications of this process). DataFrames that read them can't be used any more."""
    for p in [path] if path else list(_FOLDERS):
        fs, folder = _FOLDERS.pop(p)
        for app in [a for a, own in _OWN.items() if own == p]:
            del _OWN[app]
        try:
            fs.delete(folder, True)
        except Exception:  # noqa: BLE001  the JVM, or the store, is gone already
            pass


atexit.register(release)


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and fixes what a retried task would see."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_path = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes a table of `store` that nothing reads any more."""
    jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext
    folder = jvm.org.apache.hadoop.fs.Path(df._stored_path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
