"""Where intermediate tables live: one folder per session, below a folder that the session names."""

from __future__ import annotations

import gc
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.schemaloom.work.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.schemaloom.work.dir``, else ``spark.checkpoint.dir``, else the warehouse.

    All three come from the session, so driver and executors see the same place whatever the master is. A cluster must set one
    of them to a shared folder; a warning says so if executors elsewhere would look for files of this machine.
    """
    context = spark.sparkContext
    root = (
        spark.conf.get(SETTING, None)
        or spark.conf.get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
        or spark.conf.get("spark.sql.warehouse.dir")
    )
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
        if root.startswith(("/", "file:")) and not context.master.startswith("local"):
            warnings.warn(f"intermediate tables go to {root}, which all executors must share; {SETTING} names another folder", stacklevel=2)
    return root


def work_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/work-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediates, on whatever file system it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def clean(spark: SparkSession) -> None:
    """Delete all intermediates of this session; results read from them must be written before."""
    remove(spark, work_folder(spark))


def folders(spark: SparkSession) -> set[str]:
    """All tables that lie in the work folder of this session now."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in files.listStatus(path)} if files.exists(path) else set()


def sweep(spark: SparkSession, keep: set[str]) -> None:
    """Delete the tables of the work folder that are not in ``keep`` (names as ``folders`` gives them)."""
    for name in folders(spark) - keep:
        remove(spark, f"{work_folder(spark)}/{name}")


def swept(spark: SparkSession, names: set[str], kind: str) -> None:
    """Delete those of the tables named that are of one kind, and what was shuffled for plans that nothing refers to any more."""
    for name in names:
        if name.startswith(f"{kind}-"):
            remove(spark, f"{work_folder(spark)}/{name}")
    forget(spark)


def forget(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished plans: it does so when the driver collects its garbage, which may take long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read on from there (lineage is cut)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the work folder: columns can be pruned when read again."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
