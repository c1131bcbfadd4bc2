"""Session helpers: a tuned builder for local runs, and tables staged between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL_FOLDERS: dict[str, str] = {}
_STAGED: list[str] = []


def local_session(cores: int | str = "*", app: str = "panelcast") -> SparkSession:
    """A local session; on a cluster the submitter's own session is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; only a local
    session without that setting gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="panelcast-")
    return _LOCAL_FOLDERS[application]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own for a table of this program; ``drop_staged`` deletes it."""
    path = f"{shared_folder(spark)}/panelcast/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table that several branches of a plan read, and read it back.

    The costly part (scan, joins, first aggregation of the raw rows) then runs
    once, whatever happens to an executor later, and each branch reads only the
    columns it needs.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables this program staged, once its results are written.
    DataFrames that still read them become unusable."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        count += bool(path.getFileSystem(conf).delete(path, True))
    return count
