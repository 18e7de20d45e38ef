"""Session defaults and lineage cutting."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(master).appName("flotsam")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # no call-site capture per column expression: it costs more than building the plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder; on a cluster a folder of one machine would
    be of no use to the others.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_FOLDERS[app]


def new_path(spark: SparkSession) -> str:
    """Fresh folder name inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/flotsam-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back.

    Computes the plan a single time, cuts the lineage of iterative jobs and survives the loss of executors,
    because the copy lives in the shared folder and not on the machine that made it.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.mode("errorifexists").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def release(df: DataFrame) -> None:
    """Delete the folder of a materialised table that nothing will read again, as a superseded round of a loop."""
    path = df.__dict__.get("_written_to")
    if path is not None:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
