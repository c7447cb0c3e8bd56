"""Sessions, and what every operator needs from one."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings of a session of ours; a session made elsewhere keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.scheduler.mode": "FAIR",
    "spark.ui.enabled": "false",
}


def make_session(name: str = "halyard", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS, further settings given as spark_sql_x="...": "__" stands
    for an underscore in a setting's name."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "\0").replace("_", ".").replace("\0", "_"): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and tasks share one process and one disk."""
    m = spark.sparkContext.master
    return m == "local" or m.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: spark.checkpoint.dir. Only a
    single-process session without that setting gets a temporary one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="halyard-")
        atexit.register(shutil.rmtree, d, True)
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a table into the shared folder and read it again.

    This cuts the lineage: a lost executor costs at most a re-read, and a plan
    with several readers doesn't compute its input several times."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/halyard/{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_halyard_written", []).append(path)
    w = df.write.mode("error")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables written so far; results made of them can't be
    read afterwards. Gives their number."""
    written = spark.sparkContext.__dict__.pop("_halyard_written", [])
    for path in written:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(written)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def size_estimate(df: DataFrame) -> int:
    """Catalyst's estimate in bytes of what df reads or makes; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application: operators with
    Python code call it. Local workers need it too, as the driver's sys.path isn't
    theirs. The archive lies in the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_halyard_shipped", False):
        return
    here, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"halyard/{p.relative_to(here)}")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/halyard/{uuid.uuid4().hex}/halyard.zip")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(data.getvalue())
    finally:
        out.close()
    sc.addPyFile(at.toString())
    sc._halyard_shipped = True
