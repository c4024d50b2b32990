"""Session helpers: building a local session and cutting lineage safely."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "lineloom") -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LINELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one below the working folder where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if "local" not in spark.sparkContext.master or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        found = tempfile.mkdtemp(prefix="lineloom-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders that ``settle`` wrote, by application.
_settled: dict[str, list[str]] = {}


def settle(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and survives lost executors.

    Use it where a result is read more than once and is dear to compute. ``release`` takes the folders away again; what is not
    released goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    own = _settled.setdefault(spark.sparkContext.applicationId, [])
    if not own:
        atexit.register(_forget, spark)
    own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Take away all that ``settle`` wrote in this application, once the results made from it are written; how many folders."""
    own = _settled.pop(spark.sparkContext.applicationId, [])
    for path in own:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(own)


def _forget(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the session may have ended before
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package known to the Python workers of ``spark``, where their path does not hold it already."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_lineloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lineloom-")  # on the driver alone; Spark sends the file itself
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "lineloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for base, _, names in os.walk(os.path.join(root, "lineloom")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    out.write(path, os.path.relpath(path, root))
    sc.addPyFile(archive)
    sc._lineloom_shipped = True
