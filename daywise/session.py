"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session with the settings the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("daywise")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    A folder on this machine stands in only where the setting is absent, which is the case in tests on a local
    master; on any other master its absence is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    stand_in = os.path.join(tempfile.gettempdir(), f"daywise-{os.getpid()}")
    os.makedirs(stand_in, exist_ok=True)
    return stand_in


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: a reliable lineage cut that outlives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """``cut`` of ``df`` partitioned and sorted by a key, which the plans over it then know.

    An adaptive plan does not tell how its rows are partitioned, so this one step is planned without.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(key).sortWithinPartitions(key))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores: a scan of fewer splits than cores, which only a small table has, is dealt out anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table and read back, so that plans know its true size.

    Joins with it broadcast it only where that size is under the session's threshold.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started.

    Workers on this machine get its folder by their path. Those of a cluster get the package's files, once per
    application, unless PYTHONPATH already names the folder, which then all machines have.
    """
    sc = spark.sparkContext
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    set_already = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if home in set_already or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if sc.master.startswith("local["):
        sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (home, sc.environment.get("PYTHONPATH", "")) if p)
        return
    with tempfile.TemporaryDirectory() as folder:
        archive = os.path.join(folder, "daywise.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(Path(home, "daywise").rglob("*.py")):
                z.write(path, path.relative_to(home))
        sc.addPyFile(archive)
