"""Session set-up and the two ways this library cuts a lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8")
    spark = b.config(map=SETTINGS | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application; Spark's file server hands it out, so they need no copy of their own."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    _SHIPPED.add(sc.applicationId)
    path = f"{tempfile.mkdtemp(prefix='talus-package-')}/{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. It comes from spark.checkpoint.dir; only where that is unset (local tests) is one made here."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="talus-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at


def stage_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there, and a lost executor costs no recomputation.

    Unlike checkpoint() the table is columnar, so later reads prune columns. The tables of one application lie under one folder, see drop_stage_tables.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    w = df.write.mode("error")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/talus-stages-{spark.sparkContext.applicationId}"


def drop_stage_tables(spark: SparkSession) -> None:
    """Delete this application's stage tables; call it when their results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
