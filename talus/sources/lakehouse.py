"""Versioned tables on Parquet: every write is a new version directory, and a small log row makes it visible.

A writer that fails before its log row leaves nothing visible; readers of older versions are not disturbed. Use a table format with a catalog where one is installed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def _exists(self, p: str) -> bool:
        path = self._fs_path(p)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def snapshots(self) -> DataFrame:
        """(version, operation, n_rows), one per visible version."""
        schema = "version int, operation string, n_rows long"
        at = f"{self.path}/_snapshots"
        return self.spark.read.schema(schema).parquet(at) if self._exists(at) else self.spark.createDataFrame([], schema)

    def latest(self) -> int | None:
        return self.snapshots().agg(F.max("version")).first()[0]

    def overwrite(self, df: DataFrame, operation: str = "overwrite", partition_by: tuple[str, ...] = ()) -> int | None:
        """The new version, or None for an empty frame, which makes no snapshot."""
        last = self.latest()
        version = 0 if last is None else last + 1
        at = f"{self.path}/v={version}"
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(at)
        n = self.spark.read.parquet(at).count()
        if not n:
            return None
        self.spark.createDataFrame([(version, operation, n)], "version int, operation string, n_rows long").coalesce(1).write.mode("append").parquet(f"{self.path}/_snapshots")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        v = self.latest() if version is None else version
        if v is None or not self.snapshots().where(F.col("version") == v).count():
            raise ValueError(f"no version {v} of {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={v}")

    def add_column(self, name: str, kind: str = "string") -> int | None:
        """Additive evolution: a new version with one more nullable column."""
        df = self.read()
        return self.latest() if name in df.columns else self.overwrite(df.withColumn(name, F.lit(None).cast(kind)), f"add column {name}")

    def health(self) -> DataFrame:
        """(n_rows, n_snapshots, n_files, avg/min/max bytes per file) of the latest version, from the files' metadata columns."""
        files = self.read().groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n"), F.max("_metadata.file_size").alias("size"))
        one = files.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.avg("size").alias("avg_bytes"), F.min("size").alias("min_bytes"), F.max("size").alias("max_bytes"))
        return one.withColumn("n_snapshots", F.lit(self.snapshots().count()))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of JSON lines: blank lines are skipped; bad has the text of malformed lines, or with strict the read fails on the first."""
    if strict:
        good = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        return good, spark.createDataFrame([], "line string")
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.withColumn("r", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.where("r is not null and r._corrupt is null").select("r.*").drop("_corrupt"), parsed.where("r is null or r._corrupt is not null").select(F.col("value").alias("line"))


def read_manifests(spark: SparkSession, directory: str, suffix: str = "json") -> DataFrame:
    """One row per asset of all manifests of a directory, schema files left out; manifest fields repeat on each asset."""
    m = spark.read.option("multiLine", True).json(f"{directory}/*.{suffix}").withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    m = m.where(~F.col("_file").startswith("source_manifest"))
    return m.withColumn("asset", F.explode("assets")).drop("assets")


def read_assets(spark: SparkSession, directory: str) -> DataFrame:
    """(name, content, sha256) of all files below a directory."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", F.sha2("content", 256).alias("sha256"))
