"""Session settings the library relies on, and the session used by tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on; call it before building a plan.

    JSON-LD in the wild repeats keys. JSON allows that (the last one wins), Spark's
    parser only does with this setting.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    A local session that names none (tests, laptops) gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    fresh = tempfile.mkdtemp(prefix="pagecensus-")
    spark.conf.set("spark.checkpoint.dir", fresh)
    return fresh


def stage(table: DataFrame, name: str) -> DataFrame:
    """Write ``table`` to the shared folder and read it back.

    For results several tables derive from: they read the files instead of computing it again, and
    a lost executor costs a re-read.
    """
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagecensus")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
