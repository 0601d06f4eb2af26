"""Report sinks: tables of a run as Parquet, Markdown as text files, and the list of finished runs.

A run writes every table into a folder of its own below the table's folder. When all are written, one row about
the run is added to the table of runs; only then readers that ask for the latest run get the new one. A run that
dies half-way leaves the one before readable and is cleared away by the next one that finishes. One run at a
time writes below a folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Where the finished runs are listed, and tables that a run needs only itself.
RUNS, INTERMEDIATE = "finished_runs", "intermediate"
_RUN = "run string, run_date string, run_ts string, finished_at timestamp, tables array<string>"


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and the path for it: Spark has no function of its own that deletes."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    files, target = _files(spark, path)
    files.delete(target, True)


def _folders(spark: SparkSession, path: str) -> list[str]:
    files, target = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(target) if s.isDirectory()] if files.exists(target) else []


@dataclass
class Run:
    """One run of a job below ``out``; ``finish`` makes its tables the ones that are read."""

    spark: SparkSession
    out: str
    run_ts: str
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    tables: list[str] = field(default_factory=list)

    @property
    def run_date(self) -> str:
        return self.run_ts[:10]

    def folder(self, name: str) -> str:
        return f"{self.out}/{name}/run_date={self.run_date}/run={self.name}"

    def write(self, table: DataFrame, name: str) -> DataFrame:
        """Write a table of the run and read it back."""
        table.write.parquet(self.folder(name))
        self.tables.append(name)
        return self.spark.read.schema(table.schema).parquet(self.folder(name))

    def stage(self, table: DataFrame, name: str) -> DataFrame:
        """As ``write``, for a table that is removed when the run has finished."""
        path = f"{self.out}/{INTERMEDIATE}/run={self.name}/{name}"
        table.write.parquet(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def finish(self) -> None:
        """List the run as finished, then remove intermediate tables and earlier runs of the same date.

        The row appears in one piece: Spark moves a file to its place when it is complete.
        """
        row = self.spark.range(1).select(
            F.lit(self.name).alias("run"), F.lit(self.run_date).alias("run_date"), F.lit(self.run_ts).alias("run_ts"),
            F.current_timestamp().alias("finished_at"), F.array(*map(F.lit, self.tables)).alias("tables"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.out}/{RUNS}")
        _delete(self.spark, f"{self.out}/{INTERMEDIATE}")
        for name in self.tables:
            for other in _folders(self.spark, f"{self.out}/{name}/run_date={self.run_date}"):
                if other != f"run={self.name}":
                    _delete(self.spark, f"{self.out}/{name}/run_date={self.run_date}/{other}")


def finished_runs(spark: SparkSession, out: str) -> DataFrame:
    """``run, run_date, run_ts, finished_at, tables`` of all runs that were finished below ``out``."""
    return spark.read.schema(_RUN).parquet(f"{out}/{RUNS}")


def read_table(spark: SparkSession, out: str, name: str, run_date: str | None = None) -> DataFrame:
    """A table of the run that finished last, of all or of those of ``run_date``.

    Raises ``LookupError`` if there is no such run or it has no such table.
    """
    runs = finished_runs(spark, out).where(F.array_contains("tables", name)) if _folders(spark, out).count(RUNS) else None
    if runs is not None and run_date is not None:
        runs = runs.where(F.col("run_date") == run_date)
    last = None if runs is None else runs.orderBy(F.desc("finished_at")).first()
    if last is None:
        raise LookupError(f"no finished run below {out} has the table {name}")
    return spark.read.parquet(f"{out}/{name}/run_date={last.run_date}/run={last.run}")


def in_site_order(parts: DataFrame) -> DataFrame:
    """The parts of all documents, sorted by origin and part, for writing.

    Ranges of both split a large site over several tasks and files. A document is read back by its
    origin, which the files' statistics find, in the order of its parts.
    """
    return (
        parts.select("origin", "part", "markdown")
        .repartitionByRange("origin", "part")
        .sortWithinPartitions("origin", "part")
    )


def write_site_markdown(parts: DataFrame, folder: str) -> None:
    """The documents as a table in ``folder``; writing it again replaces it."""
    in_site_order(parts).write.mode("overwrite").parquet(folder)


def site_folder(origin: str) -> str:
    """A folder name for an origin; the checksum tells apart origins that read the same."""
    return f"concat(regexp_replace({origin}, '[^A-Za-z0-9.-]+', '_'), '-', lower(hex(crc32(CAST({origin} AS BINARY)))))"


def write_site_files(parts: DataFrame, folder: str, sites: Sequence[str]) -> None:
    """A folder with text files for each of the named ``sites``, for people to read.

    Meant for a short list. The files of a site hold its parts in order, file by file.
    """
    (
        parts.where(F.col("origin").isin(list(sites)))
        .selectExpr(f"{site_folder('origin')} AS site", "origin", "part", "regexp_replace(markdown, '\\\\n\\\\z', '') AS value")
        .repartitionByRange("origin", "part")
        .sortWithinPartitions("site", "origin", "part")
        .select("site", "value")
        .write.mode("overwrite")
        .partitionBy("site")
        .text(folder)
    )


def write_page_markdown(pages: DataFrame, folder: str) -> None:
    """Page reports as text, each followed by an empty line, without any shuffle."""
    pages.select(F.col("markdown").alias("value")).write.mode("overwrite").text(folder)
