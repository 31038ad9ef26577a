"""Folders that all executors share, and stored tables that are replaced as a whole or appended to."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets its own, a cluster must name one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cohortmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listing(spark: SparkSession, path: str, recursive: bool = False) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder; none if it does not exist."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return []
    out, files = [], fs.listFiles(p, recursive)
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def folders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def cleanup_prefix(spark: SparkSession, path: str) -> int:
    """Delete a folder; the number of files it held."""
    n = len(listing(spark, path, recursive=True))
    fs, p = _path(spark, path)
    fs.delete(p, True)
    return n


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: computed once, and lost executors do not matter."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def shuffles_go(spark: SparkSession):
    """What is written inside loses its shuffle files as soon as it is written: the driver's collection, which takes them else, comes when it likes."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, had)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects what refers to them; after a table is written it does so at once."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Store:
    """The tables of ``schemas.TABLES`` below one folder.

    Every table has numbered versions; a reader takes the last one that is complete.  Replacing a
    table writes the next version, so it may be computed from the one before, and a job that dies
    leaves the old one in place.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def create(self) -> Store:
        """All tables that do not exist yet, empty."""
        for name in schemas.TABLES:
            if self.version(name) is None:
                self.truncate(name)
        return self

    def version(self, name: str) -> str | None:
        done = [v for v in folders(self.spark, f"{self.root}/{name}") if any(p.endswith("/_SUCCESS") for p, _ in listing(self.spark, f"{self.root}/{name}/{v}"))]
        return done[-1] if done else None

    def path(self, name: str) -> str:
        at = self.version(name)
        if at is None:
            raise ValueError(f"no table {name} in {self.root}")
        return f"{self.root}/{name}/{at}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(schemas.TABLES[name][0]).parquet(self.path(name))

    def aligned(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` with the table's columns in their order and types: a missing one is an error, others are left out with a warning."""
        want = self.spark.createDataFrame([], schemas.TABLES[name][0]).schema
        missing = [f.name for f in want if f.name not in rows.columns]
        if missing:
            raise ValueError(f"{name}: columns are missing: {', '.join(missing)}")
        if extra := sorted(set(rows.columns) - set(want.names)):
            warnings.warn(f"{name}: columns are left out: {', '.join(extra)}", stacklevel=2)
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want])

    def append(self, name: str, rows: DataFrame) -> None:
        self.aligned(name, rows).write.mode("append").partitionBy(*schemas.TABLES[name][1]).parquet(self.path(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write ``rows`` as the next version and drop versions older than the one before."""
        had = folders(self.spark, f"{self.root}/{name}")
        number = int(had[-1][1:]) + 1 if had else 1
        out = self.aligned(name, rows)
        parts = schemas.TABLES[name][1]
        if parts:
            out = out.repartition(*parts, F.pmod(F.xxhash64(*[c for c in out.columns if c not in parts][:1]), F.lit(4)))
        out.write.partitionBy(*parts).parquet(f"{self.root}/{name}/v{number:06d}")
        for old in had[:-1]:
            cleanup_prefix(self.spark, f"{self.root}/{name}/{old}")

    def delete(self, name: str, which: Column) -> int:
        """Replace a table by the rows that ``which`` does not hold for; how many went."""
        rows = self.read(name)
        gone = rows.where(which).count()
        if gone:
            self.replace(name, rows.where(~F.coalesce(which, F.lit(False))))
        return gone

    def truncate(self, name: str) -> None:
        self.replace(name, self.spark.createDataFrame([], schemas.TABLES[name][0]))

    def reset(self) -> list[str]:
        for name in schemas.TABLES:
            self.truncate(name)
        return list(schemas.TABLES)
