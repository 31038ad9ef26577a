"""Shared folders, written tables and small column helpers of the training-data operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a column of ids is broadcast instead of shuffled (8 bytes a row).
BROADCAST_IDS = 200_000
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_written: list[str] = []


#: Rows and bytes of an Arrow batch, so that a batch of long texts stays small on both sides.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "8m")}
#: For the Python workers: memory that is freed goes back to the system.
WORKER = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "8388608", "MALLOC_MMAP_THRESHOLD_": "4194304", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark: SparkSession) -> SparkSession:
    """Let the Python workers import this package wherever the session was started, and keep their batches small.

    Batch sizes are set only where the session still has Spark's defaults; they stay set, since the
    queries are evaluated after this returns.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    for key, value in WORKER.items():
        env.setdefault(key, value)
    given = dict(spark.sparkContext.getConf().getAll())
    for key, (default, ours) in BATCH.items():
        if key not in given and (default is None or spark.conf.get(key, default) == default):
            spark.conf.set(key, ours)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a local session gets one of its own; on a cluster that is an error, since
    executors could not read a folder of the driver's machine.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cohortmill-")
        spark.conf.set("spark.checkpoint.dir", found)
        _written.append(found)
    return found.rstrip("/")


def save(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed once, and lost executors do not matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path, compression=compression)
    _written.append(path)
    return spark.read.schema(schema).parquet(path)


@atexit.register
def _clean() -> None:
    """Best effort: remove what ``save`` wrote, while the session still lives."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in _written:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM may be gone already
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Column of a written key that no two rows share.
ROW = "__row"


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the column ROW, written, so that every use of them reads the same keys."""
    return save(rows.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in ``ids`` (rows with a null key stay).

    ``ids`` is a written table.  Its rows are counted: up to BROADCAST_IDS they are broadcast,
    beyond that both sides are shuffled.
    """
    ids = ids.select(F.col(ids.columns[0]).alias("__id")).where("__id is not null").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col(key) == F.col("__id"), "left_anti")


def deal(rows: DataFrame, keys: list[str], member: str, most: int) -> DataFrame:
    """``rows`` with the columns part and side, so that no group of ``keys`` is larger than about ``most`` rows.

    A group within the bound is left alone (part -1).  A larger one is cut into n blocks by the hash
    of ``member``; every block meets every other in a part of its own, to which both are copied, and
    ``side`` tells the blocks of a part apart.  A part of two blocks has an odd number, one of a block
    with itself an even number.
    """
    n = save(rows.groupBy(*keys).count().where(F.col("count") > most).select(*[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("count") / (most // 2)).cast("int").alias("__n")), "large-groups")
    alone = [F.lit(-1).cast("long").alias("part"), F.lit(0).alias("side")]
    if n.isEmpty():
        return rows.select("*", *alone)
    cond = [F.col(k) == F.col(f"__{k}") for k in keys]
    joined = rows.join(n, cond, "left").withColumn("__own", F.pmod(F.xxhash64(member), F.col("__n")).cast("int"))
    parts = joined.where("__n is not null").withColumn("__other", F.explode(F.expr("sequence(0, __n - 1)")))
    part = (F.least("__own", "__other").cast("long") * F.col("__n") + F.greatest("__own", "__other")) * 2 + (F.col("__own") != F.col("__other")).cast("long")
    return joined.where("__n is null").select(*rows.columns, *alone).union(parts.select(*rows.columns, part.alias("part"), F.col("__own").alias("side")))


def sorted_groups(batches, n_keys: int):
    """The groups of rows that agree in the first ``n_keys`` columns, from batches sorted by them: (keys, list of numpy columns)."""
    import numpy as np
    import pyarrow as pa

    held: list[pa.Table] = []
    key = None

    def out():
        t = pa.concat_tables(held).combine_chunks()
        return key, [c.chunk(0) for c in t.columns]

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            now = tuple(x.item() if hasattr(x := c[lo], "item") else x for c in cols)
            if held and now != key:
                yield out()
                held = []
            key = now
            held.append(t.slice(lo, hi - lo))
    if held:
        yield out()
