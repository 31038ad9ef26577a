"""Connected components of a distributed list of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Nodes that one task keeps before it passes on what it has contracted.
NODES = 100_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task; emits (node, smallest node reached here)."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        r = x
        while (p := up.setdefault(r, r)) != r:
            r = p
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in up if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x < y:
                up[y] = x
            elif y < x:
                up[x] = y
        if len(up) > NODES:
            yield out()
            up.clear()
    yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns) that is not its component's smallest.

    Each task first contracts its own links; then alternating large-star and small-star steps
    run until nothing changes.  Every step is a group minimum and a join, written to the
    shared folder.  Links with a null end are ignored; an empty table gives no rows.
    """
    a, b = links.columns[:2]
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    # the exchange keeps what made the links and the contraction from running Python workers side by side
    now, seen = save(links.distinct().mapInArrow(_contract, "a long, b long").distinct(), "cc"), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, large.a == least.n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = save(small.union(least.select("n", "m")).distinct(), "cc")
        sign = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if sign == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign
