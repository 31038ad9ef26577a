"""SimHash near-duplicates by segment popcounts.

A fingerprint of 64 bits is cut into segments of two bits; its embedding holds the number of set
bits of every segment, each written in unary (0 -> 00, 1 -> 01, 2 -> 11).  The Manhattan distance
of two embeddings is then the popcount of their XOR, and never more than the Hamming distance of
the fingerprints.  So links at distance 3 are sought by a range join under Manhattan distance 3:
the 32 segments form six blocks, and of two embeddings within 3 at least three blocks are equal.
For each of the 20 choices of three blocks, embeddings that agree there share a grid cell: cells of
width one in 20 grids of half the dimensions each, instead of neighbouring cells of one grid in all 32,
of which there are far more than points.  Inside
a cell the Manhattan distance is tested first and the Hamming distance verifies what is left.

Distinct fingerprints only enter the grid, once for all their documents.  A cell gives no pairs,
only a star from each connected part of it, so its output is never larger than its input.  A cell
of more than CELL fingerprints is dealt to several tasks, one for each pair of blocks of it.

Edge cases: null and empty texts have the fingerprint zero and are linked like any other; rows
with a null doc_id take part through their fingerprint, and a component's id is the smallest doc_id
that is not null (null if there is none); repeated rows share one component; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import sliced
from .common import ROW, deal, keyed, save, ship, table, without_ids
from .graph import components

RADIUS = 3
#: Segments of two bits in each of the six blocks.
BLOCKS = (6, 6, 5, 5, 5, 5)
#: Fingerprints that one task compares with each other.
CELL = 8192
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles of a text, by XXH64 with seed 42; bit set if in over half."""
    from xxhash import xxh64_intdigest as h

    parts = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not parts:
        return 0
    data = b" ".join(parts)
    if len(parts) < words:
        return h(data, 42)  # one shingle: more than half is all of it
    lens = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lens)
    starts = (ends - lens)[: len(parts) - words + 1].tolist()
    got = np.fromiter([h(data[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64, len(starts))
    if len(got) == 1:
        return int(got[0])
    n = np.zeros(64, np.int64)
    for i in range(0, len(got), 1 << 15):
        n += np.unpackbits(got[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * n > len(got)).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), one row per row.  A map over the rows."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, 1):
                got = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


def embed(fp: Column) -> Column:
    """Unary popcounts of the 32 segments of two bits, as one long."""
    odd = 0x5555555555555555
    low, high = fp.bitwiseAND(F.lit(odd)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(odd))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def masks() -> list[int]:
    """For each choice of three blocks the mask that keeps their segments, as signed longs."""
    blocks, at = [], 0
    for n in BLOCKS:
        blocks.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    out = [sum(x) for x in combinations(blocks, len(BLOCKS) - RADIUS)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x b: within RADIUS by the Manhattan distance of the embeddings, then by the Hamming distance."""
    odd = np.uint64(0x5555555555555555)

    def unary(x: np.ndarray) -> np.ndarray:
        low, high = x & odd, (x >> np.uint64(1)) & odd
        return (low | high) | ((low & high) << np.uint64(1))

    maybe = np.bitwise_count(unary(a)[:, None] ^ unary(b)[None, :]) <= RADIUS
    maybe &= np.bitwise_count(a[:, None] ^ b[None, :]) <= RADIUS
    return maybe


def _stars(fp: np.ndarray, node: np.ndarray, side: np.ndarray | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (node, first node of its part) among the fingerprints of one cell; with ``side``, only between the two sides."""
    a_out, b_out = [], []
    left = np.arange(len(fp))
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = _near(fp[front[:128]], fp[left])
            if side is not None:
                near &= side[front[:128]][:, None] != side[left][None, :]
            hit = near.any(axis=0)
            found, left = left[hit], left[~hit]
            a_out.append(node[found])
            b_out.append(np.full(len(found), node[root]))
            front = np.concatenate((front[128:], found))
    return a_out, b_out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows cell, part, side, fp, node, sorted by cell and part: the stars of every cell."""
    rest: pa.Table | None = None

    def stars(t: pa.Table, done: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
        cols = [t.column(i).to_numpy() for i in range(t.num_columns)]
        k, c, p = cols[0], cols[1], cols[2]
        new = np.flatnonzero((np.diff(k) != 0) | (np.diff(c) != 0) | (np.diff(p) != 0)) + 1
        edges = np.concatenate(([0], new, [len(c)] if done else [])).astype(np.int64)
        fp, node, side = cols[4].view(np.uint64), cols[5], cols[3]
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        linked = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        a_out, b_out = [node[linked]], [node[linked + 1]]
        for at, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            split = side[at : at + n] if p[at] >= 0 and p[at] % 2 == 1 else None
            a, b = _stars(fp[at : at + n], node[at : at + n], split)
            a_out += a
            b_out += b
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a_out, b_out)], ["a", "b"])
        return out, None if done else t.slice(int(edges[-1]))

    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows > 1:
            out, rest = stars(rest.combine_chunks(), False)
            yield out
    if rest is not None and rest.num_rows:
        yield stars(rest.combine_chunks(), True)[0]


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """(node, root): components of the distinct fingerprints ``fps`` (fp, node) at distance RADIUS.

    The grid needs one shuffle of 20 narrow rows a fingerprint.
    """
    emb = embed(F.col("fp"))
    cells = fps.where("node is not null").select("fp", "node", F.posexplode(F.array(*[emb.bitwiseAND(F.lit(m)) for m in masks()])).alias("k", "cell"))
    dealt = deal(cells, ["k", "cell"], "fp", CELL)
    ship(fps.sparkSession)
    spread = dealt.repartition("k", "cell", "part").sortWithinPartitions("k", "cell", "part", "fp").select(F.col("k").cast("int"), F.col("cell").cast("long"), F.col("part").cast("long"), F.col("side").cast("int"), F.col("fp").cast("long"), F.col("node").cast("long"))
    return components(spread.mapInArrow(_cells, "a long, b long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fp and component_id for every row."""
    rows = save(fingerprints(docs, key, text, words), "fingerprints")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # narrow rows that the grid multiplies: keep them apart
    fps = save(rows.groupBy("fp").agg(F.min("doc_id").alias("node")).repartition(spread, "fp"), "distinct-fingerprints")
    roots = link_fingerprints(fps)
    named = fps.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "node").alias("component_id"))
    return rows.join(named, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each component one row of ``docs``, that with the smallest doc_id (of several such rows, or if no row has one, the first)."""
    rows = keyed(docs)
    near = save(near_duplicates(rows, ROW).select(F.col("doc_id").alias("r"), F.col("component_id").alias("c")), "near-rows")
    many = near.groupBy("c").count().where("count > 1").select(F.col("c").alias("m"))
    member = near.join(many, F.col("c") == F.col("m"), "left_semi").join(rows.select(ROW, F.col("doc_id").cast("long").alias("id")), F.col("r") == F.col(ROW)).select("c", "r", "id")
    member = save(member, "near-copies")
    stay = member.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r")).alias("least")).select(F.col("least.r").alias("stays"))
    gone = save(member.select("r").join(stay, F.col("r") == F.col("stays"), "left_anti"), "gone-near-copies")
    return without_ids(rows, gone, ROW).drop(ROW)
