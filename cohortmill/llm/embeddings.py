"""Near-duplicate embeddings by spherical-cap filters.

Every vector is rotated by a few random rotations.  After each, its two halves are compared with K
random directions a half (a product code of K x K filter directions); the vector is listed under
all directions whose score exceeds a threshold.  Two vectors of cosine 0.95 share a filter with
high probability, two unrelated ones hardly ever, so vectors are joined on filters and their exact
cosine is verified in double precision.  The number of directions grows with the number of vectors,
so that a filter holds about LOAD of them.  The threshold lists a vector under LISTED filters a
rotation on average; it comes from the tail of the scores of unit vectors, not from a normal one.
The more directions, the rarer it is that one rotation lists two near vectors together, so the number
of rotations grows too: as many as keep the share of pairs of cosine 0.95 without a common filter
at MISSED, for every number of vectors.

Equal vectors are one class and enter once.  A filter gives stars of the linked parts, not pairs;
the components of the stars follow.  Then, inside each component, all classes are compared exactly
in blocks, so the number of links does not depend on which filters found them.  Filters and
components larger than CELL are dealt to several tasks by pairs of blocks.

Edge cases: null and empty vectors, zero vectors, and such with null or non-finite components link
with nothing; vectors of different length do not link; rows with a null vec_id link like any other,
and a component's id is the smallest vec_id that is not null (null if there is none, and none is kept);
rows that repeat a vec_id count as vectors of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _ranges
from .common import deal, save, ship, sorted_groups, table
from .graph import components

LISTED = 0.75
MISSED = 2e-4
LOAD = 40
#: Pairs and rotations by which the share of pairs that a rotation lists together is measured.
TRIALS = (256, 24)
CELL = 4096
#: Numbers from here on stand for classes of vectors that have no vec_id.
NAMELESS = 1 << 62
SEED = 20_240_229


def code_size(n: int) -> int:
    """Directions a half, so that a filter holds LOAD of n vectors on average; 32 at least."""
    return max(32, math.ceil(math.sqrt(max(n, 1) * LISTED / LOAD)))


def score_limit(half: int, share: float) -> float:
    """The score that a random unit vector of two halves exceeds for this share of the filters.

    A score is r s + sqrt(1 - r^2) t: r is the length of the first half (r^2 has a beta
    distribution), s and t are cosines of random directions of ``half`` dimensions.
    """
    angle = (np.arange(256) + 0.5) * (math.pi / 512)
    r, weight = np.cos(angle), (np.cos(angle) * np.sin(angle)) ** (half - 1)
    weight /= weight.sum()
    t = np.linspace(-1, 1, 2001)
    mid = (t[1:] + t[:-1]) / 2
    p = (1 - mid**2) ** ((half - 3) / 2)
    p /= p.sum()
    tail = np.concatenate((np.cumsum(p[::-1])[::-1], [0.0]))
    low, high = 0.0, math.sqrt(2)
    for _ in range(40):
        limit = (low + high) / 2
        above = np.interp((limit - r[:, None] * mid) / np.sqrt(1 - r**2)[:, None], t, tail)
        low, high = (limit, high) if weight @ (above @ p) > share else (low, limit)
    return (low + high) / 2


@lru_cache(maxsize=64)
def plan(width: int, k: int) -> tuple[float, int]:
    """Threshold and number of rotations for vectors of ``width`` components and k directions a half."""
    limit, half = score_limit(width // 2, LISTED / (k * k)), width // 2
    rng = np.random.default_rng([SEED, width, k])
    pairs, turns = TRIALS
    shared = 0
    for _ in range(turns):
        x, z = _unit(rng.standard_normal((pairs, width))), rng.standard_normal((pairs, width))
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * _unit(z - (z * x).sum(axis=1, keepdims=True) * x)
        sets = _directions(rng, half, k)
        rows = []
        for v in (x, y):
            row, found = _exceed(v[:, :half] @ sets[0], v[:, half:] @ sets[1], limit)
            rows.append(row * (k * k) + found)
        shared += len(np.unique(np.intersect1d(*rows) // (k * k)))
    share = (shared - 2 * math.sqrt(shared)) / (pairs * turns)  # two standard errors on the safe side
    if share <= 0:
        raise ValueError(f"no filters for {width} components and {k} directions")
    return limit, math.ceil(math.log(MISSED) / math.log1p(-share))


def _directions(rng: np.random.Generator, half: int, k: int) -> np.ndarray:
    sets = rng.standard_normal((2, half, k))
    return sets / np.linalg.norm(sets, axis=1, keepdims=True)


def _exceed(a: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, pair of directions) whose scores ``a`` and ``b`` add up to ``limit``: list decoding of the two halves."""
    va, ka = np.nonzero(a >= limit - b.max(axis=1)[:, None])
    vb, kb = np.nonzero(b >= limit - a.max(axis=1)[:, None])
    first = np.searchsorted(vb, va)
    n = np.searchsorted(vb, va, side="right") - first
    ia, ib = np.repeat(np.arange(len(va)), n), _ranges(first, n)
    ok = a[va[ia], ka[ia]] + b[vb[ib], kb[ib]] >= limit
    return va[ia[ok]], ka[ia[ok]] * a.shape[1] + kb[ib[ok]]


class ProductCode:
    """Rotations, and for each two sets of K directions, for vectors of one length."""

    def __init__(self, dim: int, k: int) -> None:
        self.dim, self.k, self.width = dim, k, max(32, dim + dim % 2)
        self.limit, n = plan(self.width, k)
        rng = np.random.default_rng([SEED, dim, k])
        self.codes = []
        for _ in range(n):
            turn, _ = np.linalg.qr(rng.standard_normal((self.width, self.width)))
            self.codes.append((turn[:dim], _directions(rng, self.width // 2, k)))

    def filters(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for all filters that the unit vectors ``x`` exceed."""
        rows, found = [], []
        h = self.width // 2
        for c, (turn, sets) in enumerate(self.codes):
            y = x @ turn
            row, pair = _exceed(y[:, :h] @ sets[0], y[:, h:] @ sets[1], self.limit)
            rows.append(row)
            found.append(c * self.k * self.k + pair)
        return np.concatenate(rows), np.concatenate(found)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, by a power of two, so that squares neither overflow nor vanish and no bit is lost."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


def _matrix(col: pa.Array) -> np.ndarray:
    """The vectors of one length in double precision, scaled."""
    return _scaled(col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64)) if len(col) else np.zeros((0, 1))


def _filtered(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, ProductCode] = {}
        for b in batches:
            length = np.diff(b.column(1).offsets.to_numpy())
            for dim in np.unique(length).tolist():
                at = np.flatnonzero(length == dim)
                if dim not in known:
                    known[dim] = ProductCode(dim, k)
                code = known[dim]
                for i in range(0, len(at), 1024):
                    part = b.take(pa.array(at[i : i + 1024]))
                    rows, found = code.filters(_unit(_matrix(part.column(1))))
                    picked = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim), pa.int32()), pa.array(found, pa.int64()), *picked.columns], ["dim", "filter", "node", "vector"])

    return run


def _stars(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, _, _, node, vector) in sorted_groups(batches, 3):
            if len(node) < 2:
                continue
            x, node = _matrix(vector), node.to_numpy()
            left, a_out, b_out = np.arange(len(x)), [], []
            while len(left) > 1:
                root, front, left = left[0], left[:1], left[1:]
                while len(front) and len(left):
                    hit = (_cosine(x[front[:128]], x[left]) >= limit).any(axis=0)
                    found, left = left[hit], left[~hit]
                    a_out.append(node[found])
                    b_out.append(np.full(len(found), node[root]))
                    front = np.concatenate((front[128:], found))
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a_out, b_out)], ["a", "b"])

    return run


def _counts(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, part), (_, _, _, side, node, n, vector) in sorted_groups(batches, 3):
            x, node, n, side = _matrix(vector), node.to_numpy(), n.to_numpy().astype(np.float64), side.to_numpy()
            sums = np.zeros(len(x))
            two = part >= 0 and part % 2 == 1
            for i in range(0, len(x), 512):
                near = _cosine(x[i : i + 512], x) >= limit
                if two:
                    near &= side[i : i + 512][:, None] != side[None, :]
                else:
                    near[np.arange(len(near)), np.arange(i, i + len(near))] = False
                sums[i : i + 512] = near @ n
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sums.astype(np.int64))], ["node", "links"])

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", limit: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    ship(vectors.sparkSession)
    # vectors of floats are shipped as such, and compared in double precision
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    v = F.col(vector).cast(kind)
    usable = F.size(v) > 0
    usable &= ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = save(vectors.select(F.col(key).cast("long").alias("id"), F.when(F.coalesce(usable, F.lit(False)), v).alias("vector")), "vectors")
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64("vector"), F.lit(NAMELESS // 2))
    classes = save(rows.where("vector is not null").groupBy("vector").agg(F.coalesce(F.min("id"), nameless).alias("node"), F.count("*").alias("n")), "vector-classes")
    k = code_size(classes.count())
    listed = classes.select("node", "vector").mapInArrow(_filtered(k), f"dim int, filter long, node long, vector {kind}")
    dealt = deal(save(listed, "filters"), ["dim", "filter"], "node", CELL)
    order = ["dim", "filter", "part"]
    found = dealt.select("dim", "filter", "part", "node", "vector").repartition(*order).sortWithinPartitions(*order)
    roots = components(found.mapInArrow(_stars(limit), "a long, b long"))
    member = save(classes.join(roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("node", "n", "vector", F.coalesce("root", "node").alias("root")), "vector-members")
    # components of two classes and more, in blocks
    linked = save(roots.select("root").distinct().withColumnRenamed("root", "r"), "vector-roots")
    inside = member.join(linked, F.col("root") == F.col("r"), "left_semi").withColumn("dim", F.size("vector"))
    order = ["dim", "root", "part"]
    blocks = deal(inside, ["dim", "root"], "node", CELL).select("dim", "root", "part", "side", "node", "n", "vector").repartition(*order).sortWithinPartitions(*order)
    links = blocks.mapInArrow(_counts(limit), "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "l")
    named = member.join(links, F.col("node") == F.col("l"), "left").select(F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("root"))
    out = rows.join(named, F.col("vector") == F.col("v"), "left")
    component = F.when(F.col("v").isNull(), F.col("id")).when(F.col("root") < NAMELESS, F.col("root"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
