"""Exact deduplication with a cuckoo-filter index of live digests.

The rows are digested where they are read (SHA-256 of the whole text) and every batch is reduced
to one row a digest, so a text that a third of all rows share reaches its index as a few rows.
Digests are dealt by hash to index parts of about PER_PART, so there are more of them the more rows
there are.  A part is a cuckoo filter of 16-bit marks with two candidate buckets a key; every mark
refers to an entry of the bucketed content: the whole digest, the document that stays and the size
of the group.  Entries are only found through the filter.  A digest whose mark is in neither bucket
is new; a hit is verified against the content, so that two digests of one mark are told apart.
When an insertion finds no place, the filter is built again with twice the buckets from the stored
keys.

An index is a written table, one row a part, that outlives its session: ``insert`` and ``delete``
give a new table with digests added or taken out, ``look_up`` tells which digests are live.

Edge cases: a null text counts as empty; rows with a null doc_id belong to their group, and
keep_id is null if a group has no other (then none is kept); rows that repeat the largest doc_id
of a group are all marked as kept, being the same document; an empty table gives no rows.  The
pipeline's stage decides by rows: exactly one row of each text stays, whatever the doc_ids.
"""

from __future__ import annotations

import io
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, keyed, save, ship, table, without_ids

SLOTS = 4
KICKS = 200
#: Rows of one task that are reduced together.
REDUCED = 50_000
#: Digests of an index part, about.
PER_PART = 200_000


class LiveIndex:
    """Live keys (bytes of 16 or more, already hashed) with the document each stands for and a count."""

    def __init__(self, capacity: int = 1024) -> None:
        self.keys: list[bytes | None] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.free: list[int] = []
        self.rebuilt = self.verified = 0
        self._empty(1 << max(4, int(capacity / 0.9 / SLOTS).bit_length()))

    def _empty(self, size: int) -> None:
        self.size = size
        self.marks, self.refs = array("H", bytes(2 * size * SLOTS)), array("I", bytes(4 * size * SLOTS))

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = 1 + int.from_bytes(key[:2], "little") % 65535
        first = int.from_bytes(key[8:16], "little") & (self.size - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ ((mark * 0x5BD1E995) >> 7 & (self.size - 1))

    def _slot(self, key: bytes) -> int:
        """The slot of a live key, or -1."""
        mark, a, b = self._places(key)
        for place in (a, b) if a != b else (a,):
            for slot in range(place * SLOTS, place * SLOTS + SLOTS):
                if self.marks[slot] == mark:
                    self.verified += 1
                    if self.keys[self.refs[slot]] == key:
                        return slot
        return -1

    def maybe(self, key: bytes) -> bool:
        """What the filter alone says: never False for a live key."""
        mark, a, b = self._places(key)
        return mark in self.marks[a * SLOTS : a * SLOTS + SLOTS] or mark in self.marks[b * SLOTS : b * SLOTS + SLOTS]

    def get(self, key: bytes) -> tuple[int | None, int] | None:
        slot = self._slot(key)
        return None if slot < 0 else (self.docs[self.refs[slot]], self.counts[self.refs[slot]])

    def _place(self, mark: int, place: int, ref: int) -> bool:
        for at in (place, self._other(place, mark)):
            for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.refs[slot] = mark, ref
                    return True
        at = self._other(place, mark)
        for k in range(KICKS):
            slot = at * SLOTS + k % SLOTS
            mark, self.marks[slot] = self.marks[slot], mark
            ref, self.refs[slot] = self.refs[slot], ref
            at = self._other(at, mark)
            for slot in range(at * SLOTS, at * SLOTS + SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.refs[slot] = mark, ref
                    return True
        return False

    def insert(self, key: bytes, doc: int | None, count: int) -> None:
        """A key that is not live yet."""
        if self.free:
            ref = self.free.pop()
            self.keys[ref], self.docs[ref], self.counts[ref] = key, doc, count
        else:
            ref = len(self.keys)
            self.keys.append(key)
            self.docs.append(doc)
            self.counts.append(count)
        mark, first, _ = self._places(key)
        if not self._place(mark, first, ref):
            self._resize()

    def _resize(self) -> None:
        """Overflow: twice the buckets, from the stored keys."""
        size = self.size
        while True:
            self.rebuilt += 1
            size *= 2
            self._empty(size)
            if all(self._place(*self._places(k)[:2], ref) for ref, k in enumerate(self.keys) if k is not None):
                return

    def delete(self, key: bytes) -> bool:
        """Take a key out; False if it is not live."""
        slot = self._slot(key)
        if slot < 0:
            return False
        ref = self.refs[slot]
        self.marks[slot], self.keys[ref] = 0, None
        self.free.append(ref)
        return True

    def add(self, key: bytes, doc: int | None, count: int) -> None:
        """Count ``count`` documents of one content, of which ``doc`` has the largest id."""
        slot = self._slot(key)
        if slot < 0:
            self.insert(key, doc, count)
            return
        ref = self.refs[slot]
        self.counts[ref] += count
        if doc is not None and (self.docs[ref] is None or doc > self.docs[ref]):
            self.docs[ref] = doc

    def live(self) -> list[tuple[bytes, int | None, int]]:
        return [(k, d, n) for k, d, n in zip(self.keys, self.docs, self.counts, strict=True) if k is not None]

    def to_bytes(self) -> bytes:
        out, rows = io.BytesIO(), self.live()
        number = {k: i for i, (k, _, _) in enumerate(rows)}
        refs = np.array([number.get(self.keys[r], 0) if m else 0 for m, r in zip(self.marks, self.refs, strict=True)], np.uint32)
        ids = np.array([0 if d is None else d for _, d, _ in rows], np.int64)
        np.savez(out, marks=np.array(self.marks, np.uint16), refs=refs, keys=np.frombuffer(b"".join(k for k, _, _ in rows), np.uint8), docs=ids, known=np.array([d is not None for _, d, _ in rows], bool), counts=np.array([n for _, _, n in rows], np.int64))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> LiveIndex:
        with np.load(io.BytesIO(data), allow_pickle=False) as z:
            self = cls(1)
            self.counts = z["counts"].tolist()
            n = len(self.counts)
            raw = z["keys"].tobytes()
            width = len(raw) // n if n else 0
            self.keys = [raw[i * width : (i + 1) * width] for i in range(n)]
            self.docs = [d if known else None for d, known in zip(z["docs"].tolist(), z["known"].tolist(), strict=True)]
            self.size = len(z["marks"]) // SLOTS
            self.marks, self.refs = array("H", z["marks"].tobytes()), array("I", z["refs"].tobytes())
        return self


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a digest and REDUCED rows: the largest id and the number of rows."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by("digest").aggregate([("doc_id", "max"), ("digest", "count")])
        yield from pa.table({"digest": t["digest"], "doc_id": t["doc_id_max"], "n": t["digest_count"].cast(pa.int64())}).combine_chunks().to_batches()
        held.clear()

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= REDUCED:
            yield from out()
    if held:
        yield from out()


_CHANGES = "part int, kind int, digest binary, doc_id long, n long, state binary"
_INDEX = "part int, parts int, state binary"


def _changed(parts: int):
    """Rows part, kind (0 a stored part, 1 insert, 2 delete), sorted by both: the new state of every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, live = None, LiveIndex()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([parts], pa.int32()), pa.array([live.to_bytes()], pa.binary())], ["part", "parts", "state"])

        for b in batches:
            for p, kind, key, doc, n, state in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    if part is not None:
                        yield out()
                    part, live = p, LiveIndex()
                if kind == 0:
                    live = LiveIndex.from_bytes(state)
                elif kind == 1:
                    live.add(key, doc, n)
                else:
                    live.delete(key)
        if part is not None:
            yield out()

    return run


def _of_part(parts: int) -> Column:
    return F.pmod(F.crc32("digest"), F.lit(parts)).cast("int")


def _write(changes: DataFrame, parts: int) -> DataFrame:
    dealt = changes.repartitionById(parts, "part").sortWithinPartitions("part", "kind")
    return save(dealt.mapInArrow(_changed(parts), _INDEX), "cuckoo-index")


def _inserts(rows: DataFrame, parts: int) -> DataFrame:
    reduced = rows.select("digest", "doc_id").mapInArrow(_reduce, "digest binary, doc_id long, n long")
    return reduced.select(_of_part(parts).alias("part"), F.lit(1).alias("kind"), "digest", "doc_id", "n", F.lit(None).cast("binary").alias("state"))


def build(rows: DataFrame) -> DataFrame:
    """The index of ``rows`` (digest binary, doc_id long; a written table): part, parts, state."""
    spark = ship(rows.sparkSession)
    return _write(_inserts(rows, parts := max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PER_PART))), parts)


def _stored(index: DataFrame) -> tuple[DataFrame, int]:
    parts = index.agg(F.max("parts")).first()[0] or 1
    return index.select("part", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n"), "state"), parts


def insert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """A new index table with the documents ``rows`` (digest, doc_id) added."""
    ship(index.sparkSession)
    old, parts = _stored(index)
    return _write(old.union(_inserts(rows, parts)), parts)


def delete(index: DataFrame, digests: DataFrame) -> DataFrame:
    """A new index table without the ``digests`` (column digest): texts taken out of the corpus, which are new when they come again."""
    ship(index.sparkSession)
    old, parts = _stored(index)
    gone = digests.select(_of_part(parts).alias("part"), F.lit(2).alias("kind"), "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("state"))
    return _write(old.union(gone), parts)


def entries(index: DataFrame) -> DataFrame:
    """digest, keep_id and group_size of every live digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for state in b.column(0).to_pylist():
                live = LiveIndex.from_bytes(state).live()
                for i in range(0, len(live), 50_000):
                    k, d, n = zip(*live[i : i + 50_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(d, pa.int64()), pa.array(n, pa.int64())], ["digest", "keep_id", "group_size"])

    ship(index.sparkSession)
    return index.select("state").mapInArrow(run, "digest binary, keep_id long, group_size long")


def look_up(index: DataFrame, digests: DataFrame) -> DataFrame:
    """digest, live, keep_id and group_size of every row of ``digests`` (column digest)."""
    found = entries(index).withColumnRenamed("digest", "d")
    return digests.join(found, F.col("digest") == F.col("d"), "left").select("digest", F.col("d").isNotNull().alias("live"), "keep_id", "group_size")


def groups(rows: DataFrame) -> DataFrame:
    """digest, keep_id and group_size of every distinct digest in ``rows`` (digest binary, doc_id long; a written table)."""
    return entries(build(rows))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row, and its columns ``carry``.

    Shuffled are only digests: the reduced ones to the index, and all with their doc_id to the
    groups of two and more (a plain equi-join that Spark splits where a group is large).
    """
    rows = save(docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(digest(F.col(text))).alias("digest"), *carry), "digests")
    copies = groups(rows).where("group_size > 1").select(F.col("digest").alias("d"), "keep_id", "group_size")
    out = rows.join(copies, F.col("digest") == F.col("d"), "left")
    keep = F.when(F.col("d").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *carry)


def keep_last(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts one row, that with the largest doc_id (of several such rows, or if no row has one, the first)."""
    rows = keyed(docs)
    copies = save(exact_groups(rows, carry=(ROW,)).where("group_size > 1").select("text_sha256", ROW, (F.col("kept") | F.col("keep_id").isNull()).alias("may")), "copies")
    stay = copies.where("may").groupBy("text_sha256").agg(F.min(ROW).alias("stays")).select("stays")
    gone = save(copies.select(ROW).join(stay, F.col(ROW) == F.col("stays"), "left_anti"), "gone-copies")
    return without_ids(rows, gone, ROW).drop(ROW)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP7_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       coalesce(doc_id = max(doc_id) over w, false) as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
