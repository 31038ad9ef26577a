"""Token ids in files, compressed by a grammar per shard (Re-Pair).

Texts are encoded where they are read, and only their ids (two bytes each) are sorted by doc_id.  A
shard is a run of documents in ascending doc_id order.  Its ids are compressed by replacing frequent
pairs of neighbouring ids by new symbols, again and again until no pair stands LEAST times in the
shard or the symbols run out; pairs never reach across two documents, so every document stays a run
of symbols of its own and can be decoded alone.

A file row holds one shard, in this format (little endian):

    magic  "RPG1"
    u32    first new symbol S; u32 number of rules R; u32 number of documents D; u32 number of symbols N
    u16    R x (left, right): the pair that symbol S + k stands for, only of smaller symbols
    u32    R x expansion length of each rule, in ids
    u32    D x symbols of each document;  u32 D x ids of each document
    u16    N x symbol

Edge cases: null and empty texts hold the end id alone; rows with a null doc_id come first; rows
that share a doc_id are ordered by their ids (by a hash of them first, if they are too many for one
range); an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _ranges, encoder, sliced, vocabulary
from .common import save, ship, table

MAGIC = b"RPG1"
#: Ids of a shard; the last document may go beyond.
SHARD_IDS = 1_500_000
#: Bytes of text of a range of doc_ids, about (one task), and ranges at most; a range gives as many shards as it needs.
RANGE_BYTES = 16_000_000
MOST_RANGES = 20_000
#: A pair is replaced if it stands this often in its shard; a rule takes as much room as four symbols.
LEAST = 24
#: Odd multipliers that place the pairs in the slots, one round after the other.
_TURNS = np.array([pow(0x9E3779B1, 2 * k + 1, 1 << 32) for k in range(8)], np.uint32)
#: Slots of the pair counter at most.
SLOT_BITS = 20


def _counted(keys: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each pair, occurrences of each slot, pair of each slot); the last slot holds the pairs that wait.

    Exact counts without a sort: each slot counts the one pair that owns it, and a pair whose slot
    another one owns waits for the next round, whose slots are others.
    """
    bits = min(max(len(keys).bit_length() + 1, 10), SLOT_BITS)
    slots = 1 << bits
    slot = ((keys * _TURNS[turn % len(_TURNS)]) >> np.uint32(32 - bits)).astype(np.int32)
    owner = np.zeros(slots + 1, np.uint32)
    owner[slot] = keys
    slot[owner[slot] != keys] = slots
    return slot, np.bincount(slot, minlength=slots + 1), owner


def compress(ids: np.ndarray, counts: np.ndarray, first_new: int) -> bytes:
    """One shard: all ids of its documents, and the number of ids of each (1 at least).

    After the first round only the places where a pair can have become frequent, or still is, are
    counted: those beside new symbols, those of frequent pairs that were not replaced, and those
    that wait.  The counts of all other pairs can only fall.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(counts) - 1] = True
    rules: list[np.ndarray] = []
    made, room, turn = 0, 65536 - first_new, 0
    at = np.flatnonzero(~last[:-1]) if len(seq) else np.zeros(0, np.int64)  # places whose pairs are counted, in order
    while len(at) and made < room:
        slot, n, owner = _counted((seq[at] << np.uint32(16)) | seq[at + 1], turn)
        slots, turn = len(n) - 1, turn + 1
        wait = at[slot == slots]
        n[slots] = 0
        good = np.flatnonzero(n >= LEAST)
        good = good[np.argsort(-n[good], kind="stable")][: room - made]
        if not len(good):
            at = wait  # in other slots
            continue
        # of two pairs that overlap the more frequent one goes first: an occurrence stays if its
        # rank is at least as good as its neighbours'; in a run of one pair, every second one stays
        rank = np.full(slots + 1, -1, np.int32)
        rank[good] = np.arange(len(good), dtype=np.int32)
        here = rank[slot]
        some = np.flatnonzero(here >= 0)
        at, here = at[some], here[some]
        beside = np.diff(at) == 1
        best = np.ones(len(at), bool)
        best[1:] &= ~beside | (here[1:] <= here[:-1])
        best[:-1] &= ~beside | (here[:-1] <= here[1:])
        pos, ranks, rest = at[best], here[best], at[~best]
        run = np.flatnonzero(np.diff(pos, prepend=-9) != 1)
        first = np.repeat(run, np.diff(run, append=len(pos)))
        odd = (np.arange(len(pos)) - first) % 2 == 1
        pos, ranks = pos[~odd], ranks[~odd]
        used = np.flatnonzero(np.bincount(ranks, minlength=len(good)))
        name = np.zeros(len(good), np.uint32)
        name[used] = np.arange(len(used), dtype=np.uint32)
        rules.append(owner[good[used]].astype(np.int64))
        seq[pos] = np.uint32(first_new + made) + name[ranks]
        last[pos] |= last[pos + 1]
        stays = np.ones(len(seq), bool)
        stays[pos + 1] = False
        seq, last = seq[stays], last[stays]
        near = np.zeros(len(seq) + 1, bool)
        moved = pos - np.arange(len(pos))  # places of the new symbols
        near[moved] = True
        near[moved[moved > 0] - 1] = True
        old = np.concatenate((rest, wait))
        old = old[stays[old]]
        near[old - np.searchsorted(pos + 1, old)] = True
        near[:-1] &= ~last
        at = np.flatnonzero(near[:-1])
        at = at[at + 1 < len(seq)]
        made += len(used)
    pairs = np.concatenate(rules) if rules else np.zeros(0, np.int64)
    rule = np.stack([pairs >> 16, pairs & 0xFFFF], axis=1).astype("<u2")
    lengths = expansion_lengths(rule, first_new)[first_new:]
    symbols = np.diff(np.flatnonzero(last), prepend=-1)
    head = struct.pack("<4I", first_new, len(rule), len(counts), len(seq))
    return b"".join([MAGIC, head, rule.tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), seq.astype("<u2").tobytes()])


def _levels(rule: np.ndarray, first_new: int) -> Iterator[tuple[int, int]]:
    """Runs of rules (from, to) whose symbols are all made before the run."""
    most, at = rule.max(axis=1).astype(np.int64), 0
    while at < len(rule):
        late = np.flatnonzero(most[at:] >= first_new + at)
        end = at + int(late[0]) if len(late) else len(rule)
        yield at, end
        at = end


def expansion_lengths(rule: np.ndarray, first_new: int) -> np.ndarray:
    """The number of ids that each symbol stands for."""
    n = np.ones(first_new + len(rule), np.int64)
    for a, b in _levels(rule, first_new) if len(rule) else ():
        n[first_new + a : first_new + b] = n[rule[a:b, 0]] + n[rule[a:b, 1]]
    return n


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        s, r, d, n = struct.unpack_from("<4I", data, 4)
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, count, at)
            at += x.nbytes
            return x

        rule, lengths = take("<u2", 2 * r).reshape(r, 2), take("<u4", r)
        self.symbols, self.counts, self.seq = take("<u4", d).astype(np.int64), take("<u4", d).astype(np.int64), take("<u2", n)
        self.begin = np.cumsum(self.symbols) - self.symbols
        self.len = np.concatenate((np.ones(s, np.int64), lengths.astype(np.int64)))
        self.at = np.cumsum(self.len) - self.len
        self.flat = np.zeros(int(self.len.sum()), np.uint32)
        self.flat[:s] = np.arange(s)
        for a, b in _levels(rule, s) if r else ():
            parts = rule[a:b].ravel()  # left, right, left, right: what the rules of this run stand for, one after the other
            self.flat[self.at[s + a] : self.at[s + b - 1] + self.len[s + b - 1]] = self.flat[_ranges(self.at[parts], self.len[parts])]

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of the documents first, first + 1, ... last - 1, one after the other."""
        if last <= first:
            return np.zeros(0, np.uint32)
        seq = self.seq[self.begin[first] : self.begin[last - 1] + self.symbols[last - 1]]
        return self.flat[_ranges(self.at[seq], self.len[seq])]


def _key(c: Column) -> Column:
    """doc_id as a number, null first."""
    return F.coalesce(c.cast("long"), F.lit(-(1 << 63)))


def _splits(docs: DataFrame) -> np.ndarray:
    """Keys that part the rows into ranges of about RANGE_BYTES of text, sorted; one that many rows share comes more than once."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = min(max(1, -(-size // RANGE_BYTES)), max(1, n), MOST_RANGES)
    if parts == 1:
        return np.zeros(0, np.int64)
    shares = [k / parts for k in range(1, parts)]
    return np.array(docs.agg(F.percentile_approx(_key(F.col("doc_id")), shares, 20 * parts)).first()[0], np.int64)


def encoded(docs: DataFrame, splits: np.ndarray, path: str, end_id: int = 0) -> DataFrame:
    """part (number of the range), doc_id, hash and ids (two bytes each, little endian, the end id last) of every row.  A map over the rows.

    Rows of a key that is a split more than once are dealt to its ranges by hash, in that order.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        if enc.size > 1 << 16:
            raise ValueError("the format holds vocabularies of up to 65,536 ids")
        for whole in batches:
            for b in sliced(whole, 2):
                got, end = enc.encode(b.column(2).to_pylist()), np.array([end_id], np.uint32)
                data = np.concatenate([x for ids in got for x in (ids, end)]).astype("<u2")
                ends = np.cumsum([2 * len(ids) + 2 for ids in got])
                key = b.column(0).to_numpy()
                low, part = np.searchsorted(splits, key, side="left"), np.searchsorted(splits, key, side="right")
                mark = np.zeros(len(got), np.int64)
                for i in np.flatnonzero(part - low > 1):
                    mark[i] = zlib.crc32(got[i].tobytes())
                    part[i] = low[i] + 1 + int(mark[i]) * int(part[i] - low[i]) // (1 << 32)
                ids = pa.Array.from_buffers(pa.binary(), len(got), [None, pa.py_buffer(np.concatenate(([0], ends)).astype("<i4")), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(1), pa.array(mark), ids], ["part", "doc_id", "hash", "ids"])

    rows = docs.select(_key(F.col("doc_id")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "part int, doc_id long, hash long, ids binary")


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode every text, append ``end_id``, and write the shards in ascending doc_id order.

    One shuffle, of ids: the rows go to ranges of doc_id.  Returns the written table: part (number
    of the range), seq (of the shard in it), n_ids, doc_ids, data.
    """
    vocab = path or vocabulary()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    splits = _splits(rows)
    order = [F.col("doc_id").asc_nulls_first(), "hash", "ids"]
    ranged = encoded(rows, splits, vocab, end_id).repartitionById(len(splits) + 1, "part").sortWithinPartitions("part", *order).select("part", "doc_id", "ids")
    first_new = encoder(vocab).size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = None, 0, 0
        keys: list[int | None] = []
        got: list[bytes] = []

        def shard() -> pa.RecordBatch:
            counts = np.fromiter(map(len, got), np.int64, len(got)) // 2
            data = compress(np.frombuffer(b"".join(got), "<u2"), counts, first_new)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(counts.sum())], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["part", "seq", "n_ids", "doc_ids", "data"])

        for b in batches:
            for p, key, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if got and (p != part or held >= SHARD_IDS):
                    yield shard()
                    keys, got, held, seq = [], [], 0, seq + 1
                part = p
                keys.append(key)
                got.append(ids)
                held += len(ids) // 2
        if got:
            yield shard()

    return save(ranged.mapInArrow(run, "part int, seq int, n_ids long, doc_ids array<long>, data binary"), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of long) from written shards."""
    return _read(shards, "ids array<long>", lambda each: pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))


def _read(shards: DataFrame, column: str, form) -> DataFrame:
    ship(shards.sparkSession)
    # ids of all shards before each: a running sum over one row a part, then one inside each part
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("__n"))
    parts = parts.select(F.col("part").alias("__p"), (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("__before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    places = shards.select("part", "seq", inner.alias("__inner")).join(parts, F.col("part") == F.col("__p")).select(F.col("part").alias("__p"), F.col("seq").alias("__s"), (F.col("__before") + F.col("__inner")).alias("start"))
    df = shards.join(places, (F.col("part") == F.col("__p")) & (F.col("seq") == F.col("__s"))).select("start", "doc_ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                start, keys, shard = b.column(0)[i].as_py(), b.column(1)[i].as_py(), Shard(b.column(2)[i].as_py())
                counts = shard.counts
                at = np.cumsum(counts) - counts
                for lo in range(0, len(shard), 2048):
                    hi = min(lo + 2048, len(shard))
                    ids = shard.ids(lo, hi)
                    each = np.split(ids, (at[lo + 1 : hi] - at[lo]).tolist())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi], pa.int64()), pa.array(start + at[lo:hi], pa.int64()), pa.array(counts[lo:hi], pa.int64()), form(each)], ["doc_id", "start", "n_tokens", column.split()[0]])

    return df.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(table(spark, sf_dir, "documents"))
    return _read(shards, "ids_crc32 long", lambda each: pa.array([zlib.crc32(x.astype("<u4", copy=False).tobytes()) for x in each], pa.int64()))
