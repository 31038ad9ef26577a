"""Byte-level BPE by forced boundaries.

Two bytes that never stand next to each other inside any token of the vocabulary can never be
merged, so between them every encoding is cut.  A text is cut there, the fragments are encoded
independently, and their ids are concatenated.

A cut is made in front of white space that follows another character (the pair table forbids a
merge there, which is checked when the vocabulary is loaded, and the pre-splitting rule of the
tokenizer cuts there too), and inside a run of non-space at every forbidden pair of ASCII
characters which the pre-splitting rule treats alike on both sides.  The fragments of a batch are
hashed, equal ones are encoded once, and a bounded dictionary keeps them for the next batch.  The
ids of a batch are decoded again and compared with its bytes, so a hash shared by two fragments
cannot go unnoticed; such a text is encoded whole.

Edge cases: null and empty texts have no ids; special tokens written out in a text become their
ids, as the library does; long texts are handled whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table

#: Fragments kept in a worker's dictionary; beyond that it starts anew.
KEPT = 400_000
#: Pre-splitting rule of the byte-level tokenizer (fixed value).
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] is not None or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: only plain byte-level BPE files are supported")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        alphabet = byte_alphabet()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        raw = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        self.size = 1 + max([*raw, *self.special.values()])
        self.bytes = [raw.get(i, b"") for i in range(self.size)]
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.text = [str(i) for i in range(self.size)]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError(f"{path}: merge order and id order differ")
        self.core = tiktoken.Encoding("own", pat_str=RULE, mergeable_ranks={b: i for i, b in raw.items()}, special_tokens={})._core_bpe.encode_ordinary
        inside = np.zeros((256, 256), bool)
        for b in raw.values():
            x = np.frombuffer(b, np.uint8)
            inside[x[:-1], x[1:]] = True
        self.cut = ~inside
        ascii_space = [9, 10, 11, 12, 13, 32]
        ends = np.ones(256, bool)
        ends[[*ascii_space, 0xA0]] = False
        if inside[np.ix_(ends, ascii_space)].any():
            raise ValueError(f"{path}: a token holds white space behind other bytes")
        self.parts = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.plain_end = np.ones(256, bool)  # last bytes of characters that are surely not white space
        self.plain_end[:33] = self.plain_end[127] = False
        self.plain_end[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
        self.hash_of = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)
        self.offset = np.concatenate(([0], np.cumsum([len(b) for b in self.bytes])))
        self.flat_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        self._fresh()

    def _fresh(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.at, self.len = np.zeros(KEPT * 2, np.int64), np.zeros(KEPT * 2, np.int64)

    def cuts(self, b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Offsets in the bytes ``b`` of texts that begin at ``starts`` where a fragment begins."""
        left, right = b[:-1], b[1:]
        is_word = ((left | 32) - np.uint8(97) < 26) | (left - np.uint8(48) < 10)
        # inside a run of non-space: both neighbours are whole ASCII characters, and no contraction
        # may begin behind a symbol, where the pre-splitting rule would see it only after the cut
        graphic = (left > 32) & (left < 127) & (right > 32) & (right < 127) & (is_word | (right != 39))
        # in front of white space: the character on the left is none
        before = np.concatenate(([0], left[:-1])) if len(left) else left
        space = ((right == 32) | (right - np.uint8(9) < 5)) & (self.plain_end[left] | ((before == 0xC3) & (left >= 128)))
        at = (self.cut[left, right] & graphic) | space
        first = np.zeros(len(b), bool)
        first[1:] = at
        first[starts[starts < len(b)]] = True
        return np.flatnonzero(first)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as arrays of unsigned 32-bit integers."""
        plain: list[str] = []
        split: list[list[int]] = []  # of each text: a segment's number, or minus a special token less one
        for text in texts:
            got, at, text = [], 0, text or ""
            for m in self.parts.finditer(text):
                got += [len(plain), -1 - self.special[m[0]]]
                plain.append(text[at : m.start()])
                at = m.end()
            split.append([*got, len(plain)])
            plain.append(text[at:])
        ids = self._segments(plain)
        return [ids[x[0]] if len(x) == 1 else np.concatenate([ids[k] if k >= 0 else np.array([-1 - k], np.uint32) for k in x]) for x in split]

    def _segments(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = b"".join(raw)
        if not data:
            return [np.zeros(0, np.uint32) for _ in texts]
        b = np.frombuffer(data, np.uint8)
        begins = np.cumsum(sizes) - sizes
        cut = self.cuts(b, begins[sizes > 0])
        ends = np.append(cut[1:], len(b))
        ids, counts = self._fragments(data, b, cut, ends)
        total = np.concatenate(([0], np.cumsum(counts)))
        first = np.searchsorted(cut, begins)
        last = np.searchsorted(cut, begins + sizes)
        out = [ids[total[i] : total[j]] for i, j in zip(first.tolist(), last.tolist(), strict=True)]
        if self.decoded(ids) != data:  # two fragments of one hash: encode the texts concerned whole
            out = [x if self.decoded(x) == t else np.array(self.core(t.decode()), np.uint32) for x, t in zip(out, raw, strict=True)]
        return out

    def _fragments(self, data: bytes, b: np.ndarray, cut: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each fragment.  Equal fragments are encoded once."""
        with np.errstate(over="ignore"):
            base, n = np.uint64(0x9E3779B97F4A7C15), len(b)
            power = _powers(int(base), n + 1)
            back = _powers(pow(int(base), -1, 1 << 64), n + 1)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hash_of[b] * power[:n], dtype=np.uint64)))
            key = (sums[ends] - sums[cut]) * back[cut]
        # distinct keys in the order they come, by hashing rather than by a sort
        coded = pa.array(key.view(np.int64)).dictionary_encode()
        keys, inverse = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        example = np.empty(len(keys), np.int64)
        example[inverse[::-1]] = np.arange(len(key) - 1, -1, -1)
        if len(self.known) + len(keys) > KEPT:
            self._fresh()
        if len(self.known) + len(keys) > len(self.at):
            self.at, self.len = (np.concatenate((x, np.zeros(len(keys) + len(x), np.int64))) for x in (self.at, self.len))
        known, core = self.known, self.core
        where = list(map(known.get, keys.tolist()))
        new = [i for i, x in enumerate(where) if x is None]
        if new:
            got = [core(data[s:e].decode()) for s, e in zip(cut[example[new]].tolist(), ends[example[new]].tolist(), strict=True)]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((x for g in got for x in g), np.uint32, int(lens.sum()))
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            self.flat[self.used : self.used + len(flat)] = flat
            at = len(known)
            self.at[at : at + len(new)] = self.used + np.cumsum(lens) - lens
            self.len[at : at + len(new)] = lens
            self.used += len(flat)
            for i, k in enumerate(keys[new].tolist()):
                known[k] = where[new[i]] = at + i
        pick = np.array(where, np.int64)[inverse]
        counts = self.len[pick]
        return self.flat[_ranges(self.at[pick], counts)], counts

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, one after the other."""
        at = self.offset[ids]
        return self.flat_bytes[_ranges(at, self.offset[ids.astype(np.int64) + 1] - at)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded(ids).decode("utf-8", "replace")


def _ranges(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... at[0] + counts[0] - 1, at[1], ..."""
    if not len(at):
        return np.zeros(0, np.int64)
    return np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


_power: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared, ... modulo 2 ** 64."""
    if len(_power.get(base, ())) < n:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        _power[base] = np.cumprod(x, dtype=np.uint64)
    return _power[base]


_loaded: dict[str, ForcedBpe] = {}


def encoder(path: str) -> ForcedBpe:
    """One encoder per worker process."""
    if path not in _loaded:
        _loaded[path] = ForcedBpe(path)
    return _loaded[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of each row, its ``ids`` (array of int) and the ``decoded`` text.  A map over the rows, nothing is shuffled."""
    path, keep = path or vocabulary(), keep if keep is not None else ["doc_id"]
    ship(docs.sparkSession)
    df = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    types = dict(df.dtypes)
    schema = ", ".join([*[f"k{i} {types[f'k{i}']}" for i in range(len(keep))], "ids array<int>, decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for b in sliced(whole, len(keep)):
                ids = enc.encode(b.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.string())], [*b.schema.names[:-1], "ids", "decoded"])

    out = df.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", "decoded")


def sliced(batch: pa.RecordBatch, column: int, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, or of one row."""
    import pyarrow.compute as pc

    n = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    edges = np.flatnonzero(np.diff((np.cumsum(n) // most).astype(np.int64), prepend=0)).tolist()
    for a, b in zip([0, *edges], [*edges, len(n)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: the same encoder and decoder, digested where the rows are."""
    path = path or vocabulary()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for b in sliced(whole, 1):
                n, a, d = [], [], []
                for ids in enc.encode(b.column(1).to_pylist()):
                    listed = ids.tolist()
                    n.append(len(listed))
                    a.append(hashlib.sha256(",".join(map(enc.text.__getitem__, listed)).encode()).hexdigest())
                    d.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
