"""Main text of web pages, with boilerplate found by a suffix array over each host's pages.

First, by markup: elements that are never main text are left out (scripts, styles, forms, menus,
headers, footers, sidebars, adverts, notices, reader comments, by element name, role, class or id).
What an explicit article element holds is the page's main text.

Unmarked boilerplate remains in what markup leaves, inside articles too.  For it the token streams
of a host's pages are concatenated, each block between boundary tokens, and their suffixes are
sorted by prefix doubling (to a depth of RUN tokens, which is all that is asked).  Equal runs of RUN
tokens on PAGES distinct pages or more mark what they cover, and a block covered as a whole is
boilerplate; all other blocks are kept.  Pages whose streams are equal count as one page, so copies
of a page do not erase each other.  Near copies of an article repeat each other's blocks too, and
these are its text: where covered blocks hold more than MINOR of an article's words, all its blocks
stay.  (Pages without an article or main element have no such rule: theirs can be all boilerplate.)

How a host's pages are dealt to tasks does not matter.  A task builds the suffix arrays of the pages
it has at hand, up to HELD bytes, and gives the number of distinct pages of every run; a run's hash
has the host in it, so these counts are added up for all hosts together, in buckets of equal size
however the pages are spread over hosts.  No text is shuffled for this, only sorted hashes, written
as differences (about four bytes a run).  The runs that reach PAGES are the frequent ones.  They are
broadcast while they are few; beyond BROADCAST_RUNS they go to the groups of pages that hold them.

Pages are parsed once and their blocks written; html is never shuffled.

Edge cases: null and empty pages give an empty text; unclosed and stray tags end with what holds
them; an unended comment or script runs to the end; null urls are one host; rows that repeat a
page_id, or have none, are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import sliced
from .common import BROADCAST_IDS, save, ship, sorted_groups, table

RUN = 5
PAGES = 3
#: Share of an article's words that boilerplate may be.
MINOR = 0.5
#: Bytes of text of the pages whose suffixes a task sorts together.
HELD = 12_000_000
#: Runs of a bucket, about.
BUCKET = 1_000_000
#: Frequent runs (8 bytes each) that are broadcast; beyond that they are joined by a shuffle.
BROADCAST_RUNS = 4_000_000
#: Bits of a run's hash that are passed on; the higher ones deal it to a bucket.
BITS = 40
LOW = (1 << BITS) - 1
#: Odd multipliers of the tokens of a run; a run's hash is the same in every task.
_MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(RUN)], np.uint64)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(script|style|noscript|template|svg|textarea|select|iframe|object|canvas|math|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^<>]*>?",
    re.S | re.I,
)
_DROP = frozenset("nav header footer aside form button dialog menu head".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that may be left open and that the next block of their kind or a closing parent ends.
_LOOSE = frozenset("p li dt dd tr td th option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|footer|masthead|site-header|page-header|"
    r"cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommended|comments?|disqus|replies|respond|widget|toolbar|pagination|pager|skip-link)(?:$|[\s_-])",
    re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())


def _left_out(name: str, attrs: str) -> bool:
    if name in _DROP:
        return True
    if attrs and not attrs.isspace():
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in _ROLES):
                return True
            if key in ("class", "id") and _BAD.search(value):
                return name not in ("body", "html", "article", "main") or "comment" in value.lower()
    return False


def blocks(page: str | None) -> tuple[list[str], bool]:
    """The blocks of a page that markup does not exclude, and whether an article element holds them.

    If there is an article (or else a main element), only its blocks are returned.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, left out, kind (2 in an article, 1 in main)
    text: list[str] = []
    left, kind, at = False, 0, 0
    page = page or ""

    def end() -> None:
        if text:
            if got := " ".join(_html.unescape("".join(text)).split()):
                out.append((got, kind))
            text.clear()

    def reset() -> None:
        nonlocal left, kind
        left, kind = (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    for m in _TAG.finditer(page):
        if m.start() > at and not left:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if name in _BLOCK:
                end()
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
                reset()
            continue
        attrs = m[4]
        if name in _BLOCK:
            end()
            if stack and stack[-1][0] in _LOOSE and (stack[-1][0] == name or stack[-1][0] == "p"):
                stack.pop()
                reset()
        if name in _VOID or attrs.endswith("/"):
            if name == "br" and not left:
                text.append(" ")
            continue
        out_now = left or _left_out(name, attrs)
        if name in _BLOCK or out_now != left:
            kind = max(kind, 2 if name == "article" else 1 if name == "main" else 0)
            left = out_now
            stack.append((name, left, kind))
    if at < len(page) and not left:
        text.append(page[at:])
    end()
    best = max((k for _, k in out), default=0)
    return [t for t, k in out if k == best], best > 0


class Suffixes:
    """The suffix array, to a depth of RUN tokens, of pages that are lists of blocks of words.

    By prefix doubling: after the last step, suffixes of equal rank share RUN tokens.
    """

    def __init__(self, pages: list[list[str]], sort: bool = True) -> None:
        numbers: dict[str, int] = {}
        flat, sizes, per = [], [], []
        for i, s in enumerate(pages):
            for b in s:
                words = b.split()
                flat.append(0)  # begins a block
                flat += [numbers.setdefault(w, len(numbers) + 1) for w in words]
                sizes.append(len(words) + 1)
            flat += [0, -1 - i]  # ends the last block; a token of its own ends the page
            sizes.append(2)
            per.append(len(s))
        self.pages, self.words = pages, list(numbers)
        self.tokens = np.array(flat, np.int64)
        blocks = np.array(per, np.int64)
        of = np.repeat(np.arange(len(pages)), blocks + 1)  # page of each entry of sizes
        place = np.arange(len(of)) - np.repeat(np.cumsum(blocks + 1) - blocks - 1, blocks + 1)
        place[np.cumsum(blocks + 1) - 1] = -1
        self.page, self.where = np.repeat(of, sizes).astype(np.int32), np.repeat(place, sizes).astype(np.int32)
        if not sort:
            return
        rank, depth = self.tokens + len(pages), 1
        while depth < RUN:
            step = min(depth, RUN - depth)
            behind = np.full(len(rank), -1, np.int64)
            behind[:-step] = rank[step:]
            rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + behind + 1, return_inverse=True)[1].astype(np.int64)
            depth += step
        self.rank = rank
        # distinct pages of each rank
        self.distinct = np.bincount(np.unique(rank * len(pages) + self.page) // len(pages), minlength=int(rank.max(initial=-1)) + 1)

    def hashes(self, host: str, at: np.ndarray | None = None) -> np.ndarray:
        """A hash of the run at each place (or only at the places ``at``), the host in it; 0 for runs that reach over the end of a page."""
        token = np.array([0] + [int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little") for w in self.words], np.uint64)
        seed = np.uint64(int.from_bytes(hashlib.blake2b(host.encode("utf-8", "replace"), digest_size=8).digest(), "little"))
        places = np.arange(len(self.tokens)) if at is None else at
        out, ends = np.full(len(places), seed, np.uint64), places + RUN > len(self.tokens)
        for k in range(RUN):
            t = self.tokens[np.minimum(places + k, len(self.tokens) - 1)]
            ends |= t < 0
            x = token[np.maximum(t, 0)] + np.uint64(k + 1)
            out += (x ^ (x >> np.uint64(29))) * _MIX[k]
        out = (out ^ (out >> np.uint64(32))) * _MIX[0]
        out ^= out >> np.uint64(29)
        return np.where(ends, np.uint64(0), out | np.uint64(1))

    def runs(self, host: str) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every distinct run and on how many of these pages it is."""
        at = np.zeros(len(self.distinct), np.int64)
        at[self.rank] = np.arange(len(self.rank))
        got = self.hashes(host, at)
        return got[got != 0], self.distinct[got != 0]

    def covered(self, often: np.ndarray | None = None) -> list[list[bool]]:
        """For each page which of its blocks are covered by the runs at the places ``often``, or by those on PAGES of these pages."""
        if often is None:
            often = (self.distinct >= PAGES)[self.rank]
        cover = np.zeros(len(self.tokens) + RUN, np.int64)
        cover[: len(often)] += often
        cover[RUN:] -= often
        inside = np.cumsum(cover)[: len(self.tokens)] > 0
        out = [[True] * len(s) for s in self.pages]
        open_ = np.flatnonzero(~inside & (self.tokens > 0))
        for p, j in set(zip(self.page[open_].tolist(), self.where[open_].tolist(), strict=True)):
            out[p][j] = False
        return out


def without(page: list[str], marks: list[bool], article: bool) -> list[str]:
    """The blocks of a page that stay; the same block is boilerplate wherever it stands on the page."""
    gone = {t for t, x in zip(page, marks, strict=True) if x}
    if not gone:
        return page
    kept = [t for t in page if t not in gone]
    if article and sum(len(t.split()) for t in kept) < (1 - MINOR) * sum(len(t.split()) for t in page):
        return page
    return kept


def pack(runs: np.ndarray) -> bytes:
    """Sorted numbers of BITS bits as differences, in planes of bytes."""
    step = np.diff(runs.astype(np.uint64), prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, : BITS // 8].T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(BITS // 8, -1)
    step = np.zeros((planes.shape[1], 8), np.uint8)
    step[:, : BITS // 8] = planes.T
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64)


_TABLE = "page_id long, url string, host string, stream long, row long, task long, tokens int, article boolean, blocks string"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of every page, a hash of them, a number for the row and one for the group of pages parsed with it."""
    from pyspark import TaskContext

    # a group is a run of pages of one task; the attempt is in its number, so no two groups share one
    attempt = TaskContext.get().taskAttemptId()
    task, row, held = attempt << 20, attempt << 36, 0
    for whole in batches:
        for b in sliced(whole, 3):
            got = [blocks(page) for page in b.column(3).to_pylist()]
            texts = ["\n".join(x) for x, _ in got]
            keys = [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for x in texts]
            tokens = [x.count(" ") + x.count("\n") + 1 if x else 0 for x in texts]
            cols = [pa.array(keys, pa.int64()), pa.array(np.arange(row, row + len(got)), pa.int64()), pa.array(np.full(len(got), task), pa.int64()), pa.array(tokens, pa.int32()), pa.array([y for _, y in got], pa.bool_()), pa.array([x.encode("utf-8", "replace").decode() for x in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["page_id", "url", "host", "stream", "row", "task", "tokens", "article", "blocks"])
            row, held = row + len(got), held + sum(map(len, texts))
            if held > HELD:
                task, held = task + 1, 0


def _runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows bucket, task, runs, pages: the runs of the pages at hand, dealt by hash, and on how many of these pages each is (PAGES at most)."""
        held: dict[tuple[int, str], list[list[str]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            by_task: dict[int, list] = {}
            for (task, host), streams in held.items():
                by_task.setdefault(task, []).append(Suffixes(streams).runs(host))
            for task, got in by_task.items():
                run, pages = (np.concatenate([g[i] for g in got]) for i in (0, 1))
                bucket = (run >> np.uint64(BITS)).astype(np.int64) % buckets
                run &= np.uint64(LOW)
                order = np.lexsort((run, bucket))
                run, pages, edges = run[order], np.minimum(pages[order], PAGES).astype(np.uint8), np.searchsorted(bucket[order], np.arange(buckets + 1))
                parts = [(k, pack(run[i:j]), zlib.compress(pages[i:j].tobytes(), 1)) for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i]
                cols = [pa.array([x[0] for x in parts], pa.int32()), pa.array(np.full(len(parts), task), pa.int64()), pa.array([x[1] for x in parts], pa.binary()), pa.array([x[2] for x in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "task", "runs", "pages"])
            held.clear()

        for b in batches:
            for host, task, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault((task, host), []).append(text.split("\n"))
                size += len(text)
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows bucket, task, runs, pages, sorted by bucket: for every task the runs it holds that are on PAGES pages of their host."""
    for (bucket,), (_, task, runs, pages) in sorted_groups(batches, 1):
        each = [unpack(x.as_py()) for x in runs]
        known, at = np.unique(np.concatenate(each), return_inverse=True)
        often = np.bincount(at, weights=np.frombuffer(b"".join(zlib.decompress(x.as_py()) for x in pages), np.uint8), minlength=len(known))[at] >= PAGES
        marks = np.split(often, np.cumsum([len(x) for x in each])[:-1])
        got = [(t, pack(x[y])) for t, x, y in zip(task.to_pylist(), each, marks, strict=True) if y.any()]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), bucket), pa.int32()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], ["bucket", "task", "runs"])


def _marked(run: np.ndarray, frequent: np.ndarray, buckets: int) -> np.ndarray:
    """Which of the run hashes are frequent; ``frequent`` is sorted and holds bucket and low bits."""
    key = ((run >> np.uint64(BITS)) % np.uint64(buckets)) << np.uint64(BITS) | (run & np.uint64(LOW))
    if not len(frequent):
        return np.zeros(len(run), bool)
    at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
    return (frequent[at] == key) & (run != 0)


def _cut(rows: list[tuple], frequent: np.ndarray, buckets: int) -> list[str]:
    """The texts of rows (host, article, blocks) without their boilerplate."""
    out = [""] * len(rows)
    by: dict[str, list[int]] = {}
    for i, (host, _, text) in enumerate(rows):
        if text:
            by.setdefault(host, []).append(i)
    for host, at in by.items():
        found = Suffixes([rows[i][2].split("\n") for i in at], sort=False)
        marks = found.covered(_marked(found.hashes(host), frequent, buckets))
        for i, page, mark in zip(at, found.pages, marks, strict=True):
            out[i] = "\n".join(without(page, mark, rows[i][1]))
    return out


def distinct_streams(parsed: DataFrame) -> DataFrame:
    """host, task and blocks of the parsed pages that hold text, one row for each host and stream."""
    filled = parsed.where("tokens > 0")
    twice = filled.groupBy("host", "stream").agg(F.min("row").alias("keep"), F.max("row").alias("most")).where("most > keep").select(F.col("host").alias("h"), F.col("stream").alias("s"), "keep")
    twice = save(twice, "equal-pages")
    if twice.count() <= BROADCAST_IDS:
        twice = F.broadcast(twice)
    both = filled.join(twice, (F.col("host") == F.col("h")) & (F.col("stream") == F.col("s")), "left")
    return both.where(F.col("keep").isNull() | (F.col("keep") == F.col("row"))).select("host", "task", "blocks")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url and text of every row."""
    spark = ship(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), host.alias("host"), F.col(page).cast("string").alias("html"))
    parsed = save(rows.mapInArrow(_parsed, _TABLE), "blocks", compression="zstd")
    words = parsed.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // BUCKET))
    counted = distinct_streams(parsed).mapInArrow(_runs(buckets), "bucket int, task long, runs binary, pages binary")
    counted = counted.repartition(buckets, "bucket").sortWithinPartitions("bucket")  # as many tasks as there are buckets, which grow with the words
    often = save(counted.mapInArrow(_frequent, "bucket int, task long, runs binary"), "frequent-runs")
    # a frequent run is listed once for each task that holds it: five bytes and less in the files
    if (often.agg(F.sum(F.length("runs"))).first()[0] or 0) <= BROADCAST_RUNS * 4:
        return _cut_by_broadcast(parsed, often, buckets)
    return _cut_by_shuffle(parsed, often, buckets)


def _sorted_runs(rows: list[tuple[int, bytes]]) -> np.ndarray:
    each = [unpack(data) | (np.uint64(bucket) << np.uint64(BITS)) for bucket, data in rows]
    return np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)


def _cut_by_broadcast(parsed: DataFrame, often: DataFrame, buckets: int) -> DataFrame:
    spark = parsed.sparkSession
    shared = spark.sparkContext.broadcast(_sorted_runs([(r["bucket"], r["runs"]) for r in often.select("bucket", "runs").toArrow().to_pylist()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, 4):
                texts = _cut(list(zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)), shared.value, buckets)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return parsed.select("page_id", "url", "host", "article", "blocks").mapInArrow(run, "page_id long, url string, text string")


def _cut_by_shuffle(parsed: DataFrame, often: DataFrame, buckets: int) -> DataFrame:
    """The same where the frequent runs are too many to broadcast: each group of pages gets those that it holds."""
    held = parsed.where("tokens > 0")
    # the runs of a page that is a copy are listed for the group of the first one
    first = held.groupBy("host", "stream").agg(F.min_by("task", "row").alias("group")).select(F.col("host").alias("h"), F.col("stream").alias("s"), "group")
    placed = held.join(first, (F.col("host") == F.col("h")) & (F.col("stream") == F.col("s"))).select("group", F.lit(1).alias("kind"), "page_id", "url", "host", "article", "blocks", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("runs"))
    none = F.lit(None)
    listed = often.select(F.col("task").alias("group"), F.lit(0).alias("kind"), none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("string").alias("host"), none.cast("boolean").alias("article"), none.cast("string").alias("blocks"), "bucket", "runs")
    both = placed.union(listed).repartition("group").sortWithinPartitions("group", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, runs, frequent = None, [], None
        for whole in batches:
            for b in sliced(whole, 6):
                ids, urls, texts = [], [], []
                rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
                i = 0
                while i < len(rows):
                    if rows[i][0] != group:
                        group, runs, frequent = rows[i][0], [], None
                    j = i
                    while j < len(rows) and rows[j][0] == group and rows[j][1] == rows[i][1]:
                        j += 1
                    if rows[i][1] == 0:
                        runs += [(r[7], r[8]) for r in rows[i:j]]
                    else:
                        frequent = _sorted_runs(runs) if frequent is None else frequent
                        ids += [r[2] for r in rows[i:j]]
                        urls += [r[3] for r in rows[i:j]]
                        texts += _cut([(r[4], r[5], r[6]) for r in rows[i:j]], frequent, buckets)
                    i = j
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return both.mapInArrow(run, "page_id long, url string, text string").union(parsed.where("tokens = 0").select("page_id", "url", F.lit("").alias("text")))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
