"""Secrets in texts: three fixed patterns, and random strings found by character Markov models.

Native: only DataFrame functions run over the rows.  Two first-order Markov models of characters,
one of random strings and one of ordinary identifiers, are trained from labelled samples by a
grouped count.  In a long token without white space the stretches are sought over which the
log-likelihood ratio of the two models adds up to LEAST_SUM and is LEAST_RATIO a transition or more,
so a name that a secret is glued to does not outweigh it.  A stretch ends where the sum falls by DROP
from its peak, and is widened to the next of = / _ - on both sides; what is widened is named.

Spans are code points, end exclusive.  A pattern's places follow from the lengths of the matches and
of what lies between them, since Spark gives the matches of a pattern but not their places.

Edge cases: null and empty texts hold nothing; spans of a pattern are cut out of a token before its
rest is scored; repeated rows give repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _either(word: str) -> str:
    """A pattern for the word in either case, without the flag that also folds letters beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# whole runs of 20 and 24 characters: the same as all runs without the shorter ones
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LEAST_RATIO = 0.5
LEAST_SUM = 9.5
DROP = 8.0
#: Characters between the parts of a token; a part that begins a stretch must reach LEAST_SUM, and = ends one.
PARTS = "=/_-"
KINDS = ("assign", "access", "hex", "random")
EMPTY = "array<struct<start:int,kind:int,end:int,token:string>>"
#: Numbers that are added up one after the other; longer lists are cut into blocks, so that the work stays in proportion.
BLOCK = 256
#: Number of the first sample that is kept for measuring.
HELD_OUT = 1_000_000
#: Words of the ordinary samples.
WORDS = (
    "user account name value index count total list map set get put create update delete read write open close load save file path "
    "stream buffer data config option default server client request response handler manager service session context event message "
    "table column row field record query filter result error status code type string number date time start end first last next "
    "previous parent child node tree graph edge key lock thread process task job queue worker engine parser token lexer format "
    "print debug info warning test example sample document text page link image style color width height size length position"
).split()


def samples(spark: SparkSession, n: int = 2000, first: int = 0) -> DataFrame:
    """Labelled strings (text, random 0 or 1): hashes in several alphabets, and identifiers joined from words in several styles.

    Numbered from ``first``; those from HELD_OUT on are never trained on, and tests measure on them.
    """
    i = F.col("id")
    h = F.sha2(i.cast("string"), 256)
    b64 = F.base64(F.unhex(h))
    upper = F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", ""))
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("x"), i.cast("string")), 512))), "[^A-Za-z0-9]", "")
    texts = [h, b64, upper, mixed]
    random = spark.range(first, first + n).select(F.element_at(F.array(*texts), (i % len(texts) + 1).cast("int")).alias("text"), F.lit(1).alias("random"))
    words = F.from_json(F.lit(json.dumps(WORDS)), "array<string>")

    def word(k: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))

    parts = [word(k) for k in range(4)]
    styles = [F.concat_ws("_", *parts), F.concat_ws("-", *parts), F.concat(*[F.initcap(p) for p in parts]), F.concat(parts[0], *[F.initcap(p) for p in parts[1:]]), F.concat_ws("/", *parts), F.upper(F.concat_ws("_", *parts[:3])), F.concat(*parts), F.concat_ws("_", *parts[:3], (i % 100).cast("string"))]
    styles.append(F.repeat(F.substr(F.lit(ALPHABET), (F.pmod(F.xxhash64(i), F.lit(len(ALPHABET))) + 1).cast("int"), F.lit(1)), F.lit(24)))  # rulers and fillers
    ordinary = spark.range(first, first + n).select(F.element_at(F.array(*styles), (i % len(styles) + 1).cast("int")).alias("text"), F.lit(0).alias("random"))
    return random.union(ordinary)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, row after row of ALPHABET; counted on the executors, at most 2 x 67 x 67 rows come back."""
    pairs = labelled.where("text is not null and length(text) > 1").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda k: F.substr("text", k, F.lit(2)))).alias("pair"))
    size = len(ALPHABET)
    seen = {(r["random"], r["pair"]): r["count"] for r in pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").count().collect()}
    out = []
    for a in ALPHABET:
        row = {y: [seen.get((y, a + b), 0) + 0.5 for b in ALPHABET] for y in (0, 1)}
        out += [math.log(row[1][k] / sum(row[1])) - math.log(row[0][k] / sum(row[0])) for k in range(size)]
    return out


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column) -> Column:
    """The sum of all numbers before each one; block by block, for lists of any length."""
    empty = F.expr("cast(array() as array<int>)")

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def start(at: Column) -> Column:
        return F.struct(at.alias("at"), empty.alias("out"))

    def body(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / BLOCK), F.lit(0)).cast("int"))
        sums = F.transform(blocks, lambda k: F.aggregate(F.slice(v, k * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda acc, x: acc + x))
        bases = F.aggregate(sums, start(F.lit(0)), step)["out"]
        return F.flatten(F.transform(bases, lambda base, k: F.aggregate(F.slice(v, k * BLOCK + 1, F.lit(BLOCK)), start(base), step)["out"]))

    return _let(values, body)


def _spans(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """The matches of ``pattern`` with their places; the second group must have ``least`` characters if given."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else whole
    between = F.transform(F.split(text, pattern, -1), F.length)
    both = F.arrays_zip(F.transform(whole, F.length).alias("n"), F.slice(between, 1, F.size(whole)).alias("gap"), group.alias("g"))

    def one(x: Column, before: Column) -> Column:
        at = before + x["gap"]
        return F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (at + x["n"]).alias("end"), x["g"].alias("token"))

    found = _let(both, lambda z: F.zip_with(z, _running(F.transform(z, lambda x: x["n"] + x["gap"])), one))
    if least:
        found = F.filter(found, lambda s: F.length(s["token"]) >= least)
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as {EMPTY})"))


def _without(text: Column, pattern: str, least: int = 0) -> Column:
    """``text`` with the matches of ``pattern`` turned to spaces, so that places stay; as _spans finds them."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("w"), group.alias("g"))

    def blank(x: Column) -> Column:
        space = F.repeat(F.lit(" "), F.length(x["w"]))
        return F.concat(x["gap"], F.coalesce(F.when(F.length(x["g"]) >= least, space).otherwise(x["w"]), F.lit("")))

    return F.when(text.rlike(pattern), F.array_join(F.transform(parts, blank), "")).otherwise(text)


def _stretches(token: Column, ratios: list[float]) -> Column:
    """Structs at and to (from 0, end exclusive) of the random stretches of a token, in order and apart."""
    known = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    n = F.length(token)
    none = F.expr("cast(array() as array<struct<at:int,to:int>>)")
    size, zero = len(ALPHABET), F.lit(0.0)

    def closed(acc: Column) -> Column:
        good = (acc["best"] >= LEAST_SUM) & (acc["best"] >= LEAST_RATIO * (acc["to"] - acc["at"]))
        return F.when(good, F.concat(acc["found"], F.array(F.struct(acc["at"].alias("at"), acc["to"].alias("to"))))).otherwise(acc["found"])

    def state(total: Column, at: Column, best: Column, to: Column, found: Column) -> Column:
        return F.struct(total.alias("total"), at.alias("at"), best.alias("best"), to.alias("to"), found.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        k = x["k"] + 1  # from 1: the transition from character k to k + 1
        total = acc["total"] + F.when(x["part"], 0.0).otherwise(x["r"])
        more = (total > acc["best"]) & ~x["ahead"]
        end = (total <= 0) | (acc["best"] - total > DROP)
        name = x["equals"] | (x["ahead"] & (acc["best"] < LEAST_SUM))  # what lies before was a name
        return F.when(name, state(zero, k + 2, zero, k + 2, closed(acc))).when(end, state(zero, k + 1, zero, k + 1, closed(acc))).otherwise(state(total, acc["at"], F.when(more, total).otherwise(acc["best"]), F.when(more, k + 1).otherwise(acc["to"]), acc["found"]))

    def widened(x: Column) -> Column:
        before = F.length(F.regexp_extract(F.substr(token, F.lit(1), x["at"] - 1), r"[A-Za-z0-9+]*$", 0))
        after = F.length(F.regexp_extract(F.substr(token, x["to"] + 1, n), r"^[A-Za-z0-9+]*(?:={1,2}$)?", 0))
        return F.struct((x["at"] - 1 - before).alias("at"), (x["to"] + after).alias("to"))

    def joined(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.array(F.struct(last["at"].alias("at"), F.greatest(last["to"], x["to"]).alias("to")))
        meets = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["to"] > x["at"])
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), one)).otherwise(F.concat(acc, F.array(x)))

    # characters are listed once: a place in a long string is found only by walking to it
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))

    def moves(p: Column) -> Column:
        marks = [ALPHABET.index(c) + 1 for c in PARTS]

        def one(a: Column, b: Column) -> Column:
            return F.struct(F.element_at(known, (a - 1) * size + b).alias("r"), a.isin(*marks).alias("part"), b.isin(*marks).alias("ahead"), (b == ALPHABET.index("=") + 1).alias("equals"))

        pairs = F.zip_with(F.slice(p, 1, n - 1), F.slice(p, 2, n - 1), one)
        return F.transform(pairs, lambda x, k: F.struct(x["r"].alias("r"), x["part"].alias("part"), x["ahead"].alias("ahead"), x["equals"].alias("equals"), k.alias("k")))

    def body(m: Column) -> Column:
        found = F.aggregate(m, state(zero, F.lit(1), zero, F.lit(1), none), step, closed)
        apart = F.aggregate(F.transform(found, widened), none, joined)
        mean = F.aggregate(m, zero, lambda acc, x: acc + x["r"]) / (n - 1)
        # a token of many short parts can be random as a whole only
        return _let(apart, lambda a: F.when(F.size(a) > 0, a).when(mean >= LEAST_RATIO, F.array(F.struct(F.lit(0).alias("at"), n.alias("to")))).otherwise(none))

    return _let(places, lambda p: _let(moves(p), body))


def scan(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """``docs`` with the columns __base and __all: arrays of (start, kind, end, token), sorted by start and kind."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.array_sort(F.concat(_spans(t, ASSIGN, "assign", ASSIGN_LEAST), _spans(t, ACCESS, "access"), _spans(t, HEX, "hex")))
    rest = _without(_without(_without(t, ASSIGN, ASSIGN_LEAST), ACCESS), HEX)
    df = docs.withColumn("__base", base).withColumn("__rest", F.when(F.size("__base") > 0, rest).otherwise(t)).withColumn("__long", _spans(F.col("__rest"), TOKEN, "random"))

    def named(s: Column) -> Column:
        return F.transform(_stretches(s["token"], ratios), lambda x: F.struct((s["start"] + x["at"]).alias("start"), s["kind"].alias("kind"), (s["start"] + x["to"]).alias("end"), F.substr(s["token"], x["at"] + 1, x["to"] - x["at"]).alias("token")))

    free = F.flatten(F.transform("__long", named))
    return df.withColumn("__all", F.when(F.size("__long") > 0, F.array_sort(F.concat("__base", free))).otherwise(F.col("__base"))).drop("__long", "__rest")


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), train(samples(spark)))
    counts = [F.size(F.filter("__base", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"), _listed(F.col("__all")).alias("spans"))
