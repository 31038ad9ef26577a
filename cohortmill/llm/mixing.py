"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies.  Among all rates that give each
source its target of words the ones closest to 1 in relative entropy are exponentially tilted,
rate = exp(lambda * size), one multiplier a source, held to at most CAP.  The multipliers solve the
convex dual, by Newton steps over a histogram of sizes: every step is one distributed sum of the
gradient and the curvature of each source.  A step that leaves the bracket of the root is replaced
by its middle.

Rounding: inside a source the sizes go from large to small, and what the copies of one size are
above or below their expected words is passed on to the next size, so a source ends within about
its smallest document of its target.  Documents of one size and source get equally many copies or
one more; the ones more are those with the smallest hashes of their doc_id.

Targets: sources sorted by code point, null last, weigh 1, 2, 3, repeating, and share the words of
all; a target stops at CAP times its source's words, and the excess goes to the others by weight.

Edge cases: null and empty texts have size 0 and are taken once, which adds no words; a source of
size 0 has target 0; rows that repeat a doc_id are decided by the same hash, so they may get one
copy more together; a null doc_id has a hash of its own; an empty table gives no rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, ship, table

CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one size and source that are ranked in one task.
RANKED = 512
STEPS = 60
NEAR = 1e-9


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Not null, and sorted as sources are: by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def measured(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with __sk (key of the source) and __size."""
    return docs.withColumn("__sk", source_key(F.col("source"))).withColumn("__size", words(F.col("text")))


def targets(hist: DataFrame) -> DataFrame:
    """sk, total, n, least (smallest size above 0), target of each source, from the histogram sk, size, n."""
    by = hist.groupBy("sk").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("n"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    # one row a source from here on
    weight = (F.row_number().over(Window.orderBy("sk")) - 1) % 3 + 1
    by = by.withColumn("w", weight).withColumn("cap", F.col("total") * float(CAP)).withColumn("r", F.col("cap") / F.col("w"))
    order = Window.orderBy("r", "sk")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    all_words = F.sum("total").over(Window.partitionBy())
    by = by.withColumn("level", (all_words - before) / left)
    # sources fill up in the order of cap / weight; the first that does not sets the level for the rest
    common = F.first(F.when(F.col("r") > F.col("level"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.withColumn("target", F.when(F.col("r") <= F.col("level"), F.col("cap")).otherwise(F.least("cap", F.col("w") * common))).select("sk", "total", "n", "least", "target")


def multipliers(hist: DataFrame, goals: DataFrame) -> DataFrame:
    """sk, scale, lam: the rate of a document is exp(lam * size / scale), at most CAP."""
    scale = F.col("total") / F.col("n")
    share = F.log(F.col("target") / F.col("total"))
    start = goals.where("total > 0").select(
        "sk", "total", "target", scale.alias("scale"), share.alias("lam"),
        F.when(share < 0, share * scale / F.col("least")).otherwise(F.lit(0.0)).alias("lo"),
        (F.lit(math.log(CAP)) * scale / F.col("least")).alias("hi"),
    )
    state = save(start.withColumn("lam", F.greatest("lo", F.least("hi", "lam"))), "newton")
    cells = hist.where("size > 0").select(F.col("sk").alias("k"), "size", "n")
    for _ in range(STEPS):
        x = F.col("size") / F.col("scale")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(math.log(CAP))))
        free = F.col("lam") * x < math.log(CAP)
        mass = F.col("n") * F.col("size") * tilt
        sums = cells.join(state, F.col("k") == F.col("sk")).groupBy("k").agg(F.sum(mass).alias("got"), F.sum(F.when(free, mass * x).otherwise(F.lit(0.0))).alias("slope"))
        gap = F.col("got") - F.col("target")
        step = state.join(sums, F.col("k") == F.col("sk"))
        step = step.withColumn("lo", F.when(gap <= 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap >= 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        inside = F.coalesce((newton > F.col("lo")) & (newton < F.col("hi")), F.lit(False))
        state = save(step.select("sk", "total", "target", "scale", F.when(F.abs(gap) <= NEAR * F.col("target"), F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"), "lo", "hi", (F.abs(gap) / F.col("target")).alias("off")), "newton")
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= NEAR:
            break
    return state.select("sk", "scale", "lam")


def _rounded(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies of every size of one source, from large to small; the error in words is passed on."""
    cells = cells.sort_values("size", ascending=False)
    off, copies = 0.0, []
    for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
        want = n * rate
        k = n if size == 0 else min(CAP * n, max(0, math.floor(want + off / size + 0.5)))
        off += (want - k) * size if size else 0.0
        copies.append(k)
    return cells.assign(copies=copies)[["sk", "size", "n", "copies"]]


def plan(rows: DataFrame) -> DataFrame:
    """What each source and size takes, from ``rows`` (doc_id, sk, size): a written table.

    sk, size, total, target, base (copies of every document), m (documents with one more), and the
    largest of those by (part, hash, id).
    """
    ship(rows.sparkSession)
    hist = save(rows.groupBy("sk", "size").agg(F.count("*").alias("n")), "sizes")
    goals = save(targets(hist), "targets")
    lam = multipliers(hist, goals)
    lam = lam.select(F.col("sk").alias("lk"), "scale", "lam")
    rate = F.coalesce(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(math.log(CAP)))), F.lit(1.0))
    # the sizes of one source are as many as its longest document has words, whatever the number of rows
    cells = hist.join(lam, F.col("sk") == F.col("lk"), "left").select("sk", "size", "n", rate.alias("rate")).groupBy("sk").applyInPandas(_rounded, "sk string, size long, n long, copies long")
    cells = cells.select("sk", "size", "n", F.expr("copies div n").alias("base"), (F.col("copies") % F.col("n")).alias("m"), F.ceil(F.col("n") / RANKED).cast("int").alias("parts"))
    cells = save(cells, "copies")
    some = cells.where("m > 0").select(F.col("sk").alias("ck"), F.col("size").alias("cs"), "m", "parts")
    ranked = rows.join(some, (F.col("sk") == F.col("ck")) & (F.col("size") == F.col("cs"))).select("ck", "cs", "m", _part(_id(F.col("doc_id")), F.col("parts")).alias("part"), _hash(_id(F.col("doc_id"))).alias("hash"), _id(F.col("doc_id")).alias("id"))
    by = Window.partitionBy("ck", "cs").orderBy("part")
    edge = ranked.groupBy("ck", "cs", "m", "part").count().withColumn("upto", F.sum("count").over(by)).where("upto >= m and upto - count < m")
    edge = edge.select(F.col("ck").alias("ek"), F.col("cs").alias("es"), F.col("part").alias("ep"), (F.col("m") - (F.col("upto") - F.col("count"))).alias("need"))
    last = ranked.join(edge, (F.col("ck") == F.col("ek")) & (F.col("cs") == F.col("es")) & (F.col("part") == F.col("ep")))
    last = last.withColumn("rank", F.row_number().over(Window.partitionBy("ck", "cs", "part").orderBy("hash", "id"))).where("rank = need").select(F.col("ck").alias("ek"), F.col("cs").alias("es"), F.col("ep"), F.col("hash").alias("eh"), F.col("id").alias("ei"))
    whole = cells.join(last, (F.col("sk") == F.col("ek")) & (F.col("size") == F.col("es")), "left").join(goals.select(F.col("sk").alias("gk"), "total", "target"), F.col("sk") == F.col("gk"))
    return save(whole.select(F.col("sk").alias("pk"), F.col("size").alias("ps"), "total", "target", "base", "m", "parts", "ep", "eh", "ei"), "plan")


def _hash(id: Column) -> Column:
    return F.xxhash64(id)


def _id(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit(-(1 << 62)))


def _part(id: Column, parts: Column) -> Column:
    return F.pmod(F.shiftright(_hash(id), 20), parts)


def with_copies(rows: DataFrame, decided: DataFrame, key: str = "doc_id", sk: str = "__sk", size: str = "__size") -> DataFrame:
    """``rows`` joined with their plan and the columns __total, __target and __copies; a plan within BROADCAST_CELLS rows is broadcast.

    The columns of the plan get names that begin with __plan, so ``rows`` may have any others.
    """
    own = {c: f"__plan_{c}" for c in decided.columns}
    plan_rows = decided.select(*[F.col(c).alias(n) for c, n in own.items()])
    if decided.count() <= BROADCAST_CELLS:
        plan_rows = F.broadcast(plan_rows)
    out = rows.join(plan_rows, (F.col(sk) == F.col(own["pk"])) & (F.col(size) == F.col(own["ps"])))
    p = {c: F.col(n) for c, n in own.items()}
    i = _id(F.col(f"`{key}`"))
    part, h = _part(i, p["parts"]), _hash(i)
    more = (p["m"] > 0) & ((part < p["ep"]) | ((part == p["ep"]) & ((h < p["eh"]) | ((h == p["eh"]) & (i <= p["ei"])))))
    return out.withColumns({"__total": p["total"], "__target": p["target"], "__copies": p["base"] + F.coalesce(more, F.lit(False)).cast("int")})


#: Rows of a plan (about 80 bytes each) that are broadcast; beyond that it is joined by a shuffle.
BROADCAST_CELLS = 50_000


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as its rounded rate says; its columns may have any names.

    A table without rows gives none; texts that are null or empty are taken once.
    """
    rows = measured(docs)
    decided = plan(save(rows.select("doc_id", F.col("__sk").alias("sk"), F.col("__size").alias("size")), "measured"))
    out = with_copies(rows, decided).where("__copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1, cast(__copies as int))")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = save(measured(table(spark, sf_dir, "documents")).select("doc_id", "__sk", "__size"), "measured")
    out = with_copies(rows, plan(rows.select("doc_id", F.col("__sk").alias("sk"), F.col("__size").alias("size"))))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__total").cast("long").alias("source_size"), F.col("__target").cast("double").alias("target"), (F.col("__copies") * F.col("__size")).cast("long").alias("taken"), F.col("__copies").cast("long").alias("copies"))
