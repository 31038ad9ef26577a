"""A seeded generator of import records: subjects with clusters of terms, repeated evidence and qualifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Shares of negated, hypothetical and family findings, in thousandths.
SHARES = (("negated", 150), ("hypothetical", 80), ("family", 50))
#: Terms that belong together.
CLUSTER = 25


def records(spark: SparkSession, subjects: int, terms: list[str], project_id: str, least: int = 150, most: int = 500, evidence: int = 50, seed: int = 42) -> DataFrame:
    """Records as the import reads them: every subject has between ``least`` and ``most`` terms with 1 to ``evidence`` items each.

    Half of a subject's terms are of one cluster of neighbouring terms.  Everything follows from
    hashes of the numbers and the seed, so any number of partitions gives the same rows.
    """
    known = F.array(*map(F.lit, terms))

    def die(*of) -> Column:
        return F.xxhash64(F.lit(seed), *[F.lit(x) if isinstance(x, int | str) else x for x in of])

    def upto(n: Column | int, *of) -> Column:
        return F.pmod(die(*of), F.lit(n) if isinstance(n, int) else n).cast("int")

    s = F.col("id")
    rows = spark.range(subjects).withColumn("k", F.explode(F.sequence(F.lit(0), least + upto(most - least + 1, s, "terms") - 1)))
    home = upto(max(1, len(terms) // CLUSTER), s, "cluster") * CLUSTER
    near = F.pmod(home + upto(CLUSTER, s, F.col("k"), "near"), F.lit(len(terms)))
    pick = F.when(F.col("k") % 2 == 0, near).otherwise(upto(len(terms), s, F.col("k"), "far"))
    rows = rows.withColumn("term", F.get(known, pick)).groupBy("id", "term").agg(F.count("*").alias("n"))

    def item(j: Column) -> Column:
        luck, start = upto(1000, s, F.col("term"), j, "luck"), upto(900, s, F.col("term"), j, "span")
        marks, edge = [], 0
        for name, share in SHARES:
            marks.append(F.when((luck >= edge) & (luck < edge + share), "1.0").otherwise("0.0").alias(name))
            edge += share
        day = F.date_add(F.lit("2015-01-01").cast("date"), upto(3000, s, F.col("term"), j, "day"))
        note = F.concat(F.lit("note-"), s.cast("string"), F.lit("-"), upto(200, s, F.col("term"), j, "note").cast("string"))
        return F.struct(
            F.lit("clinical_note").alias("type"), note.alias("clinical_note_id"), F.concat(F.lit("enc-"), s.cast("string"), F.lit("-"), upto(40, s, F.col("term"), j, "enc").cast("string")).alias("encounter_id"),
            F.lit("synthetic").alias("evidence_creator_id"), F.lit("automated").alias("evidence_creator_type"), F.lit("Synthetic data").alias("evidence_creator_name"),
            F.concat(day.cast("string"), F.lit("T00:00:00Z")).alias("note_timestamp"), F.lit("progress").alias("note_type"), F.lit("physician").alias("provider_type"), F.lit("general").alias("author_specialty"),
            start.alias("span_start"), (start + 12).alias("span_end"), F.struct(*marks).alias("contexts"),
        )

    # few terms have much evidence: the square of a share
    share = upto(1000, s, F.col("term"), "much") / 1000.0
    many = 1 + F.floor(share * share * evidence).cast("int")
    out = rows.select(F.lit(project_id).alias("project_id"), F.concat(F.lit("subject-"), s.cast("string")).alias("project_subject_id"), X.term_iri(F.col("term")).alias("term_iri"), s.alias("row_num"), F.lit("synthetic").alias("batch_id"), F.transform(F.sequence(F.lit(1), F.least(many, F.lit(evidence))), item).alias("evidence"))
    return out.select("project_id", "project_subject_id", "term_iri", "row_num", "batch_id", F.transform("evidence", lambda e: e.withField("contexts", F.struct(*[e["contexts"][n].alias(n) for n in ("negated", "family", "hypothetical")]))).alias("evidence"))
