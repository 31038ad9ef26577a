"""Checks of the stored tables against each other; each gives rows of what is wrong, or counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import evidence as E
from . import graph as G


def null_keys(evidence: DataFrame) -> DataFrame:
    names = (("termlink_id", "null_termlinks"), ("subject_id", "null_subjects"), ("term_iri", "null_terms"))
    return evidence.agg(*[F.count_if(F.col(c).isNull()).alias(n) for c, n in names])


def duplicates(evidence: DataFrame) -> DataFrame:
    """subject_id, evidence_id and n of ids that a subject has more than once."""
    return evidence.groupBy("subject_id", "evidence_id").agg(F.count("*").alias("n")).where("n > 1")


def shared_ids(evidence: DataFrame) -> DataFrame:
    """evidence_id, subjects and n of ids that stand at several subjects."""
    return evidence.groupBy("evidence_id").agg(F.count_distinct("subject_id").alias("subjects"), F.count("*").alias("n")).where("subjects > 1")


def rollup_counts(evidence: DataFrame, rollup: DataFrame) -> DataFrame:
    """Termlinks whose number of evidence in the rollup is not that in the evidence; either side may lack one."""
    a = evidence.groupBy("termlink_id").agg(F.count("*").alias("n_evidence"))
    b = rollup.groupBy("termlink_id").agg(F.sum("evidence_count").alias("n_rollup"))
    return a.join(b, "termlink_id", "full").where("coalesce(n_evidence, 0) <> coalesce(n_rollup, 0)")


def materialization(evidence: DataFrame, mapping: DataFrame, by_subject: DataFrame, by_project: DataFrame) -> DataFrame:
    """One row: what both rollups hold beside what they should, and a verdict with its reasons.

    Numbers of rows and subjects, null keys, and the termlinks of every subject (no sample) are compared.
    Totals of evidence are shown but not judged, since a rollup counts evidence of one id once.
    """
    keys = ["subject_id", "term_iri", "termlink_id"]
    c, zero, null_key = F.col, F.lit(0), F.expr(" or ".join(f"{k} is null" for k in keys))
    # evidence whose subjects are together stays where it is: both aggregations and the join begin with the subject
    want = evidence.groupBy(*keys).agg(F.count("*").alias("n")).groupBy("subject_id").agg(
        F.count_if(~null_key).alias("whole"), F.count("*").alias("links"), F.count_distinct("termlink_id").alias("n_evidence"), F.sum("n").alias("lines")
    )
    got = by_subject.groupBy("subject_id").agg(F.count("*").alias("n_rollup"), F.sum("evidence_count").alias("counted"), F.count_if(null_key).alias("null_keys"))
    per = want.join(got, "subject_id", "full").join(mapping.groupBy("subject_id").agg(F.count("*").alias("projects")), "subject_id", "left")
    known = c("subject_id").isNotNull()
    total = lambda x, name: F.coalesce(F.sum(x), zero).alias(name)
    sums = per.agg(
        total(c("whole"), "want_rows"), total(c("lines"), "want_evidence"), total(c("n_rollup"), "rows"), total(c("counted"), "evidence"), total(c("links") * c("projects"), "want_project_rows"),
        F.count_if(known & c("links").isNotNull()).alias("want_subjects"), F.count_if(known & c("n_rollup").isNotNull()).alias("subjects"), total(c("null_keys"), "null_keys"),
        F.count_if(known & (F.coalesce("n_evidence", zero) != F.coalesce("n_rollup", zero))).alias("mismatched_subjects"),
    )
    out = sums.join(by_project.agg(F.count("*").alias("project_rows")), F.lit(True))  # one row each
    unlike = lambda what, w, g: F.when(c(w) != c(g), F.format_string(f"{what} count mismatch! Expected: %,d, Got: %,d", c(w), c(g)))
    errors = F.concat_ws(
        "; ", unlike("Term", "want_rows", "rows"), unlike("Subject", "want_subjects", "subjects"), unlike("Project row", "want_project_rows", "project_rows"),
        F.when(c("null_keys") > 0, F.format_string("Found %,d records with NULL critical fields!", c("null_keys"))),
        F.when(c("mismatched_subjects") > 0, F.format_string("Verification failed! %,d subjects have mismatched term counts", c("mismatched_subjects"))),
    )
    columns = ["want_rows", "want_evidence", "rows", "evidence", "want_project_rows", "project_rows", "want_subjects", "subjects", "null_keys", "mismatched_subjects"]
    return out.select(*columns, errors.alias("errors")).withColumn("valid", c("errors") == "")


def rehash_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows and subjects before and after a rehash, missing ids, rows whose ids are not those of their columns, and repeated ids."""
    fresh = E.with_ids(after.withColumns({"__e": F.col("evidence_id"), "__t": F.col("termlink_id")}))
    bad = F.count_if(~(F.col("evidence_id").eqNullSafe(F.col("__e")) & F.col("termlink_id").eqNullSafe(F.col("__t")))).alias("wrong_ids")
    a = before.agg(F.count("*").alias("rows_before"), F.count_distinct("subject_id").alias("subjects_before"))
    b = fresh.agg(F.count("*").alias("rows_after"), F.count_distinct("subject_id").alias("subjects_after"), F.count_if(F.col("__e").isNull() | F.col("__t").isNull()).alias("null_ids"), bad)
    c = duplicates(after).agg(F.count("*").alias("repeated_ids"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))


def _unlike(a: DataFrame, b: DataFrame, keys: list[str], buckets: int = 1 << 16, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides in buckets that differ, for an exact comparison; all rows if more than ``most`` do.

    A bucket's numbers of rows and sums of two hashes of 64 bits are compared, so that what is alike
    is not shuffled; a row that stands twice makes a difference too.
    """
    one, two = F.xxhash64(*keys), F.xxhash64(F.lit("other"), *keys)
    bucket = F.pmod(one, F.lit(buckets))
    halves = [h for x in (one, two) for h in (x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32))]

    def sums(df: DataFrame) -> DataFrame:
        return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), *[F.sum(h).alias(f"h{k}") for k, h in enumerate(halves)])

    x, y = sums(a), sums(b)
    odd = [r["bucket"] for r in x.withColumn("side", F.lit(1)).union(y.withColumn("side", F.lit(-1))).groupBy("bucket", "n", "h0", "h1", "h2", "h3").agg(F.sum("side").alias("side")).where("side <> 0").select("bucket").distinct().limit(most + 1).collect()]
    return (a, b) if len(odd) > most else (a.where(bucket.isin(odd)), b.where(bucket.isin(odd)))


def graph_differences(triples: DataFrame, by_subject: DataFrame, mapping: DataFrame) -> DataFrame:
    """(kind, side, s, o): what the tables say and the graph lacks, and the other way round, for links, terms, qualifiers and mappings."""
    keys = ["s", "p", "o"]
    want = G.triples(by_subject, unique=True).union(G.project_triples(mapping).where("p = 'hasProjectSubjectId'"))
    have = triples.where(F.col("p").isin("hasTermLink", "hasTerm", "hasQualifyingTerm", "hasProjectSubjectId")).select(*keys)
    want, have = _unlike(want, have, keys)
    want, have = want.distinct(), have.distinct()
    lacks = want.join(have, keys, "left_anti").select(F.col("p").alias("kind"), F.lit("missing").alias("side"), "s", "o")
    return lacks.union(have.join(want, keys, "left_anti").select(F.col("p").alias("kind"), F.lit("unknown").alias("side"), "s", "o"))


def ontology_versions(hierarchy: DataFrame, graph_labels: DataFrame) -> DataFrame:
    """Per source and version: terms in the hierarchy, terms in the graph (source, term_iri), the difference in percent, and whether it is above 50."""
    a = hierarchy.groupBy("ontology_source", "version").agg(F.count("*").alias("terms"))
    b = graph_labels.groupBy("source").agg(F.count_distinct("term_iri").alias("graph_terms"))
    out = a.join(b, F.col("ontology_source") == F.col("source"), "left").withColumn("graph_terms", F.coalesce("graph_terms", F.lit(0)))
    percent = F.round(F.abs(F.col("terms") - F.col("graph_terms")) * 100.0 / F.col("terms"), 6)
    return out.select("ontology_source", "version", "terms", "graph_terms", percent.alias("percent"), (percent > 50).alias("warn"))


def throughput(runs: DataFrame) -> DataFrame:
    """Records and evidence a second of import runs (run_id, records, evidence, seconds); null for a run of no time."""
    per = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("seconds").cast("double")), 6)
    return runs.select("run_id", per("records").alias("records_per_second"), per("evidence").alias("evidence_per_second"))


def qualifier_distribution(rollup: DataFrame) -> DataFrame:
    """How many termlinks each active qualifier holds for, and none."""
    quals = X.normalize_qualifiers(F.col("qualifiers"))
    return rollup.select(F.explode(F.when(F.size(quals) > 0, quals).otherwise(F.array(F.lit("none")))).alias("qualifier")).groupBy("qualifier").agg(F.count("*").alias("n"))
