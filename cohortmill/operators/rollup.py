"""Rollups of evidence to subject-term rows, and how they are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .evidence import flat

SUBJECT_KEYS = ["subject_id", "term_iri", "term_id", "termlink_id"]
PROJECT_KEYS = ["project_id", "subject_id", "project_subject_id", "term_iri", "term_id", "termlink_id"]


_TAIL = ["qualifiers", "evidence_count", "first_evidence_date", "last_evidence_date"]


def _rolled(df: DataFrame, keys: list[str], unique: bool = False) -> DataFrame:
    # a termlink's active qualifiers are part of its id, so any row's will do: no explode
    count = F.count("*") if unique else F.count_distinct("evidence_id")
    return df.groupBy(*keys).agg(
        F.min(X.active_qualifiers(F.col("qualifiers"))).alias("qualifiers"),
        count.alias("evidence_count"),
        F.min("note_date").alias("first_evidence_date"),
        F.max("note_date").alias("last_evidence_date"),
    )


def by_subject(evidence: DataFrame, unique: bool = False) -> DataFrame:
    """One row a termlink.  Evidence that is ``unique`` by its id, as in the stored table, is counted without its ids being shuffled."""
    return _rolled(evidence, SUBJECT_KEYS, unique)


def by_project_term(evidence: DataFrame, mapping: DataFrame, unique: bool = False) -> DataFrame:
    """Rolled up once a subject, then joined with the mapping: evidence is shuffled once and never multiplied."""
    return by_subject(evidence, unique).join(mapping, "subject_id").select(*PROJECT_KEYS, *_TAIL)


def by_subject_rows(evidence: DataFrame) -> DataFrame:
    """The rows of the stored by-subject table, from stored evidence."""
    return by_subject(flat(evidence), unique=True).withColumns({"subject_iri": X.subject_iri(F.col("subject_id")), "term_label": F.lit(None).cast("string")})


def by_project_term_rows(by_subject_table: DataFrame, mapping: DataFrame) -> DataFrame:
    """The rows of the stored by-project table, from those of the by-subject one."""
    return by_subject_table.join(mapping, "subject_id").withColumn("project_subject_iri", X.project_subject_iri(F.col("project_id"), F.col("project_subject_id")))


def merge_delta(target: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Target with the delta merged: counts added, dates widened, qualifiers united, new keys inserted.  One aggregation over both."""
    return target.unionByName(delta).groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("qualifiers")))).alias("qualifiers"),
        F.sum("evidence_count").alias("evidence_count"),
        F.min("first_evidence_date").alias("first_evidence_date"),
        F.max("last_evidence_date").alias("last_evidence_date"),
    )


def refresh(target: DataFrame, evidence: DataFrame, touched: DataFrame, keys: list[str], mapping: DataFrame | None = None) -> DataFrame:
    """Target with the rows of the touched subjects computed anew from evidence (the idempotent way)."""
    some = evidence.join(touched.select("subject_id").distinct(), "subject_id", "left_semi")
    fresh = by_subject(some) if mapping is None else by_project_term(some, mapping)
    return target.join(touched.select("subject_id").distinct(), "subject_id", "left_anti").unionByName(fresh).select(*keys, *_TAIL)


def dedupe(evidence: DataFrame) -> DataFrame:
    """One row for each (subject_id, evidence_id): the first by all other columns, so every run keeps the same."""
    rest = [c for c in evidence.columns if c not in ("subject_id", "evidence_id")]
    w = Window.partitionBy("subject_id", "evidence_id").orderBy(*rest)
    return evidence.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def insert_only(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a batch that are not in ``existing`` yet, each once.

    One window over both: rows of a subject that are together already, on both sides, stay where they are.
    """
    keys, new, place = ["subject_id", "evidence_id"], "__new", "__n"
    rest = [c for c in batch.columns if c not in keys]
    have = existing.where(F.col("subject_id").isNotNull() & F.col("evidence_id").isNotNull()).select(*keys)
    have = have.select(*[F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in batch.schema], F.lit(0).alias(new))
    w = Window.partitionBy(*keys).orderBy(new, *rest)
    return batch.withColumn(new, F.lit(1)).union(have).withColumn(place, F.row_number().over(w)).where((F.col(place) == 1) & (F.col(new) == 1)).drop(new, place)
