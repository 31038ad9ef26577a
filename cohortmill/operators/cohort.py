"""Cohort questions over the project-term rollup."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .ontology import expand_terms

ROOTS = ("HP:0000001", "HP:0000118")
#: Terms up to which a request is a list in the plan; more are joined.
LISTED = 1000


@dataclass(frozen=True)
class CohortRequest:
    project_id: str
    terms: list[str] = field(default_factory=list)
    include_child_terms: bool = True
    include_qualified: bool = True
    project_subject_ids: list[str] = field(default_factory=list)
    associated_with: str | None = None
    limit: int = 1000
    cursor: str | None = None


def check(r: CohortRequest) -> CohortRequest:
    """The request as it is answered, or an error.

    A project is needed; terms or an associated entity, not both; an associated entity's terms are
    never expanded; a root term cannot be expanded; the cursor is a number.
    """
    if not r.project_id:
        raise ValueError("project_id is needed")
    if r.terms and r.associated_with:
        raise ValueError("terms or an associated entity, not both")
    if r.limit < 1 or (r.cursor is not None and not str(r.cursor).isdigit()):
        raise ValueError("limit must be above 0, the cursor a number")
    if r.associated_with:
        return replace(r, include_child_terms=False)
    if r.include_child_terms and any(t in ROOTS for t in r.terms):
        raise ValueError("a root term cannot be expanded")
    return r


def associated_terms(associations: DataFrame, entity: str) -> list[str]:
    """The terms that a table (entity, object) names for an entity, sorted, without roots: a list of some hundred."""
    return [r["object"] for r in associations.where(F.col("entity") == entity).select("object").distinct().orderBy("object").collect() if r["object"] not in ROOTS]


def unqualified(rollup: DataFrame) -> DataFrame:
    """Rows without an active excluding qualifier; a missing list counts as none."""
    return rollup.where(~X.excluding(F.col("qualifiers")))


def matching(rollup: DataFrame, hierarchy: DataFrame, r: CohortRequest, versions: dict[str, str], associations: DataFrame | None = None) -> DataFrame:
    """The rollup rows that a request is about: filters first, then a semi-join with the expanded terms."""
    rows = rollup.where(F.col("project_id") == r.project_id)
    if r.project_subject_ids:
        rows = rows.where(F.col("project_subject_id").isin(r.project_subject_ids))
    if not r.include_qualified:
        rows = unqualified(rows)
    if r.associated_with:
        return rows.where(F.col("term_id").isin(associated_terms(associations, r.associated_with)))
    if r.terms:
        if not r.include_child_terms:
            return rows.where(F.col("term_id").isin(r.terms))
        wanted = expand_terms(hierarchy, r.terms, versions)
        few = wanted.limit(LISTED + 1).collect()
        if len(few) <= LISTED:  # reaches the scan as a filter
            return rows.where(F.col("term_id").isin([x["term_id"] for x in few]))
        return rows.join(wanted, "term_id", "left_semi")
    return rows


def subjects(rows: DataFrame) -> DataFrame:
    """One row a subject, with its matching terms as a sorted list."""
    quals = F.array_join(X.normalize_qualifiers(F.col("qualifiers")), ",")
    item = F.concat_ws("|", "term_id", quals, F.col("evidence_count").cast("string"))
    return rows.groupBy("subject_id", "project_subject_id").agg(
        F.count("*").alias("n_termlinks"),
        F.sum("evidence_count").cast("long").alias("evidence_total"),
        F.min("first_evidence_date").alias("first_date"),
        F.max("last_evidence_date").alias("last_date"),
        F.array_join(F.array_sort(F.collect_list(item)), ";").alias("phenotypes"),
    )


def page(df: DataFrame, limit: int, cursor: str | None = None) -> DataFrame:
    """Rows cursor, cursor + 1, ... in the order (subject_id, project_subject_id)."""
    return df.orderBy("subject_id", "project_subject_id").offset(int(cursor or 0)).limit(limit)


def page_after(df: DataFrame, limit: int, after: tuple[str, str] | None = None) -> DataFrame:
    """The page behind a key, which stays cheap however far it is; filters reach the rows before they are grouped."""
    if after is not None:
        df = df.where((F.col("subject_id") > after[0]) | ((F.col("subject_id") == after[0]) & (F.col("project_subject_id") > after[1])))
    return df.orderBy("subject_id", "project_subject_id").limit(limit)


def first_subjects(rows: DataFrame, limit: int, cursor: str | None = None) -> DataFrame:
    """The rows of one page of subjects: their keys are ordered first, so that only the page's rows are grouped into lists."""
    keys = page(rows.select("subject_id", "project_subject_id").distinct(), limit, cursor)
    return rows.join(F.broadcast(keys), ["subject_id", "project_subject_id"], "left_semi")  # a page


def cohort(rollup: DataFrame, hierarchy: DataFrame, r: CohortRequest, versions: dict[str, str], associations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of subjects, and the number of distinct subjects of all pages."""
    rows = matching(rollup, hierarchy, check(r), versions, associations)
    return subjects(first_subjects(rows, r.limit, r.cursor)).orderBy("subject_id", "project_subject_id"), rows.agg(F.count_distinct("subject_id").alias("total_count"))


def paged(subjects_page: DataFrame, total: DataFrame, r: CohortRequest) -> dict:
    """subjects, total_count, has_more and next_cursor."""
    got, n, at = subjects_page.collect(), total.first()["total_count"], int(r.cursor or 0)
    more = at + len(got) < n
    return {"subjects": got, "total_count": n, "has_more": more, "next_cursor": str(at + len(got)) if more else None}
