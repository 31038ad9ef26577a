"""The calls of the service, one function a path, over a folder of stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import cohort as C
from .operators import evidence as E
from .operators import ontology as O
from .operators import subjects as S
from .storage import Store


def project_create(store: Store, project_id: str, label: str | None = None) -> dict:
    return {"project_id": project_id, "created": S.create_project(store, project_id, label)}


def project_remove(store: Store, project_id: str) -> dict:
    return S.remove_project(store, project_id)


def subject_create(store: Store, project_id: str, project_subject_id: str, **known: str) -> dict:
    return S.create_subject(store, project_id, project_subject_id, **known)


def subject(store: Store, **which: str) -> dict:
    return S.get_subject(store, **which)


def subject_remove(store: Store, project_id: str, project_subject_id: str) -> dict:
    return S.remove_subject(store, project_id, project_subject_id)


def subject_term_info(store: Store, subject_id: str, term_iri: str, qualifiers: list[str] | None = None) -> dict:
    row = E.term_info(store.read("evidence"), subject_id, term_iri, qualifiers).first()
    if row is None:
        raise LookupError("no such link of a subject to a term")
    return row.asDict(recursive=True)


def versions(store: Store) -> dict[str, str]:
    """The version of each ontology that was installed last."""
    return {r["source"]: r["version"] for r in O.current_version(store.read("term_source")).collect()}


def subjects_query(store: Store, project_id: str, **rest) -> dict:
    r = C.CohortRequest(project_id, **rest)
    return C.paged(*C.cohort(store.read("subject_terms_by_project_term"), store.read("ontology_hierarchy"), r, versions(store), store.read("association")), r)


def source(store: Store, name: str) -> dict:
    row = O.source_info(store.read("term_source").where(F.col("source") == name)).first()
    if row is None:
        raise LookupError(f"no source {name}")
    return row.asDict(recursive=True)


def evidence_create(store: Store, record: dict) -> dict:
    """Add one assertion, unless it is there, and bring the rollups of its subject up to date."""
    if not S.exists(store.read("subject_mapping"), subject_id=record.get("subject_id") or ""):
        raise LookupError(f"no subject {record.get('subject_id')}")
    row = E.one_row(store.spark, record)
    ids = row.select("evidence_id", "termlink_id").first().asDict()
    if S.exists(store.read("evidence"), **ids):
        return ids | {"created": False}
    store.append("evidence", row)
    S.refresh_subjects(store, [record["subject_id"]])
    return ids | {"created": True}


def evidence(store: Store, evidence_id: str) -> dict:
    row = E.by_id(store.read("evidence"), evidence_id).first()
    if row is None:
        raise LookupError(f"no evidence {evidence_id}")
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None or k not in ("text_annotation", "term_source")}


def evidence_query(store: Store, limit: int = 100, next_token: str | None = None, **which) -> dict:
    return E.page(E.query(store.read("evidence"), **which), limit, next_token)


def evidence_query_by_run(store: Store, run_id: str, limit: int = 1000, next_token: str | None = None) -> dict:
    return E.page(store.read("evidence").where(F.col("run_id") == run_id), limit, next_token, E.MOST_RUN_PAGE)


def evidence_remove(store: Store, evidence_id: str) -> bool:
    """False if there is no such evidence; else it goes, and its subject's rollups follow."""
    row = store.read("evidence").where(F.col("evidence_id") == evidence_id).select("subject_id").first()
    if row is None:
        return False
    store.delete("evidence", F.col("evidence_id") == evidence_id)
    S.refresh_subjects(store, [row["subject_id"]])
    return True
