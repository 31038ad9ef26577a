"""Projects, subjects and the mapping between them; what is removed takes along what only it held."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..storage import Store, save
from . import graph
from .rollup import by_project_term_rows, by_subject_rows

KEYS = ["project_id", "project_subject_id"]


def exists(rows: DataFrame, **key: str) -> bool:
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    return not rows.limit(1).isEmpty()


def create_project(store: Store, project_id: str, label: str | None = None) -> bool:
    """True if the project is new."""
    if not project_id:
        raise ValueError("project_id is needed")
    if exists(store.read("project"), project_id=project_id):
        return False
    store.append("project", store.spark.createDataFrame([(project_id, label or project_id)], "project_id string, project_label string"))
    return True


def create_subject(store: Store, project_id: str, project_subject_id: str, known_subject_id: str | None = None, known_project_id: str | None = None, known_project_subject_id: str | None = None) -> dict:
    """A new subject in a project, or a known one linked to it; its rollups are made for the project that it joins.

    The known subject is named by its id, or by a project and its id there.  An error: a project
    that does not exist, a known subject that does not, both ways of naming it, half of the second.
    A pair that is mapped already is returned if it is the same subject, else an error.
    """
    if not project_id or not project_subject_id:
        raise ValueError("project_id and project_subject_id are needed")
    if known_subject_id and (known_project_id or known_project_subject_id):
        raise ValueError("a known subject is named by its id or by a project, not both")
    if bool(known_project_id) != bool(known_project_subject_id):
        raise ValueError("known_project_id and known_project_subject_id go together")
    if not exists(store.read("project"), project_id=project_id):
        raise LookupError(f"no project {project_id}")
    mapping = store.read("subject_mapping")
    subject = known_subject_id
    if known_project_id:
        row = mapping.where((F.col("project_id") == known_project_id) & (F.col("project_subject_id") == known_project_subject_id)).first()
        if row is None:
            raise LookupError(f"no subject {known_project_subject_id} in {known_project_id}")
        subject = row["subject_id"]
    elif subject and not exists(mapping, subject_id=subject):
        raise LookupError(f"no subject {subject}")
    there = mapping.where((F.col("project_id") == project_id) & (F.col("project_subject_id") == project_subject_id)).first()
    if there is not None:
        if subject and there["subject_id"] != subject:
            raise ValueError(f"{project_subject_id} is another subject in {project_id}")
        return {"subject_id": there["subject_id"], "created": False, "linked": False}
    linked, subject = subject is not None, subject or str(uuid.uuid4())
    store.append("subject_mapping", store.spark.createDataFrame([(project_id, project_subject_id, subject)], "project_id string, project_subject_id string, subject_id string"))
    if linked:
        try:
            materialize_subject(store, subject)
        except Exception:
            store.delete("subject_mapping", (F.col("project_id") == project_id) & (F.col("project_subject_id") == project_subject_id))
            raise
    return {"subject_id": subject, "created": not linked, "linked": linked}


def get_subject(store: Store, project_id: str | None = None, project_subject_id: str | None = None, subject_id: str | None = None, iri: str | None = None) -> dict:
    """A subject with its terms, by its place in a project (also as an IRI; terms may be none) or by its id (a LookupError if it has none)."""
    if iri:
        project_id, project_subject_id = iri.rstrip("/").split("/")[-2:]
    if project_id:
        row = store.read("subject_mapping").where((F.col("project_id") == project_id) & (F.col("project_subject_id") == project_subject_id)).first()
        if row is None:
            raise LookupError(f"no subject {project_subject_id} in {project_id}")
        subject_id = row["subject_id"]
    terms = terms_of(store.read("subject_terms_by_subject"), subject_id).collect()
    if not terms and not project_id:
        raise LookupError(f"no subject {subject_id}")
    return {"subject_id": subject_id, "project_subject_id": project_subject_id, "terms": terms}


def terms_of(rollup: DataFrame, subject_id: str) -> DataFrame:
    return rollup.where(F.col("subject_id") == subject_id).select("term_id", "term_iri", "term_label", X.qualifiers_to_strings(F.col("qualifiers")).alias("qualifiers"), "evidence_count", "termlink_id", "first_evidence_date", "last_evidence_date").orderBy("term_id", "termlink_id")


def last_mappings(mapping: DataFrame, gone: DataFrame) -> DataFrame:
    """subject_id of the subjects that have no row in ``mapping`` but those in ``gone``."""
    left = mapping.join(gone.select(*KEYS), KEYS, "left_anti").select("subject_id")
    return gone.select("subject_id").distinct().join(left, "subject_id", "left_anti")


def without_subjects(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("subject_id").distinct(), "subject_id", "left_anti")


def _remove(store: Store, gone: DataFrame) -> dict:
    """Drop the mapping rows ``gone``; subjects that had no others lose their evidence, rollups and triples as well."""
    gone = save(gone.select(*KEYS, "subject_id"), "unlinked")
    mapping = store.read("subject_mapping")
    ids = save(last_mappings(mapping, gone), "orphans")
    links = save(store.read("evidence").join(ids, "subject_id", "left_semi").select("subject_id", "termlink_id").distinct(), "orphan-links")
    counts = {"mappings": gone.count(), "subjects": ids.count(), "termlinks": links.count()}
    if counts["subjects"]:
        store.replace("triples", graph.without_nodes(store.read("triples"), links.select(graph.link_iri(F.col("subject_id"), F.col("termlink_id")).alias("node")).union(ids.select(X.subject_iri(F.col("subject_id")).alias("node")))))
        store.replace("evidence", without_subjects(store.read("evidence"), ids))
        store.replace("subject_terms_by_subject", without_subjects(store.read("subject_terms_by_subject"), ids))
    store.replace("subject_terms_by_project_term", store.read("subject_terms_by_project_term").join(gone.select(*KEYS), KEYS, "left_anti"))
    store.replace("subject_mapping", mapping.join(gone.select(*KEYS), KEYS, "left_anti"))
    return counts


def remove_subject(store: Store, project_id: str, project_subject_id: str) -> dict:
    """Unlink a subject from a project; with its last link go its evidence, rollups and triples."""
    gone = store.read("subject_mapping").where((F.col("project_id") == project_id) & (F.col("project_subject_id") == project_subject_id))
    if gone.isEmpty():
        raise LookupError(f"no subject {project_subject_id} in {project_id}")
    return _remove(store, gone)


def remove_project(store: Store, project_id: str) -> dict:
    """A project with all its links, and with the subjects that no other project has."""
    if not exists(store.read("project"), project_id=project_id):
        raise LookupError(f"no project {project_id}")
    counts = _remove(store, store.read("subject_mapping").where(F.col("project_id") == project_id))
    store.replace("triples", store.read("triples").where(F.col("graph") != X.BASE + "projects/" + project_id))
    store.delete("project", F.col("project_id") == project_id)
    return counts


def materialize_subject(store: Store, subject_id: str) -> None:
    """The rollup rows of one subject, in all its projects, made anew from its evidence."""
    refresh_subjects(store, [subject_id])


def materialize_project(store: Store, project_id: str) -> dict:
    """The rollup rows of a project and of its subjects made anew; how many subjects and rows."""
    mapping = store.read("subject_mapping").where(F.col("project_id") == project_id)
    rows = by_project_term_rows(by_subject_rows(store.read("evidence").join(mapping.select("subject_id").distinct(), "subject_id", "left_semi")), mapping)
    kept = store.read("subject_terms_by_project_term").where(F.col("project_id") != project_id)
    store.replace("subject_terms_by_project_term", kept.unionByName(rows))
    done = store.read("subject_terms_by_project_term").where(F.col("project_id") == project_id).agg(F.count_distinct("subject_id").alias("subjects"), F.count("*").alias("rows")).first()
    return {"subjects": done["subjects"], "rows": done["rows"]}


def materialize_all(store: Store) -> dict:
    """Both rollups made anew from all evidence: evidence is read and shuffled once."""
    store.replace("subject_terms_by_subject", by_subject_rows(store.read("evidence")))
    rows = by_project_term_rows(store.read("subject_terms_by_subject"), store.read("subject_mapping"))
    store.replace("subject_terms_by_project_term", rows)
    return {name: store.read(name).count() for name in ("subject_terms_by_subject", "subject_terms_by_project_term")}


def refresh_touched(store: Store, touched: DataFrame) -> None:
    """Both rollups of the subjects (column subject_id) made anew: what adding or removing evidence calls."""
    ids = save(touched.select("subject_id").distinct(), "touched")
    fresh = save(by_subject_rows(store.read("evidence").join(ids, "subject_id", "left_semi")), "fresh-rows")
    mapping = store.read("subject_mapping").join(ids, "subject_id", "left_semi")
    store.replace("subject_terms_by_subject", store.read("subject_terms_by_subject").join(ids, "subject_id", "left_anti").unionByName(fresh))
    store.replace("subject_terms_by_project_term", store.read("subject_terms_by_project_term").join(ids, "subject_id", "left_anti").unionByName(by_project_term_rows(fresh, mapping)))


def refresh_subjects(store: Store, subject_ids: Iterable[str]) -> None:
    refresh_touched(store, store.spark.createDataFrame([(i,) for i in sorted(set(subject_ids))], "subject_id string"))
