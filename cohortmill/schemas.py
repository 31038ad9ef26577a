"""Column types of the stored tables and of the input records."""

from __future__ import annotations

QUALIFIERS = "array<struct<qualifier_type:string,qualifier_value:string>>"

EVIDENCE = (
    "evidence_id string, run_id string, batch_id string, evidence_type string, assertion_type string, created_timestamp timestamp, created_date date, "
    "source_level string, subject_id string, encounter_id string, clinical_note_id string, termlink_id string, term_iri string, "
    "term_source struct<source:string,version:string,iri:string>, "
    "note_context struct<note_type:string,note_date:timestamp,provider_type:string,author_specialty:string>, "
    "creator struct<creator_id:string,creator_type:string,creator_name:string>, "
    f"text_annotation struct<span_start:int,span_end:int,annotation_metadata:string>, qualifiers {QUALIFIERS}"
)
BY_SUBJECT = (
    f"subject_id string, subject_iri string, term_iri string, term_id string, term_label string, qualifiers {QUALIFIERS}, evidence_count long, "
    "termlink_id string, first_evidence_date date, last_evidence_date date"
)
BY_PROJECT_TERM = "project_id string, project_subject_id string, project_subject_iri string, " + BY_SUBJECT
HIERARCHY = (
    "ontology_source string, version string, term_id string, term_iri string, term_label string, ancestor_term_ids array<string>, depth int, "
    "last_updated timestamp"
)
MAPPING = "project_id string, project_subject_id string, subject_id string"
PROJECT = "project_id string, project_label string"
SOURCE = "source string, version string, created_at timestamp, installed_at timestamp, assets array<struct<name:string,path:string>>"
TRIPLES = "graph string, s string, p string, o string"
ASSOCIATION = "entity string, object string"

#: Name, columns and folder columns of every stored table.
TABLES = {
    "evidence": (EVIDENCE, ["created_date"]),
    "subject_terms_by_subject": (BY_SUBJECT, []),
    "subject_terms_by_project_term": (BY_PROJECT_TERM, ["project_id"]),
    "ontology_hierarchy": (HIERARCHY, ["ontology_source", "version"]),
    "subject_mapping": (MAPPING, []),
    "project": (PROJECT, []),
    "term_source": (SOURCE, []),
    "triples": (TRIPLES, []),
    "association": (ASSOCIATION, []),
}

#: One line for each subject and term.  Contexts are read as text: 0.0, 1, true all come in.
RECORD = (
    "project_id string, project_subject_id string, term_iri string, row_num long, batch_id string, evidence array<struct<"
    "type:string, clinical_note_id:string, encounter_id:string, evidence_creator_id:string, evidence_creator_type:string, evidence_creator_name:string, "
    "note_timestamp:string, note_type:string, provider_type:string, author_specialty:string, span_start:int, span_end:int, "
    "contexts:struct<negated:string, family:string, hypothetical:string>>>"
)
PACKET = (
    "id string, metaData struct<created:string, createdBy:string, resources:array<struct<id:string, name:string, url:string, version:string, "
    "namespacePrefix:string, iriPrefix:string>>>, subject struct<id:string>, "
    "phenotypicFeatures array<struct<type:struct<id:string, label:string>, excluded:boolean>>"
)
