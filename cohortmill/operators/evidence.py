"""Evidence rows: making, looking up, paging and counting them."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X

MOST_PAGE, MOST_RUN_PAGE = 1000, 10_000
ORDER = ["created_timestamp", "evidence_id"]


def with_ids(rows: DataFrame, normal: Column | None = None) -> DataFrame:
    """``rows`` with termlink_id and evidence_id worked out from their other columns; ``normal``: their normalized qualifiers, if known."""
    c, normal = F.col, X.normalize_qualifiers(F.col("qualifiers")) if normal is None else normal
    link = X.termlink_hash(X.subject_iri(c("subject_id")), c("term_iri"), normal)
    own = X.evidence_hash(c("clinical_note_id"), c("encounter_id"), c("term_iri"), c("text_annotation.span_start"), c("text_annotation.span_end"), normal, c("subject_id"), c("creator.creator_id"))
    return rows.withColumns({"termlink_id": link, "evidence_id": own})


def flat(evidence: DataFrame) -> DataFrame:
    """The columns that rollups and filters use, without structs."""
    return evidence.select(
        "evidence_id", "run_id", "subject_id", "termlink_id", "term_iri", X.term_id(F.col("term_iri")).alias("term_id"), "encounter_id", "clinical_note_id",
        F.col("creator.creator_id").alias("creator_id"), F.col("creator.creator_type").alias("creator_type"), F.col("text_annotation.span_start").alias("span_start"),
        F.col("text_annotation.span_end").alias("span_end"), F.to_date("note_context.note_date").alias("note_date"), "qualifiers", "created_timestamp",
    )


def one_row(spark: SparkSession, record: dict, now: datetime | None = None) -> DataFrame:
    """A single assertion made by hand: qualifiers as a map of type to value or a list of ``type:value``; ids are worked out."""
    for need in ("subject_id", "term_iri", "creator_id"):
        if not record.get(need):
            raise ValueError(f"{need} is needed")
    quals = record.get("qualifiers") or []
    pairs = [f"{k}:{str(v).lower() if isinstance(v, bool) else v}" for k, v in quals.items()] if isinstance(quals, dict) else [str(q) for q in quals]
    kinds = {"subject_id": "string", "term_iri": "string", "run_id": "string", "batch_id": "string", "encounter_id": "string", "clinical_note_id": "string", "evidence_type": "string", "assertion_type": "string", "creator_id": "string", "creator_type": "string", "creator_name": "string", "span_start": "int", "span_end": "int", "annotation_metadata": "string", "note_type": "string", "note_timestamp": "string", "provider_type": "string", "author_specialty": "string", "term_version": "string"}
    row = spark.createDataFrame([tuple(record.get(k) for k in kinds) + (pairs, now)], ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", quals array<string>, now timestamp")
    now_ = F.coalesce("now", F.current_timestamp())
    text = F.struct("span_start", "span_end", "annotation_metadata")
    out = row.select(
        "run_id", F.coalesce("batch_id", F.lit("")).alias("batch_id"), F.coalesce("evidence_type", F.lit("manual_annotation")).alias("evidence_type"),
        F.coalesce("assertion_type", F.lit("manual_assertion")).alias("assertion_type"), now_.alias("created_timestamp"), F.to_date(now_).alias("created_date"),
        F.when(F.col("clinical_note_id").isNotNull(), "clinical_note").otherwise("subject").alias("source_level"), "subject_id", "encounter_id", "clinical_note_id", "term_iri",
        F.struct(X.term_source(X.term_id(F.col("term_iri"))).alias("source"), F.col("term_version").alias("version"), F.col("term_iri").alias("iri")).alias("term_source"),
        F.struct("note_type", X.iso_timestamp(F.col("note_timestamp")).alias("note_date"), "provider_type", "author_specialty").alias("note_context"),
        F.struct("creator_id", F.coalesce("creator_type", F.lit("manual")).alias("creator_type"), "creator_name").alias("creator"),
        F.when(F.col("span_start").isNotNull() | F.col("span_end").isNotNull() | F.col("annotation_metadata").isNotNull(), text).alias("text_annotation"),
        X.qualifier_structs(F.col("quals")).alias("qualifiers"),
    )
    return with_ids(out)


def by_id(evidence: DataFrame, evidence_id: str) -> DataFrame:
    """The row of an id with its qualifiers as a map; at most one."""
    return evidence.where(F.col("evidence_id") == evidence_id).limit(1).withColumn("qualifiers", X.qualifier_map(F.col("qualifiers")))


def termlink_id(subject_id: str, term_iri: str, qualifiers: list[str] | None = None) -> Column:
    given = F.array(*map(F.lit, qualifiers or [])).cast("array<string>")
    return X.termlink_hash(X.subject_iri(F.lit(subject_id)), F.lit(term_iri), X.normalize_qualifiers(X.qualifier_structs(given)))


def for_termlink(evidence: DataFrame, subject_id: str, term_iri: str, qualifiers: list[str] | None = None) -> DataFrame:
    """The evidence of one link of a subject to a term, oldest first."""
    mine = (F.col("subject_id") == subject_id) & (F.col("term_iri") == term_iri) & (F.col("termlink_id") == termlink_id(subject_id, term_iri, qualifiers))
    return evidence.where(mine).orderBy(*ORDER)


def term_info(evidence: DataFrame, subject_id: str, term_iri: str, qualifiers: list[str] | None = None) -> DataFrame:
    """One row of a termlink: its id, number of evidence, the levels it comes from and its active qualifier types."""
    rows = for_termlink(evidence, subject_id, term_iri, qualifiers)
    types = F.array_distinct(F.flatten(F.collect_set(F.transform(X.active_qualifiers(F.col("qualifiers")), lambda q: q["qualifier_type"]))))
    return rows.groupBy("termlink_id", "subject_id", "term_iri").agg(F.count("*").alias("evidence_count"), F.array_sort(F.collect_set("source_level")).alias("source_types"), F.array_sort(types).alias("qualifier_types"), F.min(F.to_date("note_context.note_date")).alias("first_evidence_date"), F.max(F.to_date("note_context.note_date")).alias("last_evidence_date"))


def token_of(time: datetime | None, evidence_id: str) -> str:
    """What names the row that a page ended with."""
    return base64.urlsafe_b64encode(json.dumps([time.isoformat() if time else None, evidence_id]).encode()).decode()


def after(rows: DataFrame, token: str | None) -> DataFrame:
    """The rows behind the one that a token was made of, in the order of time and id."""
    if not token:
        return rows
    try:
        time, last = json.loads(base64.urlsafe_b64decode(token.encode()))
    except ValueError as e:
        raise ValueError("not a page token") from e
    at = F.lit(time).cast("timestamp")
    return rows.where((F.col("created_timestamp") > at) | ((F.col("created_timestamp") == at) & (F.col("evidence_id") > last)))


def page(rows: DataFrame, limit: int, token: str | None = None, most: int = MOST_PAGE) -> dict:
    """evidence (rows of one page), next_token (None on the last page), has_more, and total_count on the first page."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    got = after(rows, token).orderBy(*ORDER).limit(limit + 1).collect()
    more = len(got) > limit
    out = {"evidence": got[:limit], "has_more": more, "next_token": token_of(got[limit - 1]["created_timestamp"], got[limit - 1]["evidence_id"]) if more else None}
    return out if token else out | {"total_count": rows.count()}


def query(evidence: DataFrame, subject_id: str | None = None, term_iri: str | None = None, qualifiers: list[str] | None = None, run_id: str | None = None, link: str | None = None) -> DataFrame:
    """Evidence of a termlink (by id, or by subject, term and qualifiers) and, if given, of one run."""
    if link is None and not (subject_id and term_iri):
        raise ValueError("termlink_id, or subject_id and term_iri are needed")
    rows = evidence.where(F.col("termlink_id") == (F.lit(link) if link else termlink_id(subject_id, term_iri, qualifiers)))
    return rows.where(F.col("run_id") == run_id) if run_id else rows


def links_with_counts(evidence: DataFrame, labels: DataFrame | None = None, encounter_id: str | None = None, note_id: str | None = None) -> DataFrame:
    """term_iri, qualifier types that hold, number of termlinks and of evidence, and the term's label; of one encounter or note if given."""
    rows = evidence if encounter_id is None else evidence.where(F.col("encounter_id") == encounter_id)
    rows = rows if note_id is None else rows.where(F.col("clinical_note_id") == note_id)
    types = F.array_join(F.transform(X.normalize_qualifiers(F.col("qualifiers")), lambda q: F.split(q, ":")[0]), ",")
    # first by termlink, which most of the rows of a term share
    link = rows.groupBy("term_iri", "termlink_id", types.alias("qualifier_types")).agg(F.count("*").alias("n"))
    out = link.groupBy("term_iri", "qualifier_types").agg(F.count("*").alias("n_termlinks"), F.sum("n").alias("evidence_total"))
    return out if labels is None else out.join(labels, "term_iri", "left")


def rehash(evidence: DataFrame) -> DataFrame:
    """Both ids of every row worked out again from its stored columns; equal rows become one."""
    return with_ids(evidence).dropDuplicates(["subject_id", "evidence_id"])


def merge_rehash(evidence: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids replaced by those in ``changes`` (subject_id, old_evidence_id, evidence_id, termlink_id); other rows stay."""
    new = changes.select(F.col("subject_id").alias("__s"), F.col("old_evidence_id").alias("__o"), F.col("evidence_id").alias("__e"), F.col("termlink_id").alias("__t"))
    out = evidence.join(new, (F.col("subject_id") == F.col("__s")) & (F.col("evidence_id") == F.col("__o")), "left")
    return out.withColumns({"evidence_id": F.coalesce("__e", "evidence_id"), "termlink_id": F.coalesce("__t", "termlink_id")}).drop("__s", "__o", "__e", "__t")
