"""Import: NDJSON records become evidence rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.evidence import with_ids
from ..operators.rollup import insert_only
from ..schemas import RECORD
from ..storage import Store

KEYS = ["project_id", "project_subject_id"]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All NDJSON files below a path, each row with the name of its file as batch_id where it has none."""
    rows = spark.read.schema(RECORD).option("recursiveFileLookup", True).json(path)
    return rows.withColumn("batch_id", F.coalesce("batch_id", F.input_file_name()))


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, RECORD).alias("r")).select("r.*")


def subject_uid(project: Column, psid: Column) -> Column:
    """A subject's id made from its natural key, so that every run mints the same."""
    return F.sha2(F.concat_ws("|", project, psid), 256)


def resolve_subjects(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """The mapping with ids minted for the (project_id, project_subject_id) pairs that it lacks."""
    missing = pairs.select(*KEYS).distinct().join(mapping, KEYS, "left_anti")
    return mapping.select(*KEYS, "subject_id").unionByName(missing.withColumn("subject_id", subject_uid(F.col("project_id"), F.col("project_subject_id"))))


def flatten(records: DataFrame, mapping: DataFrame, run_id: str, now: Column | None = None) -> DataFrame:
    """One row of the evidence table for each item of evidence; a record without a subject, or an unknown kind of creator, is an error."""
    rows = records.join(mapping, KEYS, "left").withColumn("e", F.explode("evidence"))
    e, now = F.col("e"), F.current_timestamp() if now is None else now
    subject = F.coalesce("subject_id", F.raise_error(F.concat(F.lit("no subject for "), F.concat_ws("#", *KEYS))).cast("string"))
    assertion, kind = X.eco_types(e["evidence_creator_type"])
    # what is worked out from the qualifiers and the creator is projected once, not in each use
    rows = rows.select("*", X.context_qualifiers(e["contexts"]).alias("qualifiers"), kind.alias("evidence_type"), assertion.alias("assertion_type"), subject.alias("__subject"))
    out = rows.select(
        F.lit(run_id).alias("run_id"), F.col("batch_id").cast("string").alias("batch_id"), "evidence_type", "assertion_type", now.alias("created_timestamp"), F.to_date(now).alias("created_date"),
        F.lit("clinical_note").alias("source_level"), F.col("__subject").alias("subject_id"), e["encounter_id"].alias("encounter_id"), e["clinical_note_id"].alias("clinical_note_id"), "term_iri",
        F.struct(X.term_source(X.term_id(F.col("term_iri"))).alias("source"), F.lit(None).cast("string").alias("version"), F.col("term_iri").alias("iri")).alias("term_source"),
        F.struct(e["note_type"].alias("note_type"), X.iso_timestamp(e["note_timestamp"]).alias("note_date"), e["provider_type"].alias("provider_type"), e["author_specialty"].alias("author_specialty")).alias("note_context"),
        F.struct(e["evidence_creator_id"].alias("creator_id"), e["evidence_creator_type"].alias("creator_type"), e["evidence_creator_name"].alias("creator_name")).alias("creator"),
        F.struct(e["span_start"].alias("span_start"), e["span_end"].alias("span_end"), F.lit(None).cast("string").alias("annotation_metadata")).alias("text_annotation"),
        "qualifiers",
    )
    return with_ids(out)


def bulk_import(records: DataFrame, mapping: DataFrame, existing: DataFrame, run_id: str, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new evidence rows, complete mapping): subjects resolved, evidence flattened, only what is not there yet."""
    whole = resolve_subjects(records, mapping)
    return insert_only(existing, flatten(records, whole, run_id, now)), whole


def validate_input_files(spark: SparkSession, path: str) -> dict:
    """The NDJSON files below a path (packed ones too), their size, and the project they are for: from a folder's name, or else the first record."""
    from ..storage import listing

    files = [(p, n) for p, n in listing(spark, path, recursive=True) if (q := re.sub(r"\.(gz|bz2)$", "", p)).endswith(".json") or (q.endswith(".jsonl") and "/jsonl/" in q)]
    if not files:
        raise FileNotFoundError(f"no input files below {path}")
    named = [part.split("=", 1)[1] if "=" in part else files[0][0].split("/projects/")[1].split("/")[0] for part in files[0][0].split("/") if part.startswith("project_id=") or part == "projects"]
    first = None if named else spark.read.schema(RECORD).json([p for p, _ in files]).where("project_id is not null").select("project_id").first()
    if not named and first is None:
        raise ValueError(f"no project_id below {path}")
    return {"files": [p for p, _ in files], "n_files": len(files), "total_bytes": sum(n for _, n in files), "project_id": named[0] if named else first["project_id"]}


def import_run(store: Store, records: DataFrame, run_id: str) -> dict:
    """Import records into the stored tables: mapping, evidence and the rollups of the subjects they touch; a status with counts."""
    from ..operators.subjects import refresh_touched

    try:
        new, whole = bulk_import(records, store.read("subject_mapping"), store.read("evidence"), run_id)
        store.replace("subject_mapping", whole)
        store.append("evidence", new)
    except Exception as e:
        return {"status": "import_failure", "run_id": run_id, "error": str(e)[:500]}
    done = store.read("evidence").where(F.col("run_id") == run_id)
    refresh_touched(store, done.select("subject_id").distinct())
    return {"status": "import_success", "run_id": run_id, "evidence": done.count()}
