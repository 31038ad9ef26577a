"""Phenopackets in and out: JSON, and zip files of JSON."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators.evidence import with_ids
from ..schemas import PACKET
from .ingest import resolve_subjects

#: Bytes of a zip file that one task unpacks in memory.
MOST_BYTES = 1 << 30


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the JSON documents in the zip files below a path; folders, other files and broken JSON are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.is_dir() or not info.filename.lower().endswith(".json") or info.file_size > MOST_BYTES:
                            continue
                        try:
                            value = json.dumps(json.loads(z.read(info)))
                        except ValueError:
                            continue
                        yield pd.DataFrame({"file": [info.filename], "value": [value]})

    return files.mapInPandas(unpack, "file string, value string")


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.select(F.from_json(column, PACKET).alias("p")).select("p.*")


def evidence_of(packets: DataFrame, project_id: str, mapping: DataFrame, run_id: str = "phenopackets", now=None) -> tuple[DataFrame, DataFrame]:
    """(evidence rows, complete mapping) of phenopackets (columns as PACKET): subjects are minted as in the import, excluded features are negated."""
    pairs = packets.select(F.lit(project_id).alias("project_id"), F.col("id").alias("project_subject_id"))
    whole = resolve_subjects(pairs, mapping)
    none = F.expr("cast(array() as array<struct<namespacePrefix:string,iriPrefix:string>>)")
    spaces = F.map_from_entries(F.coalesce(F.transform("metaData.resources", lambda r: F.struct(r["namespacePrefix"], r["iriPrefix"])), none))
    f = packets.select("id", spaces.alias("spaces"), F.coalesce("metaData.createdBy", F.lit("phenopacket-importer")).alias("by"), F.explode("phenotypicFeatures").alias("f"))
    f = f.join(whole.where(F.col("project_id") == project_id).select(F.col("project_subject_id").alias("id"), "subject_id"), "id")
    now = F.current_timestamp() if now is None else now
    text = F.lit(None).cast("string")
    rows = f.select(
        F.lit(run_id).alias("run_id"), F.lit("").alias("batch_id"), F.lit(X.OBO + "ECO_0000311").alias("evidence_type"), F.lit("manual_assertion").alias("assertion_type"), now.alias("created_timestamp"), F.to_date(now).alias("created_date"),
        F.lit("subject").alias("source_level"), "subject_id", text.alias("encounter_id"), text.alias("clinical_note_id"), X.curie_to_iri(F.col("f.type.id"), F.col("spaces")).alias("term_iri"),
        F.struct(X.term_source(F.col("f.type.id")).alias("source"), text.alias("version"), F.col("f.type.id").alias("iri")).alias("term_source"),
        F.struct(text.alias("note_type"), F.lit(None).cast("timestamp").alias("note_date"), text.alias("provider_type"), text.alias("author_specialty")).alias("note_context"),
        F.struct(F.col("by").alias("creator_id"), F.lit("system").alias("creator_type"), text.alias("creator_name")).alias("creator"),
        F.lit(None).cast("struct<span_start:int,span_end:int,annotation_metadata:string>").alias("text_annotation"),
        F.when(F.coalesce("f.excluded", F.lit(False)), F.array(F.struct(F.lit("negated").alias("qualifier_type"), F.lit("true").alias("qualifier_value")))).otherwise(F.expr("cast(array() as array<struct<qualifier_type:string,qualifier_value:string>>)")).alias("qualifiers"),
    )
    return with_ids(rows).dropDuplicates(["subject_id", "evidence_id"]), whole


def packets(cohort_rows: DataFrame, labels: DataFrame, sources: DataFrame) -> DataFrame:
    """(subject, JSON) of project rollup rows: one packet a subject, its features with labels, counts of evidence, and the ontologies they come from.

    ``labels`` holds term_id and term_label, ``sources`` source and version (one row an ontology).
    """
    rows = cohort_rows.join(labels.select(F.col("term_id").alias("__t"), F.col("term_label").alias("__l")), F.col("term_id") == F.col("__t"), "left")
    ends = F.array(F.col("first_evidence_date").cast("string"), F.col("last_evidence_date").cast("string"))
    feature = F.struct(
        F.struct(F.col("term_id").alias("id"), F.col("__l").alias("label")).alias("type"), F.exists(X.active_qualifiers(F.col("qualifiers")), lambda q: q["qualifier_type"] == "negated").alias("excluded"),
        F.col("evidence_count").alias("evidenceCount"), ends.alias("evidenceDates"),
    )
    packs = rows.groupBy("project_subject_id").agg(F.array_sort(F.collect_set(feature)).alias("phenotypicFeatures"), F.array_sort(F.collect_set(X.term_source(F.col("term_id")))).alias("__s"))
    known = sources.agg(F.array_sort(F.collect_list(F.struct(F.col("source").alias("id"), "version"))).alias("__all"))  # one row
    meta = F.struct(F.filter("__all", lambda r: F.array_contains("__s", r["id"])).alias("resources"))
    return packs.join(known, F.lit(True)).select("project_subject_id", F.to_json(F.struct(F.col("project_subject_id").alias("id"), F.struct(F.col("project_subject_id").alias("id")).alias("subject"), "phenotypicFeatures", meta.alias("metaData"))).alias("packet"))


def zipped(rows: list[tuple[str, str]]) -> bytes:
    """A zip file with one JSON file for each (subject, packet) of a page of results."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for subject, packet in rows:
            z.writestr(f"{subject}.json", packet)
    return out.getvalue()
