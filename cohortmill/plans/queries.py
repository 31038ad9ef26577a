"""One query for each operator over the derived tables, and its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import cohort as C
from ..operators import evidence as E
from ..operators import graph as G
from ..operators import ontology as O
from ..operators import rollup as R
from ..operators import validate as V
from ..sources import ingest as I
from ..sources import phenopackets as P
from ..storage import shared_dir, shuffles_go
from . import derived as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
B, T = "proj-building", "HP:0000001"
TERM_IRI = X.OBO + "HP_0000001"
ROLL = "subject_id, term_iri, term_id, termlink_id, qual_key, evidence_count, first_evidence_date, last_evidence_date"
WIDE = "project_id, project_subject_id, " + ROLL
ROLL_COLUMNS, WIDE_COLUMNS = ROLL.split(", "), WIDE.split(", ")


def rolled(df: DataFrame) -> DataFrame:
    return D.keyed(df).select(*ROLL_COLUMNS)


def wide(df: DataFrame) -> DataFrame:
    return D.keyed(df).select(*WIDE_COLUMNS)


SUBJ = (
    "select subject_id, project_subject_id, count(*) as n_termlinks, cast(sum(evidence_count) as bigint) as evidence_total, min(first_evidence_date) as first_date, "
    "max(last_evidence_date) as last_date, string_agg(term_id || '|' || qual_key || '|' || evidence_count, ';' order by term_id || '|' || qual_key || '|' || evidence_count) as phenotypes "
)


def query(name: str, sql: str | None = None, cte: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = (D.CTE if cte else "") + sql
        return f

    return add


def ev(name: str, sql: str):
    """A query that is a function of the evidence alone."""
    return lambda f: query(name, sql)(lambda s, d: f(D.evidence(s, d)))


def bs(name: str, sql: str):
    return lambda f: query(name, sql)(lambda s, d: f(D.by_subject(s, d)))


def bpt(name: str, sql: str):
    return lambda f: query(name, sql)(lambda s, d: f(D.by_project_term(s, d)))


PICK = ", pick as (select term_iri, qual_key from bs where subject_id = 'subj-7' order by term_iri, qual_key limit 1) "


def picked(s, d) -> tuple[str, str, list[str]]:
    """A subject with its first term and that link's qualifiers: what a caller would ask for."""
    r = D.by_subject(s, d).where("subject_id = 'subj-7'").orderBy("term_iri", "qual_key").select("term_iri", "qual_key").first()
    return "subj-7", r["term_iri"], [q for q in r["qual_key"].split(",") if q]


def some_id(s, d) -> str:
    return D.evidence(s, d).where("subject_id = 'subj-7'").agg(F.min("evidence_id").alias("i")).first()["i"]


SOME_ID = "(select min(evidence_id) from ev where subject_id = 'subj-7')"


# scans
ev("scan_evidence", "select subject_id, term_id, evidence_id, termlink_id, run_id, note_date from ev")(lambda e: e.select("subject_id", "term_id", "evidence_id", "termlink_id", "run_id", "note_date"))
ev("scan_evidence_run", "select evidence_id, termlink_id from ev where run_id = 'run-1995'")(lambda e: e.where("run_id = 'run-1995'").select("evidence_id", "termlink_id"))
query("scan_mapping", "select * from map_")(D.mapping)


@query("scan_evidence_lookback", "select evidence_id, subject_id from ev where note_date >= date '1998-08-01' - 1000 and run_id in ('run-1996', 'run-1997') and subject_id in (select subject_id from map_ where project_id = 'proj-building')")
def scan_evidence_lookback(s, d):
    some = D.mapping(s, d).where(F.col("project_id") == B)
    e = D.evidence(s, d).where("note_date >= date_sub(date '1998-08-01', 1000) and run_id in ('run-1996', 'run-1997')")
    return e.join(some, "subject_id", "left_semi").select("evidence_id", "subject_id")


@query("scan_ndjson_pairs", "select distinct project_id, project_subject_id from map_")
def scan_ndjson_pairs(s, d):
    lines = D.mapping(s, d).select(F.to_json(F.struct("project_id", "project_subject_id")).alias("value"))
    return I.parse_records(lines).select("project_id", "project_subject_id").distinct()


# rollups and their upkeep
query("agg_by_subject", f"select {ROLL} from bs")(lambda s, d: rolled(R.by_subject(D.evidence(s, d, near="subject_id"))))
query("agg_by_project_term", f"select {WIDE} from bpt")(lambda s, d: wide(R.by_project_term(D.evidence(s, d, near="subject_id"), D.mapping(s, d))))


@query("materialize_all", "select 'by_project_term' as t, project_id as k, count(*) as rows, cast(sum(evidence_count) as bigint) as evidence from bpt group by 2 union all select 'by_subject', '', count(*), cast(sum(evidence_count) as bigint) from bs")
def materialize_all(s, d):
    """Both rollups built anew and written; what each holds."""
    for name in ("by_subject", "by_project_term"):
        D.build(s, d, name)
    own = D.stored(s, d, "by_subject").agg(F.lit("by_subject").alias("t"), F.lit("").alias("k"), F.count("*").alias("rows"), F.sum("evidence_count").alias("evidence"))
    per = D.stored(s, d, "by_project_term").groupBy(F.lit("by_project_term").alias("t"), F.col("project_id").alias("k")).agg(F.count("*").alias("rows"), F.sum("evidence_count").alias("evidence"))
    return per.union(own)


@query("merge_by_subject", f"select {ROLL} from bs")
def merge_by_subject(s, d):
    e = D.evidence(s, d, near="subject_id")
    return rolled(R.merge_delta(R.by_subject(e.where("run_id <> 'run-1995'")), R.by_subject(e.where("run_id = 'run-1995'")), R.SUBJECT_KEYS))


@query("merge_by_project_term", f"select {WIDE} from bpt")
def merge_by_project_term(s, d):
    e, m = D.evidence(s, d), D.mapping(s, d)
    return wide(R.merge_delta(R.by_project_term(e.where("run_id <> 'run-1995'"), m), R.by_project_term(e.where("run_id = 'run-1995'"), m), R.PROJECT_KEYS))


@query("merge_match", "select (select count(*) from (select termlink_id from bs intersect select termlink_id from ev where run_id = 'run-1995')) as matched, (select count(distinct termlink_id) from ev where run_id = 'run-1995' and termlink_id not in (select termlink_id from ev where run_id <> 'run-1995')) as inserted")
def merge_match(s, d):
    """How many keys of a delta are in the target that has it, and how many were not in the one before."""
    e = D.evidence(s, d)
    delta = R.by_subject(e.where("run_id = 'run-1995'")).select(*R.SUBJECT_KEYS)
    before = R.by_subject(e.where("run_id <> 'run-1995'")).select(*R.SUBJECT_KEYS)
    return delta.join(D.by_subject(s, d).select(*R.SUBJECT_KEYS), R.SUBJECT_KEYS, "left_semi").agg(F.count("*").alias("matched")).join(delta.join(before, R.SUBJECT_KEYS, "left_anti").agg(F.count("*").alias("inserted")), F.lit(True))


@query("materialize_project", f"select {WIDE} from bpt where project_id = '{B}'")
def materialize_project(s, d):
    mine = D.mapping(s, d).where(F.col("project_id") == B)
    return wide(R.by_project_term(D.evidence(s, d).join(mine.select("subject_id"), "subject_id", "left_semi"), mine))


@query("materialize_subject", f"select {WIDE} from bpt where subject_id = 'subj-7'")
def materialize_subject(s, d):
    return wide(R.by_project_term(D.evidence(s, d).where("subject_id = 'subj-7'"), D.mapping(s, d)))


@query("upsert_on_add", f"select {ROLL} from bs")
def upsert_on_add(s, d):
    e = D.evidence(s, d, near="subject_id")
    one = F.col("subject_id") == "subj-7"
    return rolled(R.refresh(R.by_subject(e.where(~one | (F.col("run_id") != "run-1995"))), e, e.where(one).select("subject_id"), R.SUBJECT_KEYS))


@query("downsert_on_remove", "select subject_id, term_iri, term_id, termlink_id, min(qual_key) as qual_key, count(distinct evidence_id) as evidence_count, min(note_date) as first_evidence_date, max(note_date) as last_evidence_date from ev where not (subject_id = 'subj-7' and run_id = 'run-1995') group by all")
def downsert_on_remove(s, d):
    e = D.evidence(s, d, near="subject_id")
    # of the evidence only that of the touched subject is asked for: the rest is shuffled once, for the target
    mine = D.evidence(s, d).where("subject_id = 'subj-7'")
    return rolled(R.refresh(R.by_subject(e), mine.where("run_id <> 'run-1995'"), mine, R.SUBJECT_KEYS))


@query("insert_evidence", f"select evidence_id, subject_id from ev where subject_id = 'subj-7' union all select sha256('note-x|enc-x|{TERM_IRI}|1|9|negated:true|subj-7|curator-1'), 'subj-7'")
def insert_evidence(s, d):
    """One assertion made by hand beside those of its subject."""
    row = E.one_row(s, {"subject_id": "subj-7", "term_iri": TERM_IRI, "creator_id": "curator-1", "clinical_note_id": "note-x", "encounter_id": "enc-x", "span_start": 1, "span_end": 9, "qualifiers": {"negated": True, "severity": "0"}})
    mine = D.full_evidence(s, d).where("subject_id = 'subj-7'")
    return mine.unionByName(row.select(*mine.columns)).select("evidence_id", "subject_id")
ev("append_evidence", "select evidence_id, run_id from ev where run_id in ('run-1994', 'run-1995')")(lambda e: e.where("run_id = 'run-1994'").select("evidence_id", "run_id").unionByName(e.where("run_id = 'run-1995'").select("run_id", "evidence_id")))
ev("anti_existing", "select evidence_id, subject_id from ev where run_id = 'run-1995'")(lambda e: R.insert_only(e.where("run_id <> 'run-1995'"), e).select("evidence_id", "subject_id"))
ev("dedupe_batch", "select evidence_id, subject_id, note_date from ev")(lambda e: R.dedupe(e.unionAll(e)).select("evidence_id", "subject_id", "note_date"))
query("delete_evidence_by_id", f"select evidence_id from ev where evidence_id <> {SOME_ID}")(lambda s, d: D.evidence(s, d).where(F.col("evidence_id") != some_id(s, d)).select("evidence_id"))
bpt("delete_project_terms", f"select {WIDE} from bpt where project_id <> '{B}'")(lambda b: b.where(F.col("project_id") != B).select(*WIDE_COLUMNS))
bpt("delete_subject_terms", f"select {WIDE} from bpt where not (project_id = '{B}' and subject_id = 'subj-7')")(lambda b: b.where(~((F.col("project_id") == B) & (F.col("subject_id") == "subj-7"))).select(*WIDE_COLUMNS))


@query("delete_subject_cascade", "select 'termlink' as kind, count(distinct termlink_id) as n from ev where subject_id = 'subj-7' union all select 'left', count(*) from ev where subject_id <> 'subj-7'")
def delete_subject_cascade(s, d):
    """The termlinks that go with a subject, and the evidence that is left."""
    e = D.evidence(s, d)
    links = e.where("subject_id = 'subj-7'").select("termlink_id").distinct().agg(F.lit("termlink").alias("kind"), F.count("*").alias("n"))
    return links.union(e.where("subject_id <> 'subj-7'").agg(F.lit("left").alias("kind"), F.count("*").alias("n")))



# projections, filters and look-ups
@ev("nested_projection", "select evidence_id, creator_id, span_start, encounter_id from ev")
def nested_projection(e):
    nested = e.select("evidence_id", "encounter_id", F.struct("creator_id", "creator_type").alias("creator"), F.struct("span_start", "span_end").alias("text_annotation"))
    return nested.select("evidence_id", F.col("creator.creator_id").alias("creator_id"), F.col("text_annotation.span_start").alias("span_start"), "encounter_id")


ev("case_types", f"select evidence_id, case creator_type when 'automated' then '{X.OBO}ECO_0000203' else '{X.OBO}ECO_0000218' end as assertion_type, case creator_type when 'automated' then '{X.OBO}ECO_0006162' else '{X.OBO}ECO_0006161' end as evidence_type from ev")(
    lambda e: e.select("evidence_id", X.eco_types(F.col("creator_type"))[0].alias("assertion_type"), X.eco_types(F.col("creator_type"))[1].alias("evidence_type"))
)
query("get_evidence", f"select evidence_id, subject_id, term_iri, creator_id, creator_name, span_start, note_type, batch_id, case when qual_key = '' then '' else regexp_replace(qual_key, ':[^:/]*$', '') end as q from ev where evidence_id = {SOME_ID}")(
    lambda s, d: E.by_id(D.full_evidence(s, d), some_id(s, d)).select("evidence_id", "subject_id", "term_iri", "creator.creator_id", "creator.creator_name", "text_annotation.span_start", "note_context.note_type", "batch_id", F.array_join(F.array_remove(F.map_keys("qualifiers"), "severity"), ",").alias("q"))
)


@query("get_evidence_for_termlink", None)
def get_evidence_for_termlink(s, d):
    return E.for_termlink(D.full_evidence(s, d), *picked(s, d)).select("evidence_id", F.to_date("created_timestamp").alias("day"), "creator.creator_id")


ORACLE_SQL["get_evidence_for_termlink"] = D.CTE.rstrip() + PICK + "select evidence_id, note_date as day, creator_id from ev join pick using (term_iri, qual_key) where subject_id = 'subj-7'"


@query("get_subject_term_info", None)
def get_subject_term_info(s, d):
    row = E.term_info(D.full_evidence(s, d), *picked(s, d))
    return row.select("termlink_id", "term_iri", "evidence_count", F.array_join("source_types", ",").alias("source_types"), F.array_join("qualifier_types", ",").alias("qualifier_types"), "first_evidence_date", "last_evidence_date")


ORACLE_SQL["get_subject_term_info"] = D.CTE.rstrip() + PICK + """select termlink_id, term_iri, evidence_count, 'clinical_note' as source_types, case when qual_key = '' then '' else regexp_replace(qual_key, ':[^:/]*$', '') end as qualifier_types,
 first_evidence_date, last_evidence_date from bs join pick using (term_iri, qual_key) where subject_id = 'subj-7'"""
bs("query_subject_by_id", "select term_id, qual_key, evidence_count from bs where subject_id = 'subj-7' order by term_id, qual_key")(lambda b: b.where("subject_id = 'subj-7'").select("term_id", "qual_key", "evidence_count").orderBy("term_id", "qual_key"))


@query("get_subject", f"select project_subject_id, m.subject_id, term_id, evidence_count from map_ m left join bs using (subject_id) where project_id = '{B}' and project_subject_id = (select min(project_subject_id) from map_ where project_id = '{B}')")
def get_subject(s, d):
    """A subject named by its IRI in a project, with its terms; without any it is still a row."""
    m = D.mapping(s, d).withColumn("iri", X.project_subject_iri(F.col("project_id"), F.col("project_subject_id")))
    iri = m.where(F.col("project_id") == B).agg(F.min("iri").alias("i")).first()["i"]
    one = m.where((F.col("project_id") == iri.split("/")[-2]) & (F.col("project_subject_id") == iri.split("/")[-1]))
    return one.join(D.by_subject(s, d), "subject_id", "left").select("project_subject_id", "subject_id", "term_id", "evidence_count")


bpt("filter_qualified", "select project_id, termlink_id from bpt where qual_key not in ('negated:true', 'hypothetical:true', 'family:true')")(lambda b: C.unqualified(b).select("project_id", "termlink_id"))
bpt("filter_psids", "select project_subject_id, term_id from bpt where project_subject_id in ('psid-1', 'psid-2', 'b-3')")(lambda b: b.where(F.col("project_subject_id").isin("psid-1", "psid-2", "b-3")).select("project_subject_id", "term_id"))


@query("filter_terms", f"select project_id, termlink_id from bpt where term_id in (select term_id from closure where ancestor_id in ('{T}', 'HP:0000002'))")
def filter_terms(s, d):
    return D.by_project_term(s, d).join(O.expand_terms(D.hierarchy(s, d), [T, "HP:0000002", "XX:1"], D.VERSIONS), "term_id", "left_semi").select("project_id", "termlink_id")


ev("null_key_check", "select count(*) filter (termlink_id is null) as null_termlinks, count(*) filter (subject_id is null) as null_subjects, count(*) filter (term_iri is null) as null_terms from ev")(
    lambda e: e.agg(*[F.count_if(F.col(c).isNull()).alias(n) for c, n in (("termlink_id", "null_termlinks"), ("subject_id", "null_subjects"), ("term_iri", "null_terms"))])
)


# joins
@query("join_mapping_left", "select o_orderkey, project_id from orders left join map_ on 'subj-' || o_custkey = subject_id and project_id = 'proj-building'")
def join_mapping_left(s, d):
    m = D.mapping(s, d).where(F.col("project_id") == B)
    return D.read(s, d, "orders").withColumn("subject_id", F.concat(F.lit("subj-"), F.col("o_custkey").cast("string"))).join(m, "subject_id", "left").select("o_orderkey", "project_id")


query("join_mapping_inner", "select project_id, project_subject_id, evidence_id from ev join map_ using (subject_id)")(lambda s, d: D.evidence(s, d).join(D.mapping(s, d), "subject_id").select("project_id", "project_subject_id", "evidence_id"))
ev("join_touched_subjects", "select evidence_id from ev where subject_id in (select subject_id from ev where run_id = 'run-1998')")(lambda e: e.join(e.where("run_id = 'run-1998'").select("subject_id").distinct(), "subject_id", "left_semi").select("evidence_id"))


@query("join_hierarchy_left", "select subject_id, term_id, coalesce(term_label, term_id) as term_label from bs left join label using (term_id)")
def join_hierarchy_left(s, d):
    return D.by_subject(s, d).join(O.of_version(D.hierarchy(s, d), "HPO", D.VERSION).select("term_id", "term_label"), "term_id", "left").select("subject_id", "term_id", F.coalesce("term_label", "term_id").alias("term_label"))


bs("unnest_left", "select termlink_id, nullif(qual_key, '') as qualifier from bs")(lambda b: b.select("termlink_id", F.explode_outer(X.normalize_qualifiers(F.col("qualifiers"))).alias("qualifier")))


@query("full_outer_compare", "")
def full_outer_compare(s, d):
    e = D.evidence(s, d)
    return V.rollup_counts(e, R.by_subject(e.where("run_id <> 'run-1995'")))


ORACLE_SQL["full_outer_compare"] = D.CTE + "select termlink_id, n_evidence, n_rollup from (select termlink_id, count(*) as n_evidence from ev group by 1) full join (select termlink_id, count(distinct evidence_id) as n_rollup from ev where run_id <> 'run-1995' group by 1) using (termlink_id) where coalesce(n_evidence, 0) <> coalesce(n_rollup, 0)"


# aggregations
@bpt("cohort_subjects", SUBJ + f"from bpt where project_id = '{B}' group by 1, 2 order by 1, 2 limit 50")
def cohort_subjects(b):
    return C.subjects(C.first_subjects(b.where(F.col("project_id") == B), 50)).orderBy("subject_id", "project_subject_id")


bpt("cohort_total", f"select count(distinct subject_id) as total_count from bpt where project_id = '{B}'")(lambda b: b.where(F.col("project_id") == B).agg(F.count_distinct("subject_id").alias("total_count")))
TYPES = "case when qual_key = '' then '' else regexp_replace(qual_key, ':.*$', '') end"
query("term_links_with_counts", f"select term_iri, {TYPES} as qualifier_types, count(distinct termlink_id) as n_termlinks, count(*) as evidence_total, any_value(term_label) as term_label from ev left join label using (term_id) where encounter_id in ('enc-1', 'enc-2', 'enc-3', 'enc-32') group by 1, 2")(
    lambda s, d: E.links_with_counts(D.full_evidence(s, d).where(F.col("encounter_id").isin("enc-1", "enc-2", "enc-3", "enc-32")), D.hierarchy(s, d).select("term_iri", "term_label"))
)
bs("term_links_fast", f"select term_iri, {TYPES} as qualifier_types, count(*) as n_termlinks, cast(sum(evidence_count) as bigint) as evidence_total from bs group by all")(
    lambda b: b.groupBy("term_iri", F.array_join(F.transform(X.normalize_qualifiers(F.col("qualifiers")), lambda q: F.split(q, ":")[0]), ",").alias("qualifier_types")).agg(F.count("*").alias("n_termlinks"), F.sum("evidence_count").alias("evidence_total"))
)
ev("evidence_count_by_termlink", "select termlink_id, count(*) as n from ev group by all")(lambda e: e.groupBy("termlink_id").agg(F.count("*").alias("n")))
ev("latest_evidence_date", "select termlink_id, max(note_date) as latest from ev group by all")(lambda e: e.groupBy("termlink_id").agg(F.max("note_date").alias("latest")))
bpt("materialize_stats", "select count(distinct subject_id) as subjects, count(distinct project_id) as projects, count(*) as n from bpt")(lambda b: b.agg(F.count_distinct("subject_id").alias("subjects"), F.count_distinct("project_id").alias("projects"), F.count("*").alias("n")))
ev("baseline_evidence", "select count(*) as n, count(distinct subject_id) as subjects from ev")(lambda e: e.agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("subjects")))
query("baseline_iceberg", "select count(distinct (subject_id, term_iri, termlink_id)) as termlinks, (select count(*) from map_) as mappings from ev")(
    lambda s, d: D.evidence(s, d).agg(F.count_distinct("subject_id", "term_iri", "termlink_id").alias("termlinks")).join(D.mapping(s, d).agg(F.count("*").alias("mappings")), F.lit(True))
)
ev("dup_within_subject", "select subject_id, evidence_id, cast(2 as bigint) as n from ev where run_id = 'run-1995'")(lambda e: V.duplicates(e.unionAll(e.where("run_id = 'run-1995'"))))
ev("dup_across_subjects", "select evidence_id, cast(2 as bigint) as subjects, cast(2 as bigint) as n from ev where run_id = 'run-1995'")(lambda e: V.shared_ids(e.unionByName(e.where("run_id = 'run-1995'").withColumn("subject_id", F.concat("subject_id", F.lit("-copy"))))))
ev("term_distribution", "select term_iri, count(*) as n from ev where run_id = 'run-1995' group by all order by n desc, term_iri limit 10")(lambda e: e.where("run_id = 'run-1995'").groupBy("term_iri").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term_iri").limit(10))
ev("per_subject_terms", "select subject_id, count(distinct term_iri) as n from ev group by all order by n desc, subject_id limit 10")(lambda e: e.groupBy("subject_id").agg(F.count_distinct("term_iri").alias("n")).orderBy(F.desc("n"), "subject_id").limit(10))


@query("term_frequency_in_cohort", "select b.term_id, count(distinct b.subject_id) as subjects, round(count(distinct b.subject_id)::double / (select count(*) from map_ where project_id = 'proj-building'), 9) as frequency from bpt b where project_id = 'proj-building' group by 1")
def term_frequency_in_cohort(s, d):
    rows = D.by_project_term(s, d).where(F.col("project_id") == B)
    total = F.broadcast(D.mapping(s, d).where(F.col("project_id") == B).agg(F.count("*").alias("total")))
    n = rows.groupBy("term_id").agg(F.count_distinct("subject_id").alias("subjects"))
    return n.join(total, F.lit(True)).select("term_id", "subjects", F.round(F.col("subjects").cast("double") / F.col("total"), 9).alias("frequency"))


query("ontology_counts", "select 'hpo' as ontology_source, 'v1' as version, count(*) as terms, (select count(distinct term_iri) from ev) as graph_terms, round(abs(count(*) - (select count(distinct term_iri) from ev)) * 100.0::double / count(*), 6) as percent, round(abs(count(*) - (select count(distinct term_iri) from ev)) * 100.0::double / count(*), 6) > 50 as warn from label")(
    lambda s, d: V.ontology_versions(D.hierarchy(s, d), G.pattern(D.triples(s, d), "hasTerm", "link", "term_iri").select(F.lit("hpo").alias("source"), "term_iri"))
)
query("project_counts", "select count(distinct project_id) as projects, count(*) as subject_ids from map_")(lambda s, d: D.mapping(s, d).agg(F.count_distinct("project_id").alias("projects"), F.count("*").alias("subject_ids")))
bs("dataset_summary", "select min(n) as least, max(n) as most, round(avg(n), 9) as mean, median(n) as mid from (select subject_id, count(*) as n from bs group by 1)")(lambda b: b.groupBy("subject_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 9).alias("mean"), F.median("n").alias("mid")))
bs("evidence_per_link", "select min(evidence_count) as least, max(evidence_count) as most, round(avg(evidence_count), 9) as mean, median(evidence_count) as mid from bs")(lambda b: b.agg(F.min("evidence_count").alias("least"), F.max("evidence_count").alias("most"), F.round(F.avg("evidence_count"), 9).alias("mean"), F.median("evidence_count").alias("mid")))
bs("qualifier_distribution", "select case when qual_key = '' then 'none' else qual_key end as qualifier, count(*) as n from bs group by 1")(V.qualifier_distribution)
ev("latency_percentiles", "select creator_type, round(quantile_cont(span_end, 0.5), 6) as p50, round(quantile_cont(span_end, 0.95), 6) as p95, round(quantile_cont(span_end, 0.99), 6) as p99 from ev group by 1")(
    lambda e: e.groupBy("creator_type").agg(*[F.round(F.percentile("span_end", p), 6).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
)
ev("median_replicates", "select creator_type, run_id, median(span_end) as mid from ev group by 1, 2")(lambda e: e.groupBy("creator_type", "run_id").agg(F.median("span_end").alias("mid")))

# pages
bpt("page_offset", SUBJ + f"from bpt where project_id = '{B}' group by 1, 2 order by 1, 2 limit 20 offset 20")(lambda b: C.subjects(C.first_subjects(b.where(F.col("project_id") == B), 20, "20")).orderBy("subject_id", "project_subject_id"))
bpt("page_keyset", SUBJ + f"from bpt where project_id = '{B}' and subject_id > 'subj-2' group by 1, 2 order by 1, 2 limit 20")(lambda b: C.page_after(C.subjects(b.where(F.col("project_id") == B)), 20, ("subj-2", "zzz")))
ev("query_evidence_by_run", "select evidence_id, note_date from ev where run_id = 'run-1995' order by note_date, evidence_id limit 1000")(lambda e: e.where("run_id = 'run-1995'").orderBy("note_date", "evidence_id").limit(1000).select("evidence_id", "note_date"))


@query("query_evidence", None)
def query_evidence(s, d):
    """A page of the evidence of one link of a subject to a term, behind a token made of an earlier time."""
    rows = E.query(D.full_evidence(s, d), *picked(s, d))
    first = E.page(rows, 1)
    return E.after(rows, E.token_of(datetime(1990, 1, 1), "")).orderBy(*E.ORDER).limit(100).select("evidence_id", F.to_date("created_timestamp").alias("day"), F.lit(first["total_count"]).cast("long").alias("total_count"))


ORACLE_SQL["query_evidence"] = D.CTE.rstrip() + PICK + """, mine as (select evidence_id, note_date as day, count(*) over () as total_count, row_number() over (order by note_date, evidence_id) as place
 from ev join pick using (term_iri, qual_key) where subject_id = 'subj-7') select evidence_id, day, total_count from mine where place <= 100"""


@query("page_info", f"select count(distinct subject_id) as total_count, count(distinct subject_id) > 40 as has_more, case when count(distinct subject_id) > 40 then '40' end as next_cursor from bpt where project_id = '{B}'")
def page_info(s, d):
    """What the second page of 20 says beside its subjects."""
    r = C.CohortRequest(B, limit=20, cursor="20")
    got = C.paged(*C.cohort(D.by_project_term(s, d), D.hierarchy(s, d), r, D.VERSIONS), r)
    return s.createDataFrame([(got["total_count"], got["has_more"], got["next_cursor"])], "total_count long, has_more boolean, next_cursor string")


def _sources(s, d):
    return D.read(s, d, "orders").select(F.concat(F.lit("src-"), (F.col("o_custkey") % 5).cast("string")).alias("source"), F.col("o_orderkey").cast("string").alias("version"), F.struct("o_orderdate", "o_orderkey").alias("created_at"), F.when(F.col("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey")).alias("installed_at"))


query("current_version", "select 'src-' || (o_custkey % 5) as source, cast(max_by(o_orderkey, (o_orderdate, o_orderkey)) as varchar) as version from orders where o_orderstatus = 'F' group by 1", False)(lambda s, d: O.current_version(_sources(s, d)))
query("source_info", "select 'src-' || (o_custkey % 5) as source, cast(max_by(o_orderkey, (o_orderdate, o_orderkey)) as varchar) as version from orders group by 1", False)(lambda s, d: O.source_info(_sources(s, d)).select("source", "version"))

# sets
query("distinct_pairs", "select distinct project_id, project_subject_id from map_")(lambda s, d: D.mapping(s, d).select("project_id", "project_subject_id").distinct())
query("missing_pairs", "select project_id, project_subject_id from map_ where project_id <> 'proj-3'")(lambda s, d: (m := D.mapping(s, d)).join(m.where("project_id = 'proj-3'"), ["project_id", "project_subject_id"], "left_anti").select("project_id", "project_subject_id"))
bs("qualifier_union", "select subject_id, term_id, string_agg(distinct qual_key, ',' order by qual_key) as quals from bs where qual_key <> '' group by 1, 2")(
    lambda b: R.merge_delta(b.where("qual_key like 'n%'"), b.where("qual_key not like 'n%' and qual_key <> ''"), ["subject_id", "term_id"]).select("subject_id", "term_id", F.array_join(X.normalize_qualifiers(F.col("qualifiers")), ",").alias("quals"))
)
query("term_set_union", "select distinct term_id from closure where ancestor_id in ('HP:0000001', 'HP:0000003')")(lambda s, d: O.expand_terms(D.hierarchy(s, d), ["HP:0000001", "HP:0000003"], D.VERSIONS))

# scalar functions
ev("termlink_hash", f"select evidence_id, sha256('{X.BASE}subjects/' || subject_id || '|' || term_iri || '|' || qual_key) as h from ev")(lambda e: e.select("evidence_id", X.termlink_hash(X.subject_iri(F.col("subject_id")), F.col("term_iri"), X.normalize_qualifiers(F.col("qualifiers"))).alias("h")))
QUAL_TYPE = "regexp_replace(qual_key, ':[^:/]*$', '')"
query("evidence_hash", "select termlink_id, evidence_id from ev")(lambda s, d: E.with_ids(D.full_evidence(s, d).drop("termlink_id", "evidence_id")).select("termlink_id", "evidence_id"))


@query("rehash", "select termlink_id, evidence_id from ev")
def rehash(s, d):
    """Ids made anew for rows that lost theirs, one of which is there twice."""
    e = D.full_evidence(s, d)
    lost = e.unionByName(e.where("run_id = 'run-1995'")).withColumn("evidence_id", F.lit("old"))
    return E.rehash(lost).select("termlink_id", "evidence_id")


@query("merge_rehash", "select subject_id, case when run_id = 'run-1995' then evidence_id else 'old-' || evidence_id end as evidence_id, case when run_id = 'run-1995' then termlink_id else 'none' end as termlink_id from ev")
def merge_rehash(s, d):
    e = D.evidence(s, d)
    old = e.select("subject_id", F.concat(F.lit("old-"), "evidence_id").alias("evidence_id"), F.lit("none").alias("termlink_id"))
    changes = e.where("run_id = 'run-1995'").select("subject_id", F.concat(F.lit("old-"), "evidence_id").alias("old_evidence_id"), "evidence_id", "termlink_id")
    return E.merge_rehash(old, changes)


@query("validate_rehash", "select count(*) + 1 as rows_before, count(*) as rows_after, count(distinct subject_id) as subjects_before, count(distinct subject_id) as subjects_after, cast(0 as bigint) as null_ids, cast(0 as bigint) as wrong_ids, cast(0 as bigint) as repeated_ids from ev")
def validate_rehash(s, d):
    e = D.full_evidence(s, d)
    before = e.unionByName(e.where(F.col("evidence_id") == some_id(s, d)))
    return V.rehash_changes(before, E.rehash(before))


ev("split_qualifier", f"select evidence_id, {QUAL_TYPE} as qualifier_type, regexp_extract(qual_key, ':([^:/]*)$', 1) as qualifier_value from ev where qual_key <> ''")(
    lambda e: e.where("qual_key <> ''").select("evidence_id", X.split_qualifier(F.col("qual_key"))["qualifier_type"].alias("qualifier_type"), X.split_qualifier(F.col("qual_key"))["qualifier_value"].alias("qualifier_value"))
)
ev("normalize_qualifiers", "select evidence_id, qual_key as q from ev")(lambda e: e.select("evidence_id", F.array_join(X.normalize_qualifiers(F.reverse("qualifiers")), ",").alias("q")))
ev("normalize_qualifier_type", f"select evidence_id, {QUAL_TYPE} as t from ev where qual_key <> ''")(
    lambda e: e.where("qual_key <> ''").select("evidence_id", X.short_type(F.concat(F.when(F.col("qual_key").startswith("http"), "").otherwise(X.QUALIFIER), F.get("qualifiers", F.lit(0))["qualifier_type"])).alias("t"))
)
ev("qualifiers_to_strings", "select evidence_id, case when qual_key = '' then '' else qual_key || ',' end || 'severity:0' as q from ev")(lambda e: e.select("evidence_id", F.array_join(X.qualifiers_to_strings(F.col("qualifiers")), ",").alias("q")))
ev("higher_order", "select evidence_id, qual_key not in ('', 'hypothetical:true') as marked, length(qual_key) as n from ev")(
    lambda e: e.select("evidence_id", F.exists(F.filter("qualifiers", lambda q: F.lower(q["qualifier_value"]) != "0"), lambda q: q["qualifier_type"] != "hypothetical").alias("marked"), F.length(F.array_join(F.transform(F.filter(F.coalesce("qualifiers", F.array()), lambda q: q["qualifier_value"] != "0"), lambda q: F.concat_ws(":", q["qualifier_type"], q["qualifier_value"])), ",")).cast("long").alias("n"))
)
ev("context_to_qualifiers", "select evidence_id, case when span_start % 2 = 1 then 'negated:true' else '' end as q from ev")(
    lambda e: e.select("evidence_id", F.array_join(X.normalize_qualifiers(X.context_qualifiers(F.struct((F.col("span_start") % 2).cast("double").alias("negated"), F.lit(None).cast("double").alias("family"), F.lit(0.0).alias("hypothetical")))), ",").alias("q"))
)
ev("term_id_from_iri", "select distinct term_iri, term_id as t from ev")(lambda e: e.select("term_iri", X.term_id(F.col("term_iri")).alias("t")).distinct())
ev("iri_from_term_id", "select distinct term_id, term_iri as i from ev")(lambda e: e.select("term_id", X.term_iri(F.col("term_id")).alias("i")).distinct())
ev("compact_iri", "select distinct term_iri, term_id as c from ev")(lambda e: e.select("term_iri", X.compact_iri(F.col("term_iri")).alias("c")).distinct())
ev("curie_to_iri", "select distinct term_id, term_iri as i from ev")(lambda e: e.select("term_id", X.curie_to_iri(F.col("term_id"), F.create_map(F.lit("HP"), F.lit(X.OBO + "HP_"))).alias("i")).distinct())
query("build_iris", f"select '{X.BASE}projects/' || project_id || '/' || project_subject_id as iri, '{X.BASE}subjects/' || subject_id as s from map_")(lambda s, d: D.mapping(s, d).select(X.project_subject_iri(F.col("project_id"), F.col("project_subject_id")).alias("iri"), X.subject_iri(F.col("subject_id")).alias("s")))
query("split_project_iri", "select project_id, project_subject_id from map_")(lambda s, d: D.mapping(s, d).select(F.split(X.project_subject_iri(F.col("project_id"), F.col("project_subject_id")), "/").alias("p")).select(F.element_at("p", -2).alias("project_id"), F.element_at("p", -1).alias("project_subject_id")))
query("ttl_escape", """select p_partkey, replace(replace(p_name || '"\\', '\\', '\\\\'), '"', '\\"') as e from part""", False)(lambda s, d: D.read(s, d, "part").select("p_partkey", X.ttl_escape(F.concat("p_name", F.lit('"\\'))).alias("e")))
query("url_quote", "select p_partkey, url_encode(p_name) as q from part", False)(lambda s, d: D.read(s, d, "part").select("p_partkey", X.url_quote(F.col("p_name")).alias("q")))
ev("prefix_to_source", "select distinct term_id, 'hpo' as source from ev")(lambda e: e.select("term_id", X.term_source(F.col("term_id")).alias("source")).distinct())

# ontology
query("closure", "select term_id, ancestor_id from closure")(lambda s, d: D.closure(s, d))
query("closure_of_edges", "select term_id, ancestor_id from closure where term_id < 'HP:0000150'")(lambda s, d: O.closure(D.edges(s, d).where("term_id < 'HP:0000150'")))
query("descendants", f"select term_id, term_label, depth from label where term_id in (select term_id from closure where ancestor_id = '{T}') and term_id <> '{T}'")(lambda s, d: O.descendants(O.of_version(D.hierarchy(s, d), "HPO", "v1"), T).select("term_id", "term_label", "depth"))
query("ancestors", "select term_id, term_label, depth from label where term_id in (select ancestor_id from closure where term_id = 'HP:0000084')")(lambda s, d: O.ancestors(O.of_version(D.hierarchy(s, d), "HPO", "v1"), "HP:0000084").select("term_id", "term_label", "depth"))
query("ancestor_order", "select term_id, string_agg(ancestor_id, ',' order by depth, ancestor_id) as path from closure join (select term_id as ancestor_id, depth from label) using (ancestor_id) group by 1")(lambda s, d: D.hierarchy(s, d).select("term_id", F.array_join("ancestor_term_ids", ",").alias("path")))
query("expand_terms", f"select distinct term_id from closure where ancestor_id in ('{T}', 'HP:0000002')")(lambda s, d: O.expand_terms(D.hierarchy(s, d), [T, "HP:0000002", "ZZ:9", "MONDO:0000001"], D.VERSIONS))
query("depth", "select term_id, depth from label")(lambda s, d: D.hierarchy(s, d).select("term_id", "depth"))
query("term_labels", "select term_id, term_label from label")(lambda s, d: O.labels(D.hierarchy(s, d)).select("term_id", "term_label"))


# cohort
@query("cohort", SUBJ + f"from bpt where project_id = '{B}' and qual_key not in ('negated:true', 'hypothetical:true', 'family:true') and term_id in (select term_id from closure where ancestor_id = 'HP:0000002') group by 1, 2 order by 1, 2 limit 1000")
def cohort(s, d):
    return C.cohort(D.by_project_term(s, d), D.hierarchy(s, d), C.CohortRequest(B, ["HP:0000002"], include_qualified=False), D.VERSIONS)[0]


def associations(s, d):
    """A table of entities and the terms they go with."""
    return D.terms(s, d).select(F.concat(F.lit("entity-"), (F.substring("term_id", 4, 7).cast("int") % 7).cast("string")).alias("entity"), F.col("term_id").alias("object"))


@query("association_cohort", None)
def association_cohort(s, d):
    few = s.createDataFrame([("gene-1", "HP:0000001"), ("gene-1", "HP:0000005"), ("gene-1", "HP:0000021"), ("gene-2", "HP:0000006")], "entity string, object string")
    return C.cohort(D.by_project_term(s, d), D.hierarchy(s, d), C.CohortRequest(B, associated_with="gene-1"), D.VERSIONS, few)[0]


ORACLE_SQL["association_cohort"] = D.CTE + SUBJ + f"from bpt where project_id = '{B}' and term_id in ('HP:0000005', 'HP:0000021') group by 1, 2 order by 1, 2 limit 1000"


def judged(s, requests: list[C.CohortRequest]) -> DataFrame:
    """Which requests are answered."""
    out = []
    for k, r in enumerate(requests):
        try:
            C.check(r)
            out.append((k, True))
        except ValueError:
            out.append((k, False))
    return s.createDataFrame(out, "k long, ok boolean")


query("root_term_guard", "select * from (values (0::bigint, false), (1, false), (2, true), (3, true)) t(k, ok)", False)(
    lambda s, d: judged(s, [C.CohortRequest(B, ["HP:0000001"]), C.CohortRequest(B, ["HP:0000009", "HP:0000118"]), C.CohortRequest(B, ["HP:0000001"], include_child_terms=False), C.CohortRequest(B, associated_with="gene-1")])
)
query("param_guards", "select * from (values (0::bigint, false), (1, false), (2, false), (3, true)) t(k, ok)", False)(
    lambda s, d: judged(s, [C.CohortRequest(""), C.CohortRequest(B, [T], associated_with="gene-1"), C.CohortRequest(B, cursor="x"), C.CohortRequest(B, cursor="7")])
)

# graph
LINKS = f"""select '{X.BASE}subjects/' || subject_id as subject, '{X.BASE}subjects/' || subject_id || '/term-link/' || termlink_id as link, term_iri as term,
 case when qual_key like 'http%' then regexp_replace(qual_key, ':[^:/]*$', '') when qual_key <> '' then '{X.QUALIFIER}' || split_part(qual_key, ':', 1) end as qualifier from bs"""
query("sparql_bgp", LINKS)(lambda s, d: G.links_of(D.by_subject(s, d)))
query("sparql_not_exists", f"select link, term from ({LINKS}) where qualifier is null")(lambda s, d: G.without_qualifier(D.triples(s, d)).select("link", "term"))
query("sparql_values", f"select subject, link from ({LINKS}) where term in ('{TERM_IRI}', '{X.OBO}HP_0000004')")(lambda s, d: G.links(D.triples(s, d)).where(F.col("term").isin(TERM_IRI, X.OBO + "HP_0000004")).select("subject", "link"))
query("sparql_path", f"select link, term from ({LINKS}) where term in (select '{X.OBO}' || replace(term_id, ':', '_') from closure where ancestor_id = '{T}')")(lambda s, d: G.path(D.triples(s, d), D.closure(s, d), TERM_IRI))
TTL = f"""with_links as ({LINKS}) select '<' || subject || '> ex:hasTermLink <' || link || '> .' as line from with_links union select '<' || link || '> ex:hasTerm <' || term || '> .' from with_links
 union select '<' || link || '> ex:hasQualifyingTerm <' || qualifier || '> .' from with_links where qualifier is not null"""
QUERIES["write_ttl"] = lambda s, d: G.turtle(G.triples(D.by_subject(s, d)))
ORACLE_SQL["write_ttl"] = D.CTE.rstrip() + ", " + TTL
query("write_project_ttl", f"select distinct unnest(['<{X.BASE}projects/' || project_id || '> ex:a <Project> .', '<{X.BASE}subjects/' || subject_id || '> ex:hasProjectSubjectId <{X.BASE}projects/' || project_id || '/' || project_subject_id || '> .', '<{X.BASE}projects/' || project_id || '/' || project_subject_id || '> ex:hasProject <{X.BASE}projects/' || project_id || '> .']) as line from map_")(lambda s, d: G.turtle(G.project_triples(D.mapping(s, d))))
query("baseline_graph", "select count(distinct subject_id) as subjects, count(distinct termlink_id) as termlinks from bs")(lambda s, d: G.baseline(D.by_subject(s, d)))


# import and export
def records(s, d):
    """The evidence as lines that the import reads, one a subject and term of a project."""
    e, m = D.full_evidence(s, d, near="subject_id").where("not exists(qualifiers, q -> q.qualifier_type like 'http%')"), D.mapping(s, d).where(~F.col("project_subject_id").startswith("b-"))
    quals = X.normalize_qualifiers(F.col("qualifiers"))
    item = F.struct(
        "clinical_note_id", "encounter_id", F.col("creator.creator_id").alias("evidence_creator_id"), F.col("creator.creator_type").alias("evidence_creator_type"), F.col("creator.creator_name").alias("evidence_creator_name"),
        F.col("note_context.note_date").cast("string").alias("note_timestamp"), F.col("note_context.note_type").alias("note_type"), F.col("note_context.provider_type").alias("provider_type"),
        F.col("text_annotation.span_start").alias("span_start"), F.col("text_annotation.span_end").alias("span_end"), F.struct(*[F.when(F.array_contains(quals, f"{n}:true"), 1.0).otherwise(0.0).alias(n) for n in X.EXCLUDED]).alias("contexts"),
    )
    # a project's subject is one subject: grouped by it too, rows stay where the join left them
    rows = e.join(m, "subject_id").groupBy("subject_id", "project_id", "project_subject_id", "term_iri").agg(F.collect_list(item).alias("evidence"))
    return rows.drop("subject_id")


_files: dict[tuple[str, str], str] = {}


def input_files(s, d) -> str:
    """A folder of NDJSON files, written once a session: what an import begins with."""
    key = s.sparkContext.applicationId, d
    if key not in _files:
        path = f"{shared_dir(s)}/records/{uuid.uuid4().hex}/projects/proj-x"
        with shuffles_go(s):
            records(s, d).write.option("compression", "gzip").json(path + "/jsonl")
        _files[key] = path
    return _files[key]


def imported(s, d, run: str):
    """What the import makes of the files: new evidence and the mapping; evidence of 1995 is there already."""
    m = D.mapping(s, d).where(~F.col("project_subject_id").startswith("b-"))
    return I.bulk_import(I.read_records(s, input_files(s, d)), m, D.full_evidence(s, d).where("run_id = 'run-1995'"), run)[0]


NEW = "ev where run_id <> 'run-1995' and qual_key not like 'http%'"
query("scan_ndjson", "select project_id, count(distinct (subject_id, term_iri)) as records, count(*) as items from ev join map_ using (subject_id) where qual_key not like 'http%' and project_subject_id not like 'b-%' group by 1")(
    lambda s, d: I.read_records(s, input_files(s, d)).groupBy("project_id").agg(F.count("*").alias("records"), F.sum(F.size("evidence")).alias("items"))
)
query("scan_ndjson_pairs", "select distinct project_id, project_subject_id from ev join map_ using (subject_id) where qual_key not like 'http%' and project_subject_id not like 'b-%'")(lambda s, d: I.read_records(s, input_files(s, d)).select("project_id", "project_subject_id").distinct())
query("bulk_import", f"select evidence_id, termlink_id, note_date, qual_key, creator_type from {NEW}")(lambda s, d: D.keyed(E.flat(imported(s, d, "run-x"))).select("evidence_id", "termlink_id", "note_date", "qual_key", "creator_type"))
query("flatten_evidence", f"""select evidence_id, 'run-y' as run_id, case creator_type when 'automated' then '{X.OBO}ECO_0000203' else '{X.OBO}ECO_0000218' end as assertion_type, 'clinical_note' as source_level, encounter_id, clinical_note_id, 'hpo' as source,
 note_type, note_date, provider_type, creator_id, creator_type, creator_name, span_start, span_end, cast(3 as bigint) as qualifiers from {NEW}""")(
    lambda s, d: imported(s, d, "run-y").select("evidence_id", "run_id", "assertion_type", "source_level", "encounter_id", "clinical_note_id", "term_source.source", "note_context.note_type", F.to_date("note_context.note_date").alias("note_date"), "note_context.provider_type", "creator.creator_id", "creator.creator_type", "creator.creator_name", "text_annotation.span_start", "text_annotation.span_end", F.size("qualifiers").cast("long").alias("qualifiers"))
)


@query("validate_input_files", "select 'proj-x' as project_id, true as has_files", False)
def validate_input_files(s, d):
    found = I.validate_input_files(s, input_files(s, d))
    return s.createDataFrame([(found["project_id"], found["n_files"] > 0 and found["total_bytes"] > 0)], "project_id string, has_files boolean")


@query("resolve_subjects", "select project_id, project_subject_id, case when project_id = 'proj-3' then sha256(project_id || '|' || project_subject_id) else subject_id end as subject_id from map_")
def resolve_subjects(s, d):
    m = D.mapping(s, d)
    return I.resolve_subjects(m, m.where("project_id <> 'proj-3'"))


def packets(s, d):
    sources = s.createDataFrame([("hpo", "v1"), ("mondo", "v9")], "source string, version string")
    return P.packets(D.by_project_term(s, d).where(F.col("project_id") == B), D.hierarchy(s, d).select("term_id", "term_label"), sources)


@query("phenopacket_export", f"""select project_subject_id, '{{"id":"' || project_subject_id || '","subject":{{"id":"' || project_subject_id || '"}},"phenotypicFeatures":[' || string_agg(f, ',' order by term_id, excluded, evidence_count, first_evidence_date, last_evidence_date)
 || ']}}' || '|' || 'hpo=v1' as packet from (
 select distinct project_subject_id, term_id, qual_key = 'negated:true' as excluded, evidence_count, first_evidence_date, last_evidence_date,
 '{{"type":{{"id":"' || term_id || '","label":"' || term_label || '"}},"excluded":' || (qual_key = 'negated:true') || ',"evidenceCount":' || evidence_count || ',"evidenceDates":["' || first_evidence_date || '","' || last_evidence_date || '"]}}' as f
 from bpt join label using (term_id) where project_id = '{B}') group by 1""")
def phenopacket_export(s, d):
    """The packets, the ontologies in their metadata written shortly behind them."""
    meta = F.from_json(F.get_json_object("packet", "$.metaData.resources"), "array<struct<id:string,version:string>>")
    short = F.array_join(F.transform(meta, lambda r: F.concat_ws("=", r["id"], r["version"])), ",")
    return packets(s, d).select("project_subject_id", F.concat(F.regexp_replace("packet", ',"metaData":.*$', "}"), F.lit("|"), short).alias("packet"))


@query("phenopacket_import", f"""select distinct sha256('{B}|' || project_subject_id) as subject_id, term_iri, (qual_key = 'negated:true') as excluded, 'system' as creator_type, 'phenopacket-importer' as creator_id, '{X.OBO}ECO_0000311' as evidence_type,
 sha256('{X.BASE}subjects/' || sha256('{B}|' || project_subject_id) || '|' || term_iri || '|' || case when qual_key = 'negated:true' then qual_key else '' end) as termlink_id from bpt where project_id = '{B}'""")
def phenopacket_import(s, d):
    """Exported packets read again in a project of their own."""
    read = P.parse(packets(s, d).select("packet"), "packet")
    spaces = F.array(F.struct(*[F.lit(None).cast("string").alias(n) for n in ("id", "name", "url", "version")], F.lit("HP").alias("namespacePrefix"), F.lit(X.OBO + "HP_").alias("iriPrefix")))
    read = read.withColumn("metaData", F.struct(F.lit(None).cast("string").alias("created"), F.lit(None).cast("string").alias("createdBy"), spaces.alias("resources")))
    new, _ = P.evidence_of(read, B, D.mapping(s, d).limit(0))
    return new.select("subject_id", "term_iri", F.exists("qualifiers", lambda q: q["qualifier_type"] == "negated").alias("excluded"), "creator.creator_type", "creator.creator_id", "evidence_type", "termlink_id")


query("validate_materialization", """, held as (select count(distinct (subject_id, term_iri, termlink_id)) as want_rows, count(*) as want_evidence, count(distinct termlink_id) as rows, count(distinct evidence_id) as evidence, (select count(*) from bpt) as want_project_rows, (select count(*) from bpt) as project_rows,
 count(distinct subject_id) as want_subjects, (select count(distinct subject_id) from bs) as subjects, (select count(*) from bs where termlink_id is null or subject_id is null or term_iri is null) as null_keys,
 (select count(*) from (select subject_id, count(distinct termlink_id) as n_evidence from ev where subject_id is not null group by 1) full join (select subject_id, count(*) as n_rollup from bs where subject_id is not null group by 1) using (subject_id)
  where coalesce(n_evidence, 0) <> coalesce(n_rollup, 0)) as mismatched_subjects from ev)
 select *, errors = '' as valid from (select *, concat_ws('; ', case when want_rows <> rows then format('Term count mismatch! Expected: {:,}, Got: {:,}', want_rows, rows) end,
  case when want_subjects <> subjects then format('Subject count mismatch! Expected: {:,}, Got: {:,}', want_subjects, subjects) end,
  case when want_project_rows <> project_rows then format('Project row count mismatch! Expected: {:,}, Got: {:,}', want_project_rows, project_rows) end,
  case when null_keys > 0 then format('Found {:,} records with NULL critical fields!', null_keys) end,
  case when mismatched_subjects > 0 then format('Verification failed! {:,} subjects have mismatched term counts', mismatched_subjects) end) as errors from held)""")(
    lambda s, d: V.materialization(D.evidence(s, d, near="subject_id"), D.mapping(s, d), D.by_subject(s, d), D.by_project_term(s, d))
)
query("bernoulli_sample", None)(lambda s, d: D.evidence(s, d).sample(0.1, 42).limit(100).select("evidence_id"))

from . import more  # noqa: E402, F401  (registers its queries here)
