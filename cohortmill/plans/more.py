"""Queries of the subject life cycle, the graph, the stored tables and small files, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import exprs as X
from ..operators import graph as G
from ..operators import ontology as O
from ..operators import rollup as R
from ..operators import subjects as S
from ..operators import synth
from ..operators import validate as V
from ..sources import files as L
from ..sources import ingest as I
from ..storage import shared_dir
from . import derived as D
from .queries import LINKS, ORACLE_SQL, B, associations, query


# life cycle
@query("create_project", "select project_id, count(*) as n from (select distinct project_id from map_ union all select 'proj-new') group by 1")
def create_project(s, d):
    """A new project and one that is there, added to those of the mapping: only the new one is a row more."""
    have = D.mapping(s, d).select("project_id").distinct()
    new = s.createDataFrame([("proj-new",), ("proj-building",)], "project_id string").join(have, "project_id", "left_anti")
    return have.union(new).groupBy("project_id").agg(F.count("*").alias("n"))


@query("create_subject", "select project_subject_id, subject_id from map_ where project_id = 'proj-building' union all select 'known-' || c_custkey, 'subj-' || c_custkey from customer where c_custkey < 5 union all select 'new-' || c_custkey, sha256('proj-building|new-' || c_custkey) from customer where c_custkey < 5")
def create_subject(s, d):
    """Known subjects linked to a project and new ones made in it; pairs that are mapped stay as they are."""
    m = D.mapping(s, d)
    few = D.read(s, d, "customer").where("c_custkey < 5").select(F.col("c_custkey").cast("string").alias("k"))
    known = few.select(F.lit(B).alias("project_id"), F.concat(F.lit("known-"), "k").alias("project_subject_id"), F.concat(F.lit("subj-"), "k").alias("subject_id"))
    new = few.select(F.lit(B).alias("project_id"), F.concat(F.lit("new-"), "k").alias("project_subject_id"))
    linked = m.unionByName(known.join(m, S.KEYS, "left_anti"))
    pairs = new.union(m.where(F.col("project_id") == B).select(*S.KEYS))
    return I.resolve_subjects(pairs, linked).where(F.col("project_id") == B).select("project_subject_id", "subject_id")


def _after(s, d, gone: DataFrame) -> DataFrame:
    """What the tables hold when the mapping rows ``gone`` went, with the subjects that had no others."""
    m = D.mapping(s, d)
    orphans = S.last_mappings(m, gone)
    left = {"mapping": m.join(gone.select(*S.KEYS), S.KEYS, "left_anti"), "evidence": S.without_subjects(D.evidence(s, d), orphans), "by_subject": S.without_subjects(D.by_subject(s, d), orphans), "by_project_term": D.by_project_term(s, d).join(gone.select(*S.KEYS), S.KEYS, "left_anti")}
    out = orphans.agg(F.lit("orphans").alias("kind"), F.count("*").alias("n"))
    for kind, rows in left.items():
        out = out.union(rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")))
    return out


def _after_sql(which: str) -> str:
    return f""", gone as (select * from map_ where {which}), staying as (select * from map_ where not ({which})),
 orphan as (select distinct subject_id from gone where subject_id not in (select subject_id from staying))
 select 'orphans' as kind, count(*) as n from orphan union all select 'mapping', count(*) from staying
 union all select 'evidence', count(*) from ev where subject_id not in (from orphan) union all select 'by_subject', count(*) from bs where subject_id not in (from orphan)
 union all select 'by_project_term', count(*) from bpt where not ({which})"""


@query("remove_subject", None)
def remove_subject(s, d):
    return _after(s, d, D.mapping(s, d).where("project_subject_id in ('psid-1', 'psid-2', 'psid-3', 'b-3')"))


@query("remove_project", None)
def remove_project(s, d):
    return _after(s, d, D.mapping(s, d).where("project_id = 'proj-3'"))


ORACLE_SQL["remove_subject"] = D.CTE.rstrip() + _after_sql("project_subject_id in ('psid-1', 'psid-2', 'psid-3', 'b-3')")
ORACLE_SQL["remove_project"] = D.CTE.rstrip() + _after_sql("project_id = 'proj-3'")


# joins that have a row of their own
@query("join_values_cte", "select project_id, evidence_id from ev join (values ('proj-a', 'subj-1'), ('proj-a', 'subj-7'), ('proj-b', 'subj-7')) m(project_id, subject_id) using (subject_id)")
def join_values_cte(s, d):
    return D.evidence(s, d).join(F.broadcast(s.createDataFrame([("proj-a", "subj-1"), ("proj-a", "subj-7"), ("proj-b", "subj-7")], "project_id string, subject_id string")), "subject_id").select("project_id", "evidence_id")


@query("join_back", "select evidence_id, creator_id from ev where run_id = 'run-1995'")
def join_back(s, d):
    """The wide rows of a batch whose keys are not there yet, by one anti-join of the wide rows."""
    e = D.evidence(s, d)
    return R.insert_only(e.where("run_id <> 'run-1995'"), e).select("evidence_id", "creator_id")


query("agg_sql_variant", "select subject_id, term_iri, count(*) as n from ev group by all")(lambda s, d: D.by_subject(s, d).groupBy("subject_id", "term_iri").agg(F.sum("evidence_count").alias("n")))
query("topk_terms", "select term_id, count(distinct subject_id) as n from ev group by 1 order by n desc, term_id limit 20")(lambda s, d: D.by_subject(s, d).groupBy("term_id").agg(F.count_distinct("subject_id").alias("n")).orderBy(F.desc("n"), "term_id").limit(20))
query("sparql_union", "select distinct term_id, label from (select term_id, term_label as label from label union select term_id, term_id from ev)")(lambda s, d: D.hierarchy(s, d).select("term_id", F.col("term_label").alias("label")).union(D.evidence(s, d).select("term_id", "term_id")).distinct())


@query("null_guard", "select count(*) as n from map_ where project_id = 'proj-3'")
def null_guard(s, d):
    """Pairs of an import that no subject was found for: what makes it fail."""
    m = D.mapping(s, d)
    return m.select(*S.KEYS).join(m.where("project_id <> 'proj-3'"), S.KEYS, "left").where("subject_id is null").agg(F.count("*").alias("n"))


@query("throughput", "select run_id, round(count(distinct (subject_id, term_iri))::double / 60, 6) as records_per_second, round(count(*)::double / 60, 6) as evidence_per_second from ev group by 1")
def throughput(s, d):
    return V.throughput(D.evidence(s, d).groupBy("run_id").agg(F.count_distinct("subject_id", "term_iri").alias("records"), F.count("*").alias("evidence"), F.lit(60).alias("seconds")))


query("ttl_manifest", "select run_id, count(*) as rows, least(64, cast(ceil(count(*) / 1000.0) as bigint)) as pages from ev group by 1")(lambda s, d: D.evidence(s, d).groupBy("run_id").agg(F.count("*").alias("rows")).select("run_id", "rows", F.least(F.lit(64), F.ceil(F.col("rows") / 1000.0)).cast("long").alias("pages")))
query("ttl_pages", None)(lambda s, d: D.evidence(s, d).where("run_id = 'run-1995'").groupBy(F.pmod(F.xxhash64("subject_id"), F.lit(64)).alias("page")).agg(F.count("*").alias("n")))

# hierarchy tables
HIERARCHY = "select 'v1' as version, count(*) as terms, cast(sum(depth) as bigint) as depths from label"


def _two_versions(s, d) -> DataFrame:
    rows = D.hierarchy(s, d)
    return rows.union(rows.where("depth < 3").withColumn("version", F.lit("v2")))


def _per_version(rows: DataFrame) -> DataFrame:
    return rows.groupBy("version").agg(F.count("*").alias("terms"), F.sum("depth").alias("depths"))


query("insert_hierarchy_batch", HIERARCHY + " union all select 'v2', count(*), cast(sum(depth) as bigint) from label where depth < 3")(lambda s, d: _per_version(_two_versions(s, d)))
query("delete_hierarchy_version", HIERARCHY)(lambda s, d: _per_version(_two_versions(s, d).where("not (lower(ontology_source) = 'hpo' and version = 'v2')")))


@query("scan_obo", "select term_id, term_label, depth from label where depth < 4")
def scan_obo(s, d):
    """The upper terms written as an OBO file, parsed again and given their depths."""
    some = D.terms(s, d).join(D.hierarchy(s, d).where("depth < 4").select("term_id"), "term_id", "left_semi")
    lines = F.concat(F.lit("[Term]\nid: "), "term_id", F.lit("\nname: "), "term_label", F.lit("\n"), F.array_join(F.transform("parent_ids", lambda p: F.concat(F.lit("is_a: "), p, F.lit(" {source=\"x\"} ! parent\n"))), ""), F.lit("is_a: XX:0000001 ! of another ontology\n"))
    path = f"{shared_dir(s)}/obo/{uuid.uuid4().hex}"
    some.select(lines.alias("value")).coalesce(1).write.text(path)  # one file is one ontology
    return O.hierarchy(O.obo_terms(s, path, "HP"), "hpo", "v2").select("term_id", "term_label", "depth")


# graph
query("get_subjects_graph", f"""with_links as ({LINKS}), hit as (select subject, link, term from with_links where term in (select '{X.OBO}' || replace(term_id, ':', '_') from closure where ancestor_id = 'HP:0000002')
 and (qualifier is null or qualifier not in ('{X.QUALIFIER}negated', '{X.QUALIFIER}hypothetical', '{X.QUALIFIER}family')) and subject > '{X.BASE}subjects/subj-2')
 select subject, link, term from hit where subject in (select distinct subject from hit order by subject limit 10)""", False)(
    lambda s, d: G.subjects_in_rollup(D.by_subject(s, d), D.closure(s, d).where("ancestor_id = 'HP:0000002'").select(X.term_iri(F.col("term_id")).alias("term")), cursor=X.BASE + "subjects/subj-2", limit=10)
)
ORACLE_SQL["get_subjects_graph"] = D.CTE.rstrip() + ", " + ORACLE_SQL["get_subjects_graph"]


@query("node_exists", "select * from (values ('node', true), ('no node', false), ('triple', true), ('no triple', false), ('project', true), ('subject', true)) t(kind, found)", False)
def node_exists(s, d):
    m, nobody = D.mapping(s, d), X.BASE + "subjects/nobody"
    first = D.parts(s, d, "by_subject").where("subject_id is not null and term_id is not null").agg(F.min("subject_id").alias("i")).first()["i"]
    one = D.triples(s, d, f"{X.BASE}subjects/{first}").where("p = 'hasTerm'").orderBy("s").first()
    t = D.triples(s, d, one["s"])
    found = [
        ("node", G.node_exists(t, one["s"])), ("no node", G.node_exists(D.triples(s, d, nobody), nobody)), ("triple", G.triple_exists(t, one["s"], "hasTerm", one["o"])), ("no triple", G.triple_exists(t, one["s"], "hasTerm", "x")),
        ("project", S.exists(m, project_id=B)), ("subject", S.exists(m, subject_id="subj-7")),
    ]
    return s.createDataFrame(found, "kind string, found boolean")


NEW_LINK = f"'{X.BASE}subjects/subj-7/term-link/' || sha256('{X.BASE}subjects/subj-7|{X.OBO}HP_9999999|negated:true')"


@query("create_term_link", f"select '{X.BASE}subjects/subj-7' as s, 'hasTermLink' as p, {NEW_LINK} as o union all select {NEW_LINK}, 'hasTerm', '{X.OBO}HP_9999999' union all select {NEW_LINK}, 'hasQualifyingTerm', '{X.QUALIFIER}negated'", False)
def create_term_link(s, d):
    return G.create_term_link(D.triples(s, d, X.BASE + "subjects/subj-7"), "subj-7", X.OBO + "HP_9999999", ["negated:true", "family:false"])[0]


def _first_link(s, d) -> str:
    r = D.by_subject(s, d).where("subject_id = 'subj-7'").agg(F.min("termlink_id").alias("i")).first()
    return f"{X.BASE}subjects/subj-7/term-link/{r['i']}"


FIRST_LINK = "(select min(termlink_id) from bs where subject_id = 'subj-7')"
query("get_term_link", f"select '{X.BASE}subjects/subj-7' as subject, term_iri, term_label, evidence_count, case when qual_key like 'http%' then regexp_replace(qual_key, ':[^:/]*$', '') when qual_key <> '' then '{X.QUALIFIER}' || split_part(qual_key, ':', 1) else '' end as qualifiers from bs join label using (term_id) where termlink_id = {FIRST_LINK}")(
    lambda s, d: G.get_term_link(D.triples(s, d, i := _first_link(s, d)), i, D.evidence(s, d), D.hierarchy(s, d).select("term_iri", "term_label")).select("subject", "term_iri", "term_label", "evidence_count", F.array_join("qualifiers", ",").alias("qualifiers"))
)
query("delete_term_link", f"select link, term from ({LINKS}) where link <> '{X.BASE}subjects/subj-7/term-link/' || {FIRST_LINK}")(lambda s, d: G.pattern(G.delete_term_link(D.triples(s, d), _first_link(s, d)), "hasTerm", "link", "term"))
query("graph_dump", f"select link as s, term as o from ({LINKS}) order by 1, 2 limit 25")(lambda s, d: G.dump(D.triples(s, d).where("p = 'hasTerm'"), 25).select("s", "o"))
query("creator_info", f"select 'has_term' as k, term_iri as v from bs where termlink_id = {FIRST_LINK}")(
    lambda s, d: s.createDataFrame([(k, v) for k, v in G.properties(D.triples(s, d).where("p = 'hasTerm'"), _first_link(s, d)).items()], "k string, v string")
)
query("existing_encounters", "select distinct subject_id, encounter_id from ev where encounter_id in ('enc-1', 'enc-2', 'enc-3')")(
    lambda s, d: G.typed(G.encounter_triples(D.evidence(s, d)), "Encounter", D.evidence(s, d).where("encounter_id in ('enc-1', 'enc-2', 'enc-3')").select(F.concat(X.subject_iri(F.col("subject_id")), F.lit("/encounter/"), "encounter_id").alias("iri")).union(s.createDataFrame([("nothing",)], "iri string"))).select(F.element_at(F.split("iri", "/"), -3).alias("subject_id"), F.element_at(F.split("iri", "/"), -1).alias("encounter_id"))
)
query("existing_notes", "select distinct clinical_note_id from ev where run_id = 'run-1995'")(
    lambda s, d: G.typed(G.encounter_triples(D.evidence(s, d)), "ClinicalNote", D.evidence(s, d).where("run_id = 'run-1995'").select(F.concat(X.subject_iri(F.col("subject_id")), F.lit("/note/"), "clinical_note_id").alias("iri"))).select(F.element_at(F.split("iri", "/"), -1).alias("clinical_note_id"))
)


@query("bulk_load_graph", f"select 'hasTerm' as p, count(*) as n from (select distinct link, term from ({LINKS})) union all select 'hasTermLink', count(*) from (select distinct subject, link from ({LINKS})) union all select 'hasQualifyingTerm', count(*) from (select distinct link, qualifier from ({LINKS}) where qualifier is not null)")
def bulk_load_graph(s, d):
    """Turtle files written and loaded again."""
    path = f"{shared_dir(s)}/turtle/{uuid.uuid4().hex}"
    # a link's lines stand together, so that its name is packed once
    G.turtle(G.triples(D.by_subject(s, d), unique=True)).write.option("compression", "gzip").text(path)
    return G.parse_turtle(s.read.text(path).toDF("line")).groupBy("p").agg(F.count("*").alias("n"))


query("load_status", "select 3::bigint as total, 1::bigint as completed, 1::bigint as failed, 1::bigint as running, 'FAILED' as status", False)(lambda s, d: G.load_status(s.createDataFrame([("LOAD_COMPLETED",), ("LOAD_IN_PROGRESS",), ("LOAD_FAILED",)], "status string")))


def _graphs(s, d) -> DataFrame:
    t = D.triples(s, d)
    return t.withColumn("graph", F.when(F.col("p") == "hasTerm", X.BASE + "subjects").otherwise(X.BASE + "projects/x"))


query("clear_graph", f"select (select count(*) from (select distinct link, term from ({LINKS}))) as left_over")(lambda s, d: _graphs(s, d).where(F.col("graph") != X.BASE + "projects/x").agg(F.count("*").alias("left_over")))


@query("sparql_guard", f"select 'select' as kind, (select count(*) from (select distinct link, term from ({LINKS}))) as n union all select 'insert', -1 union all select 'project graph', -1 union all select 'delete in a text', (select count(*) from (select distinct link, term from ({LINKS})))")
def sparql_guard(s, d):
    """What each query may see; -1 for one that is refused."""
    out = []
    texts = {"select": "select ?s where { ?s ?p ?o }", "insert": "insert data { <a> <b> <c> }", "project graph": f"select * from <{X.BASE}projects/x> where {{ ?s ?p ?o }}", "delete in a text": "select ?s where { ?s <http://x/y#delete> 'drop it' } # clear all"}
    for kind, text in texts.items():
        try:
            out.append((kind, G.readable(_graphs(s, d), text).count()))
        except ValueError:
            out.append((kind, -1))
    return s.createDataFrame(out, "kind string, n long")


@query("validate_graph", None)
def validate_graph(s, d):
    """The graph without the terms of subj-7 and with a link that no table has, against the tables."""
    t = D.triples(s, d)
    graph = t.where(~((F.col("p") == "hasTerm") & F.col("s").startswith(X.BASE + "subjects/subj-7/"))).union(s.createDataFrame([(X.BASE + "subjects/nobody", "hasTermLink", "x")], "s string, p string, o string"))
    return V.graph_differences(graph, D.by_subject(s, d), D.mapping(s, d))


ORACLE_SQL["validate_graph"] = D.CTE + f"select 'hasTerm' as kind, 'missing' as side, '{X.BASE}subjects/subj-7/term-link/' || termlink_id as s, term_iri as o from bs where subject_id = 'subj-7' union all select 'hasTermLink', 'unknown', '{X.BASE}subjects/nobody', 'x'"
query("flatten_results", "select subject_id, term_id from ev where run_id = 'run-1995'")(
    lambda s, d: G.flatten_results(D.evidence(s, d).where("run_id = 'run-1995'").groupBy("subject_id").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(*[F.struct(F.lit("literal").alias("type"), F.col(c).alias("value")).alias(c) for c in ("subject_id", "term_id")])).alias("bindings")).alias("results"))).alias("value"))).select(F.col("b")["subject_id"].alias("subject_id"), F.col("b")["term_id"].alias("term_id"))
)

# scalars
query("json", "select evidence_id, span_start as line from ev")(lambda s, d: D.full_evidence(s, d).select("evidence_id", F.get_json_object("text_annotation.annotation_metadata", "$.line").cast("int").alias("line")))
query("parse_iso_ts", "select distinct run_id, note_date as day, cast(null as date) as bad from ev where run_id = 'run-1995'")(
    lambda s, d: D.evidence(s, d).where("run_id = 'run-1995'").select("run_id", F.to_date(X.iso_timestamp(F.concat(F.col("note_date").cast("string"), F.lit("T00:00:00Z")))).alias("day"), F.to_date(X.iso_timestamp(F.concat(F.lit("no "), F.col("note_date").cast("string")))).alias("bad")).distinct()
)
CASES = {"hasTermLink": "has_term_link", "HTTPServer": "http_server", "getURLFromID2": "get_url_from_id2", "plain": "plain", "A": "a", "aB": "a_b"}
query("camel_to_snake", "select * from (values " + ", ".join(f"('{a}', '{b}', '{b}')" for a, b in CASES.items()) + ") t(name, snake, predicate)", False)(
    lambda s, d: s.createDataFrame([(a,) for a in CASES], "name string").select("name", X.camel_to_snake(F.col("name")).alias("snake"), X.split_predicate(F.concat(F.lit("http://x/y#"), "name")).alias("predicate"))
)

# small files and tables
@query("scan_prevalence_csv", "select 'HP:' || lpad(cast(p_partkey as varchar), 7, '0') as term_id, round((p_partkey % 100) / 100.0::double, 6) as prevalence, p_name as term_label from part where p_partkey < 300", False)
def scan_prevalence_csv(s, d):
    """A table with headers of its own, read by what they mean."""
    path = f"{shared_dir(s)}/csv/{uuid.uuid4().hex}"
    rows = D.read(s, d, "part").where("p_partkey < 300")
    rows.select(F.concat(F.lit("HP:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("HPO ID"), F.concat((F.col("p_partkey") % 100).cast("string"), F.lit("%")).alias("Frequency"), F.col("p_name").alias("HPO Name")).write.csv(path, header=True)
    return L.read_prevalence(s, path).select("term_id", F.round("prevalence", 6).alias("prevalence"), "term_label")


@query("scan_terms_json", "select 'common' as pool, 'HP:' || lpad(cast(p_partkey as varchar), 7, '0') as term_id from part where p_partkey < 50", False)
def scan_terms_json(s, d):
    path = f"{shared_dir(s)}/json/{uuid.uuid4().hex}"
    ids = F.collect_list(F.concat(F.lit("HP:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")))
    some = D.read(s, d, "part").where("p_partkey < 50")
    some.union(some).agg(ids.alias("common")).select(F.to_json(F.struct(F.struct("common").alias("pools"))).alias("value")).coalesce(1).write.text(path)
    return L.read_terms(s, path)


def _ddl(name: str) -> str:
    return "select * from (values " + ", ".join(f"('{t}', {c}::bigint)" for t, c in {"evidence": 18, "subject_terms_by_subject": 10, "subject_terms_by_project_term": 13, "ontology_hierarchy": 8}.items()) + f") t({name}, n_columns)"


query("ddl_tables", _ddl("name"), False)(lambda s, d: s.createDataFrame([(n, len(s.createDataFrame([], schemas.TABLES[n][0]).columns)) for n in ("evidence", "subject_terms_by_subject", "subject_terms_by_project_term", "ontology_hierarchy")], "name string, n_columns long"))
query("write_json_result", "select term_id, qual_key, evidence_count from bs where subject_id = 'subj-7'")(lambda s, d: _json_again(s, D.by_subject(s, d).where("subject_id = 'subj-7'").select("term_id", "qual_key", "evidence_count")))


def _json_again(s, rows: DataFrame) -> DataFrame:
    path = f"{shared_dir(s)}/results/{uuid.uuid4().hex}"
    L.write_json(rows, path)
    return s.read.schema(rows.schema).json(path)


query("synth_dataset", None)(lambda s, d: synth.records(s, 40, [f"HP:{i:07d}" for i in range(2000)], "proj-synth").select("project_subject_id", "term_iri", F.size("evidence").alias("items")))
query("scan_release", "select 'src-' || (o_custkey % 5) as source, count(distinct o_orderkey) as versions from orders group by 1", False)(
    lambda s, d: D.read(s, d, "orders").select(F.concat(F.lit("src-"), (F.col("o_custkey") % 5).cast("string")).alias("source"), "o_orderkey").groupBy("source").agg(F.count_distinct("o_orderkey").alias("versions"))
)
query("scan_monarch", "select distinct 'HP:' || lpad(cast(p_partkey as varchar), 7, '0') as object from part where p_partkey % 7 = 3", False)(lambda s, d: L.associations((a := associations(s, d)).union(a), "entity-3"))
