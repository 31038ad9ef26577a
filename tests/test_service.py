"""The service over a folder of stored tables: life cycle, evidence, paging, import, stream, graph calls and validation."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cohortmill import schemas, service
from cohortmill.functions import exprs as X
from cohortmill.operators import graph, ontology, rollup, subjects, synth, validate
from cohortmill.operators.evidence import flat
from cohortmill.sources import files, ingest, phenopackets
from cohortmill.storage import Store, cleanup_prefix, listing
from cohortmill.streaming.ingest import import_stream

HP = X.OBO + "HP_"


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/tables").create()
    terms = spark.createDataFrame([("HP:0000001", "All", []), ("HP:0000118", "Abnormal", ["HP:0000001"]), ("HP:0000010", "Up", ["HP:0000118"]), ("HP:0000011", "Down", ["HP:0000010"])], "term_id string, term_label string, parent_ids array<string>")
    ontology.load(s, ontology.hierarchy(terms, "hpo", "v1"))
    files.register_source(s, "hpo", "v1", dt.datetime(2024, 1, 1))
    files.set_installed(s, "hpo", "v1", dt.datetime(2024, 1, 2))
    service.project_create(s, "p1")
    return s


def line(psid, term, note="n1", negated="0.0", project="p1"):
    item = {"clinical_note_id": note, "encounter_id": "e1", "evidence_creator_id": "nlp", "evidence_creator_type": "automated", "note_timestamp": "2024-03-01T00:00:00Z", "span_start": 1, "span_end": 5, "contexts": {"negated": negated, "family": "0.0", "hypothetical": "0.0"}}
    return json.dumps({"project_id": project, "project_subject_id": psid, "term_iri": HP + term, "evidence": [item]})


def lines(spark, *rows):
    return ingest.parse_records(spark.createDataFrame([(r,) for r in rows], "value string"))


def same_as_rebuilt(store):
    for name in ("subject_terms_by_subject", "subject_terms_by_project_term"):
        before = sorted(map(repr, store.read(name).collect()))
        subjects.materialize_all(store)
        assert before == sorted(map(repr, store.read(name).collect()))


def test_life_cycle(spark, store):
    assert not service.project_create(store, "p1")["created"] and service.project_create(store, "p2")["created"]
    a = service.subject_create(store, "p1", "a")
    assert a["created"] and service.subject_create(store, "p1", "a") == {"subject_id": a["subject_id"], "created": False, "linked": False}
    record = {"subject_id": a["subject_id"], "term_iri": HP + "0000011", "creator_id": "c", "qualifiers": {"negated": False}, "clinical_note_id": "n"}
    made = service.evidence_create(store, record)
    assert made["created"] and not service.evidence_create(store, record)["created"]
    linked = service.subject_create(store, "p2", "b", known_project_id="p1", known_project_subject_id="a")
    assert linked["linked"] and service.subject(store, project_id="p2", project_subject_id="b")["terms"][0]["evidence_count"] == 1
    for bad, error in (({"project_id": "none", "project_subject_id": "x"}, LookupError), ({"project_id": "p1", "project_subject_id": "x", "known_subject_id": "none"}, LookupError), ({"project_id": "p1", "project_subject_id": "x", "known_subject_id": "y", "known_project_id": "p1"}, ValueError), ({"project_id": "p1", "project_subject_id": "x", "known_project_id": "p1"}, ValueError)):
        with pytest.raises(error):
            service.subject_create(store, **bad)
    assert store.read("subject_mapping").count() == 2
    assert service.subject_term_info(store, a["subject_id"], HP + "0000011")["evidence_count"] == 1
    assert service.evidence(store, made["evidence_id"])["qualifiers"] == {"negated": "false"}
    store.append("triples", graph.triples(store.read("subject_terms_by_subject")).withColumn("graph", F.lit(graph.SUBJECTS)))
    assert service.subject_remove(store, "p1", "a") == {"mappings": 1, "subjects": 0, "termlinks": 0}
    assert store.read("evidence").count() == 1 and store.read("triples").count() == 2
    assert service.project_remove(store, "p2") == {"mappings": 1, "subjects": 1, "termlinks": 1}
    assert all(store.read(t).isEmpty() for t in ("evidence", "subject_terms_by_subject", "subject_terms_by_project_term", "subject_mapping", "triples"))
    with pytest.raises(LookupError):
        service.subject_remove(store, "p1", "a")
    with pytest.raises(LookupError):
        service.subject(store, subject_id=a["subject_id"])
    assert not service.evidence_remove(store, made["evidence_id"])


def test_import_and_cohorts(spark, store):
    rows = [line(f"s{i}", f"00000{10 + i % 2}", f"n{i}", "1.0" if i == 3 else "0.0") for i in range(6)]
    assert ingest.import_run(store, lines(spark, *rows), "r1") == {"status": "import_success", "run_id": "r1", "evidence": 6}
    # again, and with one more: only that is added
    assert ingest.import_run(store, lines(spark, *rows, line("s0", "0000011", "n9")), "r2")["evidence"] == 1
    assert store.read("evidence").count() == 7
    same_as_rebuilt(store)
    assert subjects.materialize_project(store, "p1") == {"subjects": 6, "rows": 7}
    assert subjects.materialize_project(store, "nothing") == {"subjects": 0, "rows": 0}
    got = service.subjects_query(store, "p1", terms=["HP:0000010"], limit=4)
    assert (got["total_count"], len(got["subjects"]), got["has_more"], got["next_cursor"]) == (6, 4, True, "4")
    assert not service.subjects_query(store, "p1", terms=["HP:0000010"], limit=4, cursor="4")["has_more"]
    assert service.subjects_query(store, "p1", terms=["HP:0000011"], include_qualified=False)["total_count"] == 3
    assert service.subjects_query(store, "p1", terms=["HP:0000010"], include_child_terms=False)["total_count"] == 3
    with pytest.raises(ValueError):
        service.subjects_query(store, "p1", terms=["HP:0000118"])
    store.append("association", spark.createDataFrame([("gene", "HP:0000011"), ("gene", "HP:0000001")], schemas.ASSOCIATION))
    assert service.subjects_query(store, "p1", associated_with="gene")["total_count"] == 4
    first = service.evidence_query_by_run(store, "r1", 4)
    rest = service.evidence_query_by_run(store, "r1", 4, first["next_token"])
    assert first["total_count"] == 6 and len({r.evidence_id for r in first["evidence"] + rest["evidence"]}) == 6 and rest["next_token"] is None
    row = first["evidence"][0]
    assert service.evidence_query(store, link=row.termlink_id)["total_count"] == 1
    with pytest.raises(ValueError):
        service.evidence_query(store, limit=0, link=row.termlink_id)
    assert service.evidence_remove(store, row.evidence_id)
    same_as_rebuilt(store)
    bad = ingest.import_run(store, lines(spark, line("s9", "0000010").replace("automated", "robot")), "r3")
    assert bad["status"] == "import_failure" and store.read("evidence").where("run_id = 'r3'").isEmpty()
    out = validate.materialization(flat(store.read("evidence")), store.read("subject_mapping"), store.read("subject_terms_by_subject"), store.read("subject_terms_by_project_term")).first()
    assert out.want_rows == out.rows and out.want_evidence == out.evidence == 6 and out.project_rows == out.want_project_rows


def test_merge_of_two_runs_is_the_whole(spark, store):
    ingest.import_run(store, lines(spark, *[line(f"s{i % 3}", "0000010", f"n{i}") for i in range(9)]), "r1")
    e = flat(store.read("evidence"))
    parts = [rollup.by_subject(e.where(F.col("clinical_note_id").isin(x))) for x in (["n0", "n1", "n2", "n3"], ["n4", "n5", "n6", "n7", "n8"])]
    merged = rollup.merge_delta(*parts, rollup.SUBJECT_KEYS).select(*parts[0].columns)
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, rollup.by_subject(e).collect()))


def test_store(spark, store, tmp_path):
    with pytest.raises(ValueError, match="missing"):
        store.append("project", spark.createDataFrame([("x",)], "project_id string"))
    with pytest.warns(UserWarning, match="left out"):
        store.append("project", spark.createDataFrame([("x", "y", 1)], "project_id string, project_label string, more int"))
    assert store.read("project").count() == 2 and store.delete("project", F.col("project_id") == "x") == 1
    assert ontology.delete_version(store, "HPO", "v1") == 4
    assert "evidence" in store.reset() and store.read("project").isEmpty()
    assert listing(spark, store.path("project")) and cleanup_prefix(spark, store.root) > 0 and listing(spark, store.root, True) == []


def test_stream(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(line(f"s{i}", "0000010", f"n{k}{i}") for i in range(3)))
        import_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "checkpoint")).awaitTermination()
    assert store.read("evidence").count() == 6 and store.read("subject_mapping").count() == 3
    same_as_rebuilt(store)


def test_phenopacket_zip(spark, store, tmp_path):
    packet = {"id": "a", "phenotypicFeatures": [{"type": {"id": "HP:0000010"}}, {"type": {"id": "HP:0000011"}, "excluded": True}], "metaData": {"createdBy": "me", "resources": [{"namespacePrefix": "HP", "iriPrefix": HP}]}}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d/", "")
        z.writestr("d/a.json", json.dumps(packet))
        z.writestr("d/b.json", json.dumps({"id": "b", "phenotypicFeatures": []}))
        z.writestr("bad.json", "{")
        z.writestr("readme.txt", "no")
    read = phenopackets.parse(phenopackets.read_zip(spark, str(tmp_path)))
    new, mapping = phenopackets.evidence_of(read, "p1", store.read("subject_mapping"))
    assert sorted((r.term_iri, [q.qualifier_type for q in r.qualifiers], r.creator.creator_id) for r in new.collect()) == [(HP + "0000010", [], "me"), (HP + "0000011", ["negated"], "me")]
    assert mapping.count() == 2
    store.replace("subject_mapping", mapping)
    store.append("evidence", new)
    subjects.materialize_all(store)
    got = phenopackets.packets(store.read("subject_terms_by_project_term"), store.read("ontology_hierarchy").select("term_id", "term_label"), store.read("term_source")).collect()
    out = zipfile.ZipFile(io.BytesIO(phenopackets.zipped([tuple(r) for r in got])))
    features = json.loads(out.read("a.json"))["phenotypicFeatures"]
    assert out.namelist() == ["a.json"] and [(f["type"], f["excluded"], f["evidenceCount"]) for f in features] == [({"id": "HP:0000010", "label": "Up"}, False, 1), ({"id": "HP:0000011", "label": "Down"}, True, 1)]


def test_graph_calls(spark):
    empty = spark.createDataFrame([], "s string, p string, o string")
    new, iri, fresh = graph.create_term_link(empty, "s1", HP + "0000010", ["negated", X.OBO + "HP_0012823:present", "family:0"])
    assert fresh and {r.o for r in new.where("p = 'hasQualifyingTerm'").collect()} == {X.QUALIFIER + "negated", X.OBO + "HP_0012823"}
    again = graph.create_term_link(new, "s1", HP + "0000010", [X.OBO + "HP_0012823:present", "negated:true"])
    assert again[0].isEmpty() and again[1] == iri and not again[2]
    assert graph.delete_term_link(new, iri).isEmpty() and graph.properties(new.where("p = 'hasTerm'"), iri) == {"has_term": HP + "0000010"}
    with pytest.raises(ValueError):
        graph.flatten_response([{"a": 1}, {"a": 2}])
    named = new.withColumn("graph", F.lit(graph.SUBJECTS))
    for text in ("delete where { ?s ?p ?o }", "select * from <http://x/projects/p> where {}", "hello", 'prefix x: <y> insert data { <a> <b> "select" }'):
        with pytest.raises(ValueError):
            graph.readable(named, text)
    assert graph.readable(named, "# insert\nselect ?s where { ?s <http://x#delete> 'clear' }").count() == 4


def test_synthetic_records(spark):
    rows = synth.records(spark, 30, [f"HP:{i:07d}" for i in range(1000)], "p", 20, 40, 10)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, synth.records(spark, 30, [f"HP:{i:07d}" for i in range(1000)], "p", 20, 40, 10).repartition(7).collect()))
    n = rows.groupBy("project_subject_id").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert 10 <= n[0] and n[1] <= 40 and n[2] == 30
    e = rows.selectExpr("explode(evidence) as e").select("e.*")
    assert 0.1 < e.where("contexts.negated = '1.0'").count() / e.count() < 0.2
    flatted = ingest.flatten(rows, ingest.resolve_subjects(rows, spark.createDataFrame([], schemas.MAPPING)), "r")
    assert flatted.count() == e.count()
