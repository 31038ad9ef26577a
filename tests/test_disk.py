"""What the derived tables and the plans over them leave out of files and shuffles."""

import os
import re
import subprocess
import sys

import pytest
from conftest import ROOT

from cohortmill.functions import exprs as X
from cohortmill.operators import evidence as E
from cohortmill.operators import graph as G
from cohortmill.operators import ontology as O
from cohortmill.operators import rollup as R
from cohortmill.plans import derived as D
from cohortmill.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["evidence", "by_subject", "by_project_term"])
def test_no_ids_in_files(spark, name):
    assert not {"termlink_id", "evidence_id", "term_iri", "clinical_note_id"} & set(D.parts(spark, SF, name).columns)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["clear_graph", "sparql_bgp"])
def test_graph_needs_no_join(spark, name):
    assert not re.search("Join", _plan(QUERIES[name](spark, SF)))


@pytest.mark.parametrize("name", ["agg_by_subject", "merge_by_subject"])
def test_rows_come_together_before_ids(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == {"subject_id"} and not re.search(r"Exchange hashpartitioning\([^)]*(termlink|evidence)_id", plan)


def test_triples_by_predicate(spark):
    q = "array(named_struct('qualifier_type', 'negated', 'qualifier_value', 'true'))"
    rows = spark.sql(f"select s subject_id, t term_iri, if(s is null or t is null, null, 'h' || s || t) termlink_id, {q} qualifiers from values ('a', 'x'), ('a', 'y'), ('b', 'x'), (null, 'x'), ('a', null) v(s, t)")
    want = sorted(map(repr, G.triples(rows).collect()))
    assert sorted(map(repr, G.triples_by_predicate(rows).collect())) == want
    assert sorted(map(repr, G.triples(rows, unique=True).collect())) == want


def test_insert_only_with_nulls(spark):
    kinds = "subject_id string, evidence_id string, v int"
    have = spark.createDataFrame([("a", "1", 9), ("a", None, 9)], kinds)
    new = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("a", "2", 1), ("a", None, 3)], kinds)
    assert sorted(map(repr, map(tuple, R.insert_only(have, new).collect()))) == ["('a', '2', 1)", "('a', None, 3)"]


def test_closure_writes_a_pair_once(spark, monkeypatch):
    """Two ways up, a chain of 9 and a circle of three."""
    edges = [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("a", None), *[(f"n{i}", f"n{i + 1}") for i in range(9)], ("x", "y"), ("y", "z"), ("z", "x")]
    written, save = [], O.save

    def counted(df, tag):
        out = save(df, tag)
        written.append(out.count() if tag == "closure" else 0)
        return out

    monkeypatch.setattr(O, "save", counted)
    got = [tuple(r) for r in O.closure(spark.createDataFrame(edges, "term_id string, parent_id string")).collect()]
    want = {(f"n{i}", f"n{j}") for i in range(10) for j in range(i, 10)} | {(p, q) for p in "xyz" for q in "xyz"} | {(t, u) for t, ups in {"a": "a", "b": "ba", "c": "ca", "d": "dbca"}.items() for u in ups}
    assert len(got) == len(want) and set(got) == want and sum(written) == len(want)


def test_build_leaves_no_shuffle_files(tmp_path):
    """A table's shuffles are gone when its build returns; in a session of its own, whose folder it looks into."""
    code = f"""
import glob, sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.local.dir", {str(tmp_path)!r}).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", 4).config("spark.sql.autoBroadcastJoinThreshold", "-1").getOrCreate()
from cohortmill.plans import derived as D
left = []
for name in ("evidence", "by_subject", "by_project_term"):
    D.build(s, {SF!r}, name)
    left.append(len(glob.glob({str(tmp_path)!r} + "/**/shuffle_*.data", recursive=True)))
print("left", left)
"""
    env = {k: v for k, v in os.environ.items() if k != "SPARK_LOCAL_DIRS"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, timeout=300)
    assert "left [0, 0, 0]" in out.stdout, out.stderr[-2000:]


def test_downsert_shuffles_evidence_once(spark):
    plan = QUERIES["downsert_on_remove"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("RepartitionByExpression", plan)) == 1


def test_ids_by_kind_are_those_of_the_qualifiers(spark):
    """The stored tables' ids, which are made of the kind, against ids made of the qualifiers."""
    e = D.stored(spark, SF, "evidence")
    got, want = (df.select("termlink_id", "evidence_id") for df in (e, E.with_ids(e)))
    assert e.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    r = D.by_subject(spark, SF)
    assert r.where(r.termlink_id != X.termlink_hash(X.subject_iri(r.subject_id), r.term_iri, X.normalize_qualifiers(r.qualifiers))).isEmpty()


@pytest.mark.parametrize("iri", [X.BASE + "subjects/a", X.BASE + "subjects/a/term-link/hax", X.BASE + "subjects/ab", "x", X.QUALIFIER + "negated", "http://q.org/k", X.BASE + "subjects/nobody"])
def test_triples_naming_an_iri(spark, iri):
    """None that names the IRI is left out, though rows that can't are (F21, F23, F9)."""
    q = "array(named_struct('qualifier_type', q, 'qualifier_value', 'true'))"
    rows = spark.sql(f"select s subject_id, t term_iri, if(s is null or t is null, null, 'h' || s || t) termlink_id, {q} qualifiers from values ('a', 'x', 'negated'), ('a', 'y', 'http://q.org/k'), ('b', 'x', 'family'), ('ab', 'z', 'negated'), (null, 'x', 'negated'), ('a', null, 'family') v(s, t, q)")
    every, some = (sorted(map(repr, t.where((t.s == iri) | (t.o == iri)).collect())) for t in (G.triples(rows), G.triples_by_predicate(rows, iri)))
    assert some == every and bool(every) == (not iri.endswith("nobody"))
    assert G.triples_by_predicate(rows, X.BASE + "subjects/b").where("s is not null and o is not null").count() < G.triples(rows).where("s is not null and o is not null").count()


def test_page_of_subjects_is_found_without_ids(spark):
    """F8: links' ids are not dealt out with the rows that are joined with the terms."""
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(QUERIES["get_subjects_graph"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert "sha2" in plan and "LeftSemi" in plan and "sha2" not in plan.split("LeftSemi", 1)[1]
