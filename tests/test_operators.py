import pytest

from cohortmill.operators import cohort as C
from cohortmill.operators import ontology as O
from cohortmill.operators import validate as V

OBO = """format-version: 1.2

[Term]
id: HP:1
name: root

[Term]
id: HP:2
name: left
is_a: HP:1 {source="x"} ! root
is_a: MONDO:9 ! other

[Term]
id: HP:3
name: right
is_a: HP:1

[Term]
id: HP:4
name: both
is_a: HP:2
is_a: HP:3

[Term]
id: HP:5
is_a: HP:1

[Typedef]
id: HP:6
name: no term
"""


def test_obo_and_depth():
    terms = {t["term_id"]: t["parent_ids"] for t in O.parse_obo(OBO, "HP")}
    assert terms == {"HP:1": [], "HP:2": ["HP:1"], "HP:3": ["HP:1"], "HP:4": ["HP:2", "HP:3"]}
    assert O.depths(terms) == {"HP:1": 0, "HP:2": 1, "HP:3": 1, "HP:4": 2}


def test_depth_is_fixed_when_a_term_is_taken():
    assert O.depths({"R": [], "P": ["R", "Q"], "Q": ["C"], "C": ["R"], "K": ["P"]}) == {"R": 0, "C": 1, "Q": 2, "P": 3, "K": 2}
    assert O.depths({"A": ["gone"]}) == {"A": 0}


def test_closure(spark):
    edges = spark.createDataFrame([("1", None), ("2", "1"), ("3", "1"), ("4", "2"), ("4", "3"), ("5", "4")], "term_id string, parent_id string")
    got = {(r.term_id, r.ancestor_id) for r in O.closure(edges).collect()}
    assert {a for t, a in got if t == "5"} == {"1", "2", "3", "4", "5"}
    assert {t for t, a in got if a == "1"} == {"1", "2", "3", "4", "5"}


def test_guards():
    with pytest.raises(ValueError):
        C.check(C.CohortRequest("p", ["HP:0000118"]))
    assert not C.check(C.CohortRequest("p", associated_with="gene")).include_child_terms
    for bad in (C.CohortRequest(""), C.CohortRequest("p", ["HP:7"], associated_with="gene"), C.CohortRequest("p", limit=0), C.CohortRequest("p", cursor="x")):
        with pytest.raises(ValueError):
            C.check(bad)


LINKS = [("a", "x", "ax"), ("a", "y", "ay"), ("b", "x", "bx"), ("c", "x", "cx")]


@pytest.mark.parametrize(
    "rolled, want",
    [
        (LINKS, (4, 3, 0, 0, "")),
        # a's row stands at b: all totals are right
        ([("b", "y", "ay") if k == ("a", "y", "ay") else k for k in LINKS], (4, 3, 0, 2, "Verification failed! 2 subjects have mismatched term counts")),
        ([("c", "x", None) if k[0] == "c" else k for k in LINKS], (4, 3, 1, 0, "Found 1 records with NULL critical fields!")),
        ([("a", "z", "az") if k[0] == "c" else k for k in LINKS], (4, 2, 0, 2, "Subject count mismatch! Expected: 3, Got: 2; Verification failed! 2 subjects have mismatched term counts")),
        ([*LINKS, (None, "x", "nx")], (5, 3, 1, 0, "Term count mismatch! Expected: 4, Got: 5; Found 1 records with NULL critical fields!")),
        ([], (0, 0, 0, 3, "Term count mismatch! Expected: 4, Got: 0; Subject count mismatch! Expected: 3, Got: 0; Verification failed! 3 subjects have mismatched term counts")),
    ],
)
def test_materialization_compares_every_subject(spark, rolled, want):
    """subjects, null keys and each subject's termlinks are checked, not totals alone."""
    keys = "subject_id string, term_iri string, termlink_id string"
    evidence = spark.createDataFrame([*LINKS, LINKS[0]], keys)
    mapping = spark.createDataFrame([("p", "a"), ("q", "a"), ("p", "b"), ("p", "nobody")], "project_id string, subject_id string")
    by_subject = spark.createDataFrame([(*k, 2 if k == LINKS[0] else 1) for k in rolled], keys + ", evidence_count long")
    r = V.materialization(evidence, mapping, by_subject, spark.range(5)).first()
    assert (r["rows"], r["subjects"], r["null_keys"], r["mismatched_subjects"], r["errors"]) == want
    assert r["valid"] == (not r["errors"]) and (r["want_rows"], r["want_evidence"], r["want_subjects"], r["want_project_rows"], r["project_rows"]) == (4, 5, 3, 5, 5)


def test_materialization_of_nothing_and_of_null_keys(spark):
    """Evidence without a key makes a row that no baseline counts; by project, 4 rows are wanted and 3 there."""
    keys = "subject_id string, term_iri string, termlink_id string"
    rows = [("a", "x", "ax"), ("a", None, None), (None, "x", None)]
    mapping = spark.createDataFrame([("p", "a"), ("q", "a")], "project_id string, subject_id string")
    evidence, by_subject = spark.createDataFrame(rows, keys), spark.createDataFrame([(*k, 1) for k in rows], keys + ", evidence_count long")
    r = V.materialization(evidence, mapping, by_subject, spark.range(3)).first()
    assert tuple(r)[:10] == (1, 3, 3, 3, 4, 3, 1, 1, 2, 1) and not r["valid"]
    assert "Project row count mismatch! Expected: 4, Got: 3" in r["errors"]
    assert tuple(V.materialization(evidence.limit(0), mapping, by_subject.limit(0), spark.range(0)).first()) == (*[0] * 10, "", True)
