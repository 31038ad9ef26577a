"""Qualifiers, hashes and IRIs on literal rows; digests worked out with hashlib."""

import hashlib

from pyspark.sql import functions as F

from cohortmill.functions import exprs as X


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()[0]


def test_split_qualifier(spark):
    cases = {
        "negated": ("negated", "true"), "severity:mild:moderate": ("severity", "mild:moderate"), X.OBO + "HP_0012823": (X.OBO + "HP_0012823", "true"),
        X.OBO + "HP_0003593:present": (X.OBO + "HP_0003593", "present"),
    }
    for s, want in cases.items():
        assert tuple(one(spark, X.split_qualifier(F.lit(s)))) == want


def test_normalize_and_hash(spark):
    quals = F.array(*[F.struct(F.lit(t).alias("qualifier_type"), F.lit(v).alias("qualifier_value")) for t, v in (("negated", "true"), ("family", "1"), ("hypothetical", "0"), (X.QUALIFIER + "extra", "yes"))])
    normal = X.normalize_qualifiers(quals)
    assert one(spark, normal) == ["extra:yes", "family:1", "negated:true"]
    assert one(spark, X.termlink_hash(F.lit("s"), F.lit("t"), normal)) == hashlib.sha256(b"s|t|extra:yes,family:1,negated:true").hexdigest()
    none = F.expr("cast(array() as array<string>)")
    got = X.evidence_hash(F.lit(None).cast("string"), F.lit("e"), F.lit("t"), F.lit(1), F.lit(None).cast("int"), none, F.lit("s"), F.lit("c"))
    assert one(spark, got) == hashlib.sha256(b"|e|t|1|||s|c").hexdigest()


def test_term_ids(spark):
    for iri, want in ((X.OBO + "HP_0001250", "HP:0001250"), (X.OBO + "HP_0001_2", "HP:0001:2"), ("http://x/y/z", "z")):
        assert one(spark, X.term_id(F.lit(iri))) == want


def test_contexts(spark):
    c = F.struct(F.lit(1.0).alias("negated"), F.lit(None).cast("double").alias("family"), F.lit(0.7).alias("hypothetical"))
    assert [tuple(q) for q in one(spark, X.context_qualifiers(c))] == [("negated", "true"), ("hypothetical", "0.7"), ("family", "false")]


def test_strings(spark):
    assert one(spark, X.camel_to_snake(F.lit("hasTermLink"))) == "has_term_link"
    assert one(spark, X.url_quote(F.lit("a b*~/é"))) == "a%20b%2A~%2F%C3%A9"
    assert one(spark, X.iso_timestamp(F.lit("nonsense"))) is None


#: Expected digests of evidence, fixed values: (note, encounter, start, end, qualifiers, subject, creator) and the digest.
EVIDENCE = [
    ((None, None, None, None, [], None, None), "2e74cb28084f4a53eb464cfad495186e6cd579ac44ac52e232278a767082f74c"),
    (("note-123", "enc-456", 10, 20, ["negated:true"], "test-subj-001", "test-creator"), "4ca5d4043b23c149bf43107d70b89130522be7116af826eed63042d8daba6fa2"),
]


def test_evidence_digests(spark):
    for (note, enc, start, end, quals, subject, creator), want in EVIDENCE:
        text = lambda v: F.lit(v).cast("string")
        normal = X.normalize_qualifiers(X.qualifier_structs(F.array(*map(F.lit, quals)).cast("array<string>")))
        assert one(spark, X.evidence_hash(text(note), text(enc), F.lit(X.OBO + "HP_0001250"), F.lit(start).cast("int"), F.lit(end).cast("int"), normal, text(subject), text(creator))) == want


def test_iri_qualifiers(spark):
    quals = X.qualifier_structs(F.array(F.lit(X.OBO + "HP_0012823:present"), F.lit("negated"), F.lit("family:0"), F.lit(X.QUALIFIER + "hypothetical:true"), F.lit("note:a,b")))
    assert one(spark, X.normalize_qualifiers(quals)) == [X.OBO + "HP_0012823:present", "hypothetical:true", "negated:true", "note:a,b"]
    assert one(spark, X.qualifiers_to_strings(quals))[2] == "family:0"
    assert one(spark, X.qualifiers_of_map(X.qualifier_map(quals)))[0].qualifier_type == "family"
    for text, want in (("negated", True), ("family:0", False), (X.QUALIFIER + "family:1", True), ("severity:mild", False)):
        assert one(spark, X.excluding(X.qualifier_structs(F.array(F.lit(text))))) is want


def test_names(spark):
    for name, want in (("hasTermLink", "has_term_link"), ("HTTPServer", "http_server"), ("a2B", "a2_b"), ("", ""), ("already_snake", "already_snake")):
        assert one(spark, X.camel_to_snake(F.lit(name))) == want
    assert one(spark, X.split_predicate(F.lit("http://x/y#hasProjectSubjectId"))) == "has_project_subject_id"
    assert one(spark, X.split_predicate(F.lit("http://x/createdBy"))) == "created_by"
