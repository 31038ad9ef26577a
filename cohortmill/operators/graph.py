"""Triples of the rollups, patterns over them, and Turtle lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


SUBJECTS = X.BASE + "subjects"


def link_iri(subject_id: Column, termlink_id: Column) -> Column:
    return F.concat(X.subject_iri(subject_id), F.lit("/term-link/"), termlink_id)


def qualifier_iri(q: Column) -> Column:
    """The IRI of a qualifier's type: an IRI as it is, a short name below our own."""
    t = q["qualifier_type"]
    return F.when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit(X.QUALIFIER), t))


def triples(rollup: DataFrame, unique: bool = False) -> DataFrame:
    """(s, p, o) of every termlink of a by-subject rollup: subject, term, and its active qualifiers.

    A rollup that is ``unique`` by subject, term and qualifiers, as the stored one is, has no triple
    twice but those of rows without a subject or a term, and is not shuffled.
    """
    if unique:
        whole = F.col("subject_id").isNotNull() & F.col("term_iri").isNotNull()
        return _exploded(rollup.where(whole)).union(_exploded(rollup.where(~whole)).distinct())
    return _exploded(rollup).distinct()


def _exploded(rollup: DataFrame) -> DataFrame:
    subject, link = X.subject_iri(F.col("subject_id")), link_iri(F.col("subject_id"), F.col("termlink_id"))
    quals = F.transform(X.active_qualifiers(F.col("qualifiers")), lambda q: F.struct(link.alias("s"), F.lit("hasQualifyingTerm").alias("p"), qualifier_iri(q).alias("o")))
    fixed = F.array(
        F.struct(subject.alias("s"), F.lit("hasTermLink").alias("p"), link.alias("o")),
        F.struct(link.alias("s"), F.lit("hasTerm").alias("p"), F.col("term_iri").alias("o")),
    )
    return rollup.select(F.explode(F.concat(fixed, F.array_distinct(quals))).alias("t")).select("t.*")


def triples_by_predicate(rollup: DataFrame, naming: str | None = None) -> DataFrame:
    """The same triples of a rollup with one row a termlink, predicate by predicate: a filter on p leaves one scan, and nothing is shuffled.

    With ``naming``, an IRI, at least those that name it, and all of its subject if it is one or a
    subject's link: rows that can't are left out before their ids are worked out.
    """
    named = F.col("subject_id").isNotNull() & F.col("term_iri").isNotNull()
    whole = rollup.where(named)
    subject, link = X.subject_iri(F.col("subject_id")), link_iri(F.col("subject_id"), F.col("termlink_id"))
    types = F.array_distinct(F.transform(X.active_qualifiers(F.col("qualifiers")), qualifier_iri))

    def of(p: str, s: Column, o: Column, has: Column = F.lit(False)) -> DataFrame:
        rows = whole if naming is None else whole.where(F.startswith(F.lit(naming), subject) | has)
        return rows.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))

    out = of("hasTermLink", subject, link).union(of("hasTerm", link, F.col("term_iri"), F.col("term_iri") == naming))
    # an IRI ends with its qualifier's type; a type with a colon may be cut there, and is left to the caller's filter
    kin = F.exists("qualifiers", lambda q: F.endswith(F.lit(naming), q["qualifier_type"]) | F.contains(q["qualifier_type"], F.lit(":")))
    out = out.union(of("hasQualifyingTerm", link, F.explode(types), kin))
    # without a subject or a term a link has no name, and its triples are alike
    return out.union(triples(rollup.where(~named)))


def project_triples(mapping: DataFrame) -> DataFrame:
    project, psid = X.project_iri(F.col("project_id")), X.project_subject_iri(F.col("project_id"), F.col("project_subject_id"))
    rows = F.array(
        F.struct(project.alias("s"), F.lit("a").alias("p"), F.lit("Project").alias("o")),
        F.struct(X.subject_iri(F.col("subject_id")).alias("s"), F.lit("hasProjectSubjectId").alias("p"), psid.alias("o")),
        F.struct(psid.alias("s"), F.lit("hasProject").alias("p"), project.alias("o")),
    )
    return mapping.select(F.explode(rows).alias("t")).select("t.*").distinct()


def turtle(t: DataFrame) -> DataFrame:
    return t.select(F.concat(F.lit("<"), "s", F.lit("> ex:"), "p", F.lit(" <"), "o", F.lit("> .")).alias("line"))


def pattern(t: DataFrame, p: str, s: str, o: str) -> DataFrame:
    """The pairs that one triple pattern binds, under the names of its variables."""
    return t.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def links(t: DataFrame) -> DataFrame:
    """subject, link, term and, where there is one, the qualifier."""
    found = pattern(t, "hasTermLink", "subject", "link").join(pattern(t, "hasTerm", "link", "term"), "link")
    return found.join(pattern(t, "hasQualifyingTerm", "link", "qualifier"), "link", "left").select("subject", "link", "term", "qualifier")


def links_of(rollup: DataFrame) -> DataFrame:
    """What ``links`` finds in the triples of a rollup with one row a termlink: the three patterns meet in its rows, so nothing is joined."""
    types = F.array_distinct(F.transform(X.active_qualifiers(F.col("qualifiers")), qualifier_iri))
    whole = rollup.where(F.col("subject_id").isNotNull() & F.col("term_iri").isNotNull())
    return whole.select(X.subject_iri(F.col("subject_id")).alias("subject"), link_iri(F.col("subject_id"), F.col("termlink_id")).alias("link"), F.col("term_iri").alias("term"), F.explode_outer(types).alias("qualifier"))


def baseline(rollup: DataFrame) -> DataFrame:
    """Subjects and termlinks of the graph of a rollup with one row a termlink."""
    return rollup.agg(F.count_distinct("subject_id").alias("subjects"), F.count_if(F.col("subject_id").isNotNull() & F.col("term_iri").isNotNull()).alias("termlinks"))


def without_qualifier(t: DataFrame) -> DataFrame:
    """Links that have no qualifier at all."""
    return pattern(t, "hasTerm", "link", "term").join(pattern(t, "hasQualifyingTerm", "link", "q"), "link", "left_anti")


def encounter_triples(evidence: DataFrame) -> DataFrame:
    """The encounters and notes of evidence and what they belong to."""
    subject = X.subject_iri(F.col("subject_id"))
    encounter, note = F.concat(subject, F.lit("/encounter/"), F.col("encounter_id")), F.concat(subject, F.lit("/note/"), F.col("clinical_note_id"))

    def one(s: Column, p: str, o: Column) -> Column:
        return F.when(s.isNotNull() & o.isNotNull(), F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")))

    rows = F.array(one(encounter, "a", F.lit("Encounter")), one(encounter, "hasSubject", subject), one(note, "a", F.lit("ClinicalNote")), one(note, "hasEncounter", encounter))
    return evidence.select(F.explode(F.filter(rows, lambda t: t.isNotNull())).alias("t")).select("t.*").distinct()


def node_exists(t: DataFrame, iri: str) -> bool:
    return not t.where((F.col("s") == iri) | (F.col("o") == iri)).limit(1).isEmpty()


def triple_exists(t: DataFrame, s: str, p: str, o: str) -> bool:
    return not t.where((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)).limit(1).isEmpty()


def typed(t: DataFrame, kind: str, iris: DataFrame) -> DataFrame:
    """The ``iris`` (column iri) that are nodes of a type, such as encounters or notes."""
    return iris.select("iri").distinct().join(pattern(t, "a", "iri", "kind").where(F.col("kind") == kind), "iri", "left_semi")


def dump(t: DataFrame, limit: int) -> DataFrame:
    return t.orderBy("s", "p", "o").limit(limit)


def properties(t: DataFrame, iri: str) -> dict[str, str]:
    """The predicates of a node in snake case with their objects."""
    rows = t.where(F.col("s") == iri).select(X.split_predicate(F.col("p")).alias("k"), "o").orderBy("k", "o").collect()
    return flatten_response([{r["k"]: r["o"]} for r in rows])


def flatten_response(parts: list[dict]) -> dict:
    """One dict of several; a key that comes with two values is an error."""
    out: dict = {}
    for part in parts:
        for k, v in part.items():
            if k in out and out[k] != v:
                raise ValueError(f"two values for {k}")
            out[k] = v
    return out


def flatten_results(rows: DataFrame, group: str | None = None) -> DataFrame:
    """Bindings of a result in JSON (column value) as rows of name and value; one map for each value of the variable ``group`` if given."""
    kind = "struct<results:struct<bindings:array<map<string,struct<type:string,value:string,datatype:string>>>>>"
    each = rows.select(F.explode(F.from_json("value", kind)["results"]["bindings"]).alias("b")).select(F.transform_values("b", lambda k, v: v["value"]).alias("b"))
    if group is None:
        return each
    return each.groupBy(F.col("b")[group].alias(group)).agg(F.array_sort(F.collect_list(F.array_sort(F.map_entries("b")))).alias("rows"))


def without_nodes(t: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples that name none of the ``nodes`` (column node) as subject or object."""
    nodes = nodes.select("node").distinct()
    return t.join(nodes, F.col("s") == F.col("node"), "left_anti").join(nodes, F.col("o") == F.col("node"), "left_anti")


def create_term_link(t: DataFrame, subject_id: str, term_iri: str, qualifiers: list[str] | None = None) -> tuple[DataFrame, str, bool]:
    """(triples to add, IRI of the link, whether it is new): none if the link is there; inactive qualifiers do not count."""
    spark = t.sparkSession
    one = spark.createDataFrame([(subject_id, term_iri, qualifiers or [])], "subject_id string, term_iri string, q array<string>").withColumn("qualifiers", X.qualifier_structs(F.col("q")))
    normal = X.normalize_qualifiers(F.col("qualifiers"))
    one = one.withColumn("termlink_id", X.termlink_hash(X.subject_iri(F.col("subject_id")), F.col("term_iri"), normal))
    iri = one.select(link_iri(F.col("subject_id"), F.col("termlink_id")).alias("i")).first()["i"]
    new = triples(one)
    there = t.select("s", "p", "o").join(F.broadcast(new), ["s", "p", "o"], "left_semi")  # a link's few triples
    return new.join(there, ["s", "p", "o"], "left_anti"), iri, not node_exists(t, iri)


def get_term_link(t: DataFrame, iri: str, evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of a link: subject, term, label, sorted qualifiers and its number of evidence."""
    mine = t.where(F.col("s") == iri).agg(F.max(F.when(F.col("p") == "hasTerm", F.col("o"))).alias("term_iri"), F.array_sort(F.collect_set(F.when(F.col("p") == "hasQualifyingTerm", F.col("o")))).alias("qualifiers"))
    subject, link = iri.split("/term-link/")
    n = evidence.where((F.col("subject_id") == subject.rsplit("/", 1)[1]) & (F.col("termlink_id") == link)).agg(F.count("*").alias("evidence_count"))
    return mine.where("term_iri is not null").join(n, F.lit(True)).join(labels, "term_iri", "left").select(F.lit(subject).alias("subject"), F.lit(iri).alias("link"), "term_iri", "term_label", "qualifiers", "evidence_count")


def delete_term_link(t: DataFrame, iri: str) -> DataFrame:
    return t.where((F.col("s") != iri) & (F.col("o") != iri))


def subjects_of_terms(t: DataFrame, terms: DataFrame, exclude: tuple[str, ...] = X.EXCLUDED, psids: DataFrame | None = None, cursor: str | None = None, limit: int = 100) -> DataFrame:
    """subject, link and term of one page of subjects, in the order of their IRIs, that have a link to one of the ``terms`` (column term).

    Links with an excluding qualifier do not count.  The page holds ``limit`` subjects behind the
    ``cursor`` (the IRI of the last subject of the page before).
    """
    found = pattern(t, "hasTermLink", "subject", "link").join(pattern(t, "hasTerm", "link", "term"), "link").join(terms.select("term").distinct(), "term", "left_semi")
    if exclude:
        bad = pattern(t, "hasQualifyingTerm", "link", "q").where(F.col("q").isin([X.QUALIFIER + e for e in exclude]))
        found = found.join(bad, "link", "left_anti")
    if psids is not None:
        found = found.join(psids.select("subject").distinct(), "subject", "left_semi")
    if cursor:
        found = found.where(F.col("subject") > cursor)
    first = found.select("subject").distinct().orderBy("subject").limit(limit)
    return found.join(F.broadcast(first), "subject").select("subject", "link", "term")  # a page of subjects


def subjects_in_rollup(rollup: DataFrame, terms: DataFrame, exclude: tuple[str, ...] = X.EXCLUDED, cursor: str | None = None, limit: int = 100) -> DataFrame:
    """``subjects_of_terms`` of the triples of a rollup with one row a termlink.

    Subjects and terms alone are joined to find the page, and only the page's rows, which are few,
    are joined with their links: an inner join, as a semi join would be moved below the page's.
    """
    types = F.transform(X.active_qualifiers(F.col("qualifiers")), qualifier_iri)
    rows = rollup.where(F.col("subject_id").isNotNull() & ~F.arrays_overlap(types, F.array(*[F.lit(X.QUALIFIER + e) for e in exclude]).cast("array<string>")))
    rows = rows.withColumn("subject", X.subject_iri(F.col("subject_id")))
    if cursor:
        rows = rows.where(F.col("subject") > cursor)
    wanted = terms.select(F.col("term").alias("term_iri")).distinct()
    first = rows.select("subject", "term_iri").join(wanted, "term_iri", "left_semi").select("subject").distinct().orderBy("subject").limit(limit)
    found = rows.join(F.broadcast(first), "subject").join(wanted, "term_iri")  # a page of subjects
    return found.select("subject", link_iri(F.col("subject_id"), F.col("termlink_id")).alias("link"), F.col("term_iri").alias("term"))


def path(t: DataFrame, closure: DataFrame, term_iri: str) -> DataFrame:
    """Links to a term or to what is below it, any number of steps: a join with the closure (term_id, ancestor_id)."""
    below = closure.where(X.term_iri(F.col("ancestor_id")) == term_iri).select(X.term_iri(F.col("term_id")).alias("term"))
    return pattern(t, "hasTerm", "link", "term").join(below, "term", "left_semi").select("link", "term")


def readable(t: DataFrame, text: str, graphs: tuple[str, ...] = ()) -> DataFrame:
    """The triples that a read-only query may see.

    ``text`` is a query: one that would change anything, or that names a project's graph, is an
    error.  Of ``graphs`` (all but the projects' if empty) only the named ones are seen.
    """
    bare = re.sub(r"#[^\n]*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", " ", re.sub(r"<[^<>\s]*>", lambda m: m[0].replace("#", "%23"), text))
    if re.search(r"\b(insert|delete|load|clear|create|drop|copy|move|add|service|with)\b", re.sub(r"<[^<>\s]*>", " ", bare), re.I):
        raise ValueError("only queries that read are allowed")
    if not re.search(r"\b(select|ask|construct|describe)\b", bare, re.I):
        raise ValueError("not a query")
    if "/projects/" in text or any("/projects/" in g for g in graphs):
        raise ValueError("the graphs of projects cannot be read")
    rows = t.where(~F.contains("graph", F.lit("/projects/")))
    return rows.where(F.col("graph").isin(list(graphs))) if graphs else rows


def load_status(statuses: DataFrame) -> DataFrame:
    """One row of the states (column status) of several loads: how many of each kind, and whether all are done or any failed."""
    done, bad = F.count_if(F.col("status") == "LOAD_COMPLETED"), F.count_if(F.col("status").rlike("FAILED|CANCELLED|ERROR"))
    return statuses.agg(F.count("*").alias("total"), done.alias("completed"), bad.alias("failed"), (F.count("*") - done - bad).alias("running")).withColumn("status", F.when(F.col("failed") > 0, "FAILED").when(F.col("completed") == F.col("total"), "COMPLETED").otherwise("IN_PROGRESS"))


def parse_turtle(lines: DataFrame) -> DataFrame:
    """(s, p, o) of the lines (column line) that ``turtle`` writes."""
    m = r"^<([^>]*)> ex:(\S+) <([^>]*)> \.$"
    return lines.where(F.col("line").rlike(m)).select(*[F.regexp_extract("line", m, i).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"))])
