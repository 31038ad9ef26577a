"""Column builders: qualifiers, content hashes, term ids and IRIs.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of the public OBO ontologies and of our own IRIs.
OBO = "http://purl.obolibrary.org/obo/"
BASE = "http://example.org/pheno/"
QUALIFIER = BASE + "qualifier/"
EXCLUDED = ("negated", "hypothetical", "family")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def is_active(value: Column) -> Column:
    """A qualifier counts unless its value is false or 0."""
    return ~F.lower(value).isin("false", "0")


def split_qualifier(s: Column) -> Column:
    """(qualifier_type, qualifier_value) of ``type:value``; in an IRI the first colon after the last slash separates; no value means true."""
    pattern = r"^(https?://.*/[^/:]*|[^:]*):(.*)$"
    bare = ~s.rlike(pattern) | (s.startswith("http") & (F.regexp_extract(s, pattern, 1).isin("http", "https")))
    return F.struct(
        F.when(bare, s).otherwise(F.regexp_extract(s, pattern, 1)).alias("qualifier_type"),
        F.when(bare, F.lit("true")).otherwise(F.regexp_extract(s, pattern, 2)).alias("qualifier_value"),
    )


def short_type(t: Column) -> Column:
    """Our own qualifier IRIs by their short name, others unchanged."""
    return F.when(t.startswith(QUALIFIER), F.substring(t, len(QUALIFIER) + 1, 1 << 20)).otherwise(t)


def normalize_qualifiers(quals: Column) -> Column:
    """Sorted ``type:value`` strings of the active qualifiers in an array of structs; null counts as empty."""
    quals = F.coalesce(quals, F.expr("cast(array() as array<struct<qualifier_type:string,qualifier_value:string>>)"))
    active = F.filter(quals, lambda q: is_active(q["qualifier_value"]))
    return F.array_sort(F.transform(active, lambda q: F.concat(short_type(q["qualifier_type"]), F.lit(":"), q["qualifier_value"])))


def termlink_hash(subject_iri: Column, term_iri: Column, normalized: Column) -> Column:
    return F.sha2(F.concat(subject_iri, F.lit("|"), term_iri, F.lit("|"), F.array_join(normalized, ",")), 256)


def evidence_hash(note: Column, encounter: Column, term: Column, start: Column, end: Column, normalized: Column, subject: Column, creator: Column) -> Column:
    parts = [text(c) for c in (note, encounter, term, start, end)]
    return F.sha2(F.concat_ws("|", *parts, F.array_join(normalized, "|"), text(subject), text(creator)), 256)


def context_qualifiers(contexts: Column, names: tuple[str, ...] = EXCLUDED) -> Column:
    """Always one struct for each name; 1 means true, null and 0 false, another value stays as it is."""

    def value(name: str) -> Column:
        v = F.lower(F.trim(contexts[name].cast("string")))
        return F.when(v.isNull() | v.isin("0", "0.0", "false"), "false").when(v.isin("1", "1.0", "true"), "true").otherwise(v)

    return F.array(*[F.struct(F.lit(n).alias("qualifier_type"), value(n).alias("qualifier_value")) for n in names])


def term_id(iri: Column) -> Column:
    """HP:0001250 of an OBO IRI, else the last segment of the path."""
    return F.when(F.contains(iri, F.lit("/obo/")), F.replace(F.substring_index(iri, "/obo/", -1), F.lit("_"), F.lit(":"))).otherwise(F.substring_index(iri, "/", -1))


def term_iri(tid: Column) -> Column:
    return F.concat(F.lit(OBO), F.replace(tid, F.lit(":"), F.lit("_")))


def compact_iri(iri: Column) -> Column:
    return F.when(iri.startswith(OBO), F.replace(F.substring(iri, len(OBO) + 1, 1 << 20), F.lit("_"), F.lit(":"))).otherwise(iri)


def curie_to_iri(curie: Column, namespaces: Column) -> Column:
    """By the first namespace (map of prefix to IRI prefix) that fits, else unchanged."""
    fits = F.filter(F.map_entries(namespaces), lambda e: curie.startswith(F.concat(e["key"], F.lit(":"))))
    return F.when(F.size(fits) > 0, F.concat(fits[0]["value"], F.substring_index(curie, ":", -1))).otherwise(curie)


def subject_iri(subject: Column) -> Column:
    return F.concat(F.lit(BASE + "subjects/"), subject)


def project_iri(project: Column) -> Column:
    return F.concat(F.lit(BASE + "projects/"), project)


def project_subject_iri(project: Column, psid: Column) -> Column:
    return F.concat(project_iri(project), F.lit("/"), psid)


def term_source(tid: Column) -> Column:
    return F.when(tid.startswith("HP:"), "hpo").when(tid.startswith("MONDO:"), "mondo")


def eco_types(creator_type: Column) -> tuple[Column, Column]:
    """Assertion and evidence type IRIs (fixed values of the public Evidence and Conclusion Ontology); another type is an error."""
    bad = F.raise_error(F.concat(F.lit("unknown creator_type: "), F.coalesce(creator_type, F.lit("null"))))
    assertion = F.when(creator_type == "automated", OBO + "ECO_0000203").when(creator_type == "manual", OBO + "ECO_0000218").otherwise(bad.cast("string"))
    evidence = F.when(creator_type == "automated", OBO + "ECO_0006162").when(creator_type == "manual", OBO + "ECO_0006161").otherwise(bad.cast("string"))
    return assertion, evidence


def iso_timestamp(s: Column) -> Column:
    """Null where it cannot be read."""
    return F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00"))


def ttl_escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def camel_to_snake(s: Column) -> Column:
    """An underscore where a word of camel case begins: before a capital behind a small letter or digit, and before the last capital of a run that small letters follow."""
    return F.lower(F.regexp_replace(s, "(?<=[a-z0-9])(?=[A-Z])|(?<=.)(?=[A-Z][a-z])", "_"))


def split_predicate(iri: Column) -> Column:
    """The local name of a predicate (behind the last # or /) in snake case."""
    return camel_to_snake(F.regexp_extract(iri, "[^#/]*$", 0))


def qualifier_structs(strings: Column) -> Column:
    """Structs of an array of ``type:value`` strings."""
    return F.transform(F.coalesce(strings, F.expr("cast(array() as array<string>)")), split_qualifier)


def qualifier_map(quals: Column) -> Column:
    """A map of type to value; of a type that comes twice the last value counts."""
    return F.aggregate(quals, F.expr("cast(map() as map<string,string>)"), lambda acc, q: F.map_concat(F.map_filter(acc, lambda k, v: k != q["qualifier_type"]), F.create_map(q["qualifier_type"], q["qualifier_value"])))


def qualifiers_of_map(values: Column) -> Column:
    """Structs of a map of type to value, sorted by type."""
    return F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct(e["key"].alias("qualifier_type"), e["value"].alias("qualifier_value"))))


def active_qualifiers(quals: Column) -> Column:
    """The active qualifiers with short types, sorted as their strings are."""
    return qualifier_structs(normalize_qualifiers(quals))


def qualifiers_to_strings(quals: Column) -> Column:
    """``type:value`` of every qualifier, in the order given."""
    return F.transform(quals, lambda q: F.concat_ws(":", q["qualifier_type"], q["qualifier_value"]))


def excluding(quals: Column) -> Column:
    """Whether an active qualifier excludes the finding, its type being a short name or one of our IRIs."""
    types = [*EXCLUDED, *[QUALIFIER + n for n in EXCLUDED]]
    return F.exists(F.coalesce(quals, F.expr("cast(array() as array<struct<qualifier_type:string,qualifier_value:string>>)")), lambda q: is_active(q["qualifier_value"]) & q["qualifier_type"].isin(types))


def url_quote(s: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
