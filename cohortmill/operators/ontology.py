"""Ontology hierarchies: OBO text, closure, depth and expansion of terms."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..storage import Store, release, save

#: The ontologies by the prefix of their terms.
PREFIXES = {"HP": "hpo", "MONDO": "mondo"}


def parse_obo(text: str, prefix: str) -> list[dict]:
    """Terms of one ontology's OBO text: stanzas [Term] with an id and a name; parents of other ontologies are left out."""
    out = []
    for stanza in re.split(r"\n(?=\[)", "\n" + text):
        lines = stanza.strip().splitlines()
        if not lines or lines[0].strip() != "[Term]":
            continue
        term: dict = {"term_id": None, "term_label": None, "parent_ids": []}
        for line in lines[1:]:
            key, _, value = line.partition(":")
            value = value.strip()
            if key == "id":
                term["term_id"] = value
            elif key == "name":
                term["term_label"] = value
            elif key == "is_a":
                parent = re.sub(r"\{.*?\}", "", value.split("!")[0]).strip()
                if parent.startswith(prefix + ":"):
                    term["parent_ids"].append(parent)
        if term["term_id"] and term["term_label"] and term["term_id"].startswith(prefix + ":"):
            out.append(term)
    return out


def depths(parents: dict[str, list[str]]) -> dict[str, int]:
    """Breadth-first depth from the roots: a term's depth is raised while it waits, and fixed once it is taken.

    Parents without a stanza do not count, so a term that has no other one is a root.
    """
    children: dict[str, list[str]] = {t: [] for t in parents}
    for t, ps in parents.items():
        for p in ps:
            if p in children:
                children[p].append(t)
    depth = {t: 0 for t, ps in parents.items() if not any(p in parents for p in ps)}
    queue, taken = deque(depth), set()
    while queue:
        t = queue.popleft()
        if t in taken:
            continue
        taken.add(t)
        for c in children[t]:
            depth[c] = max(depth.get(c, 0), depth[t] + 1)
            queue.append(c)
    return depth


def closure(edges: DataFrame) -> DataFrame:
    """(term_id, ancestor_id) with every term its own ancestor, from (term_id, parent_id).

    Each round takes the pairs that the last one found a step up, and keeps those that no round had:
    a pair is written once and joined once, and a circle of parents comes to an end.  Rounds are as
    many as the longest way up.
    """
    spark = edges.sparkSession
    up = save(edges.where("parent_id is not null").select("term_id", F.col("parent_id").alias("ancestor_id")).distinct(), "parents")
    step = up.select(F.col("term_id").alias("__t"), F.col("ancestor_id").alias("__a"))
    nodes = edges.select("term_id").union(up.select("ancestor_id")).distinct()
    pairs = new = save(nodes.select("term_id", F.col("term_id").alias("ancestor_id")), "closure")
    while not new.isEmpty():
        found = new.join(step, F.col("ancestor_id") == F.col("__t")).select("term_id", F.col("__a").alias("ancestor_id")).distinct()
        new = save(found.join(pairs, ["term_id", "ancestor_id"], "left_anti"), "closure")
        pairs = pairs.union(new)
        del found
        release(spark)
    return pairs


def hierarchy(terms: DataFrame, source: str, version: str) -> DataFrame:
    """The rows of one ontology's version, from (term_id, term_label, parent_ids): ancestors with the term itself, ordered by depth and id.

    Depths need the order of a walk from the roots, so one task works them out; an ontology has some
    ten thousand terms, and several ontologies are several tasks.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        found = depths({t: list(p) if p is not None else [] for t, p in zip(rows["term_id"], rows["parent_ids"], strict=True)})
        return pd.DataFrame({"term_id": list(found), "depth": list(found.values())})

    depth = save(terms.withColumn("o", F.lit(1)).groupBy("o").applyInPandas(walk, "term_id string, depth int"), "depths")
    clo = closure(terms.select("term_id", F.explode_outer("parent_ids").alias("parent_id")))
    above = clo.join(depth.select(F.col("term_id").alias("__t"), F.col("depth").alias("d")), F.col("ancestor_id") == F.col("__t"), "left")
    listed = above.groupBy("term_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("d", F.lit(999)).alias("d"), "ancestor_id"))), lambda x: x["ancestor_id"]).alias("ancestor_term_ids"))
    out = terms.select("term_id", "term_label").join(listed, "term_id").join(depth, "term_id", "left")
    return out.select(F.lit(source).alias("ontology_source"), F.lit(version).alias("version"), "term_id", X.term_iri(F.col("term_id")).alias("term_iri"), "term_label", "ancestor_term_ids", F.coalesce("depth", F.lit(0)).alias("depth"), F.current_timestamp().alias("last_updated"))


def obo_terms(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(term_id, term_label, parent_ids) of the OBO files below a path; each file is parsed by one task."""
    files = spark.read.text(path, wholetext=True)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                yield pd.DataFrame(parse_obo(text, prefix), columns=["term_id", "term_label", "parent_ids"])

    return files.mapInPandas(parse, "term_id string, term_label string, parent_ids array<string>")


def load(store: Store, rows: DataFrame) -> None:
    """Replace the versions that ``rows`` hold in the stored hierarchy."""
    new = rows.select("ontology_source", "version").distinct()
    old = store.read("ontology_hierarchy").join(F.broadcast(new), ["ontology_source", "version"], "left_anti")  # one row an ontology's version
    store.replace("ontology_hierarchy", old.unionByName(rows))


def delete_version(store: Store, source: str, version: str) -> int:
    return store.delete("ontology_hierarchy", (F.lower("ontology_source") == source.lower()) & (F.col("version") == version))


def of_version(rows: DataFrame, source: str, version: str) -> DataFrame:
    return rows.where((F.lower("ontology_source") == source.lower()) & (F.col("version") == version))


def closure_of(rows: DataFrame) -> DataFrame:
    """(term_id, ancestor_id) of hierarchy rows."""
    return rows.select("term_id", F.explode("ancestor_term_ids").alias("ancestor_id"))


def descendants(rows: DataFrame, term: str) -> DataFrame:
    """term_id, term_iri, term_label and depth of what is below a term, by depth; ``rows`` of one version."""
    return rows.where(F.array_contains("ancestor_term_ids", term) & (F.col("term_id") != term)).select("term_id", "term_iri", "term_label", "depth").orderBy("depth", "term_id")


def ancestors(rows: DataFrame, term: str) -> DataFrame:
    """term_id, term_label and depth of a term and all above it, from the root down."""
    up = rows.where(F.col("term_id") == term).select(F.posexplode("ancestor_term_ids").alias("place", "a"))
    return up.join(rows.select("term_id", "term_label", "depth"), F.col("a") == F.col("term_id")).orderBy("place").select("place", "term_id", "term_label", "depth")


def expand_terms(rows: DataFrame, terms: list[str], versions: dict[str, str]) -> DataFrame:
    """The terms and all below them, each in the version of its ontology; terms of unknown ontologies are skipped."""
    known: dict[str, list[str]] = {}
    for t in terms:
        source = PREFIXES.get(t.split(":", 1)[0])
        if source in versions:
            known.setdefault(source, []).append(t)
    hit = F.lit(False)
    for source, ids in known.items():
        hit |= (F.col("ontology_source") == source) & (F.col("version") == versions[source]) & (F.arrays_overlap("ancestor_term_ids", F.array(*map(F.lit, ids))))
    return rows.where(hit).select("term_id").distinct()


def labels(rows: DataFrame) -> DataFrame:
    return rows.select("term_iri", "term_id", "term_label")


def current_version(sources: DataFrame) -> DataFrame:
    """The version installed last, for each source; versions that were never installed do not count."""
    return sources.where("installed_at is not null").groupBy("source").agg(F.max_by("version", "installed_at").alias("version"))


def source_info(sources: DataFrame) -> DataFrame:
    """The newest record of each source, installed or not."""
    return sources.groupBy("source").agg(F.max_by(F.struct("version", "created_at", "installed_at"), "created_at").alias("r")).select("source", "r.*")
