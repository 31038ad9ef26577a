"""Small files: lists of terms, prevalence tables, associations, and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Store

#: Names that a column of a prevalence table goes by.
NAMES = {"term_id": ("term_id", "hpo_id", "term", "id"), "prevalence": ("prevalence", "frequency", "freq", "percent"), "term_label": ("term_label", "label", "name", "hpo_name")}


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """The distinct terms (pool, term_id) of a JSON file: a list, a map of pools to lists, or such a map below the key pools."""
    text = spark.read.text(path, wholetext=True).select("value")
    pools = F.coalesce(F.from_json(F.get_json_object("value", "$.pools"), "map<string,array<string>>"), F.from_json("value", "map<string,array<string>>"))
    listed = text.where(F.ltrim("value").startswith("[")).select(F.lit("all").alias("pool"), F.explode(F.from_json("value", "array<string>")).alias("term_id"))
    mapped = text.where(F.ltrim("value").startswith("{")).select(F.explode(pools).alias("pool", "terms")).select("pool", F.explode("terms").alias("term_id"))
    return listed.union(mapped).where("term_id is not null").distinct()


def read_prevalence(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, prevalence, term_label) of a CSV with a header, whose columns go by any of NAMES; the first row of a term counts."""
    rows = spark.read.csv(path, header=True)
    by = {c.strip().lower().replace(" ", "_"): c for c in rows.columns}
    found = {name: next((by[n] for n in given if n in by), None) for name, given in NAMES.items()}
    if found["term_id"] is None:
        raise ValueError(f"{path}: no column of term ids among {', '.join(rows.columns)}")
    some = [F.col(f"`{c}`").alias(n) if c else F.lit(None).cast("string").alias(n) for n, c in found.items()]
    out = rows.select(*some).where("term_id is not null")
    number = F.regexp_replace("prevalence", "%", "").try_cast("double") / F.when(F.col("prevalence").endswith("%"), 100.0).otherwise(1.0)
    return out.groupBy("term_id").agg(F.first(number, True).alias("prevalence"), F.first("term_label", True).alias("term_label"))


def associations(rows: DataFrame, entity: str) -> DataFrame:
    """The distinct objects that a table (entity, object) names for an entity, sorted."""
    return rows.where(F.col("entity") == entity).select("object").distinct().orderBy("object")


def register_source(store: Store, source: str, version: str, created_at, assets: list[tuple[str, str]] = ()) -> bool:
    """Note a release of an ontology; False if its version is known."""
    known = store.read("term_source")
    if not known.where((F.col("source") == source) & (F.col("version") == version)).isEmpty():
        return False
    store.append("term_source", store.spark.createDataFrame([(source, version, created_at, None, [tuple(a) for a in assets])], known.schema))
    return True


def set_installed(store: Store, source: str, version: str, at) -> None:
    one = (F.col("source") == source) & (F.col("version") == version)
    store.replace("term_source", store.read("term_source").withColumn("installed_at", F.when(one, F.lit(at)).otherwise(F.col("installed_at"))))


def write_json(rows: DataFrame, path: str) -> None:
    """A result as compressed JSON lines."""
    rows.write.mode("overwrite").json(path, compression="gzip")
