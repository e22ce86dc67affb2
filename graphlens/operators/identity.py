"""Identity of functions: declarations, implementations, homonyms, deferred-work functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens import tables
from graphlens.schema import Graph

# Parts of names, and names, of functions that defer work.
ASYNC_KEYWORDS = (
    "schedule", "delayed_work", "queue_work", "schedule_work", "init_work", "tasklet",
    "queue_work_on", "queue_work_affinity", "INIT_WORK", "INIT_DELAYED_WORK",
)
KNOWN_ASYNC = (
    "mmc_schedule_delayed_work", "queue_delayed_work", "schedule_delayed_work", "schedule_work", "queue_work",
    "queue_work_on", "queue_work_affinity", "tasklet_init", "tasklet_schedule",
)
DEFAULT_ASYNC = ("mmc_schedule_delayed_work", "schedule_work", "schedule_delayed_work", "queue_work", "queue_delayed_work")


def by_id(entities: DataFrame, *columns: str) -> DataFrame:
    """One row for each id: the last in the file, at the first's place. Columns beside id and ord as named, as no scan prunes a struct's fields."""
    columns = columns or tuple(c for c in entities.columns if c not in ("id", "ord"))
    last = entities.groupBy("id").agg(F.max_by(F.struct(*columns), "ord").alias("e"), F.min("ord").alias("ord"))
    return last.select("id", "e.*", "ord")


def by_name(entities: DataFrame, *columns: str) -> DataFrame:
    """One row for each (type, name): the last in the file."""
    columns = columns or tuple(c for c in entities.columns if c not in ("type", "name"))
    last = entities.groupBy("type", "name").agg(F.max_by(F.struct(*columns), "ord").alias("e"))
    return last.select("type", "name", "e.*")


def decl_impl_map(graph: Graph, rows: int = 0) -> DataFrame:
    """(id, canon_id): each declaration to the first implementation of its name, where there is one. rows: the graph's entities, if known, so that many are not broadcast."""
    functions = by_id(graph.of("FUNCTION"), "name", "is_declaration")
    first = functions.where(~F.col("is_declaration")).groupBy("name").agg(F.min_by("id", "ord").alias("canon_id"))
    return functions.where("is_declaration").join(tables.merging(first, rows), "name").select("id", "canon_id")


def normalize(df: DataFrame, canon: DataFrame, column: str, to: str | None = None) -> DataFrame:
    """df with a column of ids replaced (or copied to another) by their implementations'."""
    to = to or column
    known = canon.select(F.col("id").alias("_id"), F.col("canon_id").alias("_canon"))
    joined = df.join(known, F.col(column) == F.col("_id"), "left")
    return joined.withColumn(to, F.coalesce("_canon", column)).drop("_id", "_canon")


def equivalents(graph: Graph, canon: DataFrame | None = None) -> DataFrame:
    """(id, eq_id): itself, its implementation, or its declarations; never sibling declarations."""
    canon = decl_impl_map(graph) if canon is None else canon
    same = graph.of("FUNCTION").select("id", F.col("id").alias("eq_id"))
    to = canon.select("id", F.col("canon_id").alias("eq_id"))
    back = canon.select(F.col("canon_id").alias("id"), F.col("id").alias("eq_id"))
    return same.unionByName(to).unionByName(back).distinct()


def name_ids(graph: Graph) -> DataFrame:
    """(name, id, ord): all functions of a name."""
    return by_id(graph.of("FUNCTION"), "name").select("name", "id", "ord")


def latest(graph: Graph) -> DataFrame:
    """(name, id): the function that a name stands for, the last in the file."""
    return by_name(graph.of("FUNCTION"), "id").select("name", "id")


def async_functions(graph: Graph, keywords=ASYNC_KEYWORDS, known=KNOWN_ASYNC, default=DEFAULT_ASYNC) -> DataFrame:
    """(name): configured names and functions whose name holds a keyword, in any case; a default list if there are none."""
    spark = graph.entities.sparkSession
    listed = spark.createDataFrame([(n,) for n in known], "name string")
    found = graph.of("FUNCTION").select("name").where(F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower("name"), k))) if keywords else None
    names = listed if found is None else listed.unionByName(found)
    names = names.distinct()
    if not known and names.isEmpty():
        return spark.createDataFrame([(n,) for n in default], "name string")
    return names


def graph_stats(graph: Graph) -> DataFrame:
    """(kind, type, n): distinct names of each entity type and rows of each relation type."""
    entities = graph.entities.groupBy("type").agg(F.countDistinct("name").alias("n")).select(F.lit("entity").alias("kind"), "type", "n")
    relations = graph.relations.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("relation").alias("kind"), "type", "n")
    return entities.unionByName(relations)
