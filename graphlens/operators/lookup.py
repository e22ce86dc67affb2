"""Lookups and predicates on functions; the location of a log's ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens import tables
from graphlens.operators import identity
from graphlens.schema import Graph
from graphlens.sources import text as source_text


#: Names that are looked for one by one in every function; letters of the pieces that more of them are joined by.
FEW_NAMES, GRAM = 2000, 3


def function_code(code: str = "code", body: str = "body") -> Column:
    """An entity's text: code, or else body; '' counts as none."""
    return F.coalesce(F.when(F.col(code) != "", F.col(code)), F.col(body))


def with_sources(graph: Graph, files: DataFrame, root: str = "", prefixes: tuple[str, ...] = ()) -> Graph:
    """files (file, text) -> the graph, with code from its file's lines where an entity has neither code nor body.

    Files are found by the entity's path as convert_path() writes it.
    """
    lacking = function_code().isNull() | (function_code() == "")
    path = source_text.convert_path(F.coalesce("file", "source_file"), root, prefixes)
    known = files.select(F.col("file").alias("of_file"), F.col("text").alias("file_text"))
    bare = graph.entities.where(lacking).withColumn("of_file", path).join(known, "of_file", "left")
    filled = bare.withColumn("code", F.coalesce(source_text.source_slice(F.col("file_text"), F.col("start_line"), F.col("end_line")), "code"))
    return Graph(graph.entities.where(~lacking).unionByName(filled.select(*graph.entities.columns)), graph.relations)


def find_function(graph: Graph, name: str | Column) -> DataFrame:
    """The function of exactly this name (the last in the file), with file filled from source_file."""
    found = identity.by_name(graph.of("FUNCTION")).select(*graph.entities.columns).where(F.col("name") == name)
    return found.withColumn("file", F.coalesce("file", "source_file"))


def find_by_pattern(graph: Graph, pattern: str, limit: int = 10) -> DataFrame:
    """The first functions whose name holds the pattern, in any case, in file order."""
    names = graph.of("FUNCTION").groupBy("name").agg(F.min("ord").alias("first_ord"))
    return names.where(F.contains(F.lower("name"), F.lower(F.lit(pattern)))).orderBy("first_ord", "name").limit(limit)


def exists(graph: Graph, keys: DataFrame) -> DataFrame:
    """keys (type, name) that are entities."""
    return keys.join(graph.entities.select("type", "name"), ["type", "name"], "left_semi")


def keyword_search(graph: Graph, keywords: list[str], limit: int = 50) -> DataFrame:
    """Functions by the number of keywords in their name, in any case; ties in file order."""
    names = graph.of("FUNCTION").groupBy("name").agg(F.min("ord").alias("first_ord"))
    score = F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower("name"), F.lower(k))))
    return names.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "first_ord", "name").limit(limit)


def direct_calls(graph: Graph, pairs: DataFrame) -> DataFrame:
    """pairs (caller, callee) of names with a call row between exactly their last ids."""
    last = identity.latest(graph)
    calls = graph.rel("CALLS").select(F.col("head").alias("caller_id"), F.col("tail").alias("callee_id"))
    named = pairs.join(last.toDF("caller", "caller_id"), "caller").join(last.toDF("callee", "callee_id"), "callee")
    return named.join(calls, ["caller_id", "callee_id"], "left_semi").select("caller", "callee")


def locate(graph: Graph, names: DataFrame) -> DataFrame:
    """names (name) -> (name, located): the exact function, else the first in file order whose name holds it; null-safe."""
    known = graph.of("FUNCTION").groupBy(F.col("name").alias("located")).agg(F.min("ord").alias("first_ord"))
    asked = tables.joinable(tables.stored(names.select("name").where("name IS NOT NULL").distinct(), "asked-names"))  # else the functions could be broadcast
    exact = asked.join(known, F.col("name") == F.col("located")).select("name", "located")
    rest = asked.join(exact, "name", "left_anti")
    rest = tables.stored(rest, "unknown-names")
    first = F.min_by("located", F.struct("first_ord", "located")).alias("located")
    if rest.count() <= FEW_NAMES:  # few names: known functions stream past them
        near = known.join(F.broadcast(rest), F.contains(F.lower("located"), F.lower("name"))).groupBy("name").agg(first)
        return exact.unionByName(near)
    # many: a name meets the functions that hold its first GRAM letters; shorter ones meet all pieces of their own length
    lower = F.lower("name")
    asked = rest.withColumn("piece", F.substring(lower, 1, GRAM))
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("located") - n + 1, F.lit(1))), lambda i: F.substring(F.lower("located"), i, n))
    every = F.array_distinct(F.flatten(F.array(*[pieces(F.lit(n)) for n in range(1, GRAM + 1)])))
    held = known.withColumn("piece", F.explode(F.concat(every, F.array(F.lit("")))))
    near = held.join(asked, "piece").where(F.contains(F.lower("located"), lower)).groupBy("name").agg(first)
    return exact.unionByName(near)


def locate_entities(graph: Graph, parsed: DataFrame, default_start: str | None = None) -> DataFrame:
    """parsed (log_id, start_name, end_name, keys array) -> log_id, start_entity, end_entity, intermediate_entities.

    The end falls back to the first key that is found, the start to the
    default, then to the first key found (the end to the last); with more than
    two keys found the middle ones are intermediates.
    """
    keys = parsed.select("log_id", F.posexplode("keys").alias("at", "name"))
    names = keys.select("name").unionByName(parsed.select(F.col("start_name").alias("name"))).unionByName(parsed.select(F.col("end_name").alias("name")))
    if default_start:
        names = names.unionByName(parsed.sparkSession.createDataFrame([(default_start,)], "name string"))
    found = locate(graph, names)
    listed = keys.join(found, "name").groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("at", "located"))).alias("l"))
    listed = listed.select("log_id", F.col("l.located").alias("listed"))
    out = parsed.join(found.toDF("start_name", "s"), "start_name", "left").join(found.toDF("end_name", "e"), "end_name", "left").join(listed, "log_id", "left")
    fallback = F.lit(None).cast("string")
    if default_start:
        out = out.crossJoin(F.broadcast(found.where(F.col("name") == default_start).agg(F.first("located").alias("d"))))
        fallback = F.col("d")
    first = F.when(F.size("listed") > 0, F.element_at("listed", 1))
    last = F.when(F.size("listed") > 0, F.element_at("listed", -1))
    return out.select(
        "log_id",
        F.coalesce("s", fallback, first).alias("start_entity"),
        F.coalesce("e", first, last).alias("end_entity"),
        F.when(F.size("listed") > 2, F.slice("listed", F.lit(2), F.size("listed") - 2)).otherwise(F.array().cast("array<string>")).alias("intermediate_entities"),
    )


def best_rank(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by an explicit order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
