"""Callers, callees and the context of functions, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators import identity, lookup
from graphlens.schema import Graph


def name_edges(graph: Graph) -> DataFrame:
    """(caller, callee): distinct names; all ids of a name and their equivalents call; only functions are called."""
    canon = identity.decl_impl_map(graph)
    functions = identity.by_id(graph.of("FUNCTION"), "name").select("id", "name")
    heads = identity.equivalents(graph, canon).join(functions, "id").select(F.col("name").alias("caller"), F.col("eq_id").alias("head"))
    calls = graph.rel("CALLS").select("head", "tail").distinct()
    rows = identity.normalize(calls, canon, "tail").join(functions.toDF("tail", "callee"), "tail").join(heads, "head")
    return rows.select("caller", "callee").distinct()


def callees(graph: Graph, names: DataFrame) -> DataFrame:
    return name_edges(graph).join(names.select(F.col("name").alias("caller")).distinct(), "caller", "left_semi")


def callers(graph: Graph, names: DataFrame) -> DataFrame:
    return name_edges(graph).join(names.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi")


def call_frequency(graph: Graph) -> DataFrame:
    """(name, n_callers, n_sites): distinct calling names, and call rows, of each called function."""
    functions = identity.by_id(graph.of("FUNCTION"), "name").select("id", "name")
    distinct = name_edges(graph).groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("n_callers"))
    canon = identity.decl_impl_map(graph)
    sites = identity.normalize(graph.rel("CALLS").select("head", "tail"), canon, "tail").join(functions.toDF("tail", "name"), "tail").groupBy("name").agg(F.count("*").alias("n_sites"))
    return distinct.join(sites, "name", "full").select("name", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce("n_sites", F.lit(0)).alias("n_sites"))


def variables_of(graph: Graph) -> DataFrame:
    """(function, variable): variables that functions contain."""
    entities = identity.by_id(graph.entities, "name", "type")
    held = graph.rel("CONTAINS").select("head", "tail")
    return held.join(entities.where("type = 'FUNCTION'").select(F.col("id").alias("head"), F.col("name").alias("function")), "head").join(
        entities.where("type = 'VARIABLE'").select(F.col("id").alias("tail"), F.col("name").alias("variable")), "tail").select("function", "variable")


def structs_of(graph: Graph) -> DataFrame:
    """(function, struct): distinct types of the variables that functions contain."""
    entities = identity.by_id(graph.entities, "name").select("id", "name")
    typed = graph.rel("TYPE_OF").select("head", "tail").join(entities.toDF("head", "variable"), "head").join(entities.toDF("tail", "struct"), "tail")
    return variables_of(graph).join(typed.select("variable", "struct"), "variable").select("function", "struct").distinct()


def function_context(graph: Graph, names: DataFrame) -> DataFrame:
    """names (name) -> one record each: file, code, callers, callees, variables, structs (sorted)."""
    asked = names.select("name").distinct()
    one = identity.by_name(graph.of("FUNCTION"), "file", "source_file", "code", "body").select("name", F.coalesce("file", "source_file").alias("file"), lookup.function_code().alias("code"))
    edges = name_edges(graph)
    gather = lambda df, key, value, to: df.groupBy(F.col(key).alias("name")).agg(F.sort_array(F.collect_set(value)).alias(to))
    out = asked.join(one, "name")
    for df, key, value, to in ((edges, "callee", "caller", "callers"), (edges, "caller", "callee", "callees"), (variables_of(graph), "function", "variable", "variables"), (structs_of(graph), "function", "struct", "structs")):
        kept = df.join(asked.withColumnRenamed("name", key), key, "left_semi")
        out = out.join(gather(kept, key, value, to), "name", "left").withColumn(to, F.coalesce(to, F.array().cast("array<string>")))
    return out


def bridge_context(graph: Graph, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) -> what a model is told about them: both texts, a's callees, b's callers, both structs."""
    names = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name")))
    known = function_context(graph, names)
    left = known.select(F.col("name").alias("a"), F.col("code").alias("code_a"), F.col("callees").alias("callees_a"), F.col("structs").alias("structs_a"))
    right = known.select(F.col("name").alias("b"), F.col("code").alias("code_b"), F.col("callers").alias("callers_b"), F.col("structs").alias("structs_b"))
    return pairs.join(left, "a", "left").join(right, "b", "left")
