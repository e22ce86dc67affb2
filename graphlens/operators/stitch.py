"""Chains stitched from both ends, the layered strategy, and breaks with their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens import tables
from graphlens.operators import edges as E
from graphlens.operators import lookup, neighbors, reach
from graphlens.schema import Graph

#: Confidence above which a model's bridge is believed.
CONFIDENT = 0.6


def stitch_paths(graph: Graph, pairs: DataFrame, max_depth: int) -> DataFrame:
    """pairs (qid, start, goal) of names -> (qid, path, node, bridge_type, bridged): a chain through a node that both ends reach.

    Nodes whose neighbours on either side are bridged go first, then the
    shortest chain, then the node's name.
    """
    hop = tables.stored(neighbors.name_edges(graph).select(F.col("caller").alias("src"), F.col("callee").alias("dst")), "name-edges")
    half = max_depth // 2
    ahead = reach.reach_paths(hop, pairs.select("qid", F.col("start").alias("node")), half).select("qid", "node", F.col("path").alias("ahead"))
    back = reach.reach_paths(hop, pairs.select("qid", F.col("goal").alias("node")), half, backward=True).select("qid", "node", F.col("path").alias("back"))
    met = tables.stored(ahead.join(back, ["qid", "node"]), "met")
    sides = met.where("size(ahead) >= 2 AND size(back) >= 2").select("qid", "node", F.element_at("ahead", -2).alias("a"), F.element_at("back", 2).alias("b"))
    bridges = E.bridge_pairs(graph, sides.select("a", "b").distinct())
    found = met.join(sides.join(bridges, ["a", "b"]).select("qid", "node", "bridge_type"), ["qid", "node"], "left")
    out = found.select("qid", "node", "bridge_type", F.col("bridge_type").isNotNull().alias("bridged"), F.concat("ahead", F.slice("back", F.lit(2), F.size("back"))).alias("path"))
    return lookup.best_rank(out, ["qid"], F.desc("bridged"), F.size("path"), F.col("node"))


def layered_paths(graph: Graph, pairs: DataFrame, max_depth: int, oracle: DataFrame | None = None) -> DataFrame:
    """pairs (qid, start, goal) of names -> (qid, path, method, success): the shortest chain, else a stitched one, else a model's bridge, else none.

    oracle: (start, goal, bridge_entity, confidence).
    """
    hop = tables.stored(neighbors.name_edges(graph).select(F.col("caller").alias("src"), F.col("callee").alias("dst")), "name-edges")
    one = reach.shortest_path(hop, pairs, max_depth).select("qid", "path", F.lit(1).alias("layer"), F.lit("direct").alias("method"))
    two = tables.stored(stitch_paths(graph, pairs, max_depth), "stitched").select("qid", "path", F.lit(2).alias("layer"), F.lit("stitched").alias("method"))
    found = one.unionByName(two)
    if oracle is not None:
        known = pairs.join(oracle, ["start", "goal"]).where(F.col("confidence") > CONFIDENT)
        found = found.unionByName(known.select("qid", F.array("start", "bridge_entity", "goal").alias("path"), F.lit(3).alias("layer"), F.lit("llm_inferred").alias("method")))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("layer", F.size("path"), "path"))).where("n = 1").drop("n")
    return pairs.select("qid").join(best, "qid", "left").select("qid", "path", F.coalesce("method", F.lit("none")).alias("method"), F.col("path").isNotNull().alias("success"))


def break_repairs(graph: Graph, paths: DataFrame, oracle: DataFrame | None = None) -> DataFrame:
    """paths (qid, path) -> a row for each neighbouring pair without a direct call: position, from, to, fixed, method, bridge_entity.

    Repairs: an assignment's bridge, deferred work first; else a model's (a, b, bridge_entity, confidence).
    """
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct((i - 1).alias("position"), F.element_at("path", i).alias("caller"), F.element_at("path", i + 1).alias("callee")))
    pairs = paths.where("size(path) >= 2").select("qid", F.explode(steps).alias("s")).select("qid", "s.*")
    broken = pairs.join(lookup.direct_calls(graph, pairs.select("caller", "callee").distinct()), ["caller", "callee"], "left_anti")
    known = E.bridge_pairs(graph, broken.select(F.col("caller").alias("a"), F.col("callee").alias("b")).distinct()).select(F.col("a").alias("caller"), F.col("b").alias("callee"), "bridge_type", "bridge_entity")
    out = broken.join(known, ["caller", "callee"], "left")
    entity, method = F.col("bridge_entity"), F.col("bridge_type")
    if oracle is not None:
        told = oracle.where(F.col("confidence") > CONFIDENT).select(F.col("a").alias("caller"), F.col("b").alias("callee"), F.col("bridge_entity").alias("told"))
        out = out.join(told, ["caller", "callee"], "left")
        entity, method = F.coalesce(entity, "told"), F.coalesce(method, F.when(F.col("told").isNotNull(), "llm_inferred"))
    return out.select("qid", "position", F.col("caller").alias("from"), F.col("callee").alias("to"), entity.isNotNull().alias("fixed"), method.alias("method"), entity.alias("bridge_entity"))


def repaired(paths: DataFrame, repairs: DataFrame) -> DataFrame:
    """paths with the repairs' entities put in between."""
    bridges = repairs.where("fixed").groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("position", "bridge_entity"))).alias("m"))
    joined = paths.join(bridges, "qid", "left")
    put = F.flatten(F.transform("path", lambda x, i: F.when(F.coalesce(F.map_contains_key("m", i), F.lit(False)), F.array(x, F.element_at("m", i))).otherwise(F.array(x))))
    return joined.withColumn("path", put).drop("m")


def repair_stats(repairs: DataFrame) -> DataFrame:
    """(method, n): breaks by how they were repaired."""
    return repairs.groupBy(F.coalesce("method", F.lit("unrepaired")).alias("method")).agg(F.count("*").alias("n"))
