"""Derived call edges: through function pointers and through deferred work.

A caller that calls through a field reaches every function assigned to a field
of that name, whatever its structure. A caller that hands a work item to a
deferring function reaches the functions assigned to the item's field.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens import tables
from graphlens.operators import identity, lookup
from graphlens.schema import Graph

# A field's functions that graphs are known to lack, and the fields tried for unknown work items.
SUPPLEMENT = {"detect": ("mmc_rescan",)}
WORK_FIELDS = ("detect", "work", "dwork", "delayed_work")
#: The field of work items that lead nowhere else; no field of a graph has this name.
FALLBACK = "mock_data"


def supplement_rows(spark, supplement: dict = SUPPLEMENT) -> DataFrame:
    return spark.createDataFrame([(f, t) for f, ts in supplement.items() for t in ts], "field string, target string")


def assigned_functions(graph: Graph, rows: int = 0) -> DataFrame:
    """(field, target): distinct functions assigned to fields of a name. rows: the graph's entities, if known, so that many are not broadcast."""
    fields = graph.of("FIELD").select(F.col("id").alias("head"), F.col("name").alias("field"))
    functions = identity.by_id(graph.of("FUNCTION"), "name").select(F.col("id").alias("tail"), F.col("name").alias("target"))
    return graph.rel("ASSIGNED_TO").select("head", "tail").join(fields, "head").join(tables.merging(functions, rows), "tail").select("field", "target").distinct()


def assigned_entities(graph: Graph, supplement: DataFrame | None = None, rows: int = 0) -> DataFrame:
    """(field, target, via): entities of any type assigned to fields of a name, a row for each relation, then supplements not among them. rows as in assigned_functions()."""
    fields = graph.of("FIELD").select(F.col("id").alias("head"), F.col("name").alias("field"))
    entities = identity.by_id(graph.entities, "name").select(F.col("id").alias("tail"), F.col("name").alias("target"))
    found = graph.rel("ASSIGNED_TO").select("head", "tail").join(fields, "head").join(tables.merging(entities, rows), "tail").select("field", "target", F.lit("graph").alias("via"))
    if supplement is None:
        return found
    more = supplement.select("field", "target").join(found, ["field", "target"], "left_anti")
    return found.unionByName(more.withColumn("via", F.lit("supplement")))


def assigned_with_context(graph: Graph) -> DataFrame:
    """(field, target, context_var_id, context_var_name) of functions assigned to fields."""
    fields = graph.of("FIELD").select(F.col("id").alias("head"), F.col("name").alias("field"))
    functions = identity.by_id(graph.of("FUNCTION"), "name").select(F.col("id").alias("tail"), F.col("name").alias("target"))
    rows = graph.rel("ASSIGNED_TO").select("head", "tail", "context_var_id", "context_var_name")
    return rows.join(fields, "head").join(functions, "tail").select("field", "target", "context_var_id", "context_var_name")


def call_targets(entities: DataFrame, canon: DataFrame) -> DataFrame:
    """(tail, norm, callee): the implementation that a call of each id goes to, and its name."""
    known = entities.select("id", "name")
    return identity.normalize(known.select(F.col("id").alias("tail")), canon, "tail", "norm").join(known.toDF("norm", "callee"), "norm").select("tail", "norm", "callee")


def _plain() -> Column:
    return (F.col("call_type") == "direct") | (F.col("target_type") == "FUNCTION")


def _function_calls(graph: Graph, heads: DataFrame, to: DataFrame) -> DataFrame:
    """heads (id, eq_id), to (tail, ...) -> id, to's columns, call_line and ord of each call of a function; calls of what to lacks go first."""
    calls = graph.rel("CALLS").where(_plain()).select("head", "tail", "call_line", "ord").join(to, "tail").drop("tail")
    return heads.join(calls, F.col("eq_id") == F.col("head")).drop("eq_id", "head")


def _field_calls(graph: Graph, heads: DataFrame, fields: DataFrame) -> DataFrame:
    """heads (id, eq_id), fields (tail, field_name) -> (id, field, call_line, ord) of each call through a field."""
    calls = graph.rel("CALLS").where(~_plain() & (F.col("call_type") == "indirect") & (F.col("target_type") == "FIELD"))
    field = F.when(F.size("field_path") > 0, F.element_at("field_path", -1)).otherwise(F.col("field_name"))
    calls = calls.select("head", "tail", "call_line", "field_path", "ord").join(fields, "tail").select("head", field.alias("field"), "call_line", "ord")
    return heads.join(calls, F.col("eq_id") == F.col("head")).select("id", "field", "call_line", "ord")


def _fields(entities: DataFrame) -> DataFrame:
    return entities.where("type = 'FIELD'").select(F.col("id").alias("tail"), F.col("name").alias("field_name"))


def call_rows(graph: Graph, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Calls of functions (id, tail, callee, call_line, ord) and calls through fields (id, field, call_line, ord), a row for each call row.

    The id's equivalents count as callers, its other homonyms don't. A call of
    a function goes to its implementation; a call through a field names the last
    part of its path, else the field. Calls meet what they go to, without the
    columns that tell their kind, before they are multiplied by their callers.
    """
    canon = identity.decl_impl_map(graph)
    heads = identity.equivalents(graph, canon)
    if ids is not None:
        heads = heads.join(ids.select("id").distinct(), "id", "left_semi")
    entities = identity.by_id(graph.entities, "name", "type").select("id", "name", "type")
    direct = _function_calls(graph, heads, call_targets(entities, canon))
    return direct.select("id", F.col("norm").alias("tail"), "callee", "call_line", "ord"), _field_calls(graph, heads, _fields(entities))


def callees_with_lines(graph: Graph, ids: DataFrame | None = None, allow_indirect: bool = True) -> DataFrame:
    """(id, callee, call_line, is_indirect, ord, via): what each function id calls, a row for each call row and candidate.

    A call through a field goes to each function assigned to fields of that name, if the field exists.
    """
    direct, through = call_rows(graph, ids)
    direct = direct.select("id", "callee", "call_line", F.lit(False).alias("is_indirect"), "ord", F.lit(None).cast("string").alias("via"))
    if not allow_indirect:
        return direct
    through = through.join(assigned_functions(graph), "field")
    return direct.unionByName(through.select("id", F.col("target").alias("callee"), "call_line", F.lit(True).alias("is_indirect"), "ord", F.col("field").alias("via")))


def callee_counts(graph: Graph, ids: DataFrame | None = None) -> DataFrame:
    """(id, callee, call_line, is_indirect, n): the rows of callees_with_lines(), counted.

    Calls through fields are counted by field where their caller and line are dealt
    to; only there do they meet the fields' functions, so that product is never shuffled.
    """
    direct, through = call_rows(graph, ids)
    direct = direct.groupBy("id", "callee", "call_line").agg(F.count("*").alias("n"))
    sites = through.select("id", "call_line", "field").repartition("id", "call_line").groupBy("id", "call_line", "field").agg(F.count("*").alias("sites"))
    targets = tables.small(tables.stored(assigned_functions(graph), "assigned"))
    late = sites.join(targets, "field").groupBy("id", "call_line", "target").agg(F.sum("sites").alias("n"))
    columns = lambda callee, indirect: ["id", F.col(callee).alias("callee"), "call_line", F.lit(indirect).alias("is_indirect"), "n"]
    return direct.select(*columns("callee", False)).unionByName(late.select(*columns("target", True)))


def work_field(source: Column, callee: Column) -> Column:
    """The field that a caller's text hands to callee: from &x->field, else from &field."""
    name = F.concat(F.lit(r"\Q"), callee, F.lit(r"\E"))
    found = lambda rest: F.call_function("regexp_extract", source, F.concat(name, F.lit(rest)), F.lit(1))
    arrow, plain = found(r"\s*\(\s*&\w*->(\w+)"), found(r"\s*\(\s*&(\w+)")
    return F.coalesce(F.when(arrow != "", arrow), F.when(plain != "", plain))


def function_sources(graph: Graph) -> DataFrame:
    """(caller, source): a name's text, from its first implementation, else from its first function."""
    rows = identity.by_id(graph.of("FUNCTION"), "name", "is_declaration", "code", "body").select("name", "is_declaration", "ord", lookup.function_code().alias("source"))
    return rows.groupBy(F.col("name").alias("caller")).agg(F.min_by("source", F.struct("is_declaration", "ord")).alias("source"))


def async_pairs(graph: Graph, oracle: DataFrame | None = None, async_names: DataFrame | None = None, canon: DataFrame | None = None, entities: DataFrame | None = None, rows: int = 0) -> DataFrame:
    """(caller, async_callee, field): callers of deferring functions and the field that they hand over, null where none is found. rows as in assigned_functions()."""
    names = tables.merging(identity.async_functions(graph), rows) if async_names is None else async_names
    canon = identity.decl_impl_map(graph) if canon is None else canon
    functions = (identity.by_id(graph.of("FUNCTION"), "name") if entities is None else entities.where("type = 'FUNCTION'")).select("id", "name")
    deferring = call_targets(functions, canon).select("tail", F.col("callee").alias("async_callee")).join(names.toDF("async_callee"), "async_callee", "left_semi")
    deferring = tables.joinable(tables.stored(deferring, "deferring"))
    calls = graph.rel("CALLS").where(_plain()).select("head", "tail").join(deferring, "tail").select("head", "async_callee").distinct()
    pairs = calls.join(functions.toDF("head", "caller"), "head").select("caller", "async_callee").distinct()
    sourced = pairs.join(function_sources(graph).where("source IS NOT NULL AND source != ''"), "caller")
    field = work_field(F.col("source"), F.col("async_callee"))
    if oracle is not None:
        sourced = sourced.join(oracle.select("caller", "async_callee", "answer"), ["caller", "async_callee"], "left")
        field = F.coalesce("answer", field)
    return sourced.select("caller", "async_callee", field.alias("field"))


def async_edges(graph: Graph, supplement: DataFrame | None = None, use_fallback: bool = False, oracle: DataFrame | None = None, async_names: DataFrame | None = None) -> DataFrame:
    """(caller, async_callee, target, field, via): functions that deferred work reaches.

    oracle, a table (caller, async_callee, answer), goes ahead of the text's field.
    use_fallback adds the supplement's functions where nothing else is found.
    """
    fielded = async_pairs(graph, oracle, async_names)
    # both sides are distinct, so their product is, and needn't be shuffled
    assigned = tables.joinable(tables.stored(assigned_entities(graph, supplement).distinct(), "assigned"))
    found = fielded.where("field IS NOT NULL").distinct().join(assigned, "field").select("caller", "async_callee", "target", "field", "via")
    if not use_fallback:
        return found
    spark = graph.entities.sparkSession
    more = supplement_rows(spark).where(F.col("field").isin(*WORK_FIELDS)).select("field", "target")
    lacking = fielded.select("caller", "async_callee").join(found, ["caller", "async_callee"], "left_anti")
    return found.unionByName(lacking.crossJoin(F.broadcast(more)).select("caller", "async_callee", "target", "field", F.lit("mock_data").alias("via")))


@dataclass(frozen=True)
class Steps:
    """A search's edges without the product of calls through fields with the fields' functions.

    direct (src, dst, call_line, ord); through (src, kind, field, via, call_line,
    ord, mid) with kind indirect or async; targets (kind, field, dst, sub). An
    async edge passes through mid and is two nodes long. (ord, sub) is the order
    in which a search finds edges.
    """

    direct: DataFrame
    through: DataFrame
    targets: DataFrame
    written: bool = False

    def stored(self) -> Steps:
        if self.written:
            return self
        return Steps(**tables.stored_together(direct=self.direct, through=self.through, targets=self.targets), written=True)

    def edges(self) -> DataFrame:
        """(src, dst, kind, call_line, ord, sub, mid, via)."""
        none = F.lit(None).cast("string")
        one = self.direct.select("src", "dst", F.lit("direct").alias("kind"), "call_line", "ord", F.lit("").alias("sub"), none.alias("mid"), none.alias("via"))
        two = self.through.join(self.targets, ["kind", "field"]).where("kind != 'async' OR (dst != src AND dst != mid)")
        return one.unionByName(two.select(*one.columns))

    @staticmethod
    def of(edges: DataFrame) -> Steps:
        """Steps of edges as edges() gives them."""
        key = F.concat_ws("|", "src", F.col("ord").cast("string"), F.coalesce("mid", F.lit("")), F.coalesce("via", F.lit("")))
        late = edges.where("kind != 'direct'").withColumn("field", key)
        through = late.select("src", "kind", "field", "via", "call_line", "ord", "mid").distinct()
        return Steps(edges.where("kind = 'direct'").select("src", "dst", "call_line", "ord"), through, late.select("kind", "field", "dst", "sub"))


def search_steps(graph: Graph, allow_indirect: bool = True, with_async: bool = True, supplement: DataFrame | None = None, async_names: DataFrame | None = None, oracle: DataFrame | None = None, use_fallback: bool = False) -> Steps:
    """The edges of a search; oracle and use_fallback as in async_edges(). A node is the id that a function's name stands for, normalised."""
    # read by nearly every join below, and small beside the calls
    entities, seen = tables.stored_counting(identity.by_id(graph.entities, "name", "type").select("id", "name", "type"), "entities", rows=F.count("*"))
    rows, fields = seen["rows"], tables.joinable(_fields(entities))
    canon, seen = tables.stored_counting(identity.decl_impl_map(graph, rows), "canon", rows=F.count("*"))
    entities, canon = tables.merging(entities, rows), tables.merging(canon, seen["rows"])

    def known_calls() -> tuple[DataFrame, DataFrame, DataFrame]:
        nodes, seen = tables.stored_counting(identity.normalize(identity.latest(graph), canon, "id").select("name", F.col("id").alias("node")), "nodes", rows=F.count("*"))
        nodes = tables.merging(nodes, seen["rows"])
        heads = identity.equivalents(graph, canon).join(nodes.select(F.col("node").alias("id")), "id", "left_semi")
        to = call_targets(entities, canon).join(nodes.toDF("callee", "dst"), "callee").select("tail", "callee", "dst")
        known = tables.stored_together(heads=heads, to=to)
        return nodes, tables.joinable(known["heads"]), known["to"]

    def handed() -> DataFrame:
        return tables.stored(async_pairs(graph, oracle, async_names, canon, entities, rows), "deferring-calls")

    (nodes, heads, to), *fielded = tables.together(graph.entities.sparkSession, known_calls, *([handed] if with_async else []))
    direct = _function_calls(graph, heads, tables.joinable(to.select("tail", "dst"))).select(F.col("id").alias("src"), "dst", "call_line", "ord")
    through = _field_calls(graph, heads, fields)
    spark = graph.entities.sparkSession
    late = spark.createDataFrame([], "src string, kind string, field string, via string, call_line int, ord long, mid string")
    targets = spark.createDataFrame([], "kind string, field string, dst string, sub string")
    if allow_indirect:
        late = late.unionByName(through.select(F.col("id").alias("src"), F.lit("indirect").alias("kind"), "field", F.col("field").alias("via"), "call_line", "ord", F.lit(None).cast("string").alias("mid")))
        reached = assigned_functions(graph, rows).join(nodes.toDF("target", "dst"), "target")
        targets = targets.unionByName(reached.select(F.lit("indirect").alias("kind"), "field", "dst", F.col("target").alias("sub")))
    if with_async:
        fielded = fielded[0]
        assigned = assigned_entities(graph, supplement, rows).select("field", "target").distinct()
        pairs = fielded.where("field IS NOT NULL")
        if use_fallback:  # what reaches nothing goes to one field more, which has the supplement's functions
            lacking = fielded.join(assigned.select("field").distinct(), "field", "left_anti").select("caller", "async_callee", F.lit(FALLBACK).alias("field"))
            pairs = pairs.unionByName(lacking)
            more = supplement_rows(spark).where(F.col("field").isin(*WORK_FIELDS)).select(F.lit(FALLBACK).alias("field"), "target").distinct()
            assigned = assigned.unionByName(more)
        pairs = pairs.join(nodes.toDF("caller", "src"), "caller").select("src", F.col("async_callee").alias("callee"), "field")
        handed_to = tables.merging(fielded.select(F.col("async_callee").alias("callee")).distinct(), rows)
        own = tables.joinable(tables.stored(to.join(handed_to, "callee", "left_semi"), "deferred"))
        deferred = _function_calls(graph, heads, own).withColumnRenamed("id", "src").join(pairs, ["src", "callee"])
        late = late.unionByName(deferred.select("src", F.lit("async").alias("kind"), "field", F.col("field").alias("via"), "call_line", "ord", F.col("dst").alias("mid")))
        reached = assigned.join(nodes.toDF("target", "dst"), "target")
        targets = targets.unionByName(reached.select(F.lit("async").alias("kind"), "field", "dst", F.col("target").alias("sub")))
    return Steps(direct, late, targets)


def search_edges(graph: Graph, allow_indirect: bool = True, with_async: bool = True, supplement: DataFrame | None = None) -> DataFrame:
    """search_steps() multiplied out: (src, dst, kind, call_line, ord, sub, mid, via)."""
    return search_steps(graph, allow_indirect, with_async, supplement).edges()


def bridge_pairs(graph: Graph, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of names -> (a, b, bridge_type, bridge_entity, init_func) that an assignment bridges; async ahead of function pointers.

    A function assigned to a field whose name holds "func" is deferred work, "ops" a table of function pointers.
    """
    fields = identity.by_id(graph.entities, "name").select(F.col("id").alias("head"), F.lower("name").alias("field"))
    targets = identity.by_id(graph.of("FUNCTION"), "name").select(F.col("id").alias("tail"), F.col("name").alias("b"))
    kinds = graph.rel("ASSIGNED_TO").select("head", "tail").join(fields, "head").join(targets, "tail")
    kinds = kinds.groupBy("b").agg(F.max(F.contains("field", F.lit("func"))).alias("is_async"), F.max(F.contains("field", F.lit("ops"))).alias("is_ops")).where("is_async OR is_ops")
    # How a bridge is reported.
    return pairs.join(kinds, "b").select(
        "a", "b",
        F.when(F.col("is_async"), "async").otherwise("function_pointer").alias("bridge_type"),
        F.when(F.col("is_async"), "work_struct.func").otherwise("ops").alias("bridge_entity"),
        F.when(F.col("is_async"), "INIT_WORK/INIT_DELAYED_WORK").alias("init_func"),
    )
