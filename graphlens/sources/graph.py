"""Graph sources: JSON in two layouts, one folder for each subgraph, or tables of any Spark format."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens import schema
from graphlens.schema import Graph

# File name parts of the separated layout.
ENTITY_FILES = ("function", "struct", "variable", "field", "file")
RELATION_FILES = ("calls", "contains", "typeof", "assignedto", "has_members", "returns", "has_parameters", "has_variables", "includes")
RELATION_TYPES = {"typeof": "TYPE_OF", "assignedto": "ASSIGNED_TO"}

# a record's keys that are read; each is taken as text and cast by itself, so one odd value loses no other
_ENTITY_KEYS = ("id", "name", "type", "entity_type", "kind", "is_declaration", "source_file", "file", "start_line", "end_line", "code", "body", "scope")
_RELATION_KEYS = (
    "head", "tail", "type", "relation_type", "call_line", "call_type", "target_type", "field_path", "context_var_id", "context_var_name",
    "resolution_type", "visibility_checked", "source", "target",
)
_KINDS = {"is_declaration": "boolean", "visibility_checked": "boolean", "start_line": "int", "end_line": "int", "call_line": "int"}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _records(spark: SparkSession, path: str, separate: bool = False) -> DataFrame:
    """(ord, group, record): a JSON file's records as text. Layouts: a list; an object of lists by type; of records by id (separate files).

    A list inside an object's odd place, or an object where a list should be, gives no records.
    """
    listed = lambda text: F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    text = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("value"))
    lists, objects = F.col("value").startswith("["), F.col("value").startswith("{")
    flat = text.where(lists).select(F.lit(0).cast("long").alias("g"), none.alias("group"), F.posexplode(listed(F.col("value"))).alias("p", "record"))
    entries = text.where(objects).select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("g", "e"))
    if separate:
        keyed = entries.select(F.lit(0).cast("long").alias("g"), none.alias("group"), F.col("g").alias("p"), F.col("e.value").alias("record"))
    else:
        keyed = entries.select(F.col("g").cast("long").alias("g"), F.col("e.key").alias("group"), F.posexplode(listed(F.col("e.value"))).alias("p", "record"))
    return flat.unionByName(keyed).select((F.col("g") * F.lit(1 << 40) + F.col("p")).alias("ord"), "group", F.trim("record").alias("record"))


def _is_record() -> Column:
    return F.coalesce(F.col("record").startswith("{"), F.lit(False))


def _rows(spark: SparkSession, path: str, keys: tuple[str, ...], separate: bool = False) -> DataFrame:
    """The records that are objects, with their position; values that don't fit their kind are null."""
    parsed = _records(spark, path, separate).where(_is_record()).select("ord", "group", F.from_json("record", ", ".join(f"`{k}` string" for k in keys)).alias("r"))
    out = {"ord": F.col("ord"), "group": F.col("group")}
    for k in keys:
        value = F.col("r")[k]
        if k == "field_path":
            value = F.when(value.startswith("["), F.from_json(value, "array<string>"))
        out[k] = value.try_cast(_KINDS[k]) if k in _KINDS else value
    return parsed.select(*[c.alias(name) for name, c in out.items()])


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, record) of what load_graph() skips in a folder: records that are no objects, and entities without a name."""
    out = spark.createDataFrame([], "file string, ord long, record string")
    merged = exists(spark, f"{path}/entity.json") and exists(spark, f"{path}/relation.json")
    names = ["entity", "relation"] if merged else [f"entity_{x}" for x in ENTITY_FILES] + [f"relation_{x}" for x in RELATION_FILES]
    for name in names:
        if exists(spark, f"{path}/{name}.json"):
            named = F.get_json_object("record", "$.name").isNotNull() if name.startswith("entity") else F.lit(True)
            odd = _records(spark, f"{path}/{name}.json", not merged).where(~(_is_record() & named))
            out = out.unionByName(odd.select(F.lit(f"{name}.json").alias("file"), "ord", "record"))
    return out


def entities_of(rows: DataFrame, kind: Column | None = None) -> DataFrame:
    """Raw records -> entities: rows without a name go; types upper-cased; file and source_file stand in for each other."""
    kind = F.coalesce(*([kind] if kind is not None else []), F.col("group"), "type", "entity_type", "kind", F.lit("Unknown"))
    out = rows.where("name IS NOT NULL").withColumns({
        "type": F.upper(kind),
        "is_declaration": F.coalesce("is_declaration", F.lit(False)),
        "file": F.coalesce("file", "source_file"),
        "id": F.coalesce("id", "name"),
    })
    return out.select(*schema.ENTITY_COLUMNS)


def relations_of(rows: DataFrame, kind: Column | None = None) -> DataFrame:
    """Raw records -> relations: older source/target keys stand in for head/tail."""
    kind = F.coalesce(*([kind] if kind is not None else []), F.col("group"), "type", "relation_type", F.lit("UNKNOWN"))
    out = rows.withColumns({
        "type": F.upper(kind),
        "head": F.coalesce("head", "source"),
        "tail": F.coalesce("tail", "target"),
        "call_type": F.coalesce("call_type", F.lit("direct")),
        "target_type": F.coalesce("target_type", F.lit("FUNCTION")),
        "field_path": F.coalesce("field_path", F.array().cast("array<string>")),
        "context_var_id": F.coalesce("context_var_id", F.lit("N/A")),
        "context_var_name": F.coalesce("context_var_name", F.lit("N/A")),
    })
    return out.select(*schema.RELATION_COLUMNS)


def load_graph(spark: SparkSession, path: str) -> Graph:
    """Merged layout if entity.json and relation.json are both there, else one file for each type (missing ones are skipped).

    A record that is no object, or an entity without a name, is skipped alone (see
    rejected()). A JSON file is read whole by one task; graphs beyond that are
    kept as tables (load_tables, or write_tables once).
    """
    if exists(spark, f"{path}/entity.json") and exists(spark, f"{path}/relation.json"):
        return Graph(entities_of(_rows(spark, f"{path}/entity.json", _ENTITY_KEYS)), relations_of(_rows(spark, f"{path}/relation.json", _RELATION_KEYS)))
    entities, relations = spark.createDataFrame([], schema.ENTITY), spark.createDataFrame([], schema.RELATION)
    for n, part in enumerate(ENTITY_FILES):
        if exists(spark, f"{path}/entity_{part}.json"):
            rows = _rows(spark, f"{path}/entity_{part}.json", _ENTITY_KEYS, separate=True).withColumn("ord", F.col("ord") + (n << 40))
            entities = entities.unionByName(entities_of(rows, F.lit(part)))
    for n, part in enumerate(RELATION_FILES):
        if exists(spark, f"{path}/relation_{part}.json"):
            rows = _rows(spark, f"{path}/relation_{part}.json", _RELATION_KEYS, separate=True).withColumn("ord", F.col("ord") + (n << 40))
            relations = relations.unionByName(relations_of(rows, F.lit(RELATION_TYPES.get(part, part))))
    return Graph(entities, relations)


def load_tables(spark: SparkSession, entities: str, relations: str, fmt: str = "parquet", subgraph: str | list[str] | None = None) -> Graph:
    """Graph tables of any Spark format, for graphs beyond one file; subgraph prunes partitions of those names."""
    wanted = [subgraph] if isinstance(subgraph, str) else subgraph

    def read(path: str, fields: str) -> DataFrame:
        reader = spark.read.format(fmt)
        df = (reader.schema(fields) if fmt == "json" else reader).load(path)
        if wanted is not None:
            df = df.where(F.col("subgraph").isin(*wanted))
        have = set(df.columns)
        known = spark.createDataFrame([], fields).schema
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in known])

    return Graph(read(entities, schema.ENTITY), read(relations, schema.RELATION))


def write_tables(graph: Graph, base: str, subgraph: str) -> None:
    """A graph as a partition of the tables base/entities and base/relations, for load_tables()."""
    for name, df in (("entities", graph.entities), ("relations", graph.relations)):
        df.withColumn("subgraph", F.lit(subgraph)).write.mode("append").partitionBy("subgraph").parquet(f"{base}/{name}")


def write_subgraphs(graph: Graph, base: str, of: DataFrame) -> None:
    """A graph as one partition for each of its subgraphs, in one write: of (id, subgraph) places entities; an entity without a row is in all.

    A relation is in each subgraph that both its ends are in.
    """
    names = F.broadcast(of.select(F.col("subgraph").alias("name_")).distinct())  # one row for each subgraph
    own = of.select(F.col("id").alias("own_id"), F.col("subgraph").alias("own"))
    entities = graph.entities.join(own, F.col("id") == F.col("own_id"), "left").drop("own_id")
    placed = entities.where("own IS NOT NULL").withColumnRenamed("own", "subgraph")
    every = entities.where("own IS NULL").drop("own").crossJoin(names).withColumnRenamed("name_", "subgraph")
    ends = graph.relations.join(own.toDF("head_id", "a"), F.col("head") == F.col("head_id"), "left").join(own.toDF("tail_id", "b"), F.col("tail") == F.col("tail_id"), "left").drop("head_id", "tail_id")
    inside = ends.where("a = b OR a IS NULL AND b IS NOT NULL OR a IS NOT NULL AND b IS NULL").withColumn("subgraph", F.coalesce("a", "b")).drop("a", "b")
    shared = ends.where("a IS NULL AND b IS NULL").drop("a", "b").crossJoin(names).withColumnRenamed("name_", "subgraph")
    for name, df in (("entities", placed.unionByName(every)), ("relations", inside.unionByName(shared))):
        df.repartition("subgraph", F.pmod(F.xxhash64("ord"), F.lit(16))).write.mode("overwrite").partitionBy("subgraph").parquet(f"{base}/{name}")


def default_base(spark: SparkSession) -> str | None:
    """Where graphs are if no folder is given: spark.graphlens.dataDir, else KG_DATA_DIR."""
    return spark.conf.get("spark.graphlens.dataDir", None) or os.environ.get("KG_DATA_DIR")


def load_any(spark: SparkSession, base: str, names: list[str] | None = None) -> Graph:
    """The graph under base: its tables, its own files, or its subgraphs' folders together; with names only those subgraphs are read.

    Rows keep their order inside a subgraph, and subgraphs follow each other by name.
    """
    if exists(spark, f"{base}/entities") and exists(spark, f"{base}/relations"):
        return load_tables(spark, f"{base}/entities", f"{base}/relations", subgraph=names)
    folders = subgraphs(spark, base).collect()
    if not folders:
        return load_graph(spark, base)
    parts = [(n, load_graph(spark, r["path"])) for n, r in enumerate(folders) if names is None or r["subgraph"] in names]
    if not parts:
        raise ValueError(f"no subgraph of {base} is among {names}")
    moved = lambda df, n: df.withColumn("ord", F.col("ord") + F.lit(n << 50))
    return Graph(reduce(DataFrame.unionByName, [moved(g.entities, n) for n, g in parts]), reduce(DataFrame.unionByName, [moved(g.relations, n) for n, g in parts]))


def subgraphs(spark: SparkSession, base: str) -> DataFrame:
    """Child folders that hold an entity or relation file: (subgraph, path), sorted."""
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    if fs.exists(root):
        for status in fs.listStatus(root):
            path = status.getPath().toString()
            if status.isDirectory() and any(exists(spark, f"{path}/{n}.json") for n in ("entity", "relation")):
                rows.append((status.getPath().getName(), path))
    return spark.createDataFrame(sorted(rows), "subgraph string, path string").orderBy("subgraph")


def subgraph_names(spark: SparkSession, base: str) -> DataFrame:
    """(subgraph) of the folders, or of the tables' partitions."""
    if exists(spark, f"{base}/entities"):
        return spark.read.parquet(f"{base}/entities").select("subgraph").distinct()
    return subgraphs(spark, base).select("subgraph")


def subgraph_path(spark: SparkSession, base: str, name: str) -> str | None:
    row = subgraphs(spark, base).where(F.col("subgraph") == name).first()
    return row["path"] if row else None


def register(graph: Graph, prefix: str = "") -> None:
    """Temp views over the graph, so that any SQL can query it."""
    graph.entities.createOrReplaceTempView(f"{prefix}entities")
    graph.relations.createOrReplaceTempView(f"{prefix}relations")
