"""The graph model laid over the driver's star tables.

Parts are functions, a quarter of them declarations; consecutive parts of an
order call each other, through the next part's brand (a field) where the item
was returned; brands are assigned the parts of size 1. Named by p_name, parts
are heavy homonyms; named by key, a tenth of them defer work, and every caller's
text hands such a callee the callee's brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens import schema, tables
from graphlens.schema import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fit(df: DataFrame, fields: str) -> DataFrame:
    known = df.sparkSession.createDataFrame([], fields).schema
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in known])


def brand_field(brand) -> object:
    """Brand#k -> a field's name; thirds of the brands sound like tables of functions and like work."""
    number = F.substring(brand, 7, 9).cast("int")
    return F.concat(F.lit("Brand_"), number.cast("string"), F.when(number % 3 == 0, "_ops").when(number % 3 == 1, "_func").otherwise(""))


def unique_name(key) -> object:
    return F.concat(F.when(key % 10 == 7, F.lit("queue_work_")).otherwise("fn_"), key.cast("string"))


def item_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(head, next, call_line, flag, ord): consecutive items of an order."""
    items = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = items.select("l_partkey", F.lead("l_partkey").over(order).alias("next"), "l_linenumber", "l_returnflag", (F.col("l_orderkey") * 1000 + F.row_number().over(order)).alias("ord"))
    return rows.where("next IS NOT NULL AND next != l_partkey").select(F.col("l_partkey").alias("head"), "next", F.col("l_linenumber").alias("call_line"), F.col("l_returnflag").alias("flag"), "ord")


def part_graph(spark: SparkSession, sf_dir: str, unique: bool, stored: bool = False) -> Graph:
    """stored: the calls are written once, for plans that read them several times; nothing else is."""
    part = table(spark, sf_dir, "part")
    part = tables.merging(part, part.count())
    calls = item_calls(spark, sf_dir)
    if stored:
        calls = tables.stored(calls, "item-calls")
    key = F.col("p_partkey")
    functions = part.select(
        key.cast("string").alias("id"), (unique_name(key) if unique else F.col("p_name")).alias("name"), F.lit("FUNCTION").alias("type"), (key % 4 == 0).alias("is_declaration"),
        F.concat(F.lit("src/"), F.lower("p_type"), F.lit(".c")).alias("source_file"), key.alias("ord"), "p_partkey",
    )
    if unique:
        handed = calls.where("flag != 'R' AND next % 10 = 7").select("head", "next").distinct().join(part.select(key.alias("next"), brand_field(F.col("p_brand")).alias("f")), "next")
        line = F.concat(unique_name(F.col("next")), F.lit("(&dev->"), "f", F.lit(", 0);"))
        text = handed.select("head", line.alias("line")).groupBy(F.col("head").alias("p_partkey")).agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("code"))
        functions = functions.join(text, "p_partkey", "left")
    else:
        functions = functions.withColumn("code", F.concat("name", F.lit("();")))
    brands = part.select("p_brand").distinct()
    fields = brands.select(F.col("p_brand").alias("id"), brand_field(F.col("p_brand")).alias("name"), F.lit("FIELD").alias("type"), F.substring("p_brand", 7, 9).cast("long").alias("ord"))
    sizes = part.select("p_size").distinct()
    variables = sizes.select(F.concat(F.lit("var_"), "p_size").alias("id"), F.concat(F.lit("size"), "p_size").alias("name"), F.lit("VARIABLE").alias("type"), F.col("p_size").cast("long").alias("ord"))
    structs = part.select("p_type").distinct().select(F.concat(F.lit("struct_"), "p_type").alias("id"), F.lower("p_type").alias("name"), F.lit("STRUCT").alias("type"), F.lit(0).cast("long").alias("ord"))
    entities = _fit(functions, schema.ENTITY)
    for more in (fields, variables, structs):
        entities = entities.unionByName(_fit(more, schema.ENTITY))
    entities = entities.withColumn("is_declaration", F.coalesce("is_declaration", F.lit(False)))

    direct = calls.where("flag != 'R'").select(F.col("head").cast("string").alias("head"), F.col("next").cast("string").alias("tail"), "call_line", F.lit("direct").alias("call_type"), F.lit("FUNCTION").alias("target_type"), "ord")
    target = part.select(key.alias("next"), "p_brand", "p_type")
    through = calls.where("flag = 'R'").join(target, "next").select(
        F.col("head").cast("string").alias("head"), F.col("p_brand").alias("tail"), "call_line", F.lit("indirect").alias("call_type"), F.lit("FIELD").alias("target_type"),
        F.array(F.col("p_type"), brand_field(F.col("p_brand"))).alias("field_path"), "ord")
    relations = _fit(direct, schema.RELATION).unionByName(_fit(through, schema.RELATION)).withColumn("type", F.lit("CALLS"))
    small = part.where("p_size = 1").select(F.col("p_brand").alias("head"), key.cast("string").alias("tail"), F.lit("ASSIGNED_TO").alias("type"), F.col("p_type").alias("context_var_name"), key.alias("ord"))
    held = part.select(key.cast("string").alias("head"), F.concat(F.lit("var_"), "p_size").alias("tail"), F.lit("CONTAINS").alias("type"), key.alias("ord"))
    typed = part.select(F.concat(F.lit("var_"), "p_size").alias("head"), F.concat(F.lit("struct_"), "p_type").alias("tail"), F.lit("TYPE_OF").alias("type")).distinct()
    for more in (small, held, typed):
        relations = relations.unionByName(_fit(more, schema.RELATION))
    relations = relations.withColumn("field_path", F.coalesce("field_path", F.array().cast("array<string>")))
    return Graph(entities, relations)


#: DuckDB's side of the same derivation, as common table expressions.
SQL = """
items AS (
  SELECT l_partkey AS head, l_linenumber AS call_line, l_returnflag AS flag,
         lead(l_partkey) OVER w AS nxt, l_orderkey * 1000 + row_number() OVER w AS ord
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
calls AS (SELECT head, nxt, call_line, flag, ord FROM items WHERE nxt IS NOT NULL AND nxt <> head),
brands AS (
  SELECT p_brand, 'Brand_' || substr(p_brand, 7) || CASE substr(p_brand, 7)::INT % 3 WHEN 0 THEN '_ops' WHEN 1 THEN '_func' ELSE '' END AS field
  FROM (SELECT DISTINCT p_brand FROM part)),
fn AS (
  SELECT p_partkey AS k, p_partkey::VARCHAR AS id, p_name AS hname,
         CASE WHEN p_partkey % 10 = 7 THEN 'queue_work_' ELSE 'fn_' END || p_partkey AS uname,
         p_partkey % 4 = 0 AS is_decl, p_brand, field, p_type, p_size
  FROM part JOIN brands USING (p_brand)),
impl AS (SELECT hname, min(k) AS k FROM fn WHERE NOT is_decl GROUP BY hname),
canon AS (SELECT fn.k, impl.k AS canon FROM fn JOIN impl USING (hname) WHERE is_decl),
equiv AS (
  SELECT k, k AS eq FROM fn UNION SELECT k, canon FROM canon UNION SELECT canon, k FROM canon),
assigned AS (SELECT field, k FROM fn WHERE p_size = 1),
last AS (SELECT hname, max(k) AS k FROM fn GROUP BY hname),
uedges AS (
  SELECT head AS src, nxt AS dst, 'direct' AS kind, call_line, ord, '' AS sub, NULL::BIGINT AS mid FROM calls WHERE flag <> 'R'
  UNION ALL
  SELECT c.head, a.k, 'indirect', c.call_line, c.ord, ua.uname, NULL
  FROM calls c JOIN fn n ON n.k = c.nxt JOIN assigned a ON a.field = n.field JOIN fn ua ON ua.k = a.k WHERE c.flag = 'R'
  UNION ALL
  SELECT c.head, a.k, 'async', c.call_line, c.ord, ua.uname, c.nxt
  FROM calls c JOIN fn n ON n.k = c.nxt JOIN assigned a ON a.field = n.field JOIN fn ua ON ua.k = a.k
  WHERE c.flag <> 'R' AND c.nxt % 10 = 7 AND a.k <> c.head AND a.k <> c.nxt)
"""
