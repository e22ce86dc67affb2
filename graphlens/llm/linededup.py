"""Cross-site boilerplate lines by distinct-site spread (native: SQL functions only).

A HyperLogLog sketch of the sites goes with each line's hash and merges by
partial aggregation, so a line that is everywhere costs one sketch a task.
Lines whose estimate is clearly over the threshold are boilerplate; those near
it get exact distinct counts; the rest stay.

Defined cases: lines are parts between line feeds, compared without spaces,
tabs and carriage returns at either end; blank lines are never removed; a null site is a site of its own;
a null text has no lines and keeps ''; repeated rows act as one site's lines
and each row is returned; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm import common

MIN_SITES = 6
LG_K = 12
#: What is cut from either end of a line before it is compared.
BLANKS = " \t\r"
#: Share of the threshold around it, plus a site, within which estimates are not trusted (six times the sketch's error).
NEAR = 0.1


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """lines (h1, h2, site) -> the (h1, h2) seen on at least min_sites distinct sites."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    spread = common.stored(spread.where(F.col("sites") >= min_sites * (1 - near) - 1), "line-spread")
    high = min_sites * (1 + near) + 1
    close = spread.where(F.col("sites") <= high).select("h1", "h2")
    n = close.count()
    if n > common.BROADCAST_ROWS:  # a line's rows are distinct by site before they meet, so no line is a hot key
        lines = lines.select("h1", "h2", "site").distinct()
    counted = lines.join(common.small(close, n), ["h1", "h2"]).groupBy("h1", "h2").agg(F.countDistinct("site").alias("n"))
    return spread.where(F.col("sites") > high).select("h1", "h2").unionByName(counted.where(F.col("n") >= min_sites).select("h1", "h2"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, text, site) -> doc_id, n_lines, n_removed, text without boilerplate lines."""
    rows = docs.select("doc_id", F.col(site).alias("site"), "text", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("rid"))
    parts = rows.select("doc_id", "rid", F.coalesce(F.concat(F.lit("s"), F.col("site").cast("string")), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    parts = parts.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.col("line") != "")
    lines = common.stored(parts.select("doc_id", "rid", "at", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")), "lines")
    hits = common.matched(lines, common.stored(boilerplate(lines, min_sites), "boilerplate"), ["h1", "h2"], "rid")
    gone = hits.groupBy(F.col("doc_id").alias("id_"), F.col("rid").alias("rid_")).agg(F.collect_set("at").alias("gone"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("rid") == F.col("rid_")), "left")
    split = F.split("text", "\n", -1)
    # the places that stay, by a hash set, then their lines; the outer array binds the split once
    stay = lambda parts: F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    kept = F.transform(F.array(split), lambda parts: F.array_join(F.transform(stay(parts), lambda i: F.get(parts, i)), "\n"))[0]
    return joined.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce(F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept), F.lit("")).alias("text"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT r, coalesce('s' || source, '') AS site, unnest(range(len(parts))) AS pos, trim(unnest(parts), ' ' || chr(9) || chr(13)) AS line FROM split WHERE text IS NOT NULL),
common AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
gone AS (SELECT r, list(pos) AS gone FROM lines JOIN common USING (line) GROUP BY r),
kept AS (
  SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
         coalesce(CASE WHEN gone IS NULL THEN text
              ELSE array_to_string([parts[(i + 1)::INT] FOR i IN range(len(parts)) IF NOT list_contains(gone, i)], chr(10)) END, '') AS kept
  FROM split LEFT JOIN gone USING (r))
SELECT doc_id, n_lines, n_removed, length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256 FROM kept
"""
