"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every row gets a hash-random key. Within its source, rows are ordered by key;
a source's key space is cut into ranges of a few thousand rows (keys are
uniform, so equal ranges hold equal shares and a source with a third of all
rows becomes many ranges). Sums of the ranges are prefix-summed, then the rows
inside each range, and a source is cut at exactly its budget: a row before the
cut is taken whole, the row across it in part. A budget above the source's
size takes the source whole once for each full epoch first.

Defined cases: null sources form one source, ordered last; null or empty
texts have size 0 and are taken 0 times; a null doc_id is keyed by the text's md5;
rows of equal key are ordered by doc_id, size and a hash of the text; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm import common

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST_EPOCHS = 1.5, 2.0
#: Rows that one range of a source holds on average.
RANGE_ROWS = 8192
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """sizes (source, n, source_size), a row for each source -> plus target.

    Water filling: sources in order of cap over weight stop at their cap while
    the level that the rest could share is above it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * F.lit(most)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("w", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    leveled = ranked.withColumn("level", level)
    shared = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)
    target = F.when(shared.isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("w") * shared["level"])
    return leveled.select("source", "n", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(doc_id, text, source) -> doc_id, size, source_size, target, taken, source."""
    return _mixed(docs, seed, weights, share, most).drop("mark")


def _mixed(docs: DataFrame, seed: str, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """mix_sources() with mark, a hash of the text."""
    key = common.hash_key(F.coalesce(F.col("doc_id").cast("string"), F.md5("text")), seed)
    sized = common.stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), F.xxhash64("text").alias("mark")), "mix-sizes")
    per_source = targets(sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, share, most)
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(RANGE_ROWS)))).cast("int")
    plan = per_source.select(F.col("source").alias("of"), "source_size", "target", F.floor("target").alias("budget"), F.pow(F.lit(2), 60 - bits).cast("long").alias("width"))
    keyed = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("range", F.expr("key div width"))
    ahead = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = keyed.groupBy("of", "range").agg(F.sum("size").alias("held")).select(F.col("of").alias("of_"), F.col("range").alias("range_"), F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("base"))
    rows = keyed.join(ranges, F.col("of").eqNullSafe(F.col("of_")) & (F.col("range") == F.col("range_")))
    within = Window.partitionBy("of", "range").orderBy("key", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.col("budget") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.greatest(rest - start, F.lit(0)), F.col("size"))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "mark")


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself, with docs' columns: each document as often as it is taken whole, then cut after its last taken word.

    Rows that share doc_id, source and text stand together in a source's order, so at
    most one such group of a source lies across its cut; its rows are told apart by a
    hash of all their columns. Columns of any name come back as they were, but for text
    and n_chars of a cut copy.
    """
    keys = ["id", "of", "origin", "mark"]
    plan = common.stored(_mixed(docs, seed).select(F.col("doc_id").alias("id"), F.col("size").alias("of"), F.col("source").alias("origin"), "mark", "taken"), "mix-plan")
    groups = plan.groupBy(*keys).agg(F.min("taken").alias("least"), F.max("taken").alias("taken"))
    even, uneven = groups.where("least = taken AND taken > 0").drop("least"), common.stored(groups.where("least < taken").select(*keys), "uneven")
    found = docs.select(F.struct(*docs.columns).alias("row"), word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("hash"))  # no name can clash inside

    rows = found.join(even, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("words") == F.col("of")) & F.col("row.source").eqNullSafe(F.col("origin")) & (F.col("hash") == F.col("mark"))).select("row", "words", "taken")
    if not uneven.isEmpty():  # a group for each source at most
        apart = F.broadcast(uneven)
        of = apart.select(F.col("id").alias("g1"), F.col("of").alias("g2"), F.col("origin").alias("g3"), F.col("mark").alias("g4"))
        member = lambda a, b, c, d: a.eqNullSafe(F.col("g1")) & (b == F.col("g2")) & c.eqNullSafe(F.col("g3")) & (d == F.col("g4"))
        group = ["g1", "g2", "g3", "g4"]
        split = plan.join(of, member(F.col("id"), F.col("of"), F.col("origin"), F.col("mark"))).withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("taken")))).select(F.struct(*group, "r").alias("at"), "taken")
        own = found.join(of, member(F.col("row.doc_id"), F.col("words"), F.col("row.source"), F.col("hash")))
        own = own.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64("row"), F.to_json("row")))).select("row", "words", F.struct(*group, "r").alias("place"))
        rows = rows.unionByName(own.join(split, F.col("place").eqNullSafe(F.col("at"))).where("taken > 0").select("row", "words", "taken"))
    copies = rows.select("row", "words", F.explode(F.expr("transform(sequence(0, cast((taken - 1) div words as int)), i -> least(words, taken - i * words))")).alias("take"))
    # pieces that begin where a word begins, each with the blanks after it; blanks ahead of the first word are one more
    text, whole = F.col("row.text"), F.col("take") == F.col("words")
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    lead = text.rlike(r"^[\x20\x09-\x0D]").cast("int")
    head = F.array_join(F.slice(parts, F.lit(1), F.col("take").cast("int") + lead), "")
    cut = copies.select("row", whole.alias("whole"), F.when(whole, text).otherwise(head).alias("text"))
    own = {c: F.col("row")[c] for c in docs.columns}
    own["text"] = F.col("text")
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("whole"), own["n_chars"]).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[c.alias(name) for name, c in own.items()])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
ranked AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM sources),
leveled AS (
  SELECT *, ((SELECT sum(source_size)::BIGINT FROM ranked) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / ((SELECT sum(w) FROM ranked)
             - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size,
         CASE WHEN ratio <= level THEN cap ELSE w * (SELECT arg_min(level, ratio) FROM leveled WHERE ratio > level) END AS target
  FROM leveled),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0
             THEN (budget // source_size) * size + least(greatest(budget - (budget // source_size) * source_size - start, 0), size)
             ELSE 0 END)::BIGINT AS taken, source
FROM placed
"""
