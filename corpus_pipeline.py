"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns documents' columns; the last adds slot and shard. Between
stages documents are written to the shared folder and read again.

Defined cases, in every stage: an empty table gives an empty table; columns of any
name come back as they were (the last stage replaces slot and shard); null and
empty texts are accepted by the classifier's score, are nobody's copies and hold
no test item, and the mix takes them 0 times, as they have no words; rows that
share a doc_id, or have none, are judged each by its own text, and of rows with
the same doc_id and text one stays, the first by its columns as JSON; of equal copies the one with the smallest
doc_id stays; texts are read whole, however long.

SQL can't express the classifier, so there is no SQL for run().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm import common, decontam, mixing, neardup, sharding, toxicity

ORACLE_SQL = None


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    (before,) = common.unused(docs, "score_before")
    scored = toxicity.score(docs.withColumnRenamed("score", before), model)
    kept = scored.where(F.col("score") < toxicity.THRESHOLD).drop("score").withColumnRenamed(before, "score")
    return kept.select(*docs.columns)


def _rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """((key, row, text) of docs, whether ids are shared): key is doc_id where a row has it alone, else a hash of doc_id and text; row holds docs' columns.

    Rows without a doc_id share one; blank ones of them have no key.
    """
    boxed = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*docs.columns).alias("row"))
    shared = common.stored(boxed.groupBy("id").count().where("count > 1 OR id IS NULL").select("id"), "shared-ids")
    n = shared.count()
    if not n:
        return boxed.select(F.col("id").alias("key"), "row", "text"), False
    hashed = F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 62))
    worded = F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    key = F.when(F.col("id").isNull(), F.when(worded, hashed)).when(F.col("shared"), hashed).otherwise(F.col("id"))
    marks = common.small(shared.where("id IS NOT NULL").withColumn("shared", F.lit(True)), n)
    return boxed.join(marks, "id", "left").select(key.alias("key"), "row", "text"), True


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; of rows that share doc_id and text, one."""
    rows, shared = _rows(docs)
    found = common.stored(neardup.near_duplicates(rows.select(F.col("key").alias("doc_id"), "text")), "near-duplicates")
    found = found.withColumnRenamed("doc_id", "key")
    gone = common.stored(found.where(~F.col("kept")).select("key").distinct(), "gone")
    left = rows.join(common.small(gone), "key", "left_anti")
    if not shared:
        return left.select("row.*")
    again = common.stored(found.where("kept AND key IS NOT NULL").groupBy("key").count().where("count > 1").select("key"), "again")
    if again.isEmpty():
        return left.select("row.*")
    again = common.small(again)
    one = left.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return left.join(again, "key", "left_anti").select("row.*").unionByName(one)


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item's passage."""
    rows, _ = _rows(docs)
    hits = decontam.contaminated(rows.select(F.col("key").alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    gone = common.stored(hits.select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return rows.join(common.small(gone), "key", "left_anti").select("row.*")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, the one across its source's cut in part."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its slot and shard."""
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, name)
    return docs
