"""Which subgraph a text is about."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Subgraphs at most.
MOST_SUBGRAPHS = 10_000
#: Score of a subgraph whose name is in the text.
NAMED = 10


def subgraph_scores(texts: DataFrame, metadata: DataFrame) -> DataFrame:
    """(text_id, text) x (subgraph, keywords) -> (text_id, subgraph, score): NAMED if the text holds the name, else its number of keywords."""
    lower = F.lower("text")

    def score(s):
        hits = F.size(F.filter(s["keywords"], lambda k: F.contains(F.col("lower"), F.lower(k))))
        return F.struct(s["subgraph"].alias("subgraph"), F.when(F.contains(F.col("lower"), F.lower(s["subgraph"])), NAMED).otherwise(F.coalesce(F.greatest(hits, F.lit(0)), F.lit(0))).alias("score"))

    # subgraphs are folders, few by nature: gathered into one row, they go with each text instead of being multiplied with all
    listed = metadata.select("subgraph", "keywords").limit(MOST_SUBGRAPHS + 1).collect()
    if len(listed) > MOST_SUBGRAPHS:
        raise ValueError(f"over {MOST_SUBGRAPHS} subgraphs")
    known = F.from_json(F.lit(json.dumps([r.asDict() for r in listed])), "array<struct<subgraph:string,keywords:array<string>>>")
    # scored inside the text's own row: no text is copied for a subgraph
    return texts.select("text_id", lower.alias("lower")).select("text_id", F.explode(F.transform(known, score)).alias("s")).select("text_id", "s.*")


def select_subgraphs(texts: DataFrame, metadata: DataFrame, k: int = 1) -> DataFrame:
    """The k best of each text, ties by name; the first k names where nothing scores."""
    scores = subgraph_scores(texts, metadata)
    best = F.max("score").over(Window.partitionBy("text_id"))
    rank = F.row_number().over(Window.partitionBy("text_id").orderBy(F.desc("score"), "subgraph"))
    return scores.withColumn("best", best).where("score > 0 OR best = 0").withColumn("rank", rank).where(F.col("rank") <= k).select("text_id", "rank", "subgraph", "score")


def function_texts(names: DataFrame) -> DataFrame:
    """(text_id, names array) -> texts of names joined by blanks."""
    return names.select("text_id", F.array_join("names", " ").alias("text"))


def answered(selected: DataFrame, answers: DataFrame, metadata: DataFrame, k: int) -> DataFrame:
    """select_subgraphs()' choice, replaced where a model's answers (text_id, names) hold known names."""
    said = answers.select("text_id", F.posexplode("names").alias("p", "subgraph")).join(metadata.select("subgraph").distinct(), "subgraph", "left_semi")
    told = said.groupBy("text_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("p", "subgraph"))), 1, k)["subgraph"].alias("names"))
    own = selected.join(told.select("text_id"), "text_id", "left_anti")
    return own.unionByName(told.select("text_id", F.posexplode("names").alias("p", "subgraph")).select("text_id", (F.col("p") + 1).alias("rank"), "subgraph", F.lit(None).cast("int").alias("score")))


def valid_names(answer: Column, known: Column, k: int) -> Column:
    """A model's subgraph names: those that are known, in its order, the first k."""
    return F.slice(F.filter(answer, lambda x: F.array_contains(known, x)), 1, k)
