"""An extension: log files matched as they arrive, with the operators of the batch side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.functions import logs as L
from graphlens.operators import templates


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, text) of files as they arrive in a folder."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return files.select(F.input_file_name().alias("log_id"), F.col("value").alias("text"))


def parsed_stream(logs: DataFrame) -> DataFrame:
    """The generic parse of each log; stateless."""
    return logs.select("log_id", *L.parsed(F.col("text")))


def matched_stream(logs: DataFrame, messages: DataFrame) -> DataFrame:
    """Lines of each log with the templates they match: a stream joined with a table."""
    return templates.match_lines(templates.log_lines(logs), messages)
