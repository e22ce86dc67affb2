"""What the corpus operators share: tables in the cluster's folder, broadcasts behind a size check, hash keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens import tables
from graphlens.tables import dropped, shared_dir, stored  # noqa: F401

#: A side is broadcast only if it has at most so many rows (and tables.BROADCAST_BYTES).
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows and measured bytes stay under the limits; else as it is, for a shuffled join."""
    return tables.small(df, rows, BROADCAST_ROWS)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def matched(rows: DataFrame, side: DataFrame, keys: list[str], spread: str, salts: int = 16) -> DataFrame:
    """Inner join of rows with side, which holds each key once: a broadcast behind a check of side's size.

    Beyond it side is copied under salts and rows are dealt over them by their
    column spread, so a key of very many rows is met in several tasks.
    """
    n = side.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), keys)
    (salt,) = unused(rows.join(side.limit(0), keys), "salt")
    copies = side.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(copies, [*keys, salt]).drop(salt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_key(col: Column, seed: str = "") -> Column:
    """60 random bits from the md5 of a value's text, the same in any SQL engine; null counts as ''."""
    text = F.concat(F.lit(seed), F.coalesce(col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
