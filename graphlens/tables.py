"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

#: A side is broadcast only if its counted rows and their measured bytes stay under these.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Rows under which joinable() broadcasts; several of its tables are held by the driver at once.
JOINABLE_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset and there is no cluster; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "/tmp/checkpoints/graphlens"
        warnings.warn(f"spark.checkpoint.dir is unset; using {found}", stacklevel=2)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_held: dict[str, list[str]] = {}  # by application, what stored() wrote


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> int:
    """Delete every table that stored() wrote in this application, once no result of it is read any more; how many there were."""
    paths = _held.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _held.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


def stored_counting(df: DataFrame, tag: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """stored(), and what aggregates over the rows came to while they were written."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), tag)
    return out, {name: seen.get[name] or 0 for name in metrics}


def together(spark: SparkSession, *works: Callable[[], object]) -> list:
    """What some functions return that don't need each other; their jobs run side by side, so small ones fill each other's gaps."""
    with ThreadPoolExecutor(len(works)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(work)) for work in works]
        return [job.result() for job in jobs]


def stored_together(**dfs: DataFrame) -> dict[str, DataFrame]:
    """Each of some tables stored() under its name, together()."""
    spark = next(iter(dfs.values())).sparkSession
    return dict(zip(dfs, together(spark, *[partial(stored, df, tag) for tag, df in dfs.items()])))


def dropped(df: DataFrame) -> None:
    """Delete a table made by stored() that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)
        held = _held.get(df.sparkSession.sparkContext.applicationId, [])
        if path in held:
            held.remove(path)


def _width(df: DataFrame) -> tuple[int, list[Column]]:
    """(bytes of a row's fixed columns, bytes of each other column)."""
    fixed, more = 0, []
    for field in df.schema.fields:
        name = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            more.append(F.octet_length(name))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            more.append(F.octet_length(F.to_json(F.struct(name))))
        else:
            fixed += 8
    return fixed, [F.coalesce(c, F.lit(0)).cast("long") for c in more]


def small(df: DataFrame, rows: int | None = None, limit: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows and measured bytes stay under the limits; else as it is, for a shuffled join.

    rows: their number, where it is known.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    fixed, more = _width(df)
    if rows is None or (more and rows <= limit):
        held = reduce(lambda a, b: a + b, more, F.lit(0).cast("long"))
        rows, held = df.agg(F.count("*"), F.sum(held)).first()
    else:
        held = 0
    return F.broadcast(df) if rows <= limit and rows * fixed + (held or 0) <= BROADCAST_BYTES else df


def merging(df: DataFrame, rows: int) -> DataFrame:
    """df of so many rows; beyond JOINABLE_ROWS no join broadcasts it, which Spark would do where its file, or that of what it is read from, is small."""
    return df.hint("merge") if rows > JOINABLE_ROWS else df


def joinable(df: DataFrame) -> DataFrame:
    """small() with JOINABLE_ROWS; a larger table is never broadcast, however small its file is, as a driver holds several times that."""
    out = small(df, limit=JOINABLE_ROWS)
    return out if out is not df else df.hint("merge")
