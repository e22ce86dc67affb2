"""Log, source and configuration readers; slices of source lines; the report sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Each file's whole text: (log_id, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log_id"), F.col("value").alias("text"))


def read_sources(spark: SparkSession, root: str, pattern: str = "*.[ch]") -> DataFrame:
    """(file, text) of the source files anywhere under a folder, with their paths from there."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    own = F.substring(plain(F.input_file_name()), len(root.rstrip("/")) + 2, (1 << 31) - 1)
    return found.select(own.alias("file"), F.col("value").alias("text"))


def convert_path(path: Column, root: str = "", prefixes: tuple[str, ...] = ()) -> Column:
    """Backslashes become slashes, the first of the prefixes that fits goes, and the root comes first."""
    path = F.translate(path, "\\", "/")
    out = path
    for p in reversed([p.replace("\\", "/") for p in prefixes]):
        out = F.when(path.startswith(p), F.substring(path, len(p) + 1, (1 << 31) - 1)).otherwise(out)
    return F.concat(F.lit(root.rstrip("/") + "/"), out) if root else out


def _lines(text: Column) -> Column:
    """Lines with their line feeds, as a reader of lines gives them."""
    return F.filter(F.split(text, r"(?<=\n)", -1), lambda x: x != "")


def _slice(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "")


def source_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive); null out of range."""
    lines = _lines(text)
    fits = (start >= 1) & (end >= start) & (start <= F.size(lines))
    return F.when(fits, _slice(lines, F.greatest(start, F.lit(1)), F.least(end, F.size(lines))))


def source_with_context(text: Column, start: Column, end: Column, around: int = 10) -> Column:
    """struct(function, before, after, full): the slice and up to so many lines around it."""
    lines = _lines(text)
    n = F.size(lines)
    lo, hi = F.greatest(F.lit(1), start - around), F.least(n, end + around)
    last = F.least(end, n)
    body = F.struct(
        _slice(lines, F.greatest(start, F.lit(1)), last).alias("function"),
        _slice(lines, lo, start - 1).alias("before"),
        _slice(lines, F.greatest(last + 1, F.lit(1)), hi).alias("after"),
        _slice(lines, lo, hi).alias("full"),
    )
    return F.when((start >= 1) & (end >= start) & (start <= n), body)


def read_config(path: str) -> dict:
    """A YAML configuration, on the driver: it is not data."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def scenario(config: dict, name: str) -> dict:
    """A scenario's settings, with its mode: manual if it names both ends, else auto."""
    found = dict(config.get("scenarios", {}).get(name) or {})
    if not found:
        raise KeyError(name)
    found.setdefault("mode", "manual" if found.get("start_func") and found.get("end_func") else "auto")
    return found


def scenarios(config: dict) -> list[tuple[str, str, str]]:
    """(name, mode, description) of a configuration's scenarios, in its order."""
    return [(name, scenario(config, name)["mode"], str((found or {}).get("description") or "")) for name, found in (config.get("scenarios") or {}).items() if found]


def async_settings(config: dict) -> dict:
    """keywords and known of identity.async_functions() from a configuration; what it doesn't name keeps its default."""
    found = config.get("async_call_detection") or {}
    named = {"keywords": found.get("keywords"), "known": found.get("known_async_functions")}
    return {k: tuple(v) for k, v in named.items() if v is not None}


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(subgraph, keywords) of a YAML or JSON file: for each subgraph its keywords, or an object that holds them."""
    rows = [(str(name), [str(k) for k in ((found or {}).get("keywords") or [] if isinstance(found, dict) else found or [])]) for name, found in read_config(path).items()]
    return spark.createDataFrame(rows, "subgraph string, keywords array<string>")


def write_report(report: DataFrame, path: str) -> None:
    """Reports as JSON, a line each."""
    report.write.mode("overwrite").json(path)


def write_report_file(report: DataFrame, path: str) -> None:
    """The one report of a single log as an indented JSON file on the driver."""
    import json
    import os

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    row = report.select(F.to_json(F.struct("*")).alias("j")).first()
    with open(path, "w", encoding="utf-8") as f:
        json.dump(json.loads(row["j"]) if row else {}, f, ensure_ascii=False, indent=2)


def best_path(paths: Column) -> Column:
    """The best path's names of a report's paths; null where there is none."""
    return F.when(F.size(paths) > 0, F.element_at(paths, 1)["path"])
