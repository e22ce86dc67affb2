"""Thin command line: one log or two function names in, one report file out.

    python -m graphlens.cli --data-dir GRAPH --log FILE [--k 5] [--output report.json]
    python -m graphlens.cli --data-dir GRAPH --start-func A --end-func B
    python -m graphlens.cli --base FOLDER --log FILE [--subgraph NAME] [--metadata FILE]
    python -m graphlens.cli --config config.yaml [--scenario NAME]

With --base the log (or the names) choose one of the folder's subgraphs, and only
that is loaded; --subgraph names it instead. A configuration without a scenario
lists its scenarios.
"""

from __future__ import annotations

import argparse
import sys


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="graphlens")
    p.add_argument("--data-dir")
    p.add_argument("--log")
    p.add_argument("--start-func")
    p.add_argument("--end-func")
    p.add_argument("--intermediate-funcs", nargs="*", default=[])
    p.add_argument("--k", type=int, default=5)
    p.add_argument("--max-depth", type=int, default=30)
    p.add_argument("--mode", choices=("exact", "first_k"), default="exact")
    p.add_argument("--direct-only", action="store_true")
    p.add_argument("--base", help="a folder of subgraphs")
    p.add_argument("--subgraph", help="one of --base (or a folder of --data-dir)")
    p.add_argument("--metadata", help="keywords of subgraphs, YAML or JSON")
    p.add_argument("--async-config", help="names of functions that defer work, YAML")
    p.add_argument("--config")
    p.add_argument("--scenario")
    p.add_argument("--output", default="report.json")
    args = p.parse_args(argv)
    if args.config:
        from graphlens.sources import text

        config = text.read_config(args.config)
        args.listed = None if args.scenario or args.log else text.scenarios(config)
        if args.listed is not None:
            return args
        if not args.scenario:
            return _checked(p, args)
        found = text.scenario(config, args.scenario)
        args.data_dir = args.data_dir or config.get("data_dir") or config.get("data", {}).get("data_dir")
        args.log = args.log or found.get("log_file")
        if found["mode"] == "manual":
            args.start_func, args.end_func = found["start_func"], found["end_func"]
            args.intermediate_funcs = found.get("intermediate_funcs") or []
    return _checked(p, args)


def _checked(p: argparse.ArgumentParser, args: argparse.Namespace) -> argparse.Namespace:
    if not (args.log or (args.start_func and args.end_func)):
        p.error("--log or both ends are needed")
    return args


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    from pyspark.sql import SparkSession

    from graphlens import tables
    from graphlens.operators import identity
    from graphlens.plans import analysis
    from graphlens.sources import graph, text

    if getattr(args, "listed", None) is not None:
        for name, mode, description in args.listed:
            print(f"{name}\t{mode}\t{description}")
        return 0 if args.listed else 1
    spark = SparkSession.builder.appName("graphlens").getOrCreate()
    settings = {"k": args.k, "max_depth": args.max_depth, "mode": args.mode, "allow_indirect": not args.direct_only}
    asked = logs = None
    if args.start_func and args.end_func:
        asked = spark.createDataFrame([("0", args.start_func, args.end_func, args.intermediate_funcs)], "log_id string, start_func string, end_func string, intermediate_funcs array<string>")
    else:
        logs = text.read_logs(spark, args.log)
    if args.base and not args.subgraph:
        metadata = text.read_metadata(spark, args.metadata) if args.metadata else None
        report = analysis.analyse_base(spark, args.base, logs, metadata, **settings) if asked is None else analysis.analyse_base_functions(spark, args.base, asked, metadata, **settings)
    else:
        base = args.base or args.data_dir or graph.default_base(spark)
        if not base:
            print("--data-dir, --base, spark.graphlens.dataDir or KG_DATA_DIR is needed", file=sys.stderr)
            return 2
        g = graph.load_any(spark, base, [args.subgraph]) if args.subgraph else graph.load_any(spark, base)
        if args.async_config:
            settings["async_names"] = identity.async_functions(g, **text.async_settings(text.read_config(args.async_config)))
        report = analysis.analyse_functions(g, asked, **settings) if asked is not None else analysis.analyse_logs(g, logs, analysis.messages_for(g), **settings)
    text.write_report_file(report, args.output)
    row = report.select("success").first()
    tables.clear(spark)
    return 0 if row and row["success"] else 1


if __name__ == "__main__":
    sys.exit(main())
