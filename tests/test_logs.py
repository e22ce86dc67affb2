"""Logs, templates, subgraph selection, source slices, reports."""

import json

import pytest
from pyspark.sql import functions as F

from graphlens.functions import logs as L
from graphlens.functions import oracle
from graphlens.operators import select, templates
from graphlens.plans import analysis
from graphlens.sources import text
from graphlens.streaming import logs as stream
from tests.test_graph import make, plain

LOG = "\nmmc0: tuning execution failed: -1\nmmc0: error -1 whilst initialising MMC card\n    "


def logs_df(spark, *texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "log_id string, text string")


def test_generic_parse(spark):
    r = logs_df(spark, LOG).select(*L.parsed(F.col("text"))).first()
    assert set(r["error_messages"]) == {"-1", "-1 whilst initialising MMC card", "mmc0: error -1 whilst initialising MMC card"}
    assert (r["error_codes"], r["functions"], r["files"], r["lines"]) == ([-1, -1], [], [], [])
    r = logs_df(spark, "a/b.c:12: in foo_bar (x) -0 7").select(*L.parsed(F.col("text"))).first()
    assert (r["error_codes"], r["functions"], r["files"], r["lines"]) == ([12, 0, 7], ["foo_bar"], ["a/b.c"], [12])
    assert logs_df(spark, None).select(L.error_codes(F.col("text"))).first()[0] is None


def test_templates(spark):
    log = logs_df(spark, "ALL phases bad!\n\n mmc0: tuning execution failed: -1\nmmc0: error -1 whilst initialising MMC card", "mmc is fine", None)
    r = {x["log_id"]: x for x in templates.parse_with_templates(log, templates.fail_messages(spark)).collect()}
    assert r["0"]["functions"] == ["dw_mci_hi3660_execute_tuning", "mmc_execute_tuning", "mmc_attach_mmc"]
    assert [round(m["similarity"], 6) for m in r["0"]["line_matches"]] == [1.0, round(31 / 33, 6), 1.0]
    assert r["0"]["line_matches"][0]["candidates"] == ["dw_mci_hi3660_execute_tuning", "dw_mci_rk3288_execute_tuning"]
    assert r["0"]["inferred_error_point"] == r["0"]["functions"][0] and r["1"]["inferred_error_point"] is None and r["2"]["functions"] == []


def test_selection(spark):
    metadata = spark.createDataFrame([("mmc", ["tuning", "emmc"]), ("net", ["eth", "phy"]), ("usb", ["device"]), ("leds", ["led"])], "subgraph string, keywords array<string>")
    texts = spark.createDataFrame([("a", "mmc0: tuning execution failed"), ("b", "eth0: link is not ready\neth0: failed to bring up PHY"), ("c", "nothing")], "text_id string, text string")
    got = {(r["text_id"], r["rank"]): (r["subgraph"], r["score"]) for r in select.select_subgraphs(texts, metadata, 2).collect()}
    assert got == {("a", 1): ("mmc", 10), ("a", 2): ("leds", 1), ("b", 1): ("net", 2), ("b", 2): ("leds", 1), ("c", 1): ("leds", 0), ("c", 2): ("mmc", 0)}


def test_slices_and_json(spark):
    df = spark.createDataFrame([("1\n2\n3\n4\n5\n",)], "t string")
    one = df.select(text.source_slice(F.col("t"), F.lit(2), F.lit(3)), text.source_slice(F.col("t"), F.lit(6), F.lit(7)), text.source_slice(F.col("t"), F.lit(5), F.lit(9)), text.source_with_context(F.col("t"), F.lit(3), F.lit(3), 1)).first()
    assert (one[0], one[1], one[2], tuple(one[3])) == ("2\n3\n", None, "5\n", ("3\n", "2\n", "4\n", "2\n3\n4\n"))
    path = df.select(text.convert_path(F.lit("E:\\src\\a\\b.c"), "/root", ("E:\\src\\",))).first()[0]
    assert path == "/root/a/b.c"
    said = spark.createDataFrame([("k", 'so: ```json\n{"bridge_entity": "w", "confidence": 0.7}\n```'), ("n", "no json")], "key string, raw string").select("key", oracle.decoded(F.col("raw"), "bridge").alias("a"))
    assert {r["key"]: r["a"] and r["a"]["bridge_entity"] for r in said.collect()}["k"] == "w"


def test_reports(spark, tmp_path):
    g = make(spark, plain("dw_mci_pltfm_probe", "mid", "mmc_execute_tuning"), [("1", "2", 4), ("2", "3", 6)])
    log = logs_df(spark, "mmc0: tuning execution failed: -1", "mmc: no match", "call unknown_fn( here")
    got = {r["log_id"]: r for r in analysis.analyse_logs(g, log, templates.fail_messages(spark), k=2, max_depth=4).collect()}
    assert got["0"]["success"] and got["0"]["best_path"]["path"] == ["dw_mci_pltfm_probe", "mid", "mmc_execute_tuning"] and got["0"]["best_path"]["score"] == 1000 - 3 - 0.05 + 50
    assert not got["1"]["success"] and got["1"]["error"] == analysis.NOT_LOCATED and not got["2"]["success"]
    asked = spark.createDataFrame([("x", "dw_mci_pltfm_probe", "mmc_execute_tuning", ["mid"])], "log_id string, start_func string, end_func string, intermediate_funcs array<string>")
    report = analysis.analyse_functions(g, asked, max_depth=4)
    text.write_report_file(report, str(tmp_path / "r" / "report.json"))
    assert json.loads((tmp_path / "r" / "report.json").read_text())["path_count"] == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("mmc0: tuning execution failed: -1\n")
    q = stream.matched_stream(stream.read_log_stream(spark, str(tmp_path / "in")), templates.fail_messages(spark)).writeStream.format("memory").queryName("matched").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["function"] for r in spark.table("matched").collect()] == ["mmc_execute_tuning"]


def test_command_line(spark, tmp_path):
    from graphlens import cli

    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "entity.json").write_text(json.dumps([{"id": k, "name": n, "type": "FUNCTION"} for k, n in enumerate("abc")]))
    (tmp_path / "g" / "relation.json").write_text(json.dumps([{"head": 0, "tail": 1, "type": "CALLS", "call_line": 2}, {"head": 1, "tail": 2, "type": "CALLS", "call_line": 4}]))
    out = tmp_path / "report.json"
    assert cli.main(["--data-dir", str(tmp_path / "g"), "--start-func", "a", "--end-func", "c", "--max-depth", "4", "--output", str(out)]) == 0
    assert json.loads(out.read_text())["best_path"]["path"] == ["a", "b", "c"]
    assert cli.main(["--data-dir", str(tmp_path / "g"), "--start-func", "c", "--end-func", "a", "--max-depth", "4", "--output", str(out)]) == 1


def test_the_log_chooses_the_only_subgraph_that_is_loaded(spark, tmp_path, monkeypatch):
    from graphlens import cli

    def put(name, names):
        (tmp_path / name).mkdir()
        (tmp_path / name / "entity.json").write_text(json.dumps([{"id": k, "name": n, "type": "FUNCTION"} for k, n in enumerate(names)]))
        (tmp_path / name / "relation.json").write_text(json.dumps([{"head": k, "tail": k + 1, "type": "CALLS", "call_line": 2} for k in range(len(names) - 1)]))

    put("mmc", ["dw_mci_pltfm_probe", "mid", "mmc_execute_tuning"])
    put("usb", ["dw_mci_pltfm_probe", "usb_probe"])
    (tmp_path / "net").mkdir()
    (tmp_path / "net" / "entity.json").write_text("not read, or this would fail")
    (tmp_path / "meta.yaml").write_text("mmc:\n  keywords: [tuning, sd]\nusb: [hub, urb]\ngone: [nothing]\n")
    metadata = text.read_metadata(spark, str(tmp_path / "meta.yaml"))
    logs = logs_df(spark, "host: tuning execution failed: -1 mmc", "the hub lost an urb in usb_probe(")
    chosen = analysis.choose_subgraphs(spark, str(tmp_path), logs.select(F.col("log_id").alias("text_id"), "text"), metadata)
    assert {r["text_id"]: r["subgraph"] for r in chosen.collect()} == {"0": "mmc", "1": "usb"}
    searches, one = [], analysis.paths.topk_paths
    monkeypatch.setattr(analysis.paths, "topk_paths", lambda *a, **b: searches.append(1) or one(*a, **b))
    got = {r["log_id"]: r for r in analysis.analyse_base(spark, str(tmp_path), logs, metadata, k=2, max_depth=4).collect()}
    assert len(searches) == 1  # though ids are alike in both
    assert got["0"]["stats"]["n_paths"] == 1 and got["0"]["parsed_log"]["line_matches"][0]["matches"][0]["similarity"] > 0 and got["1"]["parsed_log"]["functions"] == ["usb_probe"]
    assert got["0"]["subgraph"] == "mmc" and got["0"]["best_path"]["path"] == ["dw_mci_pltfm_probe", "mid", "mmc_execute_tuning"] and got["1"]["subgraph"] == "usb"
    told = spark.createDataFrame([("0", ["nowhere", "usb"]), ("1", ["nowhere"])], "text_id string, names array<string>")
    chosen = analysis.choose_subgraphs(spark, str(tmp_path), logs.select(F.col("log_id").alias("text_id"), "text"), metadata, told)
    assert {r["text_id"]: r["subgraph"] for r in chosen.collect()} == {"0": "usb", "1": "usb"}
    asked = spark.createDataFrame([("x", "dw_mci_pltfm_probe", "usb_probe", None)], "log_id string, start_func string, end_func string, intermediate_funcs array<string>")
    assert [(r["subgraph"], r["path_count"]) for r in analysis.analyse_base_functions(spark, str(tmp_path), asked, max_depth=4).collect()] == [("usb", 1)]
    (tmp_path / "a.log").write_text("mmc0: tuning execution failed: -1")
    out = tmp_path / "r.json"
    assert cli.main(["--base", str(tmp_path), "--log", str(tmp_path / "a.log"), "--max-depth", "4", "--output", str(out)]) == 0
    assert json.loads(out.read_text())["subgraph"] == "mmc"
    assert cli.main(["--base", str(tmp_path), "--subgraph", "usb", "--start-func", "dw_mci_pltfm_probe", "--end-func", "usb_probe", "--max-depth", "4", "--output", str(out)]) == 0


def test_configuration(spark, tmp_path, capsys):
    from graphlens import cli
    from graphlens.operators import identity

    path = tmp_path / "c.yaml"
    path.write_text("data_dir: /graphs\nscenarios:\n  one:\n    description: a log\n    log_file: x.log\n  two:\n    start_func: a\n    end_func: b\nasync_call_detection:\n  keywords: [defer]\n")
    assert cli.main(["--config", str(path)]) == 0
    assert capsys.readouterr().out.splitlines() == ["one\tauto\ta log", "two\tmanual\t"]
    args = cli.arguments(["--config", str(path), "--scenario", "two"])
    assert (args.data_dir, args.start_func, args.end_func) == ("/graphs", "a", "b")
    settings = text.async_settings(text.read_config(str(path)))
    g = make(spark, plain("defer_it", "schedule_x"), [])
    assert settings == {"keywords": ("defer",)} and {"defer_it", "queue_work"} <= {r["name"] for r in identity.async_functions(g, **settings).collect()}
    assert "schedule_x" not in {r["name"] for r in identity.async_functions(g, **settings).collect()}


def test_single_chain_and_prompts(spark):
    g = make(spark, plain("a", "b", "c"), [("1", "2", 4)], [("9", "x_ops")], [("9", "3")])
    asked = spark.createDataFrame([("p", "a", "b"), ("q", "a", "nowhere")], "log_id string, start_func string, end_func string")
    got = {r["log_id"]: r for r in analysis.analyse_pair(g, asked, 4).collect()}
    assert got["p"]["path"] == got["p"]["repaired_path"] == ["a", "b"] and got["p"]["success"] and not got["q"]["success"]
    told = spark.createDataFrame([("b", "c", "bus", 0.9)], "start string, goal string, bridge_entity string, confidence double")
    one = analysis.analyse_pair(g, spark.createDataFrame([("r", "b", "c")], "log_id string, start_func string, end_func string"), 4, told).first()
    assert one["path"] == ["b", "bus", "c"] and [(x["from"], x["method"]) for x in one["breaks"]] == [("b", None), ("bus", "function_pointer")] and one["repaired_path"] == ["b", "bus", "ops", "c"]
    log = logs_df(spark, "mmc0: tuning execution failed: -1")
    assert not analysis.analyse_single(g, log, templates.fail_messages(spark), 4).first()["success"]
    row = spark.range(1).select(oracle.field_prompt(F.lit("void f() {}"), F.lit("queue_it")), oracle.fields_prompt(F.lit(None).cast("string")), oracle.log_prompt(F.lit("boom")), oracle.subgraphs_prompt(F.lit("boom"), ["mmc", "usb"], 1), oracle.bridge_prompt(F.lit("x" * 2000), F.lit(None).cast("string"), F.array(F.lit("n")))).first()
    assert "queue_it" in row[0] and "boom" in row[2] and "mmc, usb" in row[3] and row[4].count("x") < 900 and all(row)

    class Echo:
        def is_available(self):
            return True

        def chat_completion(self, messages):
            return '```json\n{"names": ["usb"]}\n```'

        def get_backend_name(self):
            return "echo"

    asked = spark.createDataFrame([("1", "p")], "key string, prompt string")
    assert [r["names"] for r in oracle.model_answers(asked, Echo, "subgraphs").collect()] == [["usb"]]
    recorded = spark.createDataFrame([("field", "k", '{"answer": "work"}'), ("log", "l", "{}")], "kind string, key string, answer string")
    assert [tuple(r) for r in oracle.table_answers(recorded, "field").collect()] == [("k", "work")]


def test_views_reports_and_smaller_helpers(spark, tmp_path):
    from graphlens import tables
    from graphlens.operators import neighbors
    from graphlens.sources import graph as sources

    g = make(spark, plain("a", "b", "c"), [("1", "2", 4), ("2", "3", 1)])
    sources.register(g, "t_")
    assert spark.sql("SELECT count(*) FROM t_relations r JOIN t_entities e ON e.id = r.head WHERE r.type = 'CALLS'").first()[0] == 2
    around = neighbors.bridge_context(g, spark.createDataFrame([("a", "c")], "a string, b string")).first()
    assert (around["callees_a"], around["callers_b"]) == (["b"], ["b"])
    messages = templates.fail_messages(spark)
    own = templates.messages_of(messages, spark.createDataFrame([("mmc_attach_mmc",)], "name string"))
    assert [r["message_id"] for r in own.collect()] == ["msg_4157275"]
    assert [r["function"] for r in templates.match_texts(logs_df(spark, LOG), own).collect()] == ["mmc_attach_mmc"]
    assert analysis.messages_for(g).count() == 4
    asked = spark.createDataFrame([("x", "a", "c", None)], "log_id string, start_func string, end_func string, intermediate_funcs array<string>")
    report = analysis.analyse_functions(g, asked, max_depth=4)
    text.write_report(report, str(tmp_path / "reports"))
    assert spark.read.json(str(tmp_path / "reports")).first()["path_count"] == 1
    assert report.select(text.best_path(F.col("paths"))).first()[0] == ["a", "b", "c"]
    own = tables.stored(spark.range(3), "own")
    tables.dropped(own)
    again = spark.newSession()
    assert tables.stored(again.range(2), "own").count() == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.log").write_text("error: boom in f_g (x)")
    q = stream.parsed_stream(stream.read_log_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["functions"] for r in spark.table("parsed").collect()] == [["f_g"]]


def test_stored_tables_are_cleared_and_bytes_bound_broadcasts(spark, monkeypatch):
    from graphlens import tables

    held = tables._held
    monkeypatch.setattr(tables, "_held", {})
    both = tables.stored_together(one=spark.range(3), two=spark.range(4))
    assert {k: v.count() for k, v in both.items()} == {"one": 3, "two": 4} and tables.clear(spark) == 2 and tables.clear(spark) == 0
    kept, counts = tables.stored_counting(spark.range(10), "counted", odd=F.count_if(F.col("id") % 2 == 1))
    assert kept.count() == 10 and counts == {"odd": 5}
    wide = spark.range(4).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array("id").alias("a"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hinted(tables.small(wide)) and hinted(tables.small(wide, 4)) and not hinted(tables.small(wide, limit=3))
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 3000)
    assert not hinted(tables.small(wide)) and not hinted(tables.small(wide, 4)) and hinted(tables.small(spark.range(4), 4))
    assert held is not tables._held


@pytest.mark.parametrize("listed", [4096, 1])
def test_the_template_index_equals_trying_every_template(spark, monkeypatch, listed):
    import random
    import re

    monkeypatch.setattr(templates, "LISTED", listed)
    rng = random.Random(listed)
    words = ["ab", "abc", "err", "x", "tuning", "Été", "a b", "%"]
    names = [f'pr_err("{"%s".join(rng.choice(words) * rng.randint(1, 2) for _ in range(rng.randint(1, 3)))}\\n", x)' for _ in range(40)] + ['e("%d")', 'e("x")', "none"]
    messages = spark.createDataFrame([(f"m{k}", n, f"f{k}", k, f"s{k}.c") for k, n in enumerate(names)], "message_id string, name string, function string, ord long, source_file string")
    lines = [" ".join(rng.choice([*words, "AB", "TUNING", "z"]) for _ in range(rng.randint(1, 6))) for _ in range(60)] + [""]
    rows = spark.createDataFrame([("l", k, x) for k, x in enumerate(lines)] + [("l", 99, None)], "log_id string, line_number int, log_line string")
    want = set()
    for r in templates.compiled(messages).collect():
        pieces = re.findall(r"\\Q(.*?)\\E", r["pattern"])
        want |= {(k, r["message_id"]) for k, x in enumerate(lines) if re.search(".*?".join(map(re.escape, pieces)), x, re.I)}
    found = templates.match_lines(rows, messages)
    got = [(r["line_number"], r["message_id"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert {r["source_file"] for r in found.where("message_id = 'm3'").collect()} <= {"s3.c"}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_models_answers_reach_the_parse(spark):
    logs = logs_df(spark, "mmc: tuning execution failed: -1", "probe(")
    told = spark.createDataFrame([("1", "start", None, ["k1", "k2"])], "log_id string, inferred_entry string, inferred_error_point string, key_functions array<string>")
    got = {r["log_id"]: r for r in templates.parse_logs(logs, templates.fail_messages(spark), answers=told).collect()}
    assert got["1"]["start_name"] == "start" and got["1"]["end_name"] is None and got["1"]["keys"] == ["k1", "k2"]
    assert got["0"]["end_name"] == "mmc_execute_tuning"
