"""Hand-checked graphs, one for each rule, and random graphs against a queue-based search in plain Python."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphlens import schema, tables
from graphlens.operators import edges as E
from graphlens.operators import identity, kbest, lookup, neighbors, paths, rank, reach, stitch
from graphlens.schema import Graph
from graphlens.sources import graph as sources
from graphlens.sources import text as text_sources


def make(spark, functions, calls, fields=(), assigned=()):
    """functions (id, name, is_declaration, code); calls (head, tail, line, kind[, field_path]); fields (id, name); assigned (field id, function id)."""
    rows = [{"id": i, "name": n, "type": "FUNCTION", "is_declaration": d, "code": c, "ord": k} for k, (i, n, d, c) in enumerate(functions)]
    rows += [{"id": i, "name": n, "type": "FIELD", "is_declaration": False, "ord": 10_000 + k} for k, (i, n) in enumerate(fields)]
    entities = spark.createDataFrame([[r.get(c) for c in schema.ENTITY_COLUMNS] for r in rows], schema.ENTITY)
    rels = []
    for k, c in enumerate(calls):
        kind = c[3] if len(c) > 3 else "direct"
        rels.append({"head": c[0], "tail": c[1], "type": "CALLS", "call_line": c[2], "call_type": kind, "target_type": "FIELD" if kind == "indirect" else "FUNCTION", "field_path": list(c[4]) if len(c) > 4 else [], "ord": k})
    rels += [{"head": a, "tail": b, "type": "ASSIGNED_TO", "field_path": [], "ord": 10_000 + k} for k, (a, b) in enumerate(assigned)]
    relations = spark.createDataFrame([[r.get(c) for c in schema.RELATION_COLUMNS] for r in rels], schema.RELATION)
    return Graph(entities, relations)


def plain(*names):
    return [(str(k + 1), n, False, None) for k, n in enumerate(names)]


def search(spark, g, start, goal, k=5, depth=30, mode="exact", keys=None, indirect=True):
    nodes = {r["name"]: r["id"] for r in identity.latest(g).collect()}
    queries = spark.createDataFrame([(0, nodes[start], nodes[goal])], "qid int, start string, goal string")
    names = identity.by_id(g.entities).select(F.col("id").alias("node"), "name")
    keys = None if keys is None else spark.createDataFrame([(0, keys)], "qid int, keys array<string>")
    return paths.topk_paths(E.search_steps(g, indirect, indirect), queries, names, k, depth, mode, keys).orderBy("rank").collect()


def test_identity(spark):
    g = make(spark, [("1", "f", True, None), ("2", "f", False, None), ("3", "f", False, None), ("4", "g", True, None), ("5", "h", False, None)], [("1", "5", 1)])
    assert [tuple(r) for r in identity.decl_impl_map(g).collect()] == [("1", "2")]
    assert {tuple(r) for r in identity.equivalents(g).collect()} == {("1", "1"), ("2", "2"), ("3", "3"), ("4", "4"), ("5", "5"), ("1", "2"), ("2", "1")}
    assert {r["name"]: r["id"] for r in identity.latest(g).collect()} == {"f": "3", "g": "4", "h": "5"}
    assert {tuple(r) for r in neighbors.name_edges(g).collect()} == {("f", "h")}
    named = spark.createDataFrame([("H",), ("nope",), (None,)], "name string")
    assert [tuple(r) for r in lookup.locate(g, named).collect()] == [("H", "h")]


def test_direct_scores_and_depth(spark):
    g = make(spark, plain("a", "b", "c", "d"), [("1", "2", 10), ("2", "3", 5), ("1", "3", 7), ("3", "1", 1), ("3", "4", 3)])
    got = search(spark, g, "a", "d", depth=5)
    assert [(r["path"], r["score"]) for r in got] == [(["a", "c", "d"], 996.95), (["a", "b", "c", "d"], 995.94)]
    boosted = search(spark, g, "a", "d", depth=6, keys=["b"])
    assert [(r["path"], round(r["score"], 6), r["key_coverage"]) for r in boosted] == [(["a", "b", "c", "d"], 1045.94, 1.0), (["a", "c", "d"], 996.95, 0.0)]
    assert [r["path"] for r in search(spark, g, "a", "d", depth=3)] == [["a", "c", "d"]]
    hop = g.rel("CALLS").select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    pair = spark.createDataFrame([(0, "1", "4")], "qid int, start string, goal string")
    assert reach.shortest_path(hop, pair, 30).first()["path"] == ["1", "3", "4"]
    assert reach.shortest_path(hop, pair, 2).count() == 0
    assert {r["node"] for r in reach.reach_paths(hop, pair.select("qid", F.col("start").alias("node")), 1).collect()} == {"1", "2", "3"}  # max_depth + 1 nodes
    assert sorted(r["path"] for r in reach.simple_paths(hop, pair, 6).collect()) == [["1", "2", "3", "4"], ["1", "3", "4"]]


def test_parallel_rows_and_collision(spark):
    g = make(spark, plain("a", "b"), [("1", "2", 10), ("1", "2", 20)])
    assert [r["call_lines"] for r in search(spark, g, "a", "b", depth=3)] == [[10], [20]]
    g = make(spark, plain("a", "probe"), [("1", "9", 3, "indirect")], [("9", "probe")])
    assert neighbors.name_edges(g).count() == 0 and search(spark, g, "a", "probe", depth=3) == []


def test_indirect(spark):
    g = make(spark, plain("m", "p", "q"), [("1", "10", 8, "indirect", ("ops", "exec")), ("2", "11", 4, "indirect")], [("10", "exec"), ("11", "exec")], [("10", "2"), ("11", "3")])
    got = E.callees_with_lines(g, spark.createDataFrame([("1",)], "id string")).collect()
    assert {(r["callee"], r["call_line"], r["is_indirect"]) for r in got} == {("p", 8, True), ("q", 8, True)}
    found = search(spark, g, "m", "q", depth=5)
    assert [(r["path"], r["score"]) for r in found] == [(["m", "q"], 987.92)]
    assert search(spark, g, "m", "q", depth=5, indirect=False) == []


def test_async(spark):
    functions = [("1", "schedule_it", False, None), ("2", "caller", False, "schedule_it(&host->detect, 0);"), ("3", "cb", False, None), ("4", "other", False, "schedule_it(&w)"), ("5", "blind", False, None), ("6", "cb2", False, None)]
    g = make(spark, functions, [("2", "1", 12), ("4", "1", 9), ("5", "1", 1)], [("7", "detect"), ("8", "w")], [("7", "3"), ("8", "6")])
    assert {(r["caller"], r["target"]) for r in E.async_edges(g).collect()} == {("caller", "cb"), ("other", "cb2")}
    got = search(spark, g, "caller", "cb", depth=5)
    assert [(r["path"], [e["type"] for e in r["edges"]], r["call_lines"], r["score"]) for r in got] == [(["caller", "schedule_it", "cb"], ["direct", "async"], [12, None], 986.88)]
    broken = rank.path_breaks(spark.createDataFrame([(0, 1, ["caller", "schedule_it", "cb"], [("direct", None), ("async", "async")])], "qid int, rank int, path array<string>, edges array<struct<type:string,bridge:string>>"))
    assert [tuple(r)[2:6] for r in broken.collect()] == [(1, "schedule_it", "cb", True)]


def test_stitch_prefers_a_bridge(spark):
    names = plain("s", "x", "y1", "y2", "t", "z")
    calls = [("1", "2", 1), ("2", "5", 1), ("1", "3", 1), ("3", "4", 1), ("4", "6", 1), ("6", "5", 1)]
    pair = spark.createDataFrame([(0, "s", "t")], "qid int, start string, goal string")
    got = stitch.stitch_paths(make(spark, names, calls, [("9", "my_ops")], [("9", "6")]), pair, 6).first()
    assert got["path"] == ["s", "y1", "y2", "z", "t"] and got["bridge_type"] == "function_pointer"
    assert stitch.stitch_paths(make(spark, names, calls), pair, 6).first()["path"] == ["s", "x", "t"]
    layered = stitch.layered_paths(make(spark, names, calls), spark.createDataFrame([(0, "s", "t"), (1, "t", "s")], "qid int, start string, goal string"), 4).collect()
    assert {r["qid"]: r["method"] for r in layered} == {0: "direct", 1: "none"}


def test_score_formula(spark):
    rows = spark.createDataFrame([(15, 0, 100, 1), (16, 4, 50, 1), (12, 2, 200, 1), (3, 0, 0, 0)], "n int, i int, s int, c int")
    assert [r[0] for r in rows.select(rank.path_score(F.col("n"), F.col("i"), F.col("s"), F.col("c"))).collect()] == [984.0, 943.5, 966.0, 997.0]


def test_layouts_agree(spark, tmp_path):
    listed_e = [{"id": 1, "name": "a", "type": "FUNCTION"}, {"id": 2, "name": "b", "type": "FUNCTION", "source_file": "b.c"}, {"id": 9, "name": "f", "type": "FIELD"}, {"id": 3}]
    listed_r = [{"head": 1, "tail": 2, "type": "CALLS", "call_line": 4}, {"head": 9, "tail": 2, "type": "ASSIGNED_TO"}]
    strip = lambda rows: [{k: v for k, v in r.items() if k != "type"} for r in rows]
    layouts = {
        "list": {"entity.json": listed_e, "relation.json": listed_r},
        "object": {"entity.json": {"FUNCTION": strip(listed_e[:2]), "FIELD": strip(listed_e[2:3])}, "relation.json": {"CALLS": strip(listed_r[:1]), "ASSIGNED_TO": strip(listed_r[1:])}},
        "separate": {"entity_function.json": {"1": strip(listed_e)[0], "2": strip(listed_e)[1]}, "entity_field.json": strip(listed_e[2:3]), "relation_calls.json": strip(listed_r[:1]), "relation_assignedto.json": strip(listed_r[1:])},
    }
    seen = []
    for name, files in layouts.items():
        (tmp_path / name).mkdir()
        for f, content in files.items():
            (tmp_path / name / f).write_text(json.dumps(content))
        g = sources.load_graph(spark, str(tmp_path / name))
        seen.append((sorted(map(tuple, g.entities.drop("ord").fillna("").collect())), sorted(map(tuple, g.relations.drop("ord", "field_path").fillna("").collect()))))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) == 3
    assert [r["subgraph"] for r in sources.subgraphs(spark, str(tmp_path)).collect()] == ["list", "object"]
    assert sources.subgraph_path(spark, str(tmp_path), "nope") is None


def queue_search(calls, targets, deferred, start, goal, k, depth):
    """The search restated: a queue of chains, the first k that arrive, sorted by score."""
    out, best, queue = [], {}, deque([(start, [start], [], [], False)])
    while queue and len(out) < k:
        node, path, kinds, lines, arrived = queue.popleft()
        if len(path) > depth:
            continue
        if node == goal:
            known = [x for x in lines if x is not None]
            score = 1000 - len(path) - 10 * sum(x != "direct" for x in kinds) - (sum(known) / len(known) if known else 0) / 100
            out.append((path, score))
            continue
        if node in best and len(path) >= best[node] + 3:
            continue
        best[node] = min(best.get(node, 99), len(path))
        for tail, line, kind in calls.get(node, []):
            if kind == "direct":
                if tail not in path:
                    queue.append((tail, path + [tail], kinds + ["direct"], lines + [line], False))
                    if tail.startswith("schedule"):
                        for t in sorted(deferred.get((node, tail), [])):
                            if t not in path + [tail]:
                                queue.append((t, path + [tail, t], kinds + ["direct", "async"], lines + [line, None], True))
            elif not arrived:
                for t in sorted(targets.get(tail, [])):
                    if t not in path:
                        queue.append((t, path + [t], kinds + ["indirect"], lines + [line], True))
    return sorted(out, key=lambda x: -x[1])


@pytest.mark.parametrize("k", [1, 3])
def test_first_k_equals_a_queue(spark, k):
    rng, functions, fields, calls, assigned, want, queries = random.Random(k), [], [], [], [], {}, []
    for n in range(60):
        size, depth = rng.randint(4, 7), 6
        names = [(f"schedule_{n}_{i}" if rng.random() < 0.2 else f"f_{n}_{i}") for i in range(size)]
        own_fields = [f"fl_{n}_{i}" for i in range(2)]
        own, targets, deferred, code = {}, {f: set() for f in own_fields}, {}, {m: "" for m in names}
        for f in own_fields:
            fields.append((f, f))
            for m in names:
                if rng.random() < 0.3:
                    targets[f].add(m)
                    assigned.append((f, m))
        for m in names:
            for t in rng.sample(names + own_fields, rng.randint(0, 4)):
                kind = "indirect" if t in own_fields else "direct"
                line = rng.randint(1, 50)
                own.setdefault(m, []).append((t, line, kind))
                calls.append((m, t, line, kind))
                if kind == "direct" and t.startswith("schedule") and rng.random() < 0.8:
                    f = rng.choice(own_fields)
                    code[m] += f"{t}(&x->{f});"
                    deferred[m, t] = targets[f]
        functions += [(m, m, False, code[m] or None) for m in names]
        a, b = rng.choice(names), rng.choice(names)
        queries.append((n, a, b))
        want[n] = [(p, round(s, 6)) for p, s in queue_search(own, targets, deferred, a, b, k, depth)]
    g = make(spark, functions, calls, fields, assigned)
    asked = spark.createDataFrame(queries, "qid int, start string, goal string")
    names = g.of("FUNCTION").select(F.col("id").alias("node"), "name")
    got = {n: [] for n in want}
    for r in paths.topk_paths(E.search_edges(g), asked, names, k, 6, "first_k").orderBy("qid", "rank").collect():
        got[r["qid"]].append((r["path"], round(r["score"], 6)))
    assert got == want and sum(map(bool, want.values())) > 15


def random_edges(spark, rng, size, degree, late=0.1, lines=60):
    """Edges as search_edges() gives them, and the same as calls of each node."""
    rows, of = [], {}
    for a in range(size):
        for b in rng.sample(range(size), degree):
            if a != b:
                kind = "indirect" if rng.random() < late else "direct"
                rows.append((str(a), str(b), kind, rng.randint(0, lines), len(rows), str(b) if kind == "indirect" else "", None, "f" if kind == "indirect" else None))
                of.setdefault(str(a), []).append(rows[-1])
    return spark.createDataFrame(rows, "src string, dst string, kind string, call_line int, ord long, sub string, mid string, via string"), of


def all_chains(of, start, goal, depth):
    """Every chain of a search: the slack rule by the shortest way to each state, then depth first."""
    seen, queue, first = {(start, False)}, deque([(start, False, 1)]), {}
    while queue:
        node, arrived, n = queue.popleft()
        if node == goal:
            continue
        first[node] = min(first.get(node, 99), n)
        for _, b, kind, *_ in of.get(node, []):
            if (kind == "direct" or not arrived) and (b, kind != "direct") not in seen and n < depth:
                seen.add((b, kind != "direct"))
                queue.append((b, kind != "direct", n + 1))
    out, stack = [], [(start, [start], [], 0, False)]
    while stack:
        node, path, lines, late, arrived = stack.pop()
        if node == goal:
            mean = sum(lines) / len(lines) if lines else 0
            out.append((1000 - len(path) - 10 * late - mean / 100, len(path), path, lines))
        elif len(path) < depth and len(path) < first[node] + 3:
            for _, b, kind, line, *_ in of.get(node, []):
                if b not in path and (kind == "direct" or not arrived):
                    stack.append((b, path + [b], lines + [line], late + (kind != "direct"), kind != "direct"))
    return out


@pytest.mark.parametrize("depth,lines", [(5, 9), (9, 3000)])
def test_best_k_equals_all_chains(spark, depth, lines):
    rng = random.Random(depth)
    edges, of = random_edges(spark, rng, 14, 4, 0.2, lines)
    asked = [(n, str(rng.randrange(14)), str(rng.randrange(14))) for n in range(12)]
    queries = spark.createDataFrame(asked, "qid int, start string, goal string")
    names = spark.createDataFrame([(str(n), f"n{n}") for n in range(14)], "node string, name string")
    keys = spark.createDataFrame([(n, ["n3", "n5", "gone", "n3"]) for n, _, _ in asked if n % 2], "qid int, keys array<string>")
    for told in (None, keys) if depth == 5 else (keys,):
        want = {}
        for n, a, b in asked:
            boost = 50 if told is not None and n % 2 else 0
            found = [(s + boost * len({"3", "5"} & set(p)), c, [f"n{x}" for x in p], ls) for s, c, p, ls in all_chains(of, a, b, depth)]
            want[n] = [round(x[0], 6) for x in sorted(found, key=lambda x: (-x[0], x[1], ">".join(x[2])))[:4]]
        got = {n: [] for n, _, _ in asked}
        for r in paths.topk_paths(edges, queries, names, 4, depth, "exact", told).orderBy("qid", "rank").collect():
            got[r["qid"]].append(round(r["score"], 6))
        assert got == want and sum(map(bool, want.values())) > 6


def test_deep_search_stays_under_a_bound(spark):
    rng = random.Random(7)
    edges, of = random_edges(spark, rng, 400, 12, 0.1, 40)  # 12 ** 29 walks of 30 nodes
    queries = spark.createDataFrame([(0, "1", "2"), (1, "3", "4")], "qid int, start string, goal string")
    for mode in ("exact", "first_k"):
        done = paths.search(edges, queries, 30, 3, mode)
        assert done.rows < 20_000, (mode, done.rows)
        assert {r["qid"]: r["n"] >= 3 for r in done.chains().groupBy("qid").agg(F.count("*").alias("n")).collect()} == {0: True, 1: True}


def test_direct_chains_of_two_nodes_more_spare_the_search_of_all_calls(spark, monkeypatch):
    def never(*args):
        raise AssertionError("all calls were searched")

    monkeypatch.setattr(kbest.KBest, "_spread", never)
    rows = [("a", "b", "direct"), ("b", "z", "direct"), ("a", "z", "indirect")]
    for n in range(4):
        rows += [(x, y, "direct") for x, y in zip(["a", f"p{n}", f"q{n}", f"r{n}"], [f"p{n}", f"q{n}", f"r{n}", "z"])]
    edges = spark.createDataFrame([(a, b, kind, 1, n, "" if kind == "direct" else b, None, None if kind == "direct" else "f") for n, (a, b, kind) in enumerate(rows)], "src string, dst string, kind string, call_line int, ord long, sub string, mid string, via string")
    queries = spark.createDataFrame([(0, "a", "z")], "qid int, start string, goal string")
    names = spark.createDataFrame([(x,) * 2 for x in sorted({y for r in rows for y in r[:2]})], "node string, name string")
    got = [(r["path"], round(r["score"], 6)) for r in paths.topk_paths(edges, queries, names, 4, 9).orderBy("rank").collect()]
    assert got == [(["a", "b", "z"], 996.99), *[(["a", f"p{n}", f"q{n}", f"r{n}", "z"], 994.99) for n in range(3)]]


@pytest.mark.parametrize("layout", ["list", "object", "separate"])
def test_odd_records_are_skipped_alone(spark, tmp_path, layout):
    good = [{"id": 1, "name": "a", "type": "FUNCTION", "start_line": "7", "end_line": "x", "is_declaration": "true", "code": {"odd": 1}}, {"id": "2", "name": "b", "type": "FUNCTION", "start_line": 3}]
    odd = ["text", 5, None, ["list"], {"id": 9, "type": "FUNCTION"}]
    calls = [{"head": 1, "tail": "2", "type": "CALLS", "call_line": "4", "field_path": ["ops", "f"]}, {"head": "2", "tail": 1, "type": "CALLS", "call_line": "?", "field_path": "no list", "visibility_checked": 1}]
    strip = lambda rows: [{k: v for k, v in r.items() if k != "type"} for r in rows]
    if layout == "list":
        files = {"entity.json": [odd[0], good[0], *odd[1:], good[1]], "relation.json": [*calls, 3, "x"]}
    elif layout == "object":
        files = {"entity.json": {"FUNCTION": [odd[0], *strip(good), *odd[1:]], "FIELD": "no list", "FILE": {"no": "list"}}, "relation.json": {"CALLS": [*strip(calls), 3, "x"]}}
    else:
        files = {"entity_function.json": {"k1": odd[0], "k2": strip(good)[0], "k3": strip(good)[1], "k4": 5, "k5": None, "k6": ["list"], "k7": {"id": 9}}, "relation_calls.json": [*strip(calls), 3, "x"]}
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content))
    g = sources.load_graph(spark, str(tmp_path))
    got = sorted((r["id"], r["name"], r["type"], r["start_line"], r["end_line"], r["is_declaration"], r["code"]) for r in g.entities.collect())
    assert got == [("1", "a", "FUNCTION", 7, None, True, '{"odd":1}'), ("2", "b", "FUNCTION", 3, None, False, None)]
    rels = sorted((r["head"], r["tail"], r["type"], r["call_line"], r["field_path"]) for r in g.relations.collect())
    assert rels == [("1", "2", "CALLS", 4, ["ops", "f"]), ("2", "1", "CALLS", None, [])]
    assert sources.rejected(spark, str(tmp_path)).groupBy("file").count().count() == 2 and sources.rejected(spark, str(tmp_path)).count() == 7


def test_tables_and_subgraphs_are_pruned(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "tables")
    sources.write_tables(make(spark, plain("a", "b"), [("1", "2", 4)]), base, "mmc")
    sources.write_tables(make(spark, plain("a", "c", "d"), [("1", "2", 4)]), base, "usb")
    g = sources.load_any(spark, base, ["usb"])
    assert {r["name"] for r in g.entities.collect()} == {"a", "c", "d"} and "PartitionFilters: [isnotnull(subgraph" in g.entities._jdf.queryExecution().toString()
    assert sources.load_tables(spark, f"{base}/entities", f"{base}/relations").entities.count() == 5
    for k, names in enumerate((["x", "y"], ["z"])):
        (tmp_path / f"s{k}").mkdir()
        (tmp_path / f"s{k}" / "entity.json").write_text(json.dumps([{"id": n, "name": n, "type": "FUNCTION"} for n in names]))
        (tmp_path / f"s{k}" / "relation.json").write_text("[]")
    assert sources.load_any(spark, str(tmp_path), ["s1"]).entities.count() == 1
    both = sources.load_any(spark, str(tmp_path)).entities.orderBy("ord").collect()
    assert [r["name"] for r in both] == ["x", "y", "z"]
    monkeypatch.setenv("KG_DATA_DIR", base)
    assert sources.default_base(spark) == base
    with pytest.raises(ValueError):
        sources.load_any(spark, str(tmp_path), ["none"])


def test_texts_come_from_files_where_the_graph_has_none(spark, tmp_path):
    (tmp_path / "drivers").mkdir()
    (tmp_path / "drivers" / "a.c").write_text("/* */\nvoid caller(void)\n{\n  schedule_it(&host->detect);\n}\n")
    g = make(spark, [("1", "schedule_it", False, None), ("2", "caller", False, ""), ("3", "cb", False, "own text")], [("2", "1", 12)], [("7", "detect")], [("7", "3")])
    entities = g.entities.withColumns({"file": F.when(F.col("name") == "caller", "E:\\src\\drivers\\a.c"), "start_line": F.lit(2), "end_line": F.lit(5)})
    g = Graph(entities, g.relations)
    assert E.async_edges(g).count() == 0
    files = text_sources.read_sources(spark, str(tmp_path))
    assert [r["file"] for r in files.collect()] == ["drivers/a.c"]
    filled = lookup.with_sources(g, files, prefixes=("E:\\src\\",))
    assert filled.entities.count() == 4 and {(r["caller"], r["target"]) for r in E.async_edges(filled).collect()} == {("caller", "cb")}
    told = spark.createDataFrame([("caller", "schedule_it", "other")], "caller string, async_callee string, answer string")
    assert E.async_edges(filled, oracle=told).count() == 0
    more = {(r["target"], r["via"]) for r in E.async_edges(filled, use_fallback=True, oracle=told).collect()}
    assert more == {("mmc_rescan", "mock_data")}
    assert {r["target"] for r in E.async_edges(filled, E.supplement_rows(spark)).collect()} == {"cb", "mmc_rescan"}


def test_breaks_are_found_and_repaired(spark):
    g = make(spark, plain("a", "b", "c", "d", "e"), [("1", "2", 1)], [("8", "work_func"), ("9", "my_ops")], [("8", "3"), ("9", "4")])
    chains = spark.createDataFrame([(0, ["a", "b", "c", "d", "e"]), (1, ["a", "b"]), (2, ["a"]), (3, None)], "qid int, path array<string>")
    told = spark.createDataFrame([("d", "e", "thread", 0.9), ("b", "c", "ignored", 0.9), ("x", "y", "z", 0.1)], "a string, b string, bridge_entity string, confidence double")
    got = stitch.break_repairs(g, chains, told)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, "b", "c", True, "async", "work_struct.func"), (0, 2, "c", "d", True, "function_pointer", "ops"), (0, 3, "d", "e", True, "llm_inferred", "thread")]
    whole = {r["qid"]: r["path"] for r in stitch.repaired(chains, got).collect()}
    assert whole == {0: ["a", "b", "work_struct.func", "c", "ops", "d", "thread", "e"], 1: ["a", "b"], 2: ["a"], 3: None}
    assert {r["method"]: r["n"] for r in stitch.repair_stats(stitch.break_repairs(g, chains)).collect()} == {"async": 1, "function_pointer": 1, "unrepaired": 1}
    layered = spark.createDataFrame([("a", "e", "bus", 0.7), ("e", "a", "bus", 0.5)], "start string, goal string, bridge_entity string, confidence double")
    pair = spark.createDataFrame([(0, "a", "e"), (1, "e", "a")], "qid int, start string, goal string")
    assert {r["qid"]: (r["method"], r["path"]) for r in stitch.layered_paths(g, pair, 4, layered).collect()} == {0: ("llm_inferred", ["a", "bus", "e"]), 1: ("none", None)}


def test_names_are_located_one_by_one_or_by_pieces(spark, monkeypatch):
    rng = random.Random(4)
    names = ["".join(rng.choice("abC_") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    g = make(spark, [(str(k), n, False, None) for k, n in enumerate(names)], [])
    asked = sorted({"".join(rng.choice("abc_") for _ in range(rng.randint(0, 5))) for _ in range(60)} | {"", "A"})
    table = spark.createDataFrame([(n,) for n in asked], "name string")
    want = {}
    for n in asked:
        hit = n if n in names else next((x for x in names if n.lower() in x.lower()), None)
        want |= {n: hit} if hit is not None else {}
    for few in (10**6, 0):
        monkeypatch.setattr(lookup, "FEW_NAMES", few)
        assert {r["name"]: r["located"] for r in lookup.locate(g, table).collect()} == want


def deferred_chains(rows, start, goal, depth):
    """all_chains() with deferred work: such an edge has a node between and counts two."""
    of = {}
    for r in rows:
        of.setdefault(r[0], []).append(r)
    size = lambda r: 2 if r[2] == "async" else 1
    far, first = {(start, False): 1}, {}
    for n in range(1, depth + 1):
        for (node, arrived), m in list(far.items()):
            if m == n and node != goal:
                first[node] = min(first.get(node, 99), n)
                for r in of.get(node, []):
                    if r[2] != "indirect" or not arrived:
                        key = (r[1], r[2] != "direct")
                        far[key] = min(far.get(key, 99), n + size(r))
    out, stack = [], [(start, [start], [], 0, False)]
    while stack:
        node, path, lines, late, arrived = stack.pop()
        if node == goal:
            out.append((1000 - len(path) - 10 * late - (sum(lines) / len(lines) if lines else 0) / 100, -len(path), path, lines))
        elif len(path) < first.get(node, 0) + 3:
            for r in of.get(node, []):
                more = [r[6], r[1]] if r[2] == "async" else [r[1]]
                if (r[2] != "indirect" or not arrived) and not set(more) & set(path) and len(set(more)) == len(more) and len(path) + len(more) <= depth:
                    stack.append((r[1], path + more, lines + [r[3]], late + (r[2] != "direct"), r[2] != "direct"))
    return out


@pytest.mark.parametrize("size,degree,late", [(12, 2, 0.6), (9, 4, 0.4)])
def test_default_depth_equals_all_chains(spark, size, degree, late):
    """Sparse, wide and dense graphs whose shortest ways are often indirect, with lists of ways that are too short at first."""
    rng, rows = random.Random(size), []
    for a in range(size):
        for b in rng.sample([x for x in range(size) if x != a], degree):
            kind = rng.choice(["indirect", "async"]) if rng.random() < late else "direct"
            mid = str(rng.randrange(size)) if kind == "async" else None
            for line in [rng.randint(0, 9)] * rng.choice([1, 1, 2]):
                rows.append((str(a), str(b), kind, line, len(rows), "" if kind == "direct" else str(b), mid, None if kind == "direct" else "f"))
    edges = spark.createDataFrame(rows, "src string, dst string, kind string, call_line int, ord long, sub string, mid string, via string")
    asked = [(n, str(rng.randrange(size)), str(rng.randrange(size))) for n in range(24)]
    queries = spark.createDataFrame(asked, "qid int, start string, goal string")
    names = spark.createDataFrame([(str(n), f"n{n}") for n in range(size)], "node string, name string")
    got = {n: [] for n, _, _ in asked}
    for r in paths.topk_paths(edges, queries, names, 3, 30).orderBy("qid", "rank").collect():
        got[r["qid"]].append((round(r["score"], 6), r["path"]))
    for n, a, b in asked:
        best = sorted(deferred_chains(rows, a, b, 30), key=lambda x: (-round(x[0], 9), -x[1], ">".join(f"n{y}" for y in x[2])))[:3]
        assert got[n] == [(round(x[0], 6), [f"n{y}" for y in x[2]]) for x in best], (n, a, b)


def test_shortest_paths_meet_in_the_middle(spark):
    from graphlens.operators import spread

    rng, size = random.Random(3), 600
    pairs_of = [(a, b) for a in range(size) for b in rng.sample(range(size), 4)] + [(1000 + k, 1001 + k) for k in range(25)]
    edges = spark.createDataFrame([(str(a), str(b), "direct" if (a + b) % 3 else "indirect") for a, b in pairs_of], "src string, dst string, kind string")
    asked = [(n, rng.randrange(size), rng.randrange(size)) for n in range(20)] + [(50, 1000, 1025), (51, 1000, 1), (52, 7, 7), (53, 1, 1003), (54, 1000, 1029)]
    queries = spark.createDataFrame([(n, str(a), str(b)) for n, a, b in asked], "qid int, start string, goal string")
    to, kind = {}, {}
    for a, b in pairs_of:
        to.setdefault(str(a), set()).add(str(b))
        kind[str(a), str(b)] = "direct" if (a + b) % 3 else "indirect"
    got = {r["qid"]: r for r in reach.shortest_path(edges, queries, 30).collect()}
    for n, a, b in asked:
        best, seen = {str(a): [str(a)]}, {str(a): [str(a)]}
        while best and str(b) not in seen:
            new = {}
            for node, path in best.items():
                for x in to.get(node, ()):
                    if x not in seen:
                        new[x] = min(new.get(x, path + [x]), path + [x])
            best = new
            seen |= new
        want = seen.get(str(b))
        assert (got[n]["path"] if n in got else None) == want, n
        if want:
            assert got[n]["length"] == len(want) and got[n]["labels"] == [kind[x] for x in zip(want, want[1:])]
    hop = E.Steps(edges.where("src != dst").select("src", "dst").distinct(), None, None)
    some = queries.where("qid < 20")
    _, ahead, back = spread.distances(hop, some, 30, late=False)
    whole = spread.Spread(hop, some, True, False)
    while not whole.ended:
        whole.grow()
    assert sum(ahead.counts.values()) + sum(back.counts.values()) < sum(whole.counts.values()) / 3


def test_subgraphs_are_partitions(spark, tmp_path):
    g = make(spark, plain("a", "b", "c", "d"), [("1", "2", 4), ("2", "3", 5), ("3", "4", 6)])
    of = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "id string, subgraph string")  # d is in both
    base = str(tmp_path / "tables")
    sources.write_subgraphs(g, base, of)
    x, y = sources.load_any(spark, base, ["x"]), sources.load_any(spark, base, ["y"])
    assert sorted(r["id"] for r in x.entities.collect()) == ["1", "2", "4"] and sorted(r["id"] for r in y.entities.collect()) == ["3", "4"]
    assert [(r["head"], r["tail"]) for r in x.relations.collect()] == [("1", "2")] and [(r["head"], r["tail"]) for r in y.relations.collect()] == [("3", "4")]
    assert "PartitionFilters: [subgraph" in x.relations._jdf.queryExecution().executedPlan().toString().replace("isnotnull(subgraph#", "subgraph")


def test_deferred_edges_are_distinct_before_their_product(spark):
    """Callers, work and targets were multiplied first, and the product shuffled to be made distinct."""
    from graphlens.plans import catalog

    plan = E.async_edges(catalog.by_key(spark, "/root/testdata/sf0.001", stored=True))._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert dealt and not any("target" in x for x in dealt), plan


def test_calls_through_fields_are_counted_before_their_product(spark):
    """Sites met the functions of their fields first, and the product was shuffled to be counted."""
    from graphlens.plans import catalog

    plan = catalog.QUERIES["callees_with_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert dealt and not any("target" in x for x in dealt if "hashpartitioning(id" in x), plan


def test_pairs_that_nothing_connects_are_dropped_before_they_spread(spark, monkeypatch):
    """A search that can't arrive went through every node of both ends' parts."""
    from graphlens.operators import spread

    rng, size = random.Random(5), 150
    rows = {(base + a, base + b) for base in (0, 1000) for a in range(size) for b in rng.sample(range(size), 4) if a != b} | {(2000 + k, 2001 + k) for k in range(12)}
    edges = spark.createDataFrame([(str(a), str(b)) for a, b in rows], "src string, dst string").cache()
    of = {r["node"]: r["component"] for r in spread.components(edges).collect()}
    assert len(set(of.values())) == 3 and len(of) == 2 * size + 13
    assert all(of[str(a)] == of[str(b)] for a, b in rows)
    asked = [(n, rng.randrange(size), 1000 + rng.randrange(size)) for n in range(30)] + [(40, 0, 5), (41, 2000, 2009), (42, 2009, 2000), (43, 7, 7), (44, 7, 9999), (45, 9998, 9998)]
    queries = spark.createDataFrame([(n, str(a), str(b)) for n, a, b in asked], "qid int, start string, goal string")
    steps = E.Steps(edges, None, None)
    before, a, b = spread.distances(steps, queries, 30, late=False)
    want, rows_before = {r["qid"]: r["dist"] for r in before.collect()}, sum(a.counts.values()) + sum(b.counts.values())
    monkeypatch.setattr(spread, "APART", 1)
    after, a, b = spread.distances(steps, queries, 30, late=False)
    assert {r["qid"]: r["dist"] for r in after.collect()} == want and want.keys() == {40, 41, 43, 45}
    assert sum(a.counts.values()) + sum(b.counts.values()) < rows_before / 2


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_large_graphs_tables_are_not_broadcast(spark, monkeypatch):
    """Their files are small, so Spark would; a driver of 750 MB then held ten tables of 1.2 million functions at once."""
    g = make(spark, [*plain("a", "b", "c", "queue_work_x"), ("9", "b", True, None)], [("1", "9", 3), ("2", "f", 4, "indirect", ["s", "field"]), ("3", "4", 5)], [("f", "field")], [("f", "3")])
    small = {tuple(r) for r in E.search_edges(g).collect()}
    assert "strategy=merge" not in _plan(E.search_steps(g).targets)
    monkeypatch.setattr(tables, "JOINABLE_ROWS", 1)
    steps = E.search_steps(g)
    assert _plan(steps.targets).count("strategy=merge") >= 4  # functions, entities, and nodes for both kinds
    assert "strategy=merge" in _plan(identity.decl_impl_map(g, 2))
    assert {tuple(r) for r in steps.edges().collect()} == small and small
    queries = spark.createDataFrame([(0, "1", "3")], "qid int, start string, goal string")
    names = identity.by_id(g.entities).select(F.col("id").alias("node"), "name")
    got = paths.topk_paths(steps, queries, names, 5, 4, keys=spark.createDataFrame([(0, ["b"])], "qid int, keys array<string>"))
    assert [(r["path"], round(r["score"], 6)) for r in got.collect()] == [(["a", "b", "c"], 1036.965)]
    assert [tuple(r) for r in lookup.locate(g, spark.createDataFrame([("B",), ("b",)], "name string")).orderBy("name").collect()] == [("B", "b"), ("b", "b")]


def test_states_too_far_from_the_goal_are_not_kept(spark, monkeypatch):
    """of 200 functions that the start calls too, none of which leads to the goal, a deep search keeps no state."""
    pairs = [("s", "a"), ("a", "b"), ("b", "g")] + [("s", f"x{n}") for n in range(200)]
    rows = [(a, b, "direct", 1, n, "", None, None) for n, (a, b) in enumerate(pairs)]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string, call_line int, ord long, sub string, mid string, via string")
    names = spark.createDataFrame([(x, x) for x in {y for pair in pairs for y in pair}], "node string, name string")
    kept, plain = [], tables.stored

    def stored(df, tag):
        out = plain(df, tag)
        if tag == "first-sizes":
            kept.append(out.count())
        return out

    monkeypatch.setattr(tables, "stored", stored)
    found = paths.topk_paths(edges, spark.createDataFrame([(0, "s", "g")], "qid int, start string, goal string"), names, 1, 30).collect()
    assert [r["path"] for r in found] == [["s", "a", "b", "g"]]
    assert kept and max(kept) <= 4


@pytest.mark.parametrize("mode,k", [("exact", None), ("exact", 3), ("first_k", 3)])
def test_a_wide_last_layer_before_the_goals_is_not_grown(spark, monkeypatch, mode, k):
    """it holds first calls alone and has more rows than all chains; without it the chains are the same."""
    rng = random.Random(11)
    edges, _ = random_edges(spark, rng, 14, 4, 0.3, 9)
    queries = spark.createDataFrame([(n, str(rng.randrange(14)), str(rng.randrange(14))) for n in range(8)], "qid int, start string, goal string")
    names = spark.createDataFrame([(str(n), f"n{n}") for n in range(14)], "node string, name string")
    layers, plain = [], tables.stored

    def stored(df, tag):
        layers.append(tag)
        return plain(df, tag)

    monkeypatch.setattr(tables, "stored", stored)
    found = {}
    for wide in (50_000, 0):
        monkeypatch.setattr(paths, "WIDE", wide, raising=False)
        layers.clear()
        rows = paths.topk_paths(edges, queries, names, k, 5, mode).select("qid", "rank", "path", "call_lines", "score").collect()
        found[wide] = sorted(map(str, rows)), layers.count("spread")
    assert found[0][0] == found[50_000][0] and found[0][0]
    assert found[0][1] == found[50_000][1] - 1 == 2


def test_steps_are_written_once(spark):
    """a report's steps are written while its ends are located, and not again by the search."""
    g = make(spark, plain("a", "b"), [("1", "2", 3)])
    steps = E.search_steps(g).stored()
    assert steps.stored() is steps


def test_tables_of_120000_rows_are_not_broadcast(spark):
    """a driver of 750 MB held four of them, of 16 MB each."""
    assert "strategy=merge" in _plan(tables.merging(spark.range(1), 120_000).join(spark.range(2), "id"))


def test_deferring_functions_of_a_large_graph_are_not_broadcast(spark, monkeypatch):
    """F6, F8: a tenth of 1.2 million functions, whose names were broadcast four times over."""
    g = make(spark, [*plain("a", "b", "queue_work_x")], [("1", "3", 5)], [], [])
    monkeypatch.setattr(tables, "JOINABLE_ROWS", 1)
    plans, plain_stored = {}, tables.stored

    def stored(df, tag):
        plans[tag] = _plan(df)
        return plain_stored(df, tag)

    monkeypatch.setattr(tables, "stored", stored)
    E.search_steps(g)
    assert "rightHint=(strategy=merge)" in plans["deferring"].split("LeftSemi")[1].split("\n")[0]
    assert "rightHint=(strategy=merge)" in plans["deferred"].split("LeftSemi")[1].split("\n")[0]
