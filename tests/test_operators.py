"""Golden cases of the code model's operators on tiny tables."""

import pytest
from pyspark.sql import functions as F

from sievework.operators import budgets, code_graph, dependencies, findings, flows, joins, locate, ranges, reporting, rules, text, verdicts


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def make(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


# ---- flows


def test_flows_stop_at_sinks(spark):
    edges = make(spark, "src string, dst string", ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("b", "b"), ("a", "c"))
    node = lambda *x: make(spark, "node string", *[(n,) for n in x])
    assert rows(flows.bounded_flows(edges, node("a"), node("c"))) == [("a", "c", ["a", "b", "c"]), ("a", "c", ["a", "c"])]
    assert flows.bounded_flows(edges, node("a"), node("z")).count() == 0
    assert flows.bounded_flows(edges.limit(0), node("a"), node("c")).count() == 0


def test_paths_compare_node_by_node(spark):
    edges = make(spark, "src string, dst string", *[("s", x) for x in ("s1", "s10", "s1a")], *[(x, "p") for x in ("s1", "s10", "s1a")], *[("s1", f"q{i}") for i in range(12)])
    node = lambda *x: make(spark, "node string", *[(n,) for n in x])
    got = flows.bounded_flows(edges, node("s"), node("p", *[f"q{i}" for i in range(12)]))
    assert sorted(tuple(r["path"]) for r in got.collect())[0] == ("s", "s1", "p") and got.count() == 8
    assert [r["path"][1] for r in got.where("sink = 'p'").orderBy("path").collect()] == ["s1", "s10", "s1a"]


def test_first_discovery_and_bound(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)]
    edges = make(spark, "src string, dst string", *chain, ("n00", "x"), ("x", "n02"), ("n02", "t"))
    node = lambda x: make(spark, "node string", (x,))
    assert rows(flows.bounded_flows(edges, node("n00"), node("t"))) == [("n00", "t", ["n00", "n01", "n02", "t"])]
    assert flows.bounded_flows(edges, node("n00"), node("n12")).count() == 1 and flows.bounded_flows(edges, node("n00"), node("n13")).count() == 0


def test_endpoint_flow_and_attributes(spark):
    schema = "id string, repo string, path string, symbol string, type string, route string, annotations array<string>"
    nodes = make(
        spark, schema, ("w:a.py#@GET /orders", "w", "a.py", None, "endpoint", "GET /orders", None), ("w:a.py#authenticateUser", "w", "a.py", "authenticateUser", "function", None, ["authentication_required"]),
        ("v:<datastore>#get", "v", "<datastore>", "get", "datastore", None, ["security_sink"]), ("w:b.py", "w", "b.py", None, "file", None, []),
    )
    edges = make(spark, "src string, dst string, type string", ("w:a.py#@GET /orders", "w:a.py#authenticateUser", "handler"), ("w:a.py#authenticateUser", "v:<datastore>#get", "reads"), ("w:a.py#authenticateUser", "w:b.py", "contains"))
    assert rows(code_graph.sources(nodes), "type") == [("endpoint",)] and rows(code_graph.sinks(nodes), "type") == [("datastore",)]
    ids = lambda df: df.select(F.col("id").alias("node"))
    found = flows.bounded_flows(code_graph.traversable(edges), ids(code_graph.sources(nodes)), ids(code_graph.sinks(nodes)))
    (got,) = flows.flow_attributes(found, nodes).collect()
    assert got["validations"] == ["authentication_required at w:a.py#authenticateUser"] and got["transforms"] == ["w:a.py#authenticateUser"] and got["crosses_repo"] and got["n_nodes"] == 3
    assert not flows.reachability(nodes, found).first()["unconfirmed"] and flows.reachability(nodes, found.limit(0)).first()["unconfirmed"]
    where = make(spark, "id int, repo string, file string, symbol string", (1, "w", "a.py", "authenticateUser"), (2, "w", "b.py", None))
    assert rows(flows.flow_for_locations(where, found.withColumn("flow_seq", F.lit(7)), nodes)) == [(1, 7)]
    assert flows.flows_for_segment(found, nodes, make(spark, "repo string, path string", ("w", "a.py"))).count() == 1


def test_last_flow_near_the_sink_wins(spark):
    nodes = make(spark, "id string, repo string, path string, symbol string", *[(x, "r", x, None) for x in "abcd"])
    traced = make(spark, "flow_seq int, path array<string>", (1, ["a", "b", "c", "d"]), (2, ["b", "a"]), (3, ["a", "c", "b", "d"]))
    places = make(spark, "id int, repo string, file string, symbol string", (1, "r", "a", None), (2, "r", "b", None), (3, "r", "z", None))
    assert rows(flows.flow_for_locations(places, traced, nodes)) == [(1, 2), (2, 3)]


def test_closure_and_cycles(spark):
    edges = make(spark, "src string, dst string", ("web", "api"), ("api", "worker"), ("worker", "api"), ("x", "x"))
    nodes = make(spark, "node string", ("web",), ("worker",))
    assert rows(flows.closure(edges, nodes)) == [("web", "api"), ("web", "web"), ("web", "worker"), ("worker", "api"), ("worker", "worker")]
    assert rows(flows.cycles(edges)) == [(["api", "worker"],)]
    ring = make(spark, "src int, dst int", *[(i, (i + 1) % 120) for i in range(120)])
    assert flows.closure(ring, make(spark, "node int", (0,))).count() == 120
    assert flows.cycles(edges.limit(0)).count() == 0
    with pytest.raises(ValueError, match="larger bound"):
        flows.cycles(ring)


# ---- graph


SYMBOLS = "repo string, path string, name string, id string"


def test_calls_wiring_and_templates(spark):
    symbols = make(spark, SYMBOLS, ("a", "x.py", "run", "a:x.py#run"), ("b", "y.py", "run", "b:y.py#run"), ("a", "x.py", "main", "a:x.py#main"))
    calls = make(spark, "repo string, path string, caller string, callee string", ("a", "x.py", "main", "svc.run"), ("a", "x.py", "main", "run"), ("a", "z.py", "gone", "main"), ("a", "x.py", "run", "run"))
    got = code_graph.resolve_calls(calls, symbols)
    assert rows(got, "src", "dst", "cross_repo") == [("a:x.py#main", "a:x.py#run", False), ("a:x.py#main", "b:y.py#run", True), ("a:x.py#run", "b:y.py#run", True), ("a:z.py", "a:x.py#main", False)]
    wiring = make(spark, "repo string, path string, route string, target string, line int", ("a", "r.py", None, "run", 1), ("a", "r.py", "GET /q", "main", 2), ("a", "r.py", None, "nobody", 3))
    endpoints = make(spark, "id string, repo string, path string, route string", ("e1", "a", "r.py", "GET /q"), ("e2", "a", "r.py", "GET /p"))
    edges, missing = code_graph.resolve_wiring(wiring, symbols, endpoints)
    assert rows(edges, "src", "dst", "type") == [("a:r.py", "a:x.py#main", "calls"), ("a:r.py", "a:x.py#run", "calls"), ("e1", "a:x.py#main", "handler"), ("e1", "a:x.py#run", "handler"), ("e2", "a:x.py#run", "handler")]
    assert rows(missing, "file", "line", "name") == [("r.py", 3, "nobody")]
    assert rows(code_graph.bind_templates(make(spark, "repo string, sink string, name string", ("a", "t", "MAIN"), ("b", "t", "Main")), symbols), "src", "dst", "type") == [("a:x.py#main", "t", "renders")]


def test_calls_of_common_names_make_distinct_edges_without_an_exchange(spark, monkeypatch):
    monkeypatch.setattr(code_graph, "CELL", 3)
    symbols = make(spark, SYMBOLS, *[("a", f"x{i}.py", "run", f"a:x{i}.py#run") for i in range(11)], ("b", "y.py", "run", "shared"), ("b", "y.py", "go", "shared"), ("a", "y.py", "go", "shared"), (None, "n.py", "run", "n"))
    calls = make(spark, "repo string, path string, caller string, callee string", *[("a", f"z{i}.py", "gone", f"s.{c}") for i in range(10) for c in ("run", "go")], ("a:b", "c", "gone", "run"), ("a", "b:c", "gone", "run"), ("a", None, "gone", "run"))
    seen = {(r["repo"], r["path"], r["callee"].split(".")[-1]) for r in calls.collect() if r["path"]}
    want = {(f"{repo}:{path}", s["id"], None if s["repo"] is None else repo != s["repo"]) for repo, path, name in seen for s in symbols.collect() if s["name"] == name}
    got = code_graph.resolve_calls(calls, symbols)
    assert rows(got, "src", "dst", "cross_repo") == sorted(want, key=repr)
    above = code_graph.resolve_calls(calls, symbols.where("id like 'a:%'"))._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert above.count("Aggregate") == 0


def test_nodes_guards_and_access(spark):
    seen = make(spark, "id string, seq int, type string, annotations array<string>", ("n", 2, "late", ["b"]), ("n", 1, "first", ["a"]), ("m", 1, "only", None))
    assert rows(code_graph.upsert_nodes(seen)) == [("m", "only", []), ("n", "first", ["a", "b"])]
    access = make(spark, "repo string, path string, symbol string, operation string, detail string", ("a", "x", "f", "read", "users"), ("a", "x", "f", "execute", "users"), ("a", "x", "gone", "write", None))
    made, edges = code_graph.data_access(access, make(spark, "id string", ("a:x#f",)))
    assert rows(made, "id", "annotations") == [("a:<datastore>#users", ["security_sink"]), ("a:<datastore>#write", [])]
    assert rows(edges, "src", "dst", "type") == [("a:x#f", "a:<datastore>#users", "reads"), ("a:x#f", "a:<datastore>#users", "writes")]
    nodes = make(spark, "id string, repo string, path string, symbol string, type string, annotations array<string>", *[(f"a:{p}#{s}", "a", p, s, "function", None) for p, s in (("g.py", "guardAll"), ("g.py", "checkSession"), ("h.py", "other"))])
    uses = make(spark, "src string, dst string, type string", ("a:g.py", "a:g.py#guardAll", "contains"), ("a:x.test.js#t", "a:g.py#guardAll", "calls"), ("a:h.py#other", "a:g.py#checkSession", "calls"))
    pattern = r"guard\w+|check_?(?:session|auth\w*)|(?i:checkSession)"
    assert rows(code_graph.unattached_guards(nodes, uses, pattern), "symbol") == [("guardAll",)]
    assert [r["annotations"] for r in code_graph.with_unattached(nodes, uses, pattern).where("symbol = 'guardAll'").collect()] == [["unattached_security_guard"]]
    assert rows(code_graph.neighbours(make(spark, "id string", ("a:g.py#checkSession",)), uses)) == [("a:h.py#other",)]
    assert rows(code_graph.call_summary(uses, 1)) == [("a:h.py#other -> a:g.py#checkSession",)]
    digest = {r["file"]: r["callers"] for r in code_graph.role_digest(uses, nodes).collect()}
    assert digest["a:g.py"] == ["a:h.py"]
    points = make(spark, "id string, path string", ("e", "r.py"), ("f", "q.py"))
    marked = make(spark, "id string, symbol string, annotations array<string>", ("g", "guard", ["authentication_required"]))
    assert rows(code_graph.guard_matrix(points, make(spark, "src string, dst string, type string", ("e", "g", "handler")), marked)) == [("q.py", "none"), ("r.py", "guard")]


# ---- locations


def test_location_cascade(spark):
    nodes = make(
        spark, "id string, repo string, path string, symbol string, line_start int, line_end int",
        ("r:a#f2", "r", "a", "f", 30, 40), ("r:a#f1", "r", "a", "f", 10, 20), ("r:b#g", "r", "b", "g", 5, None), ("r:c#g", "r", "c", "g", 7, 3), ("r:a", "r", "a", None, None, None), ("r:gone", "r", "gone", None, None, None), ("r:a#n", "r", "a", "n", None, None),
    )
    found = make(
        spark, "id int, repo string, file string, symbol string, line_start int, line_end int",
        (1, "r", "", "f", 1, 1), (2, "r", "nowhere", "f", 1, 1), (3, "r", "a", "f", 99, 99), (4, "r", "a", "g", 1, 1), (5, "r", "a", None, 500, 600), (6, "r", "a", "n", 3, 1000), (7, "r", "gone", None, 1, 1), (8, "r", "a", "h", None, None),
    )
    lines = make(spark, "repo string, path string, lines int", ("r", "a", 100), ("r", "gone", 0))
    got = {r["id"]: r for r in locate.resolve_locations(found, nodes, lines).collect()}
    assert [got[i]["tier"] for i in range(1, 9)] == ["rejected", "rejected", "symbol", "symbol", "file", "file", "rejected", "file"]
    assert (got[3]["r_file"], got[3]["r_start"], got[3]["r_end"], got[3]["alternatives_existed"], got[3]["chosen_by"]) == ("a", 10, 20, True, "lowest node id among same-file definitions")
    assert (got[4]["r_file"], got[4]["r_start"], got[4]["r_end"]) == ("b", 5, 5) and got[4]["chosen_by"].startswith(locate.ELSEWHERE + "; lowest")
    assert (got[5]["r_start"], got[5]["r_end"]) == (100, 100) and "exceeds the file's 100 lines" in got[5]["chosen_by"]
    assert (got[6]["r_start"], got[6]["r_end"], got[8]["r_start"], got[8]["r_end"]) == (3, 100, 1, 1) and "could not be read" in got[7]["rejected_reason"]
    assert tuple(locate.resolution_tiers(locate.resolve_locations(found, nodes, lines)).first()) == (2, 3, 3)
    inside = make(spark, "repo string, path string", ("r", "b"))
    assert {r["rejected_reason"] is None for r in locate.resolve_locations(found, nodes, lines, inside).collect()} == {False}


def test_enclosing_and_following(spark):
    symbols = make(spark, "path string, name string, kind string, line_start int, line_end int", ("a", "C", "class", 1, 50), ("a", "f", "function", 5, 20), ("a", "g", "function", 10, 12), ("b", "K", "class", 1, 9))
    points = make(spark, "path string, line int", ("a", 11), ("a", 6), ("a", 30), ("a", 60), ("b", 3))
    assert rows(locate.enclosing(points, symbols, ["path"])) == [("a", 11, "g"), ("a", 30, "C"), ("a", 6, "f"), ("a", 60, None), ("b", 3, "K")]
    assert rows(locate.following_symbol(points, symbols, ["path"])) == [("a", 11, "g"), ("a", 30, "C"), ("a", 6, "g"), ("a", 60, None), ("b", 3, "K")]
    texts = make(spark, "path string, text string", ("a", "x\n" * 10 + "eval(y)\n"))
    assert rows(locate.lines_in_symbols(texts, symbols, ["path"], "eval")) == [("a", 11, "g")]


# ---- decisions


def calibration(spark, *data):
    schema = "id int, severity double, confidence double, verified boolean, gap string, control string, usage string"
    return {r["id"]: (r["severity"], r["confidence"], r["caps"]) for r in verdicts.calibrated(make(spark, schema, *data)).collect()}


def test_calibration(spark):
    cap = "plausible-unconfirmed-reachability"
    assert calibration(spark, (1, 7.0, 0.9, True, None, None, None), (2, 9.8, 0.9, False, None, None, None)) == {1: (7.0, 0.9, []), 2: (6.9, 0.5, [cap])}
    assert calibration(spark, (3, 8.2, 0.9, False, "", None, None))[3] == (8.2, 0.5, [cap])
    assert calibration(spark, (4, 6.1, 0.9, True, None, "unassessed", None))[4] == (6.1, 0.6, ["framework-control-unassessed"])
    severity, _, caps = calibration(spark, (5, 6.1, 0.9, True, None, "credited", None))[5]
    assert severity < 6.1 and caps[0] == "framework-control-credited"
    assert calibration(spark, (6, 6.1, 0.4, True, None, "absent", None))[6] == (6.1, 0.4, [])
    assert calibration(spark, (7, 5.0, 0.9, True, None, None, "none-found"))[7] == (5.0, 0.5, ["usage-none-found"])
    assert calibration(spark, (8, 9.0, 0.9, False, "another doubt", None, None), (9, 4.0, 0.9, True, None, None, None))[8] == (9.0, 0.9, [])
    broken = make(spark, "severity double, verified boolean", (5.0, True), (6.0, False))
    assert verdicts.ranking_broken(broken).first()[0] and not verdicts.ranking_broken(broken.where("verified")).first()[0]


def test_verdicts(spark):
    schema = "id int, cwe string, detection string, has_flow boolean, validations array<string>, implicated array<string>, gap_active boolean"
    auth = ["authentication_required at w:a.py#guard"]
    data = [
        (1, "CWE-862", None, True, auth, ["other"], False), (2, "CWE-862", None, True, auth, ["guard"], False), (3, "CWE-79", None, True, auth, [], False), (4, "CWE-1427", None, True, ["boundary_labeled at x"], [], False), (5, "CWE-798", None, False, [], [], False),
        (6, "CWE-798", "heuristic", False, [], [], False), (7, "CWE-306", "format", False, [], [], True), (8, "CWE-306", "format", False, [], None, False), (9, "CWE-89", None, False, [], [], False),
    ]
    got = {r["id"]: (r["status"], r["basis"], r["gap"] is not None) for r in verdicts.verdict(make(spark, schema, *data)).collect()}
    assert got == {1: ("disproven", None, False), 2: ("verified", "traced", False), 3: ("verified", "traced", False), 4: ("disproven", None, False), 5: ("verified", "presence", False), 6: ("plausible", None, True), 7: ("plausible", None, True), 8: ("verified", "presence", False), 9: ("plausible", None, True)}
    route = make(
        spark, "id int, flow_known boolean, route_marks array<string>, missing_check string, partial boolean, actor string",
        (1, False, [], "", False, ""), (2, True, None, "", False, ""), (3, True, ["authentication_required"], "no staff check", False, "user"), (4, True, ["authentication_required"], "no identity", False, "user"), (5, True, [], "x", True, "user"), (6, True, [], "x", False, "undetermined"),
    )
    assert rows(verdicts.flow_verdict(route), "id", "status") == [(1, "plausible"), (2, "plausible"), (3, "verified"), (4, "disproven"), (5, "plausible"), (6, "plausible")]


def test_applicability_and_remap(spark):
    data = make(spark, "member string, shapes array<string>, requested boolean", ("svc-server", ["server-request-issuer"], False), ("spa-browser", ["browser-client"], False), ("tool-cli", ["cli"], False), ("lib-package", ["library"], False), ("mystery", ["undetermined"], False), ("none", [], False), ("asked", ["cli"], True), ("both", ["browser-client", "server-request-issuer"], False))
    need = F.array(F.lit("server-request-issuer"))
    got = data.withColumn("applicable", verdicts.applicable(F.col("shapes"), need, F.col("requested"))).withColumns({"cwe": F.lit("CWE-918"), "severity": F.lit(8.6), "alternative": F.lit("CWE-601"), "alternative_severity": F.lit(5.4)})
    out = {r["member"]: (r["applicable"], r["cwe"], r["severity"]) for r in verdicts.remapped(got).collect()}
    moved, kept = ("false", "CWE-601", 5.4), lambda s: (s, "CWE-918", 8.6)
    assert out == {"svc-server": kept("true"), "spa-browser": moved, "tool-cli": moved, "lib-package": moved, "mystery": kept("undetermined"), "none": kept("undetermined"), "asked": kept("true"), "both": kept("true")}
    assert spark.range(1).select(verdicts.applicable(F.array(F.lit("cli")), F.lit(None).cast("array<string>"))).first()[0] == "true"


def test_control_states(spark):
    names = ("n_frameworks", "control_id", "requires_config", "escapes", "sink_marker", "sink_framework_fits", "sink_known", "unparsed_member", "bypass_member", "unparsed_path", "bypass_path")
    base = dict(zip(names, (1, "c", False, True, None, True, True, False, False, False, False), strict=True))
    cases = [({"n_frameworks": 0}, "unassessed"), ({"control_id": None}, "absent"), ({"sink_marker": "m", "sink_framework_fits": False}, "absent"), ({"sink_marker": "m", "sink_known": False}, "absent"), ({"sink_marker": "m", "unparsed_member": True}, "unassessed"), ({"sink_marker": "m", "bypass_member": True}, "bypassed"), ({"sink_marker": "m"}, "credited"), ({"requires_config": True, "escapes": False}, "unassessed"), ({"unparsed_path": True, "bypass_path": True}, "unassessed"), ({"bypass_path": True}, "bypassed"), ({}, "credited")]
    schema = "i int, n_frameworks int, control_id string, requires_config boolean, escapes boolean, sink_marker string, sink_framework_fits boolean, sink_known boolean, unparsed_member boolean, bypass_member boolean, unparsed_path boolean, bypass_path boolean"
    data = [(i, *(base | change).values()) for i, (change, _) in enumerate(cases)]
    assert rows(verdicts.control_state(make(spark, schema, *data)), "i", "control") == sorted(((i, want) for i, (_, want) in enumerate(cases)), key=repr)


def test_triage(spark):
    schema = "id int, asked boolean, answered boolean, well_formed boolean, gated boolean, verdict string, citations_hold boolean, in_perimeter boolean, severity double, confidence double"
    ok = (True, True, True, False)
    data = [(0, False, None, None, None, None, None, None), (1, True, False, None, None, None, None, None), (2, True, True, False, False, "refuted", True, False), (3, *ok, "confirmed", False, False), (4, *ok, "flagged", False, False), (5, *ok, "refuted", False, False), (6, *ok, "refuted", True, True), (7, *ok, "refuted", True, False), (8, *ok, "downgraded", True, False), (9, True, True, True, True, "refuted", True, False)]
    got = {r["id"]: (r["outcome"], r["effect"], r["kept"], r["severity"], r["confidence"]) for r in verdicts.triage_outcomes(make(spark, schema, *[(*d, 1.5, 0.9) for d in data])).collect()}
    same = (True, 1.5, 0.9)
    assert got == {0: (None, None, *same), 1: ("unanswered", "none", *same), 2: ("rejected-malformed", "none", *same), 3: ("applied", "none", *same), 4: ("applied", "flag-attached", *same), 5: ("degraded-flagged", "flag-attached", *same), 6: ("rejected-perimeter", "flag-attached", *same), 7: ("applied", "suppression-added", False, 1.5, 0.9), 8: ("applied", "grading-adjusted", True, 1.0, 0.8), 9: ("rejected-malformed", "none", *same)}
    found = make(spark, "id int, dependency string, band string, detection string, verified boolean", (1, None, "High", None, True), (2, "p", "High", None, True), (3, None, "Low", "heuristic", False), (4, None, "Low", None, True), (5, None, "Odd", None, False))
    assert rows(verdicts.triage_candidates(found), "id") == [(1,), (3,), (5,)] and rows(verdicts.triage_candidates(found, include_unverified=False), "id") == [(1,)]
    assert [verdicts.is_credential(F.lit(c)) is not None for c in ("cwe-798",)] == [True]


# ---- dependencies


def test_cross_check(spark):
    schema = "id int, member string, package string, fixed string, introduced string, file string, line_start int"
    found = make(spark, schema, (1, "m", "ghost-lib", "1.0.0", "", None, None), (2, "m", "safe-serial", "3.0.0", "", None, None), (3, "m", "left-pad-again", "1.2.4", "", None, None), (4, "m", None, "", "", "src/missing.py", 1), (5, "m", None, "", "", "src/app.py", 3), (6, "m", None, "", "", "src/app.py", 300), (7, "stranger", "ghost-lib", "1", "", None, None), (8, "m", "left-pad-again", "", "2.0", None, None))
    pins = make(spark, "member string, package string, version string", ("m", "safe-serial", "3.0.0"), ("m", "left-pad-again", "1.2.3"))
    held = make(spark, "member string, file string, lines int", ("m", "src/app.py", 10))
    got = {r["id"]: r["ground"] for r in dependencies.cross_check(found, pins, make(spark, "member string", ("m",)), held).collect()}
    assert got == {1: "package-absent", 2: "version-outside-range", 3: "", 4: "location-unresolvable", 5: "", 6: "location-unresolvable", 7: "", 8: "version-outside-range"}


def test_merge_and_groups(spark):
    schema = "id string, seq int, ecosystem string, package string, range string, advisory_ids array<string>, sources array<string>"
    native = make(spark, schema, ("N1", 1, "npm", "a", "<2", ["X"], ["audit"]), ("N2", 2, "npm", "a", "<2", ["Y"], ["audit"]))
    external = make(spark, schema, ("E1", 1, "npm", "a", "<2", ["Z"], ["osv"]), ("E2", 2, "npm", "a", "", ["Y"], ["trivy"]), ("E3", 3, "npm", "b", "<2", ["X"], ["osv"]), ("E4", 4, None, None, None, None, ["semgrep"]))
    merged, rest = dependencies.merge_external(native, external)
    assert rows(merged, "id", "sources") == [("N1", ["audit", "osv"]), ("N2", ["audit", "trivy"])] and rows(rest, "id") == [("E3",), ("E4",)]
    reports = make(spark, "scanner string, ecosystem string", ("osv", "npm"), ("old", None), ("nobody", "go"))
    scanners = make(spark, "scanner string, ecosystem string", ("osv", "npm"), ("osv", "go"), ("old", "pypi"))
    covered = dependencies.covered_domains(reports, scanners)
    assert rows(covered) == [("npm",), ("pypi",)] and rows(dependencies.displaced(make(spark, "ecosystem string", ("npm",), ("go",)), covered)) == [("go",)]
    advisories = make(spark, "member string, ecosystem string, package string, range string, exposure string, ambiguous boolean", ("m1", "npm", "P", "<1", "development", False), ("m2", "npm", "P", "<1", "runtime", True))
    (one,) = dependencies.advisory_groups(advisories).collect()
    assert (one["reporters"], one["exposure"], one["ambiguous"], one["members"], one["attribution"]) == (["m1", "m2"], "runtime", True, ["m1", "m2"], "per-member")
    declared = make(spark, "member string, package string", ("m3", "p"))
    assert [(r["members"], r["attribution"]) for r in dependencies.advisory_groups(advisories, declared, True).collect()] == [(["m3"], "per-member")]
    assert [(r["members"], r["attribution"]) for r in dependencies.advisory_groups(advisories, declared.limit(0), True).collect()] == [([], "not-derivable")]
    assert dependencies.distinct_advisories(advisories.unionByName(advisories)).count() == 2


def test_merge_goes_into_the_first_native_of_a_mark(spark):
    schema = "id string, seq int, ecosystem string, package string, range string, advisory_ids array<string>, sources array<string>"
    native = make(spark, schema, ("N1", 2, "npm", "a", "<2", ["X", None], ["audit"]), ("N2", 1, "npm", "a", "<2", ["Y"], ["audit"]), ("N3", 0, None, "a", "<2", ["X"], ["audit"]), ("N4", 0, "npm", None, "<2", ["X"], ["audit"]), ("N5", 9, "npm", "b", None, None, ["audit"]))
    external = make(spark, schema, ("E1", 1, "npm", "a", "<2", ["X"], ["osv"]), ("E2", 1, "npm", "a", "<3", ["X", "X"], ["trivy", "osv"]), ("E3", 1, "npm", "a", None, [None], ["osv"]), ("E4", 1, None, "a", "<2", ["X"], ["osv"]), ("E5", 1, "npm", "b", "", [], None), ("E6", 1, "npm", "a", "X", ["<2"], ["osv"]), ("E7", 1, "npm", "a", "", ["X"], None))
    merged, rest = dependencies.merge_external(native, external)
    assert rows(merged, "id", "sources") == [("N1", ["audit", "osv", "trivy"]), ("N2", ["audit", "osv"]), ("N3", ["audit"]), ("N4", ["audit"]), ("N5", ["audit"])]
    assert rows(rest, "id") == [("E3",), ("E4",), ("E5",), ("E6",)] and merged.columns == rest.columns == native.columns


def test_versions_and_cycles(spark):
    components = make(spark, "ecosystem string, package string, version string", ("npm", "a", "1.2.10"), ("npm", "a", "1.10.0"), ("npm", "b", "2.0.0-rc1"))
    advisories = make(spark, "ecosystem string, package string, introduced string, fixed string", ("npm", "a", "1.2.9", "1.10.0"), ("npm", "b", "", "2.0.0"), ("npm", "b", "1", None))
    assert rows(dependencies.affected_components(components, advisories), "version", "introduced") == [("1.2.10", "1.2.9"), ("2.0.0-rc1", "1")]
    assert rows(dependencies.affected_coordinates(components, advisories), "version", "introduced") == [("1.2.10", "1.2.9"), ("2.0.0-rc1", "1")]
    cycles = make(spark, "product string, cycle string, eol date", ("ng", "9", None), ("ng", "9.1", None)).withColumn("eol", F.when(F.col("cycle") == "9", F.lit("2021-08-06").cast("date")))
    versions = make(spark, "product string, version string", ("ng", "9.0.1"), ("ng", "9.1.2"), ("ng", "90.1"), ("other", "1"))
    got = {r["version"]: (r["cycle"], r["ended"], r["reason"]) for r in dependencies.release_cycles(versions, cycles, F.lit("2024-01-01").cast("date")).collect()}
    assert got == {"9.0.1": ("9", True, None), "9.1.2": ("9.1", None, "no end-of-support date published"), "90.1": (None, None, "release cycle not in dataset"), "1": (None, None, "product not in dataset")}
    old = make(spark, "member string, product string, cycle string, package string, version string, exposure string", ("m", "ng", "9", "@angular/core", "9.0.1", "development"), ("m", "ng", "9", "@angular/platform-browser", "9.0.1", "runtime"))
    assert [(r["packages"], r["runtime"]) for r in dependencies.currency_rollup(old).collect()] == [({"@angular/core": "9.0.1", "@angular/platform-browser": "9.0.1"}, True)]
    outcomes = dependencies.audit_outcomes(make(spark, "member string, ecosystem string", ("m", "npm"), ("m", "go"), ("m", "pypi")), make(spark, "member string, ecosystem string", ("m", "npm")), make(spark, "ecosystem string", ("npm",), ("pypi",)))
    assert rows(outcomes) == [("m", "go", "could-not-check", 0), ("m", "npm", "advisories", 1), ("m", "pypi", "clean", 0)]


def test_usage(spark):
    packages = make(spark, "member string, ecosystem string, package string", ("stale", "npm", "marked"), ("consumer", "npm", "minimist"), ("scoped", "npm", "@a/b"), ("py", "pypi", "PyYAML"), ("gone", "npm", "x"), ("dyn", "npm", "x"), ("g", "go", "github.com/a/b"), ("j", "maven", "g:a"), ("tests", "npm", "mocha"))
    imports = make(spark, "member string, path string, language string, text string", ("stale", "a.js", "javascript", "import u from 'unfetch'"), ("consumer", "a.ts", "typescript", "import m from 'minimist/lib'"), ("scoped", "a.ts", "typescript", "import m from '@a/b/c'"), ("py", "a.py", "python", "import yaml.nodes"), ("dyn", "a.js", "javascript", "import x from './x'"), ("g", "a.go", "go", 'import "github.com/a/b/c"'), ("tests", "t/a.test.js", "javascript", "require('mocha')"))
    files = make(spark, "member string, path string, language string, parsed boolean, text string", *[(m, p, lang, True, "require(name)" if m == "dyn" else "") for m, p, lang in (("stale", "a.js", "javascript"), ("consumer", "a.ts", "typescript"), ("scoped", "a.ts", "typescript"), ("py", "a.py", "python"), ("dyn", "a.js", "javascript"), ("g", "a.go", "go"), ("j", "A.java", "java"), ("tests", "t/a.test.js", "javascript"))])
    overrides = make(spark, "ecosystem string, module string, package string", ("pypi", "yaml", "PyYAML"))
    state = lambda o: {r["member"]: (r["usage"], r["role"]) for r in verdicts.usage_state(dependencies.usage_evidence(packages, imports, files, o)).collect()}
    got = state(overrides)
    assert got["stale"] == ("none-found", None) and got["consumer"] == got["scoped"] == got["py"] == got["g"] == ("found", "runtime")
    assert got["gone"] == got["dyn"] == ("undetermined", None) and got["tests"] == ("found", "development")
    assert state(None)["j"] == ("undetermined", None) and state(None)["py"] == ("none-found", None)


# ---- budgets


def test_greedy(spark):
    sizes = lambda *x: spark.range(1).select(budgets.greedy_groups(F.array(*map(F.lit, x)), F.lit(25))).first()[0]
    assert sizes(10, 10, 10, 10, 10) == [0, 0, 1, 1, 2] and sizes(100) == [0] and sizes(100, 1) == [0, 1]
    requests = make(spark, "model string, seq int, size int", ("m1", 1, 1), ("m1", 2, 1), ("m2", 3, 1), *[("m3", i, 1) for i in range(10, 15)])
    assert rows(budgets.batch_chunks(requests, 2, 100), "model", "seq", "chunk") == [("m1", 1, 0), ("m1", 2, 0), ("m2", 3, 0), *[("m3", 10 + i, i // 2) for i in range(5)]]
    files = make(spark, "segment string, path string, tokens int, is_test boolean", ("s", "__tests__/a", 40, True), ("s", "src/b", 40, False), ("s", "src/c", 40, False), ("t", "x", 999, False))
    assert rows(budgets.split_segments(files, 120)) == [("s", 1, "src/b", 40), ("s", 1, "src/c", 40), ("s", 2, "__tests__/a", 40), ("t", 0, "x", 999)]
    entries = spark.range(1).select(budgets.listed_entries(F.transform(F.sequence(F.lit(1), F.lit(42)), lambda i: i.cast("string")), F.lit("seg"))).first()[0]
    assert len(entries) == 41 and entries[-1] == "+2 more (full enumeration in segments/seg.json)"
    kept = budgets.fitting(make(spark, "k string, n int", ("a", 5), ("a", 3), ("a", 9)), ["k"], "n", [F.col("n")], 8)
    assert rows(kept) == [("a", 3), ("a", 5)]


def test_chunks_of_a_long_model(spark, monkeypatch):
    def greedy(sizes, most, limit):
        out, chunk, n, held = [], 0, 0, 0
        for size in sizes:
            if n and (n >= most or (held is not None and size is not None and held + size > limit)):
                chunk, n, held = chunk + 1, 0, 0
            n, held = n + 1, None if held is None or size is None else held + size
            out.append(chunk)
        return out

    plain = lambda df: sorted((r["model"], r["seq"], r["chunk"]) for r in df.where("model is not null").collect())
    for block in (1, 7, 64):
        monkeypatch.setattr(budgets, "BLOCK", block)
        for most, limit in ((5, 40), (25, 100), (1, 9)):
            sizes = {m: [None if i * k % 37 == 5 else 0 if i * k % 11 == 3 else i * i * k % 53 for i in range(n)] for m, n, k in (("a", 150, 7), ("b", 1, 3), ("c", 71, 5), ("", 14, 1))}
            data = [(m, i * 3, x, "t") for m, xs in sizes.items() for i, x in enumerate(xs)]
            got = budgets.batch_chunks(make(spark, "model string, seq long, size int, text string", *data, (None, 1, 5, "t"), (None, 2, 5, "t")), most, limit)
            assert plain(got) == sorted((m, i * 3, c) for m, xs in sizes.items() for i, c in enumerate(greedy(xs, most, limit)))
            assert got.columns == ["model", "seq", "size", "text", "chunk"] and got.where("model is null").count() == 2
    many = spark.range(300_000).select(F.lit("m").alias("model"), F.col("id").alias("seq"), (F.col("id") % 900).alias("size"))
    monkeypatch.undo()
    got = budgets.batch_chunks(many, 25, 12_000)
    assert got.agg(F.max("chunk")).first()[0] == greedy([i % 900 for i in range(300_000)], 25, 12_000)[-1]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "FlatMapGroupsInArrow" in plan


def test_excerpts(spark):
    text_ = "\n".join(f"line {i}" for i in range(1, 101))
    files = make(spark, "repo string, path string, text string", ("r", "a", text_), ("r", "empty", ""), ("r", "long", "x" * 300))
    found = make(spark, "id int, repo string, file string, line_start int, line_end int", (1, "r", "a", 10, 12), (2, "r", "a", 1, 60), (3, "r", "a", 40, 77), (4, "q", "a", 1, 1), (5, "r", "none", 1, 1), (6, "r", "empty", 1, 1), (7, "r", "long", 1, 1), (8, "r", "a", 500, 500))
    got = {r["id"]: r for r in budgets.excerpts(found, files, make(spark, "repo string", ("r",))).collect()}
    window = lambda i: (got[i]["window_start"], got[i]["window_end"], got[i]["truncated"])
    assert window(1) == (7, 15, False) and window(2) == (1, 60, True) and window(3) == (39, 78, True) and window(7) == (1, 1, True) and window(8) == (97, 100, False)
    assert [x["number"] for x in got[1]["lines"] if x["cited"]] == [10, 11, 12] and len(got[7]["lines"][0]["text"]) == 200
    assert [got[i]["status"] for i in (4, 5, 6)] == ["unavailable"] * 3 and len({got[i]["reason"] for i in (4, 5, 6)}) == 3
    view = budgets.sliced_view(files.where("path = 'a'"), make(spark, "repo string, path string, a int, z int", ("r", "a", 20, 21), ("r", "a", 21, 22)), header=2)
    assert rows(view, "line_no", "skipped") == [(1, 0), (2, 0), (20, 17), (21, 0), (22, 0)]


def test_ranks_and_sums_by_ranges(spark):
    data = [("a" if i % 3 else "b", (i * 7919) % 1009, i) for i in range(500)]
    df = make(spark, "k string, v int, id int", *data).repartition(7)
    got = {(r["k"], r["id"]): r["rank"] for r in ranges.ranked(df, ["k"], [F.desc("v"), F.col("id")]).collect()}
    want = {}
    for k in "ab":
        for n, (_, _, i) in enumerate(sorted((x for x in data if x[0] == k), key=lambda x: (-x[1], x[2])), 1):
            want[k, i] = n
    assert got == want
    total = {r["k"]: r["m"] for r in ranges.cumulative(df, ["k"], [F.col("id")], F.col("v"), "run").groupBy("k").agg(F.max("run").alias("m")).collect()}
    assert total == {k: sum(v for x, v, _ in data if x == k) for k in "ab"}


# ---- reports


def test_folds(spark):
    item = "array<struct<file:string,reason:string>>"
    e = lambda *rs: [("f", r) for r in rs]
    found = make(spark, f"id string, seq int, cwe string, symbol string, confidence double, evidence {item}", ("A", 1, "c", None, 0.5, e("x", "y")), ("B", 2, "c", None, 0.9, e("z")), ("C", 3, "c", None, 0.9, e("z", "x", "w", "w")), ("D", 4, "c", "s", 0.1, e("q")))
    got = {r["id"]: ([x["reason"] for x in r["evidence"]], r["duplicates"]) for r in reporting.fold_duplicates(found, ["cwe", "symbol"]).collect()}
    assert got == {"B": (["z", "x", "y", "w"], ["A", "C"]), "D": (["q"], [])}
    assert rows(findings.best_by(found.drop("evidence"), ["cwe"]), "id", "merged") == [("B", 4)]


def test_folds_of_null_keys_and_pieces_need_one_exchange(spark):
    item = "array<struct<file:string,reason:string>>"
    found = make(spark, f"id string, seq int, cwe string, confidence double, evidence {item}", ("A", 1, None, 0.5, [("f", None), ("f", "x")]), ("B", 2, None, 0.9, [("g", "z"), ("g", "z")]), ("C", 3, None, 0.9, None), ("D", 4, None, 0.2, []), ("E", 5, "c", 0.1, [("f", "q"), ("f", "q")]), ("F", 6, "d", 0.1, None), ("G", 7, "g", 0.9, None), ("H", 8, "g", 0.1, [("f", "q")]), ("I", 9, "i", 0.9, None), ("J", 10, "i", 0.1, None))
    folded = reporting.fold_duplicates(found, ["cwe"])
    got = {r["id"]: (r["evidence"] and [tuple(e) for e in r["evidence"]], r["duplicates"]) for r in folded.collect()}
    assert got == {"B": ([("g", "z"), ("f", None), ("f", "x")], ["A", "C", "D"]), "E": ([("f", "q"), ("f", "q")], []), "F": (None, []), "G": ([("f", "q")], ["H"]), "I": (None, ["J"])}
    dealt = reporting.fold_duplicates(found.repartition(3, "cwe"), ["cwe"])
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_links_and_families(spark):
    found = make(spark, "id string, cwe string, repo string, file string, flow_ref string", ("A", "c", "r", "f", None), ("B", "c", "r", "f", "flow"), ("C", "d", "r", "f", None))
    assert rows(reporting.systemic_links(found)) == [("B", "A")] and rows(reporting.flow_links(found)) == [("A", "B"), ("B", "A")]
    said = make(spark, "id string, from_pack boolean, text string", ("A", False, "reads X-User-Email"), ("B", True, "x-user-email again"), ("C", False, "authorization, query, ax-user-x"))
    assert rows(reporting.identity_families(said)) == [("x-user-email", "A", "B", "related"), ("x-user-email", "B", "A", "dependent")]
    evidence = make(spark, "id string, repo string, segment string", ("A", "r", "s"), ("A", "q", "s"), ("B", "r", None), ("B", "r", "s"))
    assert rows(reporting.cross_system_ids(evidence)) == [("A",)]
    assert rows(reporting.repo_view(found, evidence, "q"), "id") == [("A",)] and rows(reporting.files_cited(found, evidence.withColumn("file", F.lit("g"))).where("repo = 'q'"), "ids") == [(["A"],)]
    banded = make(spark, "cwe string, band string", ("a", "Low"), ("a", "Critical"), ("b", "High"))
    assert [tuple(r) for r in reporting.recommendations(banded).collect()] == [("a", 2, "Critical,Low"), ("b", 1, "High")]


def test_gaps_and_coverage(spark):
    notes = make(spark, "note string", ("f dropped at level 1 for budget",), ("f dropped at level 2 for budget",), ("g dropped at level 3",), ("plain",), ("plain",), ("h at level 1",), ("h at level 1",))
    assert rows(reporting.gap_notes(notes)) == [("f dropped (levels 1, 2) for budget",), ("g dropped at level 3",), ("h (levels 1)",), ("plain",)]
    gaps = make(spark, "cause string, file string, segment string", ("budget-dropped", "src/a.py", "s"), ("budget-dropped", "src/a.py", "s"), ("unparsed-format", "x/authz.rb", "s"), ("blocked-value", "Dockerfile", "s"), ("budget-dropped", "src/b.py", "s"))
    nodes = make(spark, "path string, annotations array<string>, file_class string, symbol string, parsed boolean", ("src/a.py", ["security_sink"], "source", None, True), ("src/b.py", [], "source", None, False), ("src/b.py", [], "source", "f", False), ("Dockerfile", None, "deploy-config", None, False))
    classes = make(spark, "name string, file_class string", ("Dockerfile", "deploy-config"), ("x.html", "template"))
    assert rows(reporting.gap_details(gaps, nodes, classes), "file", "critical") == [("Dockerfile", True), ("src/a.py", True), ("src/b.py", False), ("x/authz.rb", True)]
    kinds = make(spark, "file_class string", ("source",), ("template",))
    assert rows(reporting.file_class_coverage(kinds, nodes)) == [("deploy-config", 1, [], True), ("source", 1, ["src/b.py"], True), ("template", 0, [], False)]
    sections = make(spark, "section string, text string", ("lead", "see SEC-0001 and SEC-0009"))
    assert rows(reporting.dangling_references(sections, make(spark, "id string", ("SEC-0001",)))) == [("lead", "SEC-0009")]


def test_contradictions(spark):
    schema = "id string, band string, printed_band string, status string, observed boolean, trail array<string>, path array<string>, control string, impact_restated boolean, reproduction_text string, trigger string, trigger_reason string, read_guidance string, refs array<string>"
    clean = ("A", "High", "High", "verified", True, ["a"], ["a", "b"], "credited", True, "run", "t", None, "g", ["B"])
    bad = ("B", "High", "Low", "disproven", True, ["z"], ["a"], "credited", False, "run", "", "", "", ["A", "Q"])
    worse = ("C", "Low", "Low", "plausible", False, ["z"], [], None, None, None, "", "none known", "g", [])
    got = reporting.contradictions(make(spark, schema, clean, bad, worse), make(spark, "section string, text string", ("s", "SEC-1234")))
    assert rows(got) == sorted([*[(r, "B") for r in ("finding-outside-band", "unearned-observation", "trail-entry-off-path", "impact-against-credited-control", "reproduction-against-narrative", "trigger-omitted-without-reason", "missing-read-guidance", "dangling-finding-reference")], ("trail-without-path", "C"), ("dangling-section", "s")], key=repr)


def test_declarations(spark):
    flags = make(spark, "id int, repo string, file string, cwe string, symbol string, question string, severity double, confidence double", (1, "r", "f", "CWE-79", "s", "q", 8.0, 0.9), (2, "r", "g", "CWE-79", None, "q", 8.0, 0.9), (3, "r", "h", "CWE-798", None, "p", 8.0, 0.9), (4, "r", "i", "CWE-89", None, "u", 8.0, 0.9))
    said = make(spark, "seq int, repo string, file string, cwe string, symbol string, question string, resolution string, clean boolean", (1, "r", "f", "cwe-79", "s", "q", "downgrade", True), (2, "r", "h", "CWE-798", None, "p", "refute", True), (3, "r", "f", "CWE-79", "other", "q", "refute", True), (4, "r", "i", "CWE-89", None, "u", "refute", False))
    decisions, resolved = reporting.apply_declarations(said, flags)
    assert rows(decisions) == [("1", "applied", "grading-adjusted"), ("2", "applied", "grading-adjusted"), ("3", "rejected-credential-refute", "none"), ("declaration:r:f:CWE-79", "declared-lapsed", "none"), ("declaration:r:i:CWE-89", "rejected-declaration", "none")]
    assert rows(resolved, "id", "effect", "severity", "confidence") == [(1, "grading-adjusted", 4.0, 0.8), (2, "grading-adjusted", 4.0, 0.8), (3, "none", 8.0, 0.9), (4, None, 8.0, 0.9)]
    open_ = make(spark, "id int, question string, provenance string, hint string", (1, "q", "p", "b"), (2, "q", "p", "a"))
    assert rows(reporting.awaiting_questions(open_)) == [("q", "p", [1, 2], "a; b")]


def test_ids_and_regimes(spark):
    found = make(spark, "id string, producer string, file string", (None, "b", "z"), (None, "a", "y"), ("SEC-0007", "a", "x"), (None, "a", "w"), (None, "b", "a"))
    got = {(r["producer"], r["file"]): r["id"] for r in reporting.allocated_ids(found, ["a", "b"], ["file"]).collect()}
    assert got == {("a", "x"): "SEC-0007", ("a", "w"): "SEC-0008", ("a", "y"): "SEC-0009", ("b", "a"): "SEC-0010", ("b", "z"): "SEC-0011"}
    seen = make(spark, "category string, step string", ("personal-data", "s1"), ("health", "s2"))
    packs = make(spark, "regime string, category string", ("gdpr", "personal-data"), ("hipaa", "health"))
    declared = make(spark, "regime string", ("ccpa",), ("gdpr",))
    names = lambda mode: [r[0] for r in rows(reporting.regimes(seen, packs, declared, mode), "regime")]
    assert (names("inferred"), names("declared"), names("hybrid")) == (["gdpr", "hipaa"], ["ccpa", "gdpr"], ["ccpa", "gdpr", "hipaa"])


# ---- texts and rules


def test_must_find(spark):
    wanted = make(spark, "item_id int, wanted string", (1, "big brown bear"), (2, "own fo"), (3, "absent words here"), (4, "x"), (5, "brown  bear sat"))
    files = make(spark, "path int, text string", (1, "a big brown bear sat"), (2, "brown fox"), (3, "big brown bears"), (4, "a brown  bear sat"))
    assert rows(text.must_find(wanted, files)) == [(1, 2, True), (2, 1, True), (3, 0, False), (4, 1, True), (5, 1, True)]


def test_absence_of_searched_files_is_undetermined(spark):
    files = make(spark, "repo string, path long, language string, text string", ("r", 1, "de", "License"), ("s", 2, "en", "x"), ("t", 3, "en", "License"))
    got = {r["repo"]: r["state"] for r in text.absence(files, "License", "en").collect()}
    assert got == {"r": "undetermined", "s": "absent-proven", "t": "evidenced"}
    a, b = make(spark, "k int, d string", (1, "x"), (2, "y"), (4, "s")), make(spark, "k int, d string", (2, "z"), (3, "w"), (4, "s"))
    assert rows(joins.changes(a, b, "k", "d")) == [(1, "removed"), (2, "modified"), (3, "added")]


def test_packs_with_lines(spark, tmp_path):
    (tmp_path / "pack.json").write_text('{"version": "1", "rules": [{"id": "a", "file_globs": ["**/*.java"], "pattern": "x\\\\s+y"}, {"id": "b", "file_globs": ["*.yml"], "pattern": "z"}]}')
    pack = rules.load_pack(spark, str(tmp_path / "pack.json"), "id:string,file_globs:array<string>,pattern:string")
    files = make(spark, "repo string, path string, text string", ("r", "src/A.java", "q\nx\n y\nx y"), ("r", "B.java", "x y"), ("r", "c.yml", "zz\nz"), ("r", "c.txt", "x y z"))
    assert rows(rules.file_matches(files, pack), "path", "id", "line") == [("B.java", "a", 1), ("c.yml", "b", 1), ("c.yml", "b", 1), ("c.yml", "b", 2), ("src/A.java", "a", 2), ("src/A.java", "a", 4)]
    for bad in ('{"version": "1", "rules": [{"id": "a"}, {"id": "a"}]}', "no json", '{"version": "1"}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError, match="rule"):
            rules.load_pack(spark, str(tmp_path / "bad.json"), "id:string")


def test_compound_rules(spark):
    files = make(
        spark, "repo string, path string, text string", ("open", "S.java", 'requestMatchers("/graphql").permitAll()'), ("open", "s.graphql", "type A { b: B }\ntype B { a: [A!] }"), ("held", "S.java", "uses /graphql"), ("held", "s.graphql", "type A { n: Int }"), ("none", "x.py", "def loginUser(): pass"),
        ("seed", "db/seed.sql", "-- the password is x\nINSERT INTO users VALUES (1)"),
    )
    leg = lambda kind, **p: {"kind": kind, "params": p}
    depth = {"id": "depth", "legs": [leg("endpoint-unauthenticated", route_contains="/graphql"), leg("graphql-schema-cycle"), leg("config-absent", file_globs=["**/*.java", "*.java"], patterns=["maxDepth"])]}
    got = {(r["repo"]): (r["confidence"], r["legs"]) for r in rules.evaluate_compound(files, [depth]).collect()}
    assert got["open"] == (0.75, "config-absent=absent-proven,endpoint-unauthenticated=evidenced,graphql-schema-cycle=evidenced") and "held" not in got and got["none"][0] == 0.5
    seeded = {"id": "seed", "legs": [leg("seeded-credential-pattern"), leg("public-auth-entrypoint", route_contains="login")]}
    states = {r["repo"]: r["legs"] for r in rules.evaluate_compound(files, [seeded]).collect()}
    assert states["none"] == "public-auth-entrypoint=evidenced,seeded-credential-pattern=absent-proven" and states["seed"].endswith("=evidenced")
    with pytest.raises(ValueError, match="unknown leg"):
        rules.evaluate_compound(files, [{"id": "x", "legs": [leg("no-such")]}])
    assert "config-absent" in rules.leg_kinds()


def test_supply_chain_agents_and_identities(spark):
    deps = make(spark, "repo string, path string, ecosystem string, name string, spec string, line int", ("r", "package.json", "npm", "left", "^1.0.0", 3), ("r", "package.json", "npm", "pin", "1.0.0", 4), ("l", "package.json", "npm", "left", "^1.0.0", 3), ("r", "requirements.txt", "pypi", "internal-x", "==1", 1), ("l", "package.json", "npm", "@corp/x", "1.0.0", 9), ("r", "package.json", "npm", "EvilPkg", "1.0.0", 2))
    pack = make(spark, "id string, kind string, ecosystems array<string>, pattern string, names map<string,array<string>>", ("mut", "mutable-reference", ["npm", "pypi"], None, None), ("int", "internal-namespace-unprotected", ["pypi", "npm"], "(?:internal-|@corp/)", None), ("sus", "suspicious-package", ["npm"], None, {"npm": ["evilpkg"]}))
    got = rules.supply_chain(deps, pack, make(spark, "repo string, ecosystem string", ("l", "npm")), make(spark, "repo string, scope string", ("l", "@corp")))
    assert rows(got, "repo", "name", "rule") == [("r", "EvilPkg", "sus"), ("r", "internal-x", "int"), ("r", "left", "mut")]
    configs = make(spark, "repo string, path string, text string", ("r", ".mcp.json", '{"mcpServers": {"a": {"command": "/bin/bash", "args": ["-c", "x"]}, "b": {"command": "bash", "args": ["-c"], "approval": "ask"}, "c": {"command": "node", "alwaysAllow": ["*"]}}}'), ("r", "bad.json", "no"))
    assert rows(rules.agent_grants(configs), "server", "grant") == [("a", "shell-exec"), ("c", "tool-auto-approve")]
    body = "const u = req.headers['x-user-email']; db.get(u)"
    functions = make(spark, "repo string, path string, symbol string, line_start int, body string", ("r", "a.js", "f", 1, body), ("r", "a.js", "g", 9, body + "; jwt.verify(t)"), ("r", "__tests__/a.js", "h", 1, body))
    archetype = make(spark, "id string, file_globs array<string>, identity_read string, dispatch string, requires_absent array<string>", ("hdr", ["**/*.js"], r"req\.(?:headers|cookies)[\[.][\w'\".-]*", r"db\.", [r"jwt\.verify"]))
    assert rows(rules.identity_archetypes(functions, archetype), "symbol", "rule", "channel") == [("f", "hdr", "x-user-email")]
    marks = make(spark, "id string, packages array<string>, imports array<string>", ("a", ["csrf"], []), ("b", [], ["from x"]), ("c", [], []))
    manifests, sources = make(spark, "repo string, text string", ("r", '"csrf": "1"')), make(spark, "repo string, text string", ("r", "import y"))
    assert rows(rules.integration_evidence(marks, manifests, sources)) == [("r", "a", "found"), ("r", "b", "no-integration-found"), ("r", "c", "undetermined")]
