"""Golden cases: business flows, architecture, model answers."""

import json

from pyspark.sql import functions as F

from sievework.operators import architecture as ar
from sievework.operators import business, model_output


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def make(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


NODES = "id string, repo string, path string, type string, route string, annotations array<string>, outbound_hosts array<string>, symbol string"


def journeys(spark, nodes, edges, members=("web", "api"), integrations=()):
    df = make(spark, NODES, *[(*n, None) for n in nodes])
    links = make(spark, "from_repo string, to_repo string, type string, endpoints array<string>", *integrations)
    got = business.business_flows(df, make(spark, "src string, dst string, type string", *edges), make(spark, "repo string", *[(m,) for m in members]), links)
    return {r["root"]: r for r in got.collect()}


POINT = ("web:a.py#@GET /x", "web", "a.py", "endpoint", "GET /x", ["trust_boundary", "user_controlled_input"], None)
FILE = ("web:a.py", "web", "a.py", "file", None, [], ["api.internal", "other.example"])
FUNCTION = ("web:a.py#f", "web", "a.py", "function", None, ["authentication_required"], None)
STORE = ("web:<datastore>#t", "web", "<datastore>", "datastore", None, ["security_sink"], None)
REMOTE = ("api:b.py#@GET /orders", "api", "b.py", "endpoint", "GET /orders", ["trust_boundary"], None)
OTHER = ("api:b.py#@GET /users", "api", "b.py", "endpoint", "GET /users", [], None)
EDGES = [(POINT[0], FUNCTION[0], "handler"), (FUNCTION[0], STORE[0], "reads"), (FUNCTION[0], REMOTE[0], "calls")]


def test_business_flow_steps(spark):
    got = journeys(spark, [POINT, FILE, FUNCTION, STORE, REMOTE, OTHER], EDGES, integrations=[("web", "api", "http", ["GET /orders"])])
    flow = got[POINT[0]]
    steps = [(s["node"], s["operation"], s["leg"], s["target_repo"]) for s in flow["steps"]]
    assert steps == [(POINT[0], "entry", None, None), (REMOTE[0], "entry", "http", "api"), (FUNCTION[0], "mutation", None, None), (STORE[0], "mutation", None, None)]
    assert (flow["actor"], flow["determination"], flow["partial"], flow["name"]) == ("anonymous", "inferred", False, "GET /x")
    assert flow["steps"][0]["annotations"] == ["user_controlled_input"] and flow["flow_id"].startswith("flow:workspace:") and len(flow["flow_id"]) == 27
    assert [s["node"] for s in got[FILE[0]]["steps"]] == [FILE[0], REMOTE[0]] and got[FILE[0]]["steps"][0]["operation"] == "external-call"
    every = journeys(spark, [POINT, FILE, REMOTE, OTHER], [], integrations=[("web", "api", "http", [])])
    assert [s["node"] for s in every[POINT[0]]["steps"]] == [POINT[0], REMOTE[0], OTHER[0]]


def test_business_flow_gaps(spark):
    undeclared = journeys(spark, [POINT, FILE, FUNCTION, REMOTE], EDGES[:1])
    assert undeclared[POINT[0]]["gap_reasons"] == ["integration-undeclared"] and undeclared[POINT[0]]["partial"]
    assert (undeclared[POINT[0]]["actor"], undeclared[POINT[0]]["determination"]) == ("authenticated", "declared")
    role = (POINT[0], "web", "q.py", "endpoint", "GET /x", ["authorization_required"], None)
    got = journeys(spark, [role], [])
    assert (got[POINT[0]]["actor"], got[POINT[0]]["gap_reasons"]) == ("role", ["actor-undetermined"])
    many = [(f"web:q.py#f{i:02}", "web", "q.py", "function", None, [], None) for i in range(30)]
    wide = journeys(spark, [POINT, *many], [(POINT[0], m[0], "calls") for m in many])
    assert len(wide[POINT[0]]["steps"]) == 12 and wide[POINT[0]]["gap_reasons"] == ["budget-unreconstructable"]
    assert [s["node"] for s in wide[POINT[0]]["steps"]][1:] == [m[0] for m in many[:11]]
    assert journeys(spark, [STORE], []) == {}


def test_related_and_exposures(spark):
    journey = make(spark, "flow_id string, steps array<struct<node:string>>", ("F", [("a",), ("b",)]))
    traced = make(spark, "source string, sink string, path array<string>", ("s", "t", ["b", "c"]), ("u", "v", ["x", "y"]), ("e", "m", ["ext", "inv"]))
    assert rows(business.related_flows(journey, traced)) == [("F", ["s->t"])]
    nodes = make(spark, "id string, type string, annotations array<string>, symbol string, path string", ("ext", "function", ["external_content_source"], None, "p"), ("inv", "function", ["llm_invocation"], None, "p"), ("both", "function", ["user_controlled_input", "llm_prompt_sink"], None, "p"), ("file", "file", ["user_controlled_input", "llm_prompt_sink"], None, "p"), ("safe", "function", ["external_content_source", "llm_invocation", "boundary_labeled"], None, "p"), ("tool", "function", ["tool_declaration"], "pay", "p"))
    assert rows(business.model_exposures(nodes, traced)) == [("both", "direct", "both"), ("inv", "indirect", "ext")]
    assert rows(business.capabilities(nodes, make(spark, "src string, dst string", ("inv", "tool"), ("inv", "ext")))) == [("inv", ["pay"])]


def test_hosts(spark):
    hosts = make(spark, "id string, repo string, host string", ("f", "web", "API.internal"), ("f", "web", "api"), ("f", "web", "apis.x"), ("f", "api", "api.internal"))
    assert rows(business.host_members(hosts, make(spark, "repo string", ("web",), ("api",))), "host", "member") == [("API.internal", "api"), ("api", "api")]
    verdicts = ar.host_verdicts(make(spark, "host string", ("localhost",), ("api.x.y",), ("API",), ("evil.com",)), make(spark, "name string", ("api",)))
    assert rows(verdicts) == [("API", "internal"), ("api.x.y", "internal"), ("evil.com", "external"), ("localhost", "internal")]


def test_shapes(spark):
    members = make(spark, "member string", *[(m,) for m in ("spa", "server", "tool", "lib", "nothing", "hybrid", "static")])
    dependencies = make(spark, "member string, package string", ("spa", "@angular/core"), ("spa", "axios"), ("server", "Flask"), ("tool", "x"), ("lib", "y"), ("hybrid", "react-dom"))
    files = make(spark, "member string, path string, text string", ("tool", "setup.py", "console_scripts"), ("static", "firebase.json", "{}"))
    points = make(spark, "member string, kind string", ("hybrid", "http"))
    shapes = ar.member_shapes(members, dependencies, files, points)
    assert dict(rows(shapes)) == {"spa": ar.BROWSER, "server": ar.SERVER, "tool": ar.CLI, "lib": ar.LIBRARY, "nothing": ar.UNDETERMINED, "hybrid": ar.SERVER, "static": ar.BROWSER}
    reach = make(spark, "origin string, member string", ("a", "spa"), ("a", "server"), ("b", "unknown"))
    assert rows(ar.shapes_over(reach, shapes)) == [("a", [ar.BROWSER, ar.SERVER]), ("b", [ar.UNDETERMINED])]
    case = lambda shape, classes, marks, n: spark.range(1).select(ar.segment_shape(F.lit(shape), F.array(*map(F.lit, classes)), F.array(*map(F.lit, marks)), F.lit(n))).first()[0]
    assert case(ar.SERVER, ["template"], ["x"], 0) == ar.BROWSER and case(ar.SERVER, ["template"], ["trust_boundary"], 0) is None and case(ar.SERVER, ["source"], ["x"], 0) is None and case(ar.BROWSER, ["template"], ["x"], 0) is None and case(ar.SERVER, ["template"], ["x"], 2) is None
    files = make(spark, "repo string, path string, segment string", ("r", "t.html", "tpl"), ("r", "api.py", "api"), ("r", "u.html", "other"))
    segments = make(spark, "segment string, shape string", ("tpl", ar.BROWSER), ("api", None), ("other", ar.BROWSER))
    edges = make(spark, "repo string, path string, to_repo string, to_path string", ("r", "t.html", "r", "api.py"), ("r", "api.py", "r", "u.html"))
    found = make(spark, "id int, repo string, file string", (1, "r", "t.html"), (2, "r", "u.html"), (3, "r", "api.py"))
    assert rows(ar.origin_shapes(found, files, segments, edges, make(spark, "member string, shape string", ("r", ar.SERVER)))) == [(1, None), (2, ar.BROWSER), (3, None)]


def test_domains_tools_and_roots(spark):
    got = spark.range(1).select(ar.domains(F.lit("UserAuth"), F.array(F.lit("llm_invocation")), F.array(F.lit("template")))).first()[0]
    assert got == ["authentication", "authorization", "injection", "llm-security", "pii", "secrets", "session-management"]
    tools = make(spark, "tool string, applies_to array<string>", ("b", ["npm"]), ("a", ["any"]), ("c", ["go"]))
    assert [r["tool"] for r in ar.applicable_tools(tools, make(spark, "ecosystem string", ("npm",))).collect()] == ["a", "b"]
    found = make(spark, "tool string, member string, origin string", ("t", "b", "project"), ("t", "a", "system"), ("u", "a", "missing"), ("v", "b", "system"), ("v", "a", "system"))
    assert rows(ar.first_roots(found)) == [("t", "b", "project"), ("v", "a", "system")]
    texts = make(spark, "member string, text string", ("m", "import django"), ("m", "x"))
    assert rows(ar.frameworks_present(texts, make(spark, "framework string, marker string", ("django", "django"), ("spring", "spring")))) == [("m", "django")]
    segments = make(spark, "segment string, repo string", ("s1", "a"), ("s2", "b"), ("s3", "c"))
    assert rows(ar.segments_touching(segments, make(spark, "from_repo string, to_repo string", ("a", "b"), ("c", "c")), "a"), "segment") == [("s2",)]


def test_answers(spark):
    one = {"cwe": "79", "location": {"file": "a.py", "line_start": 5, "line_end": 2}, "evidence": [{"reason": " seen "}], "confidence": 3.0}
    answers = {"fence": "Here:\n```json\n" + json.dumps({"findings": [one]}) + "\n```", "list": json.dumps([one, one]), "single": json.dumps(one), "none": "", "prose": "nothing found", "clean": '{"findings": []}', "wrong": '{"findings": "x"}'}
    parsed = model_output.parse(make(spark, "key string, content string", *answers.items()))
    got = {r["key"]: (len(r["findings"]), r["malformed"]) for r in parsed.collect()}
    assert got == {"fence": (1, False), "list": (2, False), "single": (1, False), "none": (0, False), "prose": (0, True), "clean": (0, False), "wrong": (0, True)}
    cases = [one, {"cwe": "CWE-99999", "evidence": [{"file": "a", "reason": "r"}]}, {"cwe": "CWE-79"}, {"cwe": "CWE-79", "evidence": [{"file": "a", "reason": "r"}], "flow_ref": "f"}, {"cwe": "CWE-79", "evidence": [{"file": "a", "reason": "r"}], "flow_ref": "f", "flow_category": "regulatory-violation", "flow_narrative": "n"}, {"cwe": "CWE-79", "severity_score": 99.0, "location": {"repo": "q", "file": "b"}, "evidence": [{"file": "a", "reason": "r"}], "detection": "odd"}]
    raw = model_output.parse(make(spark, "key string, content string", *[(str(i), json.dumps([c])) for i, c in enumerate(cases)])).select("key", F.inline("findings"))
    known = make(spark, "cwe string, default_severity double, name string", ("CWE-79", 6.1, "Cross-site scripting"))
    good, bad = model_output.normalize(raw, known, F.lit("r"), F.lit("seg"))
    good = {r["key"]: r for r in good.collect()}
    assert (good["0"]["severity"], good["0"]["band"], good["0"]["confidence"], good["0"]["line_start"], good["0"]["line_end"], good["0"]["repo"], good["0"]["evidence"][0]["file"], good["0"]["description"]) == (6.1, "Medium", 1.0, 5, 5, "r", "a.py", "Cross-site scripting")
    assert (good["5"]["severity"], good["5"]["repo"], good["5"]["detection"], good["5"]["confidence"]) == (10.0, "q", None, 0.5)
    assert {r["key"] for r in bad.collect()} == {"1", "2", "3", "4"} and len({r["reason"] for r in bad.collect()}) == 4


def test_citations(spark):
    cited = make(spark, "id int, repo string, file string, line_start int, line_end int, pattern string, symbol string", (1, "r", "a", 2, 3, "two\nthree", None), (1, "r", "a", 1, 1, "one", "f"), (2, "r", "a", 2, 2, "three", None), (3, "q", "a", 1, 1, "", None), (4, "r", "b", 1, 1, "", None), (5, "r", "a", 9, 9, "", None), (6, "r", "a", 3, 2, "", None), (7, "r", "a", 1, 1, "one", "g"))
    files = make(spark, "repo string, path string, text string", ("r", "a", "one\ntwo\nthree"))
    got = {r["id"]: (r["holds"], r["failures"]) for r in model_output.verify_citations(cited, make(spark, "repo string", ("r",)), files, make(spark, "id string", ("r:a#f",))).collect()}
    assert got[1] == (True, []) and [got[i][0] for i in range(2, 8)] == [False] * 6 and len({tuple(got[i][1]) for i in range(2, 8)}) == 6


def test_controls_and_reproductions(spark):
    found = make(spark, "id int, repo string, file string, control string, control_state string", (1, "r", "f.py", "csrf", "unassessed"), (2, "r", "g.py", None, None))
    nodes = make(spark, "repo string, path string, type string, annotations array<string>", ("r", "auth.py", "file", ["authentication_required"]), ("r", "x.py", "file", ["other"]), ("r", "auth.py", "function", ["authentication_required"]))
    steps = make(spark, "id int, seq int, repo string, file string", (1, 0, "r", "auth.py"), (1, 1, "r", "step.py"))
    links = make(spark, "repo string, endpoint string", ("r", "GET /p"))
    got = model_output.candidate_controls(found, nodes, steps, links)
    assert [(r["rank"], r["file"]) for r in got.where("id = 1").orderBy("rank").collect()] == [(1, "auth.py"), (2, "step.py"), (3, "GET /p"), (4, "f.py")]
    assert [r["file"] for r in got.where("id = 2").orderBy("rank").collect()] == ["auth.py", "GET /p"]
    seen = make(spark, "id int, cwe string, status string, route string, fixed_prefix boolean, path array<string>", (1, "CWE-89", "verified", "GET|POST /o/{id}", False, ["a", "b"]), (2, "CWE-918", "plausible", None, True, []), (3, "CWE-862", None, "GET /o/<int:id>", None, None), (4, "CWE-798", None, None, None, None))
    out = {r["id"]: r for r in model_output.reproductions(seen).collect()}
    assert (out[1]["mode"], out[1]["trail"]) == ("observed", ["a", "b"]) and out[1]["trigger"].startswith("send: GET /o/%27%20OR%20%27SIEVEWORK")
    assert out[2]["trigger"] is None and "fixed prefix" in out[2]["trigger_reason"] and out[2]["trail"] is None and out[2]["mode"] == "hypothesis"
    assert out[3]["trigger"].endswith("GET /o/SIEVEWORK-CANARY-1") and "checkout" in out[4]["trigger"]
