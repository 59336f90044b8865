"""Sources on tiny trees: files, manifests, reports, artifacts, options."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import extract
from sievework.sources import artifacts, manifests, reports, trees

FILES = "repo string, path string, text string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, data in {
        "src/a.py": b"import os\n", "src/b.py": b"x = '\xff\xfe'\n", "node_modules/x.js": b"1", ".venv/y.py": b"1", ".cursorrules": b"be careful", "docs/.mcp.json": b"{}",
        "package.json": b"{}", "notes.txt": b"no", "web/v.html": b"<p>", "Dockerfile": b"FROM x",
    }.items():
        where = root / path
        where.parent.mkdir(parents=True, exist_ok=True)
        where.write_bytes(data)
    return root


def test_source_tree(spark, tree):
    got = {r["path"]: r for r in trees.source_files(spark, {"r": str(tree)}).collect()}
    assert sorted(got) == [".cursorrules", "Dockerfile", "docs/.mcp.json", "package.json", "src/a.py", "src/b.py", "web/v.html"]
    assert got["src/b.py"]["text"] == "x = '��'\n" and got["src/a.py"]["language"] == "python" and got["Dockerfile"]["file_class"] == "deploy-config" and not got["Dockerfile"]["parsed"]
    with pytest.raises(ValueError, match="no trees"):
        trees.source_files(spark, {})


def test_members_snapshot_and_manifest(spark):
    files = spark.createDataFrame([("r", "src/orders/a.py", "python", "source", True, "import flask\nx"), ("r", "b.rb", "ruby", "source", False, "y"), ("s", "package.json", None, "dependency-manifest", False, '{"express": 1}')], "repo string, path string, language string, file_class string, parsed boolean, text string")
    declared = spark.createDataFrame([("r",), ("gone",)], "repo string")
    here, missing = trees.members(declared, files)
    assert rows(here) == [("r",)] and rows(missing) == [("gone",)] and rows(trees.members(declared.limit(0), files)[0]) == [("r",), ("s",)]
    got = {r["repo"]: r for r in trees.manifest(files).collect()}
    assert (got["r"]["languages"], got["r"]["frameworks"], got["r"]["files"], got["r"]["loc"], got["r"]["modules"], got["r"]["unparsed"]) == (["python", "ruby"], ["flask"], 2, 3, {"orders": 1, ".": 1}, ["b.rb"])
    assert got["s"]["frameworks"] == ["express", "node"]
    assert all(len(r["digest"]) == 16 for r in trees.snapshot(files).collect())


def test_components(spark):
    pom = "<project><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1.2</version></dependency><dependency><groupId>g</groupId><artifactId>b</artifactId><version>${v}</version></dependency></project>"
    files = spark.createDataFrame([
        ("r", "package.json", json.dumps({"dependencies": {"minimist": "^1.2.0", "ranged": "~2.0.0"}, "devDependencies": {"mocha": "9.0.0"}})), ("r", "package-lock.json", json.dumps({"packages": {"": {}, "node_modules/minimist": {"version": "1.2.5"}}})),
        ("r", "web/package.json", '{"dependencies": {"minimist": "^1.0.0"}}'), ("r", "bad/package.json", "no json"), ("r", "pom.xml", pom), ("r", "requirements.txt", "flask==2.0.1 # web\n-r x\nlow>=1\n git+https://x"), ("r", "go.mod", "module x\ngo 1.20\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"), ("r", ".npmrc", "@corp:registry=https://x\n"),
    ], FILES)
    assert rows(manifests.components(files), "manifest", "package", "version", "exposure") == [
        ("go.mod", "github.com/a/b", "1.2.3", "runtime"), ("package.json", "minimist", "1.2.5", "runtime"), ("package.json", "mocha", "9.0.0", "development"), ("package.json", "ranged", "2.0.0", "runtime"), ("pom.xml", "g:a", "1.2", "runtime"), ("requirements.txt", "flask", "2.0.1", "runtime"), ("web/package.json", "minimist", "1.0.0", "runtime"),
    ]
    assert rows(manifests.dependencies(files).where("ecosystem = 'pypi'"), "name", "spec", "line") == [("flask", "==2.0.1", 1), ("low", ">=1", 3)]
    assert ("minimist", "^1.2.0", 1) in rows(manifests.dependencies(files), "name", "spec", "line")
    assert {"flask", "low", "minimist", "github.com/a/b"} <= {r["package"] for r in manifests.declared_packages(files).collect()}
    assert rows(manifests.locked(files)) == [("r", "npm")] and rows(manifests.mapped_scopes(files)) == [("r", "@corp")] and len(rows(manifests.ecosystems(files))) == 4


def read(spark, tool, document):
    text = document if isinstance(document, str) else json.dumps(document)
    return [r.asDict() for r in reports.read(spark.createDataFrame([("m", text)], "member string, text string"), tool).collect()]


def test_reports(spark):
    (got,) = read(spark, "osv-scanner", {"results": [{"packages": [{"package": {"name": "left-pad", "ecosystem": "npm", "version": "1"}, "vulnerabilities": [{"id": "G1", "summary": "s", "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.2.4"}]}]}], "severity": [{"type": "CVSS", "score": "9"}]}]}, {"package": {"name": "x", "ecosystem": "cargo"}, "vulnerabilities": [{"id": "G2"}]}]}]})
    assert (got["package"], got["range"], got["fixed"], got["advisory_ids"], got["severity"], got["file"], got["cwe"]) == ("left-pad", "<1.2.4", "1.2.4", ["G1"], 7.5, "package-lock.json", "CWE-1035")
    image = read(spark, "trivy", {"SchemaVersion": 2, "Results": [{"Target": "pom.xml", "Type": "pom", "Vulnerabilities": [{"VulnerabilityID": "C1", "PkgName": "a:b", "FixedVersion": "2", "Severity": "MEDIUM", "Title": "t"}], "Misconfigurations": [{"ID": "D1", "Severity": "LOW", "Message": "m"}]}]})
    assert sorted((x["ecosystem"] or "", x["file"], x["severity"], x["rule"] or "") for x in image) == [("", "pom.xml", 3.1, "D1"), ("maven", "pom.xml", 5.3, "")]
    (got,) = read(spark, "npm-audit", {"auditReportVersion": 2, "vulnerabilities": {"p": {"severity": "high", "range": "<9", "via": ["q", {"url": "https://x/GHSA-1", "title": "t", "range": "<2", "cwe": ["CWE-400"]}], "fixAvailable": {"version": "3.0.0"}}}})
    assert (got["advisory_ids"], got["range"], got["fixed"], got["cwe"], got["message"]) == (["GHSA-1"], "<2", "3.0.0", "CWE-400", "t")
    (got,) = read(spark, "gitleaks", [{"File": "a.py", "StartLine": 3, "EndLine": 0, "RuleID": "aws", "Secret": "s3cr3t"}])
    assert (got["file"], got["line_start"], got["line_end"], got["cwe"]) == ("a.py", 3, 3, "CWE-798") and "s3cr3t" not in str(got)
    (got,) = read(spark, "semgrep", {"results": [{"path": "a.py", "check_id": "r", "start": {"line": 2}, "end": {"line": 4}, "extra": {"message": "m", "severity": "WARNING", "metadata": {"cwe": ["CWE-79: XSS"]}}}]})
    assert (got["line_start"], got["line_end"], got["severity"], got["cwe"]) == (2, 4, 5.3, "CWE-79")
    (got,) = read(spark, "pip-audit", {"dependencies": [{"name": "flask", "vulns": [{"id": "P1", "description": "one\ntwo", "fix_versions": ["2.1"]}]}, {"name": "clean", "vulns": []}]})
    assert (got["package"], got["fixed"], got["message"]) == ("flask", "2.1", "one")
    lines = [{"osv": {"id": "GO-1", "affected": [{"package": {"name": "github.com/a/b"}}]}}, {"finding": {"osv": "GO-1"}}, {"finding": {"osv": "GO-1"}}, {"osv": {"id": "GO-2", "affected": []}}, {"finding": {"osv": "GO-3"}}]
    assert sorted(x["package"] for x in read(spark, "govulncheck", "\n".join(map(json.dumps, lines)))) == ["GO-3", "github.com/a/b"]
    (got,) = read(spark, "owasp-dependency-check", {"reportSchema": "1.1", "dependencies": [{"packages": [{"id": "pkg:maven/g/a@1"}], "vulnerabilities": [{"name": "C", "cvssv3": {"baseScore": 8.1}, "description": "d"}]}, {"packages": [{"id": "pkg:npm/x@1"}], "vulnerabilities": [{"name": "D"}]}]})
    assert (got["package"], got["severity"], got["ecosystem"]) == ("g:a", 7.5, "maven")
    assert len(reports.tools()) == 8


@pytest.mark.parametrize(("tool", "text"), [("osv-scanner", "{}"), ("trivy", '{"SchemaVersion": 1}'), ("npm-audit", '{"auditReportVersion": 1}'), ("gitleaks", "{}"), ("semgrep", "no"), ("pip-audit", "{}"), ("govulncheck", "no json"), ("owasp-dependency-check", '{"reportSchema": "2"}')])
def test_reports_of_another_shape(spark, tool, text):
    with pytest.raises(Exception, match="shape|no JSON"):
        read(spark, tool, text)
    with pytest.raises(ValueError, match="no reader"):
        reports.read(None, "nothing")


def test_artifacts_and_stages(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    artifacts.write_artifact(df, str(tmp_path / "t"), "scan", "s1")
    assert rows(artifacts.read_artifact(spark, str(tmp_path / "t"))) == [(1, "a")]
    df.write.parquet(str(tmp_path / "bare"))
    assert rows(artifacts.read_artifact(spark, str(tmp_path / "bare"))) == [(1, "a")]
    df.withColumns({"_schema_version": F.lit("9"), "_stage": F.lit("x"), "_scan_id": F.lit("y")}).write.parquet(str(tmp_path / "other"))
    with pytest.raises(Exception, match="schema version 9"):
        artifacts.read_artifact(spark, str(tmp_path / "other")).collect()
    stages, made = artifacts.Stages(spark, str(tmp_path)), []

    def make():
        made.append(1)
        return df

    for key in ("k1", "k1", "k2"):
        assert rows(stages.run("graph", key, str(tmp_path), make)) == [(1, "a")]
    assert len(made) == 2 and rows(stages.status()) == [("graph", "k2", "done")]
    stages.invalidate("graph")
    assert not stages.should_skip("graph", "k2")
    for name in ("20240101.json", "20240301.json", "20240201.json", "z.txt"):
        artifacts.write_text(spark, str(tmp_path / "reports" / name), "{}")
    assert artifacts.latest_report(spark, str(tmp_path / "reports")).endswith("20240301.json")


def test_renderings(spark):
    found = spark.createDataFrame([("SEC-1", "CWE-79", "r", "a<b>.py", "High", 7.5, 0.9), ("SEC-2", "CWE-89", "r", "b.py", "Low", 2.0, 0.5)], "id string, cwe string, repo string, file string, band string, severity double, confidence double")
    got = artifacts.report_rows(found)
    assert json.loads(artifacts.render_json(got, "s"))["findings"][0]["id"] == "SEC-1"
    text = artifacts.render_markdown(got, "s")
    assert text.index("## High") < text.index("## Low") and "## Critical" not in text
    page = artifacts.render_html(got, "s")
    assert 'href="#SEC-1"' in page and 'id="SEC-1"' in page and "a&lt;b&gt;.py" in page
    with pytest.raises(ValueError, match="anchor"):
        artifacts.render_html([*got, {**got[0]}], "s")
    with pytest.raises(ValueError, match="more than 1"):
        artifacts.report_rows(found, 1)


def test_options_and_profiles():
    assert artifacts.options()["mode"] == "auto" and artifacts.options({"timeout_s": 5})["timeout_s"] == 5
    assert artifacts.options({}, {"SIEVEWORK_TIMEOUT_S": "7", "OTHER": "x"})["timeout_s"] == 7
    with pytest.raises(artifacts.OptionError, match="mode must be one of.*unknown option nope"):
        artifacts.options({"nope": 1, "mode": "fast"})
    assert artifacts.profile("quick").min_band == "High" and artifacts.profile().max_level == 3
    custom = {"mine": {"base": "audit", "min_confidence": 0.2}}
    assert (artifacts.profile("mine", custom).min_band, artifacts.profile("mine", custom, {"max_level": 2}).max_level) == ("None", 2)
    for bad in (("none", None, None), ("mine", {"mine": {"base": "x"}}, None), ("full", None, {"max_level": 9})):
        with pytest.raises(artifacts.OptionError):
            artifacts.profile(*bad)
    assert artifacts.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert artifacts.canonical_json({"b": 1, "a": 2}) == '{\n  "a": 2,\n  "b": 1\n}\n'


PY = '''import os
from flask import Flask
app = Flask(__name__)

@app.route("/orders", methods=["POST", "get"])
@login_required
def orders():
    db.execute("select " + request.args["q"])
    return helper()

class Helper:
    def run(self):
        return os.path.join("a", "b")
'''
JS = """import { x } from './y';
const auth = require('auth');
router.use(authenticateUser, (req, res) => {});
router.get('/items', guardItems, listItems);
function listItems(req, res) {
  // a { brace
  return Item.findAll();
}
class Item {
  static all() { return 1; }
}
"""


def test_extraction(spark):
    schema = "repo string, path string, language string, text string"
    files = spark.createDataFrame([("r", "a.py", "python", PY), ("r", "b.js", "javascript", JS), ("r", "bad.py", "python", "def ("), ("r", "x.rb", "ruby", "def y")], schema)
    parsed = extract.facts(files)
    assert rows(parsed, "path", "parsed") == [("a.py", True), ("b.js", True), ("bad.py", False), ("x.rb", False)]
    symbols = extract.symbols_of(parsed)
    assert rows(symbols.where("path = 'a.py'"), "name", "kind", "line_start", "line_end") == [("Helper", "class", 11, 13), ("orders", "function", 7, 9), ("run", "function", 12, 13)]
    assert [r["decorators"] for r in symbols.where("name = 'orders'").collect()] == ['@app.route("/orders", methods=["POST", "get"])\n@login_required']
    assert {("Item", "class", 9, 11), ("listItems", "function", 5, 8)} <= set(rows(symbols.where("path = 'b.js'"), "name", "kind", "line_start", "line_end"))
    assert {("orders", "helper"), ("run", "os.path.join")} <= {(r["caller"], r["callee"]) for r in extract.calls_of(parsed).collect()}
    assert ("listItems", "Item.findAll") in {(r["caller"], r["callee"]) for r in extract.calls_of(parsed).collect()}
    points = rows(extract.endpoints(files, symbols), "path", "route", "symbol", "line")
    assert ("a.py", "GET|POST /orders", "orders", 5) in points and ("b.js", "GET /items", "listItems", 4) in points
    assert rows(extract.access_facts(files), "path", "operation", "unsafe", "line") == [("a.py", "execute", True, 8), ("b.js", "read", False, 7)]
    assert rows(extract.wiring_facts(files), "route", "target", "line") == [("GET /items", "guardItems", 4), ("GET /items", "listItems", 4), (None, "authenticateUser", 3)]
    marks = {r["path"]: r["annotations"] for r in extract.file_annotations(files).collect()}
    assert marks["a.py"] == ["authentication_required", "security_sink", "trust_boundary", "user_controlled_input"] and marks["x.rb"] == []
    own = {r["name"]: r["annotations"] for r in extract.symbol_annotations(files, symbols).collect()}
    assert own["orders"] == ["authentication_required", "security_sink", "user_controlled_input"] and own["Helper"] == []
    nodes, edges, missing = extract.build_graph(files)
    found = {(r["src"], r["dst"], r["type"]) for r in edges.collect()}
    assert {("r:a.py#@GET|POST /orders", "r:a.py#orders", "handler"), ("r:a.py#orders", "r:<datastore>#execute", "writes"), ("r:b.js#listItems", "r:<datastore>#findAll", "reads"), ("r:a.py", "r:a.py#orders", "contains")} <= found
    assert {r["name"] for r in missing.collect()} == {"authenticateUser", "guardItems"}
    assert {r["type"] for r in nodes.collect()} == {"file", "function", "class", "endpoint", "datastore"}


def test_hosts_categories_and_templates(spark):
    files = spark.createDataFrame([("r", "a", "See https://API.x.org/1 and http://localhost:1, Email: a"), ("r", "b", "<p [innerHTML]='user.bio.text'>\n<p>")], FILES)
    assert [r[0] for r in files.select(extract.outbound_hosts(F.col("text"))).collect()] == [["api.x.org"], []]
    signals = spark.createDataFrame([("personal-data", "email"), ("financial-data", "iban")], "category string, signal string")
    assert rows(extract.data_categories(files, signals)) == [("r", "a", ["personal-data"]), ("r", "b", [])]
    assert rows(extract.template_sinks(files, spark.createDataFrame([("[innerHTML]",)], "marker string"))) == [("r", "b", 1, "[innerHTML]")]
    assert spark.range(1).select(extract.bound_identifiers(F.lit("user.bio.text | item.id + null"))).first()[0] == ["text", "user"]
