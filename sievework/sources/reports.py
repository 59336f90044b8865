"""Reports of other tools as findings: one reader per format over a table of report texts, in a registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import safe_cwe, tool_severity

# Lockfiles of ecosystems; words of a tool and what they stand for.
MANIFEST_OF = {"npm": "package-lock.json", "pypi": "requirements.txt", "maven": "pom.xml", "go": "go.mod"}
IMAGE_TYPES = {"npm": "npm", "pip": "pypi", "poetry": "pypi", "jar": "maven", "pom": "maven", "gomod": "go"}
IMAGE_SEVERITY = {"critical": "critical", "high": "high", "medium": "moderate", "low": "low"}
LINT_SEVERITY = {"error": "high", "warning": "moderate", "info": "low"}
DEPENDENCY_CONFIDENCE, CODE_CONFIDENCE = 0.95, 0.8
FINDING = ("member", "tool", "cwe", "severity", "confidence", "file", "line_start", "line_end", "package", "ecosystem", "range", "fixed", "advisory_ids", "rule", "message")

Reader = Callable[[DataFrame], DataFrame]
_READERS: dict[str, Reader] = {}


def reader(tool: str) -> Callable[[Reader], Reader]:
    """Registers a reader: a function of reports (member, text) that gives FINDING without `tool`."""

    def add(f: Reader) -> Reader:
        _READERS[tool] = f
        return f

    return add


def tools() -> tuple[str, ...]:
    return tuple(sorted(_READERS))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _checked(reports: DataFrame, doc: Column, ok: Column, what: str) -> DataFrame:
    """reports with the parsed `d`; a whole report of another shape is an error, not a row less."""
    rows = reports.withColumn("d", doc)
    return rows.where(F.coalesce(ok, F.lit(False)) | F.raise_error(F.lit(f"{what}: the report has another shape")).cast("boolean"))


def _dependency(df: DataFrame, package: Column, ecosystem: Column, range_: Column, fixed: Column, ids: Column, severity: Column, message: Column, file: Column, cwe: Column | None = None) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit(""))
    return df.select(
        "member", (F.lit(None).cast("string") if cwe is None else cwe).alias("__cwe"), tool_severity(severity).alias("severity"), F.lit(DEPENDENCY_CONFIDENCE).alias("confidence"), file.alias("file"),
        F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), package.alias("package"), ecosystem.alias("ecosystem"), text(range_).alias("range"), text(fixed).alias("fixed"),
        F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != "")))).alias("advisory_ids"), F.lit(None).cast("string").alias("rule"), text(message).alias("message"),
    )


def _code(df: DataFrame, file: Column, line: Column, line_end: Column, severity: Column, message: Column, rule: Column, cwe: Column) -> DataFrame:
    start = F.coalesce(F.when(line > 0, line), F.lit(1)).cast("int")
    none = lambda t: F.lit(None).cast(t)
    return df.select(
        "member", cwe.alias("__cwe"), tool_severity(severity).alias("severity"), F.lit(CODE_CONFIDENCE).alias("confidence"), F.coalesce(file, F.lit("")).alias("file"), start.alias("line_start"),
        F.coalesce(F.when(line_end > 0, line_end), start).cast("int").alias("line_end"), none("string").alias("package"), none("string").alias("ecosystem"), F.lit("").alias("range"), F.lit("").alias("fixed"),
        F.array().cast("array<string>").alias("advisory_ids"), F.coalesce(rule, F.lit("")).alias("rule"), F.coalesce(message, F.lit("")).alias("message"),
    )


def read(reports: DataFrame, tool: str, known_cwe: DataFrame | None = None) -> DataFrame:
    """FINDING rows of reports (member, text) of one tool. A weakness that is not well formed, or not among known_cwe (cwe),
    becomes the class of vulnerable components."""
    if tool not in _READERS:
        raise ValueError(f"no reader for {tool}")
    rows = _READERS[tool](reports).withColumn("tool", F.lit(tool))
    if known_cwe is not None:
        known = known_cwe.select(F.col("cwe").alias("__known")).distinct()
        rows = rows.join(known, safe_cwe(F.col("__cwe")) == F.col("__known"), "left").withColumn("cwe", safe_cwe(F.col("__cwe"), F.col("__known").isNotNull()))
    else:
        rows = rows.withColumn("cwe", safe_cwe(F.coalesce("__cwe", F.lit(""))))
    return rows.select(*FINDING)


def _last_event(vulnerability: Column, key: str) -> Column:
    events = F.flatten(F.transform(F.flatten(F.transform(F.filter(vulnerability["affected"], lambda a: a["ranges"].isNotNull()), lambda a: a["ranges"])), lambda r: F.coalesce(r["events"], F.array().cast("array<struct<introduced:string,fixed:string>>"))))
    named = F.filter(F.transform(events, lambda e: e[key]), lambda x: x.isNotNull())
    return F.when(F.size(named) > 0, F.element_at(named, -1))


@reader("osv-scanner")
def osv(reports: DataFrame) -> DataFrame:
    event = "struct<introduced:string,fixed:string>"
    vulnerability = f"struct<id:string,summary:string,affected:array<struct<ranges:array<struct<events:array<{event}>>>>>,severity:array<struct<type:string,score:string>>>"
    doc = F.from_json("text", f"results array<struct<packages:array<struct<package:struct<name:string,ecosystem:string,version:string>,vulnerabilities:array<{vulnerability}>>>>>")
    rows = _checked(reports, doc, F.col("d.results").isNotNull(), "osv-scanner").select("member", F.explode("d.results").alias("r")).select("member", F.explode("r.packages").alias("p")).select("member", "p.package", F.explode("p.vulnerabilities").alias("v"))
    eco = F.lower("package.ecosystem")
    rows = rows.where(eco.isin(*MANIFEST_OF) & (F.coalesce("package.name", F.lit("")) != "") & (F.coalesce("v.id", F.lit("")) != ""))
    rows = rows.withColumns({"fixed": _last_event(F.col("v"), "fixed"), "introduced": _last_event(F.col("v"), "introduced")})
    range_ = F.when(F.col("fixed").isNotNull(), F.concat(F.lit("<"), "fixed")).when(F.col("introduced").isNotNull(), F.concat(F.lit(">="), "introduced"))
    severity = F.when(F.size("v.severity") > 0, "high").otherwise("unknown")
    return _dependency(rows, F.col("package.name"), eco, range_, F.col("fixed"), F.array("v.id"), severity, F.col("v.summary"), _map(MANIFEST_OF)[eco])


@reader("trivy")
def trivy(reports: DataFrame) -> DataFrame:
    vulnerability = "struct<VulnerabilityID:string,PkgName:string,FixedVersion:string,Severity:string,Title:string,Description:string>"
    misconfiguration = "struct<ID:string,Filename:string,Severity:string,Title:string,Message:string>"
    doc = F.from_json("text", f"SchemaVersion int, Results array<struct<Target:string,Type:string,Vulnerabilities:array<{vulnerability}>,Misconfigurations:array<{misconfiguration}>>>")
    rows = _checked(reports, doc, F.col("d.SchemaVersion") == 2, "trivy").select("member", F.explode("d.Results").alias("r"))
    word = lambda c: F.coalesce(_map(IMAGE_SEVERITY)[F.lower(c)], F.lit("unknown"))
    eco = _map(IMAGE_TYPES)[F.lower("r.Type")]
    found = rows.select("member", "r.Target", eco.alias("eco"), F.explode("r.Vulnerabilities").alias("v")).where("eco is not null and coalesce(v.PkgName, '') <> '' and coalesce(v.VulnerabilityID, '') <> ''")
    file = F.coalesce(F.nullif("Target", F.lit("")), F.lit("package-lock.json"))
    packages = _dependency(found, F.col("v.PkgName"), F.col("eco"), F.lit(""), F.col("v.FixedVersion"), F.array("v.VulnerabilityID"), word("v.Severity"), F.coalesce(F.nullif("v.Title", F.lit("")), "v.Description"), file)
    wrong = rows.select("member", "r.Target", F.explode("r.Misconfigurations").alias("m")).where("coalesce(m.ID, '') <> ''")
    place = F.coalesce(F.nullif("m.Filename", F.lit("")), F.nullif("Target", F.lit("")), F.lit("."))
    return packages.unionByName(_code(wrong, place, F.lit(1), F.lit(0), word("m.Severity"), F.coalesce(F.nullif("m.Title", F.lit("")), "m.Message"), F.col("m.ID"), F.lit(None).cast("string")))


@reader("npm-audit")
def npm_audit(reports: DataFrame) -> DataFrame:
    """`via` holds names and advisories side by side: the first advisory speaks."""
    doc = F.from_json("text", "auditReportVersion int, vulnerabilities map<string,struct<severity:string,range:string,via:array<string>,fixAvailable:string>>")
    rows = _checked(reports, doc, (F.col("d.auditReportVersion") == 2) & F.col("d.vulnerabilities").isNotNull(), "npm-audit").select("member", F.explode("d.vulnerabilities").alias("package", "v"))
    first = F.get(F.filter("v.via", lambda x: F.startswith(F.trim(x), F.lit("{"))), F.lit(0))
    rows = rows.withColumn("a", F.from_json(first, "url string, source string, range string, title string, cwe array<string>"))
    url = F.coalesce("a.url", F.lit(""))
    ids = F.when(F.contains(url, F.lit("/")), F.array(F.element_at(F.split(url, "/"), -1))).otherwise(F.array("a.source"))
    fixed = F.get_json_object("v.fixAvailable", "$.version")
    range_ = F.coalesce(F.nullif("a.range", F.lit("")), "v.range")
    return _dependency(rows, F.col("package"), F.lit("npm"), range_, fixed, ids, F.col("v.severity"), F.col("a.title"), F.lit(MANIFEST_OF["npm"]), F.get("a.cwe", F.lit(0)))


@reader("gitleaks")
def gitleaks(reports: DataFrame) -> DataFrame:
    """Credentials; the value is never read."""
    doc = F.from_json("text", "array<struct<File:string,StartLine:int,EndLine:int,RuleID:string>>")
    rows = _checked(reports, doc, F.col("d").isNotNull() & F.startswith(F.trim("text"), F.lit("[")), "gitleaks").select("member", F.explode("d").alias("r"))
    rule = F.coalesce("r.RuleID", F.lit("unknown"))
    message = F.concat(F.lit("Hard-coded secret matched by rule '"), rule, F.lit("' (value redacted)"))
    return _code(rows, F.col("r.File"), F.col("r.StartLine"), F.col("r.EndLine"), F.lit("high"), message, rule, F.lit("CWE-798"))


@reader("semgrep")
def semgrep(reports: DataFrame) -> DataFrame:
    doc = F.from_json("text", "results array<struct<path:string,check_id:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string,metadata:struct<cwe:array<string>>>>>")
    rows = _checked(reports, doc, F.col("d.results").isNotNull(), "semgrep").select("member", F.explode("d.results").alias("r"))
    severity = F.coalesce(_map(LINT_SEVERITY)[F.lower("r.extra.severity")], F.lit("unknown"))
    return _code(rows, F.col("r.path"), F.col("r.start.line"), F.col("r.end.line"), severity, F.col("r.extra.message"), F.col("r.check_id"), F.get("r.extra.metadata.cwe", F.lit(0)))


def _first_line(text: Column) -> Column:
    return F.substring(F.split(F.coalesce(text, F.lit("")), "\r?\n")[0], 1, 200)


@reader("pip-audit")
def pip_audit(reports: DataFrame) -> DataFrame:
    doc = F.from_json("text", "dependencies array<struct<name:string,version:string,vulns:array<struct<id:string,description:string,affected_range:string,fix_versions:array<string>>>>>")
    rows = _checked(reports, doc, F.col("d.dependencies").isNotNull(), "pip-audit").select("member", F.explode("d.dependencies").alias("p")).select("member", "p.name", F.explode("p.vulns").alias("v"))
    return _dependency(rows, F.col("name"), F.lit("pypi"), F.col("v.affected_range"), F.get("v.fix_versions", F.lit(0)), F.array("v.id"), F.lit("unknown"), _first_line(F.col("v.description")), F.lit(MANIFEST_OF["pypi"]))


@reader("govulncheck")
def govulncheck(reports: DataFrame) -> DataFrame:
    """A stream of messages, one a line: advisories name packages, findings name advisories; both come from one pass."""
    message = "osv struct<id:string,affected:array<struct<package:struct<name:string>>>>, finding struct<osv:string>, _corrupt string"
    lines = reports.select("member", F.explode(F.split("text", "\r?\n")).alias("line")).where("trim(line) <> ''")
    rows = lines.withColumn("m", F.from_json("line", message, {"columnNameOfCorruptRecord": "_corrupt"}))
    rows = rows.where(F.col("m._corrupt").isNull() | F.raise_error(F.lit("govulncheck: a message is no JSON")).cast("boolean"))
    named = F.get("m.osv.affected", F.lit(0))["package"]["name"]
    both = rows.select("member", F.coalesce("m.finding.osv", "m.osv.id").alias("osv"), F.when(F.col("m.osv.id").isNotNull(), named).alias("package"), F.col("m.finding.osv").isNotNull().alias("found")).where("osv is not null")
    by = both.groupBy("member", "osv").agg(F.max("package").alias("package"), F.bool_or("found").alias("found")).where("found")
    return _dependency(by, F.coalesce(F.nullif("package", F.lit("")), "osv"), F.lit("go"), F.lit(""), F.lit(""), F.array("osv"), F.lit("unknown"), F.concat(F.lit("govulncheck advisory "), "osv"), F.lit(MANIFEST_OF["go"]))


@reader("owasp-dependency-check")
def dependency_check(reports: DataFrame) -> DataFrame:
    """Maven coordinates alone; a score of 7 stands in for a missing severity."""
    doc = F.from_json("text", "reportSchema string, dependencies array<struct<packages:array<struct<id:string>>,vulnerabilities:array<struct<name:string,severity:string,description:string,cvssv3:struct<baseScore:double>>>>>")
    rows = _checked(reports, doc, F.startswith("d.reportSchema", F.lit("1.")), "owasp-dependency-check").select("member", F.explode("d.dependencies").alias("p"))
    purl = F.get(F.filter(F.transform("p.packages", lambda x: x["id"]), lambda x: F.startswith(x, F.lit("pkg:maven/")) & F.contains(x, F.lit("@"))), F.lit(0))
    package = F.replace(F.split(F.regexp_replace(purl, "^pkg:maven/", ""), "@")[0], F.lit("/"), F.lit(":"))
    found = rows.withColumn("package", package).where("package is not null").select("member", "package", F.explode("p.vulnerabilities").alias("v"))
    severity = F.coalesce(F.nullif("v.severity", F.lit("")), F.when(F.col("v.cvssv3.baseScore") >= 7, "high"), F.lit("unknown"))
    return _dependency(found, F.col("package"), F.lit("maven"), F.lit(""), F.lit(""), F.array("v.name"), severity, _first_line(F.col("v.description")), F.lit(MANIFEST_OF["maven"]))
