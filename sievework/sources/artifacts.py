"""Artifacts with an envelope, stages that need not run again, reports, and the options of a session."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1"
# Profiles by name, and what each changes of the defaults; options that a session knows, with defaults.
PROFILES = {
    "quick": {"domains": ("authentication", "authorization", "injection", "secrets"), "max_level": 2, "system_review": False, "triage": False, "min_band": "High", "min_confidence": 0.0},
    "full": {"domains": "all", "max_level": 3, "system_review": True, "triage": True, "min_band": "Medium", "min_confidence": 0.5},
    "audit": {"domains": "all", "max_level": 4, "system_review": True, "triage": True, "min_band": "None", "min_confidence": 0.0},
}
OPTIONS = {
    "mode": ("auto", "interactive", "batch", "batch-offpeak"), "max_context_tokens": 12000, "max_output_tokens": 3000, "escalation_threshold": 0.75, "extra_patterns": [], "entropy_threshold": 4.0,
    "tooling_install": ("ask", "never", "all"), "timeout_s": 120, "window_hours": 24, "applicability_mode": ("hybrid", "declared-only", "inferred-only"), "declared_regimes": [], "output": ("default", "quiet", "verbose"), "run_bound_s": 45,
}
OK, ERROR, NOT_READY, PENDING, QUARANTINED, INTERRUPTED = 0, 1, 2, 3, 4, 130


class OptionError(ValueError):
    """All that is wrong with a set of options."""


@dataclass(frozen=True)
class Profile:
    domains: tuple[str, ...] | str
    max_level: int
    system_review: bool
    triage: bool
    min_band: str
    min_confidence: float


@dataclass(frozen=True)
class Options:
    """A closed set of options: a list's first member is the default, another value must be one of the list."""

    values: dict = field(default_factory=dict)

    def __getitem__(self, name: str):
        default = OPTIONS[name]
        return self.values.get(name, default[0] if isinstance(default, tuple) else default)


def options(given: dict | None = None, environment: dict | None = None, prefix: str = "SIEVEWORK_") -> Options:
    """Options over defaults, those of the environment above the given ones; unknown names and wrong values are all named."""
    found, wrong = dict(given or {}), []
    for name, value in (environment or {}).items():
        if name.startswith(prefix):
            found[name.removeprefix(prefix).lower()] = value
    for name, value in list(found.items()):
        if name not in OPTIONS:
            wrong.append(f"unknown option {name}")
            continue
        default = OPTIONS[name]
        if isinstance(default, tuple):
            if value not in default:
                wrong.append(f"{name} must be one of {', '.join(default)}")
        elif isinstance(value, str) and not isinstance(default, (str, list)):
            try:
                found[name] = type(default)(value)
            except ValueError:
                wrong.append(f"{name} must be a number")
    if wrong:
        raise OptionError("; ".join(sorted(wrong)))
    return Options(found)


def deep_merge(base: dict, patch: dict) -> dict:
    """patch over base; maps are merged, all else is replaced."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in patch.items()}


def profile(name: str = "full", custom: dict | None = None, overrides: dict | None = None) -> Profile:
    """A built-in or custom profile; a custom one may name a base."""
    known = {**PROFILES, **(custom or {})}
    if name not in known:
        raise OptionError(f"unknown profile {name}; known: {', '.join(sorted(known))}")
    raw = dict(known[name])
    base = raw.pop("base", None)
    if base is not None and base not in known:
        raise OptionError(f"profile {name} has an unknown base {base}")
    raw = deep_merge(deep_merge({k: v for k, v in known[base or "full"].items() if k != "base"}, raw), overrides or {})
    if not 1 <= int(raw["max_level"]) <= 4 or not 0 <= float(raw["min_confidence"]) <= 1 or raw["min_band"] not in ("Critical", "High", "Medium", "Low", "None"):
        raise OptionError(f"profile {name}: a level, confidence or band out of range")
    return Profile(**raw)


def canonical_json(document) -> str:
    """One text for one document: sorted keys, two blanks a level, a line end."""
    return json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


# ---- tables with an envelope


def write_artifact(df: DataFrame, path: str, stage: str, scan_id: str) -> None:
    """df as Parquet, each row with the version, stage and scan that made it."""
    df.withColumns({"_schema_version": F.lit(SCHEMA_VERSION), "_stage": F.lit(stage), "_scan_id": F.lit(scan_id)}).write.mode("overwrite").parquet(path)


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """The rows without their envelope; tables without one are read as they are, other versions are an error."""
    df = spark.read.parquet(path)
    if "_schema_version" not in df.columns:
        return df
    right = F.col("_schema_version") == SCHEMA_VERSION
    ok = right | F.raise_error(F.concat(F.lit(f"{path}: schema version "), "_schema_version")).cast("boolean")
    return df.where(ok).drop("_schema_version", "_stage", "_scan_id")


class Stages:
    """Which stages are done, under which key: a table in the artifacts' folder, one row a run of a stage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/stages"

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], "stage string, key string, status string, seq long")

    def status(self) -> DataFrame:
        """stage, key, status of the latest run of each."""
        rows = self._rows()
        return rows.groupBy("stage").agg(F.max_by(F.struct("key", "status"), "seq").alias("s")).select("stage", "s.key", "s.status")

    def record(self, stage: str, key: str, status: str = "done") -> None:
        seq = self._rows().agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
        self.spark.createDataFrame([(stage, key, status, seq)], "stage string, key string, status string, seq long").write.mode("append").parquet(self.path)

    def should_skip(self, stage: str, key: str) -> bool:
        return self.status().where((F.col("stage") == stage) & (F.col("key") == key) & (F.col("status") == "done")).limit(1).count() > 0

    def invalidate(self, *stages: str) -> None:
        for s in stages:
            self.record(s, "", "invalid")

    def run(self, stage: str, key: str, folder: str, make) -> DataFrame:
        """The stored table of a stage; `make()` gives it where there is none under the key."""
        path = f"{folder.rstrip('/')}/{stage}"
        if not self.should_skip(stage, key):
            write_artifact(make(), path, stage, key)
            self.record(stage, key)
        return read_artifact(self.spark, path)


# ---- text and reports


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text, to any file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def latest_report(spark: SparkSession, folder: str, suffix: str = ".json") -> str | None:
    """The last file by name: scans are named by their time."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().toString() for f in base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(base)]
    return max((n for n in names if n.endswith(suffix)), default=None)


def report_rows(findings: DataFrame, most: int = 10_000) -> list[dict]:
    """The findings of a report for a rendering; more than `most` are an error, as a report is read by people."""
    rows = findings.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} findings: narrow the report's thresholds")
    return [r.asDict(recursive=True) for r in rows]


def render_json(rows: list[dict], scan_id: str) -> str:
    return canonical_json({"schema_version": SCHEMA_VERSION, "scan_id": scan_id, "findings": rows})


def render_markdown(rows: list[dict], scan_id: str, bands: tuple[str, ...] = ("Critical", "High", "Medium", "Low", "None")) -> str:
    """A section for each band that has findings, in the order given."""
    out = [f"# Report {scan_id}", ""]
    for b in bands:
        here = [r for r in rows if r["band"] == b]
        if here:
            out += [f"## {b}", "", *[f"- {r['id']} {r['cwe']} {r['repo']}:{r['file']} severity {r['severity']} confidence {r['confidence']}" for r in here], ""]
    return "\n".join(out) + "\n"


def render_html(rows: list[dict], scan_id: str) -> str:
    """Each finding with an anchor, and a list of links at the top; a link without its anchor is an error."""
    from html import escape

    ids = [str(r["id"]) for r in rows]
    clean = lambda x: "".join(c if c.isalnum() or c in "-_" else "-" for c in x)
    links = "".join(f'<li><a href="#{clean(i)}">{escape(i)}</a></li>' for i in ids)
    body = "".join(f'<section id="{clean(str(r["id"]))}"><h2>{escape(str(r["id"]))}</h2><p>{escape(str(r["cwe"]))} {escape(str(r["repo"]))}:{escape(str(r["file"]))} {escape(str(r["band"]))}</p></section>' for r in rows)
    anchors = {clean(i) for i in ids}
    if len(anchors) != len(ids):
        raise ValueError("two findings share an anchor")
    return f"<!doctype html><html><head><title>{escape(scan_id)}</title></head><body><ul>{links}</ul>{body}</body></html>\n"
