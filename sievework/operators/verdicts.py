"""Decisions on findings: applicability, framework controls, verification, calibration, triage. Each is a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import BANDS, band, band_rank

# Weaknesses whose presence is the finding, those of them that reachability still bears on, those that a
# control on the path refutes, and those of credentials.
PRESENCE = ("CWE-798", "CWE-259", "CWE-256", "CWE-522", "CWE-532", "CWE-352", "CWE-942", "CWE-306", "CWE-489", "CWE-1188", "CWE-295", "CWE-1004", "CWE-290")
REACHABILITY_SENSITIVE = ("CWE-306", "CWE-290")
REFUTED_BY_CONTROL = ("CWE-862", "CWE-863", "CWE-285", "CWE-284", "CWE-306", "CWE-287")
PROMPT_INJECTION = "CWE-1427"
CREDENTIAL = ("CWE-798", "CWE-522")
MITIGATING = ("authorization_required", "authentication_required")
ROLE_WORDS = ("role", "staff", "admin", "authoriz", "permiss", "tenant")
NO_SOURCE = "no externally controllable source could be traced to this location; reachability from an entry point is unconfirmed"
GAP = (
    "reachability unconfirmed: endpoints and data-access facts were found, but flow tracing connected none of them — authentication/authorization wiring, "
    "source channels, or driver calls may use conventions not yet recognized; treat presence-confirmed verdicts in this run as reachability-unproven"
)
# Caps of confidence, the factor of a credited control, the distance from the least verified severity.
UNCONFIRMED, UNASSESSED, CREDITED, RANK_GAP, DOWNGRADED = 0.5, 0.6, 0.5, 0.1, 0.8


def _empty(c: str) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def is_credential(cwe: Column) -> Column:
    return F.upper(cwe).isin(*CREDENTIAL)


def verdict(findings: DataFrame) -> DataFrame:
    """findings with status, basis and gap. Of each: cwe, detection, has_flow, validations (of its flow), implicated
    (places that it blames), gap_active (the run's reachability is unconfirmed).

    A traced flow verifies, unless an independent control on it refutes; without a flow presence verifies where presence is
    the finding and its format is sure; all else is plausible. A missing detection counts as a sure format.
    """
    holds = lambda v, marks: F.greatest(*[F.contains(v, F.lit(m)) for m in marks])
    labelled = F.exists("validations", lambda v: F.contains(v, F.lit("boundary_labeled")))
    own = lambda v: F.exists(F.coalesce("implicated", F.array().cast("array<string>")), lambda t: (t != "") & F.contains(v, t))
    control = F.exists("validations", lambda v: holds(v, MITIGATING) & ~own(v))
    refuted = F.when(F.col("cwe") == PROMPT_INJECTION, labelled).when(F.col("cwe").isin(*REFUTED_BY_CONTROL), control).otherwise(False)
    present = F.col("cwe").isin(*PRESENCE) & (F.coalesce("detection", F.lit("format")) == "format")
    open_ = F.col("cwe").isin(*REACHABILITY_SENSITIVE) & F.coalesce("gap_active", F.lit(False))
    rules = (
        (F.col("has_flow") & F.coalesce(refuted, F.lit(False)), "disproven", None, None),
        (F.col("has_flow"), "verified", "traced", None),
        (present & open_, "plausible", None, GAP),
        (present, "verified", "presence", None),
    )
    pick = lambda i, default: F.coalesce(*[F.when(r[0], F.struct(F.lit(r[i]).cast("string").alias("v"))) for r in rules], F.struct(F.lit(default).cast("string").alias("v")))["v"]
    return findings.withColumns({"status": pick(1, "plausible"), "basis": pick(2, None), "gap": pick(3, NO_SOURCE)})


def flow_verdict(findings: DataFrame) -> DataFrame:
    """The verdict on a flow finding: flow_known, route_marks (annotations up to the privileged step; null: no such step),
    missing_check, partial, actor (determination).

    A gap of roles is refuted by authorization alone, one of identity by authentication too.
    """
    missing = F.lower(F.coalesce("missing_check", F.lit("")))
    role = F.greatest(*[F.contains(missing, F.lit(w)) for w in ROLE_WORDS])
    has = lambda m: F.array_contains("route_marks", m)
    gated = has("authorization_required") | (~role & has("authentication_required"))
    unsure = F.coalesce("partial", F.lit(False)) | (F.coalesce("actor", F.lit("")) == "undetermined")
    status = F.when(~F.col("flow_known") | F.col("route_marks").isNull(), "plausible").when(gated, "disproven").when(unsure, "plausible").otherwise("verified")
    return findings.withColumn("status", status)


def severity_ceiling(findings: DataFrame) -> DataFrame:
    """One row: RANK_GAP below the least severity of a verified finding; null without any."""
    return findings.agg(F.round(F.min(F.when(F.col("verified"), F.col("severity"))) - RANK_GAP, 1).alias("ceiling"))


def calibrated(findings: DataFrame) -> DataFrame:
    """findings with severity, confidence and band as the rules leave them, and `caps`: the rules applied, in order.

    findings: severity, confidence, verified, gap, control (credited, unassessed, ...), usage (found, none-found, ...). A
    credited control halves the severity, an unassessed one caps the confidence, so does usage that was not found, and what
    is neither verified nor known for another gap must not outrank the verified. The ceiling comes from severities before
    the first rule, so one row is broadcast and no window over all rows is needed.
    """
    rows = findings.crossJoin(F.broadcast(severity_ceiling(findings)))
    halved = F.round(F.col("severity") * CREDITED, 1)
    credited = (F.coalesce("control", F.lit("")) == "credited") & (halved < F.col("severity"))
    unassessed = (F.coalesce("control", F.lit("")) == "unassessed") & (F.col("confidence") > UNASSESSED)
    rows = rows.withColumns({"__s": F.when(credited, halved).otherwise(F.col("severity")), "__c": F.when(unassessed, UNASSESSED).otherwise(F.col("confidence")), "__1": F.when(credited, "framework-control-credited").when(unassessed, "framework-control-unassessed")})
    unused = (F.coalesce("usage", F.lit("")) == "none-found") & (F.col("__c") > UNCONFIRMED)
    rows = rows.withColumns({"__c": F.when(unused, UNCONFIRMED).otherwise(F.col("__c")), "__2": F.when(unused, "usage-none-found")})
    unproven = ~F.col("verified") & (_empty("gap") | F.contains("gap", F.lit("reachability")) | F.contains("gap", F.lit("externally controllable source")))
    over = F.coalesce(F.col("__s") > F.col("ceiling"), F.lit(False))
    capped = unproven & (over | (F.col("__c") > UNCONFIRMED))
    rows = rows.withColumns({"__s": F.when(capped, F.least("__s", F.coalesce("ceiling", "__s"))).otherwise(F.col("__s")), "__c": F.when(capped, F.least("__c", F.lit(UNCONFIRMED))).otherwise(F.col("__c")), "__3": F.when(capped, "plausible-unconfirmed-reachability")})
    rows = rows.withColumns({"severity": F.round("__s", 1), "confidence": F.round("__c", 2), "caps": F.array_compact(F.array("__1", "__2", "__3"))})
    return rows.drop("ceiling", "__s", "__c", "__1", "__2", "__3").withColumn("band", band(F.col("severity")))


def ranking_broken(findings: DataFrame) -> DataFrame:
    """One row: whether an unverified finding is as severe as a verified one, or more."""
    worst = F.max(F.when(~F.col("verified"), F.col("severity")))
    least = F.min(F.when(F.col("verified"), F.col("severity")))
    return findings.agg(F.coalesce(worst >= least, F.lit(False)).alias("broken"))


def applicable(shapes: Column, requires: Column, requested: Column | None = None) -> Column:
    """true, false or undetermined: whether a weakness is possible on what is reachable.

    requires: shapes of which one is needed, null where no rule speaks of the weakness; a requested weakness stays.
    """
    unknown = (F.coalesce(F.size(shapes), F.lit(0)) <= 0) | F.array_contains(shapes, "undetermined")
    out = F.when(requires.isNull(), "true").when(unknown, "undetermined").when(F.arrays_overlap(shapes, requires), "true")
    return (out if requested is None else out.when(requested, "true")).otherwise("false")


def remapped(findings: DataFrame) -> DataFrame:
    """findings with their weakness remapped where `applicable` is exactly false: cwe, severity and `proposed_cwe`.

    findings: cwe, severity, applicable, alternative, alternative_severity. No alternative leaves the row as it is.
    """
    out = (F.col("applicable") == "false") & F.col("alternative").isNotNull()
    return findings.withColumns(
        {
            "proposed_cwe": F.when(out, F.col("cwe")),
            "severity": F.when(out, F.least("severity", F.coalesce("alternative_severity", "severity"))).otherwise(F.col("severity")),
            "cwe": F.when(out, F.col("alternative")).otherwise(F.col("cwe")),
        }
    )


def control_state(rows: DataFrame) -> DataFrame:
    """rows with `control`: credited, bypassed, absent or unassessed; the first rule that fits.

    rows: n_frameworks, control_id (null: none mitigates the weakness), requires_config, escapes, sink_marker (null: no
    template sink here), sink_framework_fits, sink_known (its marker is one of the control's), unparsed_member,
    bypass_member, unparsed_path, bypass_path.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    unescaped = no("requires_config") & ~no("escapes")
    template = (
        F.when(~no("sink_framework_fits") | ~no("sink_known"), "absent")
        .when(unescaped | no("unparsed_member"), "unassessed")
        .when(no("bypass_member"), "bypassed")
        .otherwise("credited")
    )
    state = (
        F.when(F.col("n_frameworks") == 0, "unassessed")
        .when(F.col("control_id").isNull(), "absent")
        .when(F.col("sink_marker").isNotNull(), template)
        .when(unescaped | no("unparsed_path"), "unassessed")
        .when(no("bypass_path"), "bypassed")
        .otherwise("credited")
    )
    return rows.withColumn("control", state)


def usage_state(rows: DataFrame) -> DataFrame:
    """rows with usage and role: found where places use the package, none-found where all could be searched, else
    undetermined. rows: n_found, n_reasons (why the search is not conclusive), n_runtime (places that are no tests)."""
    usage = F.when(F.col("n_found") > 0, "found").when(F.col("n_reasons") > 0, "undetermined").otherwise("none-found")
    return rows.withColumns({"usage": usage, "role": F.when(F.col("n_found") > 0, F.when(F.col("n_runtime") > 0, "runtime").otherwise("development"))})


def triage_candidates(findings: DataFrame, least_band: str = "Medium", include_unverified: bool = True) -> DataFrame:
    """Findings that triage looks at: no dependency, verified if that is asked, and severe enough or found by a heuristic.

    A band that is none of the known ones passes.
    """
    known = F.col("band").isin("None", *[b for b, _ in BANDS])
    severe = ~known | (band_rank(F.col("band")) >= band_rank(F.lit(least_band)))
    out = findings.where(_empty("dependency") & (severe | (F.coalesce("detection", F.lit("")) == "heuristic")))
    return out if include_unverified else out.where("verified")


def triage_outcomes(findings: DataFrame) -> DataFrame:
    """findings with outcome, effect, kept, severity and confidence after triage; the first rule that fits.

    findings: asked (has a verdict row), answered, well_formed, gated, verdict (confirmed, flagged, refuted, downgraded),
    citations_hold, in_perimeter. What was not asked has no outcome. Only a refutation whose citations hold, outside of
    what the finding accuses, takes a row away.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    rules = (
        (~no("asked"), None, None),
        (~no("answered"), "unanswered", "none"),
        (~no("well_formed") | no("gated"), "rejected-malformed", "none"),
        (F.col("verdict") == "confirmed", "applied", "none"),
        (F.col("verdict") == "flagged", "applied", "flag-attached"),
        (~no("citations_hold"), "degraded-flagged", "flag-attached"),
        (no("in_perimeter"), "rejected-perimeter", "flag-attached"),
        (F.col("verdict") == "refuted", "applied", "suppression-added"),
        (F.col("verdict") == "downgraded", "applied", "grading-adjusted"),
    )
    pick = lambda i: F.coalesce(*[F.when(r[0], F.struct(F.lit(r[i]).cast("string").alias("v"))) for r in rules], F.struct(F.lit("rejected-malformed" if i == 1 else "none").alias("v")))["v"]
    out = findings.withColumns({"outcome": pick(1), "effect": pick(2)})
    graded = F.coalesce(F.col("effect") == "grading-adjusted", F.lit(False))
    return out.withColumns(
        {
            "kept": F.coalesce(F.col("effect") != "suppression-added", F.lit(True)),
            "severity": F.when(graded, F.greatest(F.lit(1.0), F.round(F.col("severity") * CREDITED, 1))).otherwise(F.col("severity")),
            "confidence": F.when(graded, F.least("confidence", F.lit(DOWNGRADED))).otherwise(F.col("confidence")),
        }
    )
