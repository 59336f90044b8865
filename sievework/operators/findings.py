"""Findings in a report: thresholds, ranks, groups and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import band_rank
from sievework.operators import ranges


def best_by(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One finding per key, the highest confidence, then the least id, and how many there were, as `merged`.

    Two hash aggregates before the join on id: a hot key moves two numbers a task.
    """
    most = findings.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("merged"))
    least = findings.join(most, [*keys, "confidence"]).groupBy(*keys).agg(F.min("id").alias("id"), F.max("merged").alias("merged"))
    return findings.join(least.select("id", "merged"), "id")


def systemic(findings: DataFrame) -> DataFrame:
    """cwe, findings, repos, anchor_id of weaknesses that more than one finding has."""
    return findings.groupBy("cwe").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("repo").alias("repos"), F.min("id").alias("anchor_id")).where("findings > 1")


def admitted(findings: DataFrame, least_band: str = "Medium", least_confidence: float = 0.5) -> DataFrame:
    """The rows that report thresholds let through: neither disproven nor rejected, the band high enough, and verified or
    confident enough. status and verification may be missing."""
    rank = band_rank(F.lit(least_band))
    out = findings.where((band_rank(F.col("band")) >= rank) & (F.col("verified") | (F.col("confidence") >= least_confidence)))
    if "verification" in findings.columns:
        out = out.where(F.coalesce("verification", F.lit("")) != "disproven")
    return out.where(F.coalesce("status", F.lit("")) != "rejected") if "status" in findings.columns else out


def ranked(findings: DataFrame) -> DataFrame:
    """Rank within a band: verified first, then severity, confidence and id; bands are few, so ranks go by ranges."""
    return ranges.ranked(findings, ["band"], [F.desc("verified"), F.desc("severity"), F.desc("confidence"), F.col("id")])


def executive_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("band").agg(F.count(F.lit(1)).alias("findings"), F.count_if("verified").alias("verified"), F.count_if(F.col("confidence") >= 0.8).alias("confident"))


def grouped_by_band(findings: DataFrame) -> DataFrame:
    """band, rank, id of all findings, most severe band first: the order of a report's sections."""
    return ranked(findings).select("band", (-band_rank(F.col("band"))).alias("section"), "rank", "id")
