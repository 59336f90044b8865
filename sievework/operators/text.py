"""Facts from texts: lines, annotations, categories, rule hits, entropy candidates, absence proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalars import entropy, token_estimate

# The rules of the minimum slice: label, CWE, severity, confidence, pattern of a line.
RULES = (
    ("assigned-secret", "CWE-798", 8.2, 0.9, "(token|secret|password|api_key) = \"[A-Za-z0-9]{16,}\""),
    ("email", "CWE-359", 4.3, 0.6, "[a-z0-9.]+@[a-z0-9]+[.][a-z]+"),
    ("hex-candidate", "CWE-321", 7.1, 0.5, "[0-9a-f]{40}"),
    ("license-line", "CWE-1104", 2.1, 0.4, "(Licensed|License|Copyright)"),
)
# Data categories by their signals.
CATEGORIES = (
    ("personal-data", ("email", "firstname", "lastname", "full_name", "address", "phone", "birthdate", "date_of_birth", "ssn", "passport")),
    ("financial-data", ("card_number", "credit_card", "iban", "account_number", "routing_number")),
    ("health-data", ("patient", "diagnosis", "medical", "prescription", "health_record", "treatment", "lab_result", "phi")),
)


def lines(files: DataFrame) -> DataFrame:
    """repo, path, line_no (from 1), line: texts cut at line feeds; a null text has no lines."""
    return files.select("repo", "path", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("repo", "path", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def numbered(files: DataFrame) -> DataFrame:
    """path, numbered: every line with its right-aligned number."""
    parts = F.split("text", "\n")
    width = F.length(F.size(parts).cast("string"))
    return files.select("path", F.array_join(F.transform(parts, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit("| "), x)), "\n").alias("numbered"))


def rule_hits(lines: DataFrame) -> DataFrame:
    """repo, path, line_no, label, cwe, severity, confidence, matches: rules that match a line.

    The pack is unrolled into one projection of literal patterns, which compile once.
    """
    rows = F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(label).alias("label"), F.lit(cwe).alias("cwe"), F.lit(s).alias("severity"), F.lit(c).alias("confidence"), F.regexp_count("line", F.lit(p)).cast("long").alias("matches"))) for label, cwe, s, c, p in RULES])
    return lines.select("repo", "path", "line_no", F.inline(F.filter(rows, lambda x: x.isNotNull())))


def entropy_candidates(files: DataFrame, length: int = 24, least: float = 4.0) -> DataFrame:
    """path, candidate, bits, secret: long words of a file, each once, their entropy, and whether it is that of a secret."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(f"([A-Za-z0-9+/=_-]{{{length},}})"), 1))
    found = files.select("path", F.explode(words).alias("candidate"))
    return found.withColumn("bits", F.round(entropy(F.col("candidate")), 6)).withColumn("secret", F.col("bits") >= least)


def must_find(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """item_id, files, found: which of a stated set of texts (item_id, wanted) occur verbatim in files (path, text).

    A text that occurs brings along its inner words, whole: the longest of them is its anchor, by which it meets the words
    of files, by equality. What meets is then compared in full. A text without an inner word has no anchor and is compared
    with every file, in blocks.
    """
    inner = F.filter(F.slice(F.split("wanted", r"\s+"), F.lit(2), F.greatest(F.size(F.split("wanted", r"\s+")) - 2, F.lit(0))), lambda w: w != "")
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    sought = wanted.withColumn("anchor", F.when(F.size(inner) > 0, longest))
    words = files.select("path", "text", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("anchor"))
    met = words.join(sought.where("anchor is not null"), "anchor").where(F.contains("text", F.col("wanted"))).select("item_id", "path")
    bare = sought.where("anchor is null").select("item_id", "wanted")
    if not bare.isEmpty():
        met = met.unionByName(files.join(F.broadcast(bare), F.contains("text", F.col("wanted"))).select("item_id", "path"))  # texts of two words at most
    counts = met.groupBy("item_id").agg(F.count(F.lit(1)).alias("files"))
    return wanted.join(counts, "item_id", "left").select("item_id", F.coalesce("files", F.lit(0)).alias("files"), F.col("files").isNotNull().alias("found"))


def token_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum(token_estimate(F.col("text"))).alias("tokens"))


def manifest(files: DataFrame) -> DataFrame:
    """repo, languages (sorted, comma-joined), files, loc (line feeds + 1)."""
    loc = F.regexp_count("text", F.lit("\n")) + 1
    return files.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.count(F.lit(1)).alias("files"), F.sum(loc).cast("long").alias("loc"))


def absence(files: DataFrame, pattern: str, language: str) -> DataFrame:
    """repo, searched, state: absent-proven only where files were searched, undetermined where none were."""
    mine = F.col("language") == language
    found = files.groupBy("repo").agg(F.count_if(mine).alias("searched"), F.coalesce(F.bool_or(mine & F.col("text").rlike(pattern)), F.lit(False)).alias("present"))
    return found.select("repo", "searched", F.when(F.col("present"), "evidenced").when(F.col("searched") == 0, "undetermined").otherwise("absent-proven").alias("state"))
