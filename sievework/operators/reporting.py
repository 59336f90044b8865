"""What a report says: coverage, gaps, cross-checks of its own text, declarations, views of one repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.scalars import band_rank, channel_tokens
from sievework.operators.flows import stored
from sievework.operators.verdicts import DOWNGRADED, is_credential

# Marks that make a gap critical, and names of security files.
CRITICAL_MARKS = ("security_sink", "sensitive_data", "trust_boundary", "authentication_required", "authorization_required")
SECURITY_NAME = "(?i)security|firewall|acl|auth"
IMPACT = {
    "blocked-value": "a value that could not be confirmed as a non-credential was blocked; security-config and credential rules could not fully assess this file's content",
    "budget-dropped": "the file exceeded the token budget and was deferred; segment analysis may not have seen its content",
    "unparsed-format": "the file's format is not parsed; only file-tier facts exist",
}
FINDING_ID = r"SEC-[0-9]{4,}"
VERIFICATION_RANK = {"verified": 0, "plausible": 1, "disproven": 2}


def verification_rank(status: Column) -> Column:
    out = F.lit(9)
    for name, rank in VERIFICATION_RANK.items():
        out = F.when(F.coalesce(status, F.lit("plausible")) == name, rank).otherwise(out)
    return out


def fold_duplicates(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One finding per key: the highest confidence, then the first by seq, with the evidence of all, in the order of
    (winner, then seq), each file and reason once; and the ids of the others as `duplicates`.

    findings: id, seq, confidence, evidence (array of structs with file and reason), the keys and others. Null keys are
    keys. Rows are dealt once by their keys, or not at all where they lie so already; of a hot key a task holds, besides
    the ids that it returns, the winner and the pieces of evidence that differ, one by one.
    """
    rest = [c for c in findings.columns if c not in keys]
    row = F.col("__row")
    order = F.struct((-row["confidence"]).alias("c"), row["seq"], row["id"])
    # One sort serves both steps, and their aggregates stream over it. Hash aggregates that collect would sort anew in each
    # of their four phases; a key whose type compares by a collation, here of a text that is always empty, rules them out.
    hashed = F.xxhash64(*keys)
    streamed = F.collate(F.substring(hashed.cast("string"), 1, 0), "UTF8_LCASE")
    groups = ["__h", "__z", *keys]
    items = findings.select(hashed.alias("__h"), streamed.alias("__z"), *keys, F.struct(*rest).alias("__row"), F.posexplode_outer("evidence").alias("__i", "__e"))
    # One row for each piece of evidence: the first says for its finding that it is there.
    first = F.when(F.coalesce("__i", F.lit(0)) == 0, row["id"])
    pieces = items.groupBy(*groups, F.col("__e.file").alias("__f"), F.col("__e.reason").alias("__r")).agg(
        F.min_by("__row", order).alias("__row"), F.collect_list(first).alias("__ids"), F.min(F.when(F.col("__i").isNotNull(), F.struct(row["seq"], "__i", "__e"))).alias("__m")
    )
    folded = pieces.groupBy(*groups).agg(F.min_by("__row", order).alias("__w"), F.flatten(F.collect_list("__ids")).alias("__ids"), F.array_sort(F.collect_list("__m")).alias("__all"))
    same = lambda a, b: a["file"].eqNullSafe(b["file"]) & a["reason"].eqNullSafe(b["reason"])
    own = F.col("__w.evidence")
    others = F.transform(F.filter("__all", lambda m: ~F.coalesce(F.exists(own, lambda e: same(e, m["__e"])), F.lit(False))), lambda m: m["__e"])
    distinct = F.filter(own, lambda e, i: ~F.exists(F.slice(own, F.lit(1), i), lambda x: same(x, e)))
    evidence = F.when((F.size("__ids") > 1) & (F.size("__all") > 0), F.concat(F.coalesce(distinct, F.array().cast(dict(findings.dtypes)["evidence"])), others)).otherwise(own)
    late = F.array_sort(F.filter("__ids", lambda x: x != F.col("__w.id")))
    columns = [evidence.alias(c) if c == "evidence" else F.col(c) if c in keys else F.col(f"__w.`{c}`").alias(c) for c in findings.columns]
    return folded.select(*columns, late.alias("duplicates"))


def cross_system_ids(evidence: DataFrame) -> DataFrame:
    """ids of findings whose own evidence (id, repo, segment) spans several repositories or segments."""
    return evidence.groupBy("id").agg(F.countDistinct("repo").alias("repos"), F.countDistinct("segment").alias("segments")).where("repos > 1 or segments > 1").select("id")


def systemic_links(findings: DataFrame) -> DataFrame:
    """id, target_id: each finding of a weakness that several have, to the one of the least id."""
    anchors = findings.groupBy("cwe").agg(F.min("id").alias("target_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return findings.join(anchors, "cwe").where("id <> target_id").select("id", "target_id")


def flow_links(findings: DataFrame) -> DataFrame:
    """id, target_id, both ways, between findings of flows and of code with one weakness in one file."""
    place = ["cwe", "repo", "file"]
    flows = findings.where("flow_ref is not null").select(*place, F.col("id").alias("a"))
    met = flows.join(findings.where("flow_ref is null").select(*place, F.col("id").alias("b")), place)
    return met.select(F.col("a").alias("id"), F.col("b").alias("target_id")).unionByName(met.select(F.col("b").alias("id"), F.col("a").alias("target_id")))


def identity_families(findings: DataFrame) -> DataFrame:
    """token, anchor_id, id, type: findings whose text names one identity channel. The anchor is the first that a pack made,
    else the first; it depends on nothing, the others on it, and it is related to each of them. findings: id, text, from_pack."""
    members = findings.select("id", "from_pack", F.explode(channel_tokens(F.col("text"))).alias("token"))
    anchors = members.groupBy("token").agg(F.min(F.struct((~F.col("from_pack")).alias("a"), "id"))["id"].alias("anchor_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = members.join(anchors, "token").where("id <> anchor_id")
    return met.select("token", "anchor_id", "id", F.lit("dependent").alias("type")).unionByName(met.select("token", F.col("id").alias("anchor_id"), F.col("anchor_id").alias("id"), F.lit("related").alias("type")))


def recommendations(findings: DataFrame, most: int = 8) -> DataFrame:
    """The most frequent weaknesses: cwe, findings, bands from the most severe down."""
    ranked = F.array_sort(F.collect_set(F.struct((-band_rank(F.col("band"))).alias("r"), "band")))
    out = findings.groupBy("cwe").agg(F.count(F.lit(1)).alias("findings"), F.array_join(F.transform(ranked, lambda x: x["band"]), ",").alias("bands"))
    return out.orderBy(F.desc("findings"), "cwe").limit(most)


def gap_details(gaps: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """cause, file, segment, critical, impact: each gap once; critical by marks in the file, its class, or its name.

    gaps: cause, file, segment; nodes: path, annotations; classes: name, file_class (source and template are no configuration).
    """
    marked = nodes.where(F.arrays_overlap(F.coalesce("annotations", F.array().cast("array<string>")), F.array(*map(F.lit, CRITICAL_MARKS)))).select(F.col("path").alias("file")).distinct().withColumn("__marked", F.lit(True))
    config = classes.where("file_class not in ('source', 'template')").select(F.col("name").alias("__name")).distinct().withColumn("__config", F.lit(True))
    rows = gaps.select("cause", "file", "segment").distinct().withColumn("__name", F.element_at(F.split("file", "/"), -1))
    rows = rows.join(marked, "file", "left").join(F.broadcast(config), "__name", "left")
    critical = F.coalesce("__marked", F.lit(False)) | F.coalesce("__config", F.lit(False)) | F.col("__name").rlike(SECURITY_NAME)
    impact = F.create_map(*[F.lit(x) for pair in IMPACT.items() for x in pair])[F.col("cause")]
    return rows.select("cause", "file", "segment", critical.alias("critical"), impact.alias("impact"))


def gap_notes(notes: DataFrame) -> DataFrame:
    """note: each once, those that differ in their level alone folded into one that lists the levels."""
    level = F.regexp_extract("note", r" at level (\d+)", 1)
    cut = F.split("note", r" at level \d+", 2)
    rows = notes.select(F.when(level != "", cut[0]).otherwise(F.col("note")).alias("before"), F.when(level != "", cut[1]).otherwise("").alias("after"), F.when(level != "", level.cast("int")).alias("level"))
    by = rows.groupBy("before", "after").agg(F.array_sort(F.collect_set("level")).alias("levels"), F.count("level").alias("n"))
    shown = F.array_join(F.transform("levels", lambda x: x.cast("string")), ", ")
    return by.select(F.when(F.size("levels") == 0, F.col("before")).when(F.col("n") == 1, F.concat("before", F.lit(" at level "), shown, "after")).otherwise(F.concat("before", F.lit(" (levels "), shown, F.lit(")"), "after")).alias("note"))


def file_class_coverage(classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """file_class, represented, unparsed (paths), attempted: every class, also those without a file. nodes: file_class,
    symbol, parsed, path; symbols do not count, and only sources can be unparsed."""
    files = nodes.where("file_class is not null and coalesce(symbol, '') = ''")
    lost = (~F.coalesce("parsed", F.lit(True))) & (F.col("file_class") == "source")
    by = files.groupBy("file_class").agg(F.count_if(~lost).alias("represented"), F.array_sort(F.collect_list(F.when(lost, F.col("path")))).alias("unparsed"))
    out = classes.select("file_class").distinct().join(by, "file_class", "full")
    return out.select("file_class", F.coalesce("represented", F.lit(0)).alias("represented"), F.coalesce("unparsed", F.array().cast("array<string>")).alias("unparsed"), F.col("represented").isNotNull().alias("attempted"))


def dangling_references(sections: DataFrame, admitted: DataFrame) -> DataFrame:
    """section, dangling_id: finding ids that a section of the narrative names and the report does not have."""
    named = sections.select("section", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({FINDING_ID})"), 1))).alias("dangling_id"))
    return named.join(admitted.select(F.col("id").alias("dangling_id")), "dangling_id", "left_anti").select("section", "dangling_id")


def contradictions(findings: DataFrame, sections: DataFrame) -> DataFrame:
    """rule, subject: what in a report contradicts the rest of it. A report with any is withheld.

    findings: id, band, printed_band, status, observed, trail, path, control, impact_restated, reproduction_text,
    trigger, trigger_reason, read_guidance, refs. Each check is a filter; they are one union.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    off_path = F.size(F.array_except(F.coalesce("trail", F.array().cast("array<string>")), F.coalesce("path", F.array().cast("array<string>")))) > 0
    checks = {
        "finding-outside-band": F.col("band") != F.col("printed_band"),
        "unearned-observation": F.coalesce("observed", F.lit(False)) & (text("status") != "verified"),
        "trail-without-path": (size("trail") > 0) & (size("path") <= 0),
        "trail-entry-off-path": (size("trail") > 0) & (size("path") > 0) & off_path,
        "impact-against-credited-control": (text("control") == "credited") & ~F.coalesce("impact_restated", F.lit(False)),
        "reproduction-against-narrative": (text("reproduction_text") != "") & (text("status") == "disproven"),
        "trigger-omitted-without-reason": (text("trigger") == "") & (text("trigger_reason") == ""),
        "missing-read-guidance": text("read_guidance") == "",
    }
    found = findings.withColumn("__rules", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])))
    out = found.select(F.explode("__rules").alias("rule"), F.col("id").cast("string").alias("subject"))
    refs = findings.select("id", F.explode("refs").alias("ref")).join(findings.select(F.col("id").alias("ref")), "ref", "left_anti")
    out = out.unionByName(refs.select(F.lit("dangling-finding-reference").alias("rule"), F.col("id").cast("string").alias("subject")))
    return out.unionByName(dangling_references(sections, findings).select(F.lit("dangling-section").alias("rule"), F.col("section").alias("subject")))


def apply_declarations(declarations: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, flags with resolution, severity and confidence) from what users declare on open questions.

    declarations: seq, repo, file, cwe, symbol, question, resolution (refute or downgrade), clean (the answer holds no
    secret); flags: id, repo, file, cwe, symbol, question, severity, confidence. A declaration needs a flag of its place
    with its question; then it speaks for every flag with that question, the first one by seq. Credentials cannot be
    refuted. What matches nothing lapses.
    """
    named = F.coalesce(declarations["symbol"], F.lit("")) == ""
    on = (declarations["repo"] == flags["repo"]) & (declarations["file"] == flags["file"]) & (F.upper(declarations["cwe"]) == F.upper(flags["cwe"])) & (declarations["question"] == flags["question"])
    admitted = declarations.join(flags, on & (named | (declarations["symbol"] == flags["symbol"])), "left_semi")
    lapsed = declarations.join(admitted.select("seq"), "seq", "left_anti")
    unclean = admitted.where("not clean")
    first = admitted.where("clean").groupBy("question").agg(F.min_by("resolution", "seq").alias("resolution"))
    out = flags.join(first, "question", "left")
    refused = (F.col("resolution") == "refute") & is_credential(F.col("cwe"))
    effect = F.when(F.col("resolution").isNull(), F.lit(None)).when(refused, "none").when(F.col("resolution") == "refute", "suppression-added").otherwise("grading-adjusted")
    out = out.withColumn("effect", effect)
    graded = F.coalesce(F.col("effect") == "grading-adjusted", F.lit(False))
    severity = F.when(graded, F.greatest(F.lit(1.0), F.round(F.col("severity") * 0.5, 1))).otherwise(F.col("severity"))
    confidence = F.when(graded, F.least("confidence", F.lit(DOWNGRADED))).otherwise(F.col("confidence"))
    resolved = out.select(*flags.columns, "effect").withColumns({"severity": severity, "confidence": confidence})
    label = F.concat_ws(":", F.lit("declaration"), "repo", "file", "cwe")
    decisions = out.where("resolution is not null").select(F.col("id").cast("string").alias("subject"), F.when(F.col("effect") == "none", "rejected-credential-refute").otherwise("applied").alias("outcome"), "effect")
    decisions = decisions.unionByName(lapsed.select(label.alias("subject"), F.lit("declared-lapsed").alias("outcome"), F.lit("none").alias("effect")))
    return decisions.unionByName(unclean.select(label.alias("subject"), F.lit("rejected-declaration").alias("outcome"), F.lit("none").alias("effect"))), resolved


def awaiting_questions(flags: DataFrame) -> DataFrame:
    """question, provenance, ids, hints of open questions."""
    return flags.groupBy("question", "provenance").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.array_join(F.array_sort(F.collect_set("hint")), "; ").alias("hints"))


def files_cited(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """repo, file, ids: where findings (id, repo, file) lie and what their evidence (id, repo, file) names."""
    both = findings.select("repo", "file", "id").unionByName(evidence.select("repo", "file", "id"))
    return both.groupBy("repo", "file").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def repo_view(findings: DataFrame, evidence: DataFrame, repo) -> DataFrame:
    """Findings that lie in a repository, or of which a piece of evidence (id, repo) does."""
    touching = evidence.where(F.col("repo") == repo).select("id").distinct().withColumn("__touches", F.lit(True))
    rows = findings.join(touching, "id", "left")
    return rows.where((F.col("repo") == repo) | F.col("__touches")).select(*findings.columns)


def regimes(categories: DataFrame, packs: DataFrame, declared: DataFrame | None = None, mode: str = "hybrid") -> DataFrame:
    """regime, categories, steps: rules of data protection that apply, as declared, as inferred from categories (category,
    step), or as both. packs: regime, category."""
    inferred = categories.join(packs, "category").groupBy("regime").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("step")).alias("steps"))
    if mode == "inferred" or declared is None:
        return inferred
    named = declared.select("regime").distinct()
    return named.join(inferred, "regime", "left" if mode == "declared" else "full")


def allocated_ids(findings: DataFrame, producers: list[str], order: list[str], start: int = 1, prefix: str = "SEC-") -> DataFrame:
    """findings with an id: one gapless sequence over producers, in their order, behind the ids that rows bring along.

    Rows are numbered within ranges, by a checkpoint that fixes them, and the ranges' sizes are summed up: no task holds
    all of them.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, producers)), F.col("producer")), F.lit(0))
    taken = findings.agg(F.max(F.regexp_extract("id", rf"^{prefix}(\d+)$", 1).try_cast("int"))).first()[0] or 0
    new = findings.where("id is null").withColumn("__rank", rank)
    cut = new.repartitionByRange("__rank", *order).sortWithinPartitions("__rank", *order)
    cut = cut.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    cut = stored(cut)
    sizes = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    number = F.col("__before") + F.col("__at") + F.lit(max(start, taken + 1))
    made = cut.join(F.broadcast(before), "__part").withColumn("id", F.concat(F.lit(prefix), F.lpad(number.cast("string"), F.greatest(F.lit(4), F.length(number.cast("string"))), F.lit("0"))))
    return made.select(*findings.columns).unionByName(findings.where("id is not null"))
