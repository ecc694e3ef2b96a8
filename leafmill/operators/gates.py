"""Quality gates: unit verdicts, three-level ratios, completeness, risk, metric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X

# Thresholds, codes and the kinds that rules exempt.
UNIT_LEAST, BATCH_LEAST, DOCUMENT_LEAST, KEPT_MOST = 0.50, 0.70, 0.80, 0.50
EXEMPT_KINDS = "title subtitle heading section-heading author affiliation metadata figure-or-caption table-or-caption table-note".split()
SOURCE_FORM_KINDS = "author-block affiliation publication-metadata doi-url reference bibliography".split()
SOURCE_FORM_ROLES = "author affiliation publication-metadata reference-entry".split()
KEEP_LIMITS = {
    "person-name": 80,
    "official-product-name": 80,
    "acronym": 24,
    "formula-or-statistical-symbol": 200,
    "doi-or-url": 200,
    "citation": 60,
    "required-original-term": 80,
}
REVIEW_MODES = ("none", "independent", "precise", "unknown")


def is_source_form(kind: Column, role: Column) -> Column:
    return kind.rlike("^(?:" + "|".join(SOURCE_FORM_KINDS) + ")") | F.coalesce(role.isin(SOURCE_FORM_ROLES), F.lit(False))


def keep_source_ok(code: Column, source: Column, kind: Column, role: Column, in_references: Column, kept_terms: Column) -> Column:
    """Whether a code may keep a unit in its source language: length limit and evidence by code."""
    limits = F.create_map(*[F.lit(x) for pair in KEEP_LIMITS.items() for x in pair])
    v = X.clean(source)
    short = F.char_length(v) <= F.coalesce(limits[code], F.lit(0))
    return F.coalesce(
        F.when(code == "bibliography-entry", kind.rlike("^(?:reference|bibliography)") | (role == "reference-entry") | in_references)
        .when(code == "publication-front-matter", kind.rlike("^(?:author-block|affiliation|publication-metadata|doi-url)") | role.isin("author", "affiliation", "publication-metadata"))
        .when(code.isin("person-name", "official-product-name"), short & X.is_proper_name(v))
        .when(code == "acronym", short & v.rlike(r"^[A-Z0-9][A-Z0-9\-/&.]{0,23}$"))
        .when(code == "formula-or-statistical-symbol", short & ~X.is_prose(v))
        .when(code == "doi-or-url", short & (X.clean(F.regexp_replace(F.regexp_replace(v, X.URL, " "), X.DOI, " ")).rlike(r"^(?i)(?:doi|[\s:;,.])*$")))
        .when(code == "citation", short & v.rlike(r"^(?:\[[\d\s,;–-]+\]|\([^()]*(?:19|20)\d{2}[a-z]?[^()]*\))$"))
        .when(code == "required-original-term", short & F.array_contains(kept_terms, v)),
        F.lit(False),
    )


def three_levels(rows: DataFrame, document: str, batch: str, target: Column, residual: Column, kept: Column, chars: Column) -> DataFrame:
    """Ratio of sums at batch and document level with the gate of each; null where there is nothing to divide.

    One grouping-sets pass over the rows: level is document or batch.
    """
    r = rows.select(F.col(document).alias("document"), F.col(batch).alias("batch"), target.alias("t"), residual.alias("x"), F.when(kept, chars).otherwise(0).alias("k"), chars.alias("c"))
    g = r.groupingSets([["document", "batch"], ["document"]], "document", "batch").agg(
        F.grouping("batch").alias("is_document"), F.sum("t").alias("t"), F.sum("x").alias("x"), F.sum("k").alias("k"), F.sum("c").alias("c"), F.count("*").alias("n_units")
    )
    ratio = F.when(F.col("t") + F.col("x") > 0, F.col("t") / (F.col("t") + F.col("x")))
    keep = F.when(F.col("c") > 0, F.col("k") / F.col("c")).otherwise(0.0)
    document_level = F.col("is_document") == 1
    least = F.when(document_level, DOCUMENT_LEAST).otherwise(BATCH_LEAST)
    ok = (F.coalesce(ratio, F.lit(1.0)) >= least) & (~document_level | (keep <= KEPT_MOST))
    return g.select(
        F.when(document_level, "document").otherwise("batch").alias("level"), "document", "batch", "n_units", ratio.alias("ratio"), keep.alias("kept_ratio"), ok.alias("passes")
    )


def compression_floors(source_lang: Column, target_lang: Column) -> tuple[Column, Column]:
    """Hard and review floor of target length over source length by language pair."""
    latin = source_lang.isin("en", "und-Latn")
    zh = latin & target_lang.startswith("zh")
    ja_ko = latin & target_lang.isin("ja", "ko")
    return F.when(zh, 0.20).when(ja_ko, 0.22).otherwise(0.45), F.when(zh, 0.25).when(ja_ko, 0.27).otherwise(0.60)


def compression_flag(kind: Column, source_chars: Column, ratio: Column, hard: Column, review: Column, kept: Column | None = None) -> Column:
    exempt = F.lower(kind).isin(EXEMPT_KINDS) | (source_chars < 30)
    if kept is not None:
        exempt = exempt | kept
    return (
        F.when(exempt, F.lit(None).cast("string"))
        .when(ratio < hard, "SEVERE_TRANSLATION_COMPRESSION")
        .when((source_chars >= 120) & (ratio < review), "POSSIBLE_SUMMARY_OR_OMISSION")
    )


def tally(locations: DataFrame, by: str, located: Column, required: Column) -> DataFrame:
    """source, located, required, missing required and coverage by type."""
    return locations.groupBy(by).agg(
        F.count("*").alias("source"),
        F.count_if(located).alias("located"),
        F.count_if(required).alias("required"),
        F.count_if(required & ~located).alias("missing_required"),
    ).withColumn("coverage", F.when(F.col("source") > 0, F.col("located") / F.col("source")))


def presence_ratio(rows: DataFrame, by: str, text: Column, present: Column) -> DataFrame:
    """Share of characters that are present."""
    n = F.char_length(text)
    return rows.groupBy(by).agg(F.sum(n).alias("chars"), F.sum(F.when(present, n).otherwise(0)).alias("present")).withColumn("ratio", F.when(F.col("chars") > 0, F.col("present") / F.col("chars")))


def against_median(rows: DataFrame, by: list[str], measure: Column, floor: float = 0.12, factor: float = 0.78) -> DataFrame:
    """Adds the group's exact median and whether a row is below max(floor, factor x median)."""
    m = rows.groupBy(*by).agg(F.median(measure).alias("median"))
    return rows.join(m, by).withColumn("low", measure < F.greatest(F.lit(floor), F.col("median") * factor))


def metric_summary(events: DataFrame, modes: DataFrame, mode: str, run: Column, passed: Column, seconds: Column) -> DataFrame:
    """A row for every mode, with or without events: runs, passes, rate and exact median (null if empty)."""
    g = events.groupBy(mode).agg(
        F.count("*").alias("n_events"),
        F.count_if(run).alias("runs"),
        F.count_if(run & passed).alias("passes"),
        F.median(F.when(run, seconds)).alias("median_seconds"),
    )
    out = modes.join(g, mode, "left").fillna(0, ["n_events", "runs", "passes"])
    return out.withColumn("pass_rate", F.when(F.col("runs") > 0, F.col("passes") / F.col("runs")))


def stage_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("seconds").alias("total"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def compare_runs(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Change in percent by case; null against nothing or zero."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return a.join(b, key, "full_outer").withColumn("percent", F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before") * 100))


def decision(flags: DataFrame, by: str, repair: list[str]) -> DataFrame:
    """NEEDS_REPAIR if any repair flag, REVIEW if any other, else READY. flags: by and `code` (null for none)."""
    return flags.groupBy(by).agg(
        F.when(F.bool_or(F.coalesce(F.col("code").isin(repair), F.lit(False))), "NEEDS_REPAIR").when(F.count("code") > 0, "REVIEW").otherwise("READY").alias("decision"),
        F.array_sort(F.collect_set("code")).alias("codes"),
    )


def repair_tasks(flags: DataFrame, by: list[str], action: Column, priority: Column) -> DataFrame:
    """One task for each page with flags: its highest priority and distinct actions."""
    return flags.groupBy(*by).agg(F.min(priority).alias("priority"), F.array_sort(F.collect_set(action)).alias("actions"), F.count("*").alias("n_flags"))
