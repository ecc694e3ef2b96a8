"""Audit of translated units: a verdict for each, ratios of batches and documents, coverage, and flags of pages.

Units are rows: doc_id, batch, unit_id, page, ord, kind, role, source, translation, keep_code, keep_reason, in_references, kept_terms, cross_language.
Null texts count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import arrow as A
from leafmill.functions import text as X
from leafmill.operators import gates

# Limits of the page rules.
PAGE_CHARS, SENTENCES, SENTENCE_RETENTION = 800, 8, 0.62
LOSSES = (("STATISTICAL_ANCHOR_LOSS", "statistics", 6, 0.25), ("CITATION_ANCHOR_LOSS", "citations", 8, 0.35), ("TERM_OR_ACRONYM_LOSS", "acronyms", 5, 0.5))
UNIT_STATISTICS, UNIT_CHARS = 4, 30
SOURCE_SENTENCE, TARGET_SENTENCE = r"(?U)(?<=[.!?])(?:[\"')\]]+)?\s+", "[。！？!?]+"
REFERENCE_SHARE = 0.9
REPAIR = ("SEVERE_TRANSLATION_COMPRESSION", "STATISTICAL_ANCHOR_LOSS", "COMPLEX_VISUAL_REBUILD_NOT_PRESENT")


def verdicts(units: DataFrame, system: str, same: Column | None = None) -> DataFrame:
    """Adds state (translated, kept-source, invalid), `problems` (at most one code), `chars` of the source, and, of translations that should be in the
    target language, `target` and `residual` characters. `same` tells whether source and translation agree; by default by `comparison_text`.
    """
    source, said = F.trim(X.text(F.col("source"))), F.trim(X.text(F.col("translation")))
    code, reason = F.trim(X.text(F.col("keep_code"))), F.trim(X.text(F.col("keep_reason")))
    keeps = (code != "") | (reason != "")
    kind = F.lower(X.text(F.col("kind")))
    form = gates.is_source_form(kind, F.col("role"))
    cross = F.coalesce("cross_language", F.lit(True))
    if same is None:
        units = units.withColumn("_same", A.comparison_text("source") == A.comparison_text("translation"))
        same = F.col("_same")
    target, residual = X.target_chars(said, system), X.residual_letters(said)
    language = F.when(~cross | ~X.has_letters(source), F.lit(None)).when(same, "TRANSLATION_EQUALS_SOURCE")
    if system != "latin":  # letters cannot tell two languages in Latin script apart
        language = (
            language.when(~X.is_prose(source) | form, F.lit(None))
            .when(target == 0, "TARGET_LANGUAGE_ABSENT")
            .when(target / (target + residual) < gates.UNIT_LEAST, "TARGET_LANGUAGE_RATIO_LOW")
        )
    allowed = gates.keep_source_ok(code, source, kind, F.col("role"), F.coalesce("in_references", F.lit(False)), F.col("kept_terms"))
    problem = (
        F.when((said != "") & keeps, "TRANSLATION_AND_KEEP_SOURCE_CONFLICT")
        .when(said != "", language)
        .when(code != "", F.when(~allowed, "KEEP_SOURCE_CODE_NOT_ALLOWED_FOR_UNIT"))
        .when(reason != "", "KEEP_SOURCE_CODE_MISSING")
        .otherwise("UNIT_NOT_TRANSLATED")
    )
    out = units.withColumn("problem", problem.cast("string"))
    out = out.withColumn("state", F.when(F.col("problem").isNotNull(), "invalid").when(said != "", "translated").otherwise("kept-source"))
    counts = (F.col("state") == "translated") & ~form & cross & F.lit(system != "latin")
    out = out.withColumns({"chars": X.content_length(source), "target": F.when(counts, target), "residual": F.when(counts, residual)})
    return out.withColumn("problems", F.array_compact(F.array("problem"))).drop("problem", "_same")


def evaluation(judged: DataFrame) -> DataFrame:
    """level (batch or document), doc_id, batch, n_units, translated, kept, invalid, ratio, kept_ratio, problems: one grouping-sets pass over the verdicts.

    A ratio is of sums, and null where nothing counts. Only documents have a limit of what is kept. Units without a batch count for the document alone.
    """
    g = judged.select("doc_id", "batch", "state", "chars", "target", "residual")
    g = g.groupingSets([["doc_id", "batch"], ["doc_id"]], "doc_id", "batch").agg(
        F.grouping("batch").alias("top"),
        F.count("*").alias("n_units"),
        *[F.count_if(F.col("state") == s).alias(n) for s, n in (("translated", "translated"), ("kept-source", "kept"), ("invalid", "invalid"))],
        F.coalesce(F.sum("target"), F.lit(0)).alias("t"),
        F.coalesce(F.sum("residual"), F.lit(0)).alias("x"),
        F.sum("chars").alias("chars"),
        F.coalesce(F.sum(F.when(F.col("state") == "kept-source", F.col("chars"))), F.lit(0)).alias("k"),
    )
    top = F.col("top") == 1
    ratio = F.when(F.col("t") + F.col("x") > 0, F.col("t") / (F.col("t") + F.col("x")))
    kept = F.when(F.col("chars") > 0, F.col("k") / F.col("chars")).otherwise(0.0)
    problems = F.array_compact(
        F.array(
            F.when(top & (ratio < gates.DOCUMENT_LEAST), F.lit("DOCUMENT_TARGET_LANGUAGE_RATIO_LOW")),
            F.when(~top & (ratio < gates.BATCH_LEAST), F.lit("BATCH_TARGET_LANGUAGE_RATIO_LOW")),
            F.when(top & (kept > gates.KEPT_MOST), F.lit("DOCUMENT_KEEP_SOURCE_RATIO_HIGH")),
        )
    )
    level = F.when(top, "document").otherwise("batch").alias("level")
    return g.where(top | F.col("batch").isNotNull()).select(level, "doc_id", "batch", "n_units", "translated", "kept", "invalid", ratio.alias("ratio"), kept.alias("kept_ratio"), problems.alias("problems"))


def coverage(judged: DataFrame) -> DataFrame:
    """Each document's counts of claimed and of validated units, its ratios, every problem code of its units, batches and itself, whether it is complete,
    and note: complete, invalid, or pending. A document is complete if it has units, none is invalid, and neither its batches nor itself have a problem."""
    said = F.trim(X.text(F.col("translation"))) != ""
    keeps = (F.trim(X.text(F.col("keep_code"))) != "") | (F.trim(X.text(F.col("keep_reason"))) != "")
    claimed = judged.groupBy("doc_id").agg(
        F.count("*").alias("units"),
        F.count_if(said).alias("claimed_translated"),
        F.count_if(~said & keeps).alias("claimed_kept"),
        F.collect_set(F.get("problems", F.lit(0))).alias("_unit_codes"),
    )
    levels = evaluation(judged)
    doc = levels.where("level = 'document'").select("doc_id", "translated", "kept", "invalid", "ratio", "kept_ratio")
    codes = levels.select("doc_id", F.explode("problems").alias("code")).groupBy("doc_id").agg(F.collect_set("code").alias("_level_codes"))
    out = claimed.join(doc, "doc_id").join(codes, "doc_id", "left")
    levels_ok = F.col("_level_codes").isNull()
    all_codes = F.array_sort(F.array_distinct(F.concat("_unit_codes", F.coalesce("_level_codes", F.array().cast("array<string>")))))
    complete = (F.col("units") > 0) & (F.col("invalid") == 0) & levels_ok
    note = F.when(complete, "complete").when((F.col("invalid") > 0) | ~levels_ok, "invalid").otherwise("pending")
    return out.withColumns({"problem_codes": all_codes, "complete": complete, "note": note}).drop("_unit_codes", "_level_codes")


def is_reference(kind: Column, translation: Column, keep_code: Column) -> Column:
    """By kind, or by a structured code without a translation; free text never counts."""
    by_code = (F.trim(X.text(translation)) == "") & (F.trim(X.text(keep_code)) == "bibliography-entry")
    return F.lower(X.text(kind)).rlike("^(?:reference|bibliography)") | by_code


def reference_pages(units: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """doc_id, page of pages on which references are 90 % of the units' characters, and of `covered` pages (filled by a retained reference region)."""
    n = X.content_length(F.col("source"))
    entry = is_reference(F.col("kind"), F.col("translation"), F.col("keep_code"))
    g = units.groupBy("doc_id", "page").agg(F.sum(n).alias("n"), F.sum(F.when(entry, n).otherwise(0)).alias("k"))
    out = g.where((F.col("n") > 0) & (F.col("k") / F.col("n") >= REFERENCE_SHARE)).select("doc_id", "page")
    return out if covered is None else out.union(covered.select("doc_id", "page")).distinct()


def _lost(want: Column, have: Column) -> Column:
    return F.array_sort(F.array_except(want, have))


def _neighbours(pages: DataFrame, value: Column, name: str) -> DataFrame:
    """doc_id, page, name: the non-empty values of the pages before and after, in that order."""
    v = pages.select("doc_id", "page", value.alias("v")).where("v <> ''")
    near = v.select("doc_id", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)).alias("page"), F.col("page").alias("of"), "v")
    g = near.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("of", "v"))).alias("parts"))
    return g.select("doc_id", "page", F.array_join(F.transform("parts", lambda p: p["v"]), "\n").alias(name))


def _missing_statistics(rows: DataFrame, source: Column, target: Column, adjacent: Column) -> DataFrame:
    """Adds `_have`, the statistics of the source, `_gone`, those that neither the target has, nor a conversion gives, nor adjacent pages have if these have two or more, and `_moved`, the latter.

    Each step is a column of its own, so a text is searched once; that of the adjacent pages only where two statistics or more are gone.
    """
    none = F.array().cast("array<string>")
    both = F.concat_ws("\n", F.nullif(target, F.lit("")), F.nullif(adjacent, F.lit("")))
    rows = rows.withColumn("_have", X.statistics(source)).withColumn("_gone", F.array_except("_have", X.statistics(target)))
    rows = rows.withColumn("_gone", F.when(F.size("_gone") > 0, F.array_except("_gone", X.converted_statistics(source, both))).otherwise(F.col("_gone")))
    rows = rows.withColumn("_moved", F.when(F.size("_gone") >= 2, F.array_intersect("_gone", X.statistics(adjacent))))
    rows = rows.withColumn("_moved", F.when(F.size("_moved") >= 2, F.col("_moved")).otherwise(none))
    return rows.withColumn("_gone", F.array_sort(F.array_except("_gone", "_moved"))).withColumn("_moved", F.array_sort("_moved"))


def page_audit(units: DataFrame, source_lang: Column, target_lang: Column, kept: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """doc_id, page, reference_page, lengths, ratio, sentences, missing anchors, flags and unit flags of every page with units.

    kept: doc_id, unit_id of validated kept sources, which no compression rule judges. references: doc_id, page (`reference_pages`). Texts of a page are
    its units other than references in order; of its neighbours only the translations are read. One shuffle by (doc_id, page) and one of each page to
    its two neighbours.
    """
    u = units.select("doc_id", "page", "ord", "unit_id", "kind", X.text(F.col("source")).alias("source"), X.text(F.col("translation")).alias("said"), is_reference(F.col("kind"), F.col("translation"), F.col("keep_code")).alias("entry"), source_lang.alias("from_lang"), target_lang.alias("to_lang"))
    said = F.when(F.trim("said") != "", F.col("said"))
    rows = lambda value, when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("ord", "unit_id", value.alias("v"))))), lambda r: r["v"]), "\n")
    pages = u.groupBy("doc_id", "page").agg(
        rows(F.col("source"), ~F.col("entry")).alias("source"),
        rows(said, ~F.col("entry") & said.isNotNull()).alias("target"),
        rows(said, said.isNotNull()).alias("all_target"),
        F.min("from_lang").alias("from_lang"),
        F.min("to_lang").alias("to_lang"),
    )
    near = _neighbours(pages, F.col("all_target"), "adjacent")
    pages = pages.join(near, ["doc_id", "page"], "left").withColumn("adjacent", X.text(F.col("adjacent")))
    marks = (references if references is not None else reference_pages(units)).select("doc_id", "page", F.lit(True).alias("reference_page")).distinct()
    pages = pages.join(marks, ["doc_id", "page"], "left").withColumn("reference_page", F.coalesce("reference_page", F.lit(False)))

    s, t = F.col("source"), F.col("target")
    hard, review = gates.compression_floors(F.col("from_lang"), F.col("to_lang"))
    pages = _missing_statistics(pages, s, t, F.col("adjacent"))
    ratio = F.when(F.col("source_chars") > 0, F.round(F.col("translation_chars") / F.col("source_chars"), 3))
    retained = F.when(F.col("source_sentences") > 0, F.round(F.col("translation_sentences") / F.col("source_sentences"), 3))
    pages = pages.withColumns(
        {
            "source_chars": X.content_length(s),
            "translation_chars": X.content_length(t),
            "source_sentences": X.sentence_count(s, SOURCE_SENTENCE),
            "translation_sentences": X.sentence_count(t, TARGET_SENTENCE),
            "missing_statistics": F.col("_gone"),
            "relocated_statistics": F.col("_moved"),
            "missing_citations": _lost(X.citations(s), X.citations(t)),
            "missing_acronyms": _lost(X.acronyms(s), X.present_acronyms(t)),
            "missing_urls": _lost(X.urls(s), X.urls(t)),
            "missing_dois": _lost(X.dois(s), X.dois(t)),
            "hard": hard,
            "review": review,
        }
    ).withColumns({"ratio": ratio, "sentence_retention": retained})
    n_of = {"statistics": F.size("_have"), "citations": F.size(X.citations(s)), "acronyms": F.size(X.acronyms(s))}
    long_ = F.col("source_chars") >= PAGE_CHARS
    rules = [
        ("SEVERE_TRANSLATION_COMPRESSION", long_ & (F.col("ratio") < F.col("hard"))),
        ("POSSIBLE_SUMMARY_OR_OMISSION", long_ & (F.col("ratio") >= F.col("hard")) & (F.col("ratio") < F.col("review"))),
        ("LOW_SENTENCE_RETENTION", (F.col("source_sentences") >= SENTENCES) & (F.col("sentence_retention") < SENTENCE_RETENTION) & (F.col("ratio") < F.col("review") + 0.04)),
        *[(code, (n_of[what] >= least) & (F.size(f"missing_{what}") / n_of[what] >= share)) for code, what, least, share in LOSSES],
        ("URL_LOSS", F.size("missing_urls") > 0),
        ("DOI_LOSS", F.size("missing_dois") > 0),
    ]
    flags = [F.when(~F.col("reference_page") & hit, F.lit(code)) for code, hit in rules] + [F.when(F.size("relocated_statistics") > 0, F.lit("ADJACENT_PAGE_ANCHOR_SHIFT"))]
    pages = pages.withColumn("page_flags", F.array_compact(F.array(*flags)))

    own = _unit_flags(u.where(~F.col("entry")).join(near, ["doc_id", "page"], "left"), kept)
    by_page = own.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.when(F.size("flags") > 0, F.struct("unit_id", "flags")))).alias("unit_issues"))
    issues = "array<" + dict(by_page.dtypes)["unit_issues"].removeprefix("array<")
    pages = pages.join(by_page, ["doc_id", "page"], "left").withColumn("unit_issues", F.coalesce("unit_issues", F.array().cast(issues)))
    every = F.array_sort(F.array_distinct(F.concat("page_flags", F.flatten(F.transform("unit_issues", lambda x: x["flags"])))))
    return pages.withColumn("flags", every).drop("source", "target", "all_target", "adjacent", "from_lang", "to_lang", "hard", "review", "page_flags", "_have", "_gone", "_moved")


def unit_flags(units: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """doc_id, page, unit_id, flags of units of 30 characters or more that are too short or lose a quarter of four or more statistics."""
    return _unit_flags(units, kept).where(F.size("flags") > 0)


def _unit_flags(units: DataFrame, kept: DataFrame | None) -> DataFrame:
    """The same with units that have no flag: a condition on flags would be pushed down and work them out twice."""
    if kept is not None:
        units = units.join(kept.select("doc_id", "unit_id", F.lit(True).alias("_kept")).distinct(), ["doc_id", "unit_id"], "left")
    else:
        units = units.withColumn("_kept", F.lit(None).cast("boolean"))
    s, t = F.col("source"), F.col("said")
    hard, review = gates.compression_floors(F.col("from_lang"), F.col("to_lang"))
    n = X.content_length(s)
    short = gates.compression_flag(X.text(F.col("kind")), n, F.round(X.content_length(t) / n, 3), hard, review, F.coalesce("_kept", F.lit(False)))
    units = _missing_statistics(units.where(n >= UNIT_CHARS), s, t, X.text(F.col("adjacent")))
    have = F.size("_have")
    lost = F.when((have >= UNIT_STATISTICS) & (F.size("_gone") / have >= 0.25), F.lit("STATISTICAL_ANCHOR_LOSS"))
    flags = F.array_sort(F.array_compact(F.array(short, lost)))
    return units.select("doc_id", "page", "unit_id", flags.alias("flags"))


def page_anchors(c: Column) -> Column:
    """Citations, statistics and acronyms of a text, each marked by its kind."""
    mark = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind + ":"), x))
    return F.concat(mark("citation", X.citations(c)), mark("stat", X.statistics(c)), mark("acronym", X.acronyms(c)))


def mapping_drift(pages: DataFrame) -> DataFrame:
    """doc_id, page, score, neighbour, neighbour_score of pages whose anchors a neighbour's translation holds better: three more, and at least five and half as many again.

    pages: doc_id, page, anchors, target_anchors (arrays). Of equal neighbours the one before counts.
    """
    out = pages.select("doc_id", "page", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("at"), "anchors")
    other = pages.select("doc_id", F.col("page").alias("at"), "target_anchors")
    scored = out.join(other, ["doc_id", "at"]).select("doc_id", "page", "at", F.size(F.array_intersect("anchors", "target_anchors")).alias("n"))
    here = F.col("at") == F.col("page")
    best = F.max(F.when(~here, F.struct("n", (-F.col("at")).alias("o"))))
    g = scored.groupBy("doc_id", "page").agg(F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0)).alias("score"), best.alias("b"))
    g = g.select("doc_id", "page", "score", (-F.col("b.o")).alias("neighbour"), F.col("b.n").alias("neighbour_score"))
    return g.where((F.col("neighbour_score") >= F.col("score") + 3) & (F.col("neighbour_score") >= F.greatest(F.lit(5.0), F.col("score") * 1.5)))


def visual_rebuild_problem(method: Column, source_drawings: Column, drawings: Column, images: Column, not_applicable: Column) -> Column:
    """Whether the candidate lacks what a method of rebuilding must leave behind."""
    least = F.greatest(F.lit(4), F.least(F.lit(12), F.bround(source_drawings * 0.1).cast("int")))
    bare = images == 0
    return ~F.coalesce(not_applicable, F.lit(False)) & F.coalesce(
        F.when(method == "vector-rebuild", bare & (drawings < least))
        .when(method.isin("structured-table-rebuild", "semantic-grid-rebuild"), bare & (drawings < 3))
        .when(method == "image-text-localization", bare & (drawings < 4)),
        F.lit(False),
    )


def audit_status(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, n_flagged, n_repair, median_ratio (exact, of pages of 600 characters that are no references) of audited pages."""
    repair = reduce(lambda a, b: a | b, [F.array_contains("flags", c) for c in REPAIR])
    counted = F.when(~F.col("reference_page") & (F.col("source_chars") >= 600) & (F.col("ratio") > 0), F.col("ratio"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.size("flags") > 0).alias("n_flagged"), F.count_if(repair).alias("n_repair"), F.median(counted).alias("median_ratio"))
