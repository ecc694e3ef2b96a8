"""Page-level quality rules over one wide table of page metrics: all rules in one pass, findings by explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import geom as G

# Code, severity (H hard failure, R review) and predicate over the page metrics.
RULES = (
    ("REFERENCE_FONT_TOO_BOLD", "H", "chars >= 200 AND bold_share > 0.6"),
    ("VISIBLE_SOURCE_PAGE_MARKER", "H", "has_marker"),
    ("PAGE_SIZE_MISMATCH", "H", "NOT has_map AND size_delta > 0.1"),
    ("BLANK_PAGES", "H", "chars = 0 AND images = 0"),
    ("TARGET_TEXT_MISSING", "H", "target_chars < least_target_chars AND NOT whole_reference"),
    ("BODY_FONT_BELOW_MINIMUM", "H", "(body_size < least_body_size OR low_body_spans > 0) AND NOT is_reference AND NOT is_complex"),
    ("TABLE_FONT_BELOW_MINIMUM", "H", "low_table_chars >= 24 OR longest_low_table_span >= 12"),
    ("LEADING_BELOW_HARD_MINIMUM", "H", "leading < least_leading_exception AND NOT is_reference AND NOT is_table AND NOT is_complex"),
    ("LEADING_EXCEPTION_NOT_DOCUMENTED", "H", "leading >= least_leading_exception AND leading < least_leading AND NOT leading_documented AND NOT is_reference AND NOT is_table AND NOT is_complex"),
    ("LEADING_REQUIRES_VISUAL_CHECK", "R", "leading_samples = 0 AND chars >= 300"),
    ("PARAGRAPH_GAP_INFLATION", "H", "outlier_gaps >= 2 OR widest_gap >= 8"),
    ("SPARSE_PAGE_REQUIRES_JUSTIFICATION", "R", "sparse AND NOT has_retained AND NOT before_break"),
    ("BODY_WIDTH_COLLAPSE_VS_SOURCE", "H", "target_chars >= 120 AND width_retention < 0.72 AND width_loss >= 0.12"),
    ("ORPHAN_SINGLE_HAN_LINE", "H", "orphan_lines > 0 AND NOT is_reference AND NOT is_table"),
)


def findings(pages: DataFrame, keys: list[str], rules=RULES) -> DataFrame:
    """keys, code and severity of every rule that a page breaks; a metric that is null breaks none."""
    hit = F.array_compact(F.array(*[F.when(F.expr(p), F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"))) for c, s, p in rules]))
    return pages.select(*keys, F.explode(hit).alias("f")).select(*keys, "f.code", "f.severity")


def page_count(source: DataFrame, candidate: DataFrame, maps: DataFrame) -> DataFrame:
    """Documents whose page counts differ: mismatch without a page map, reflow with one."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count_distinct("page").alias(name))
    both = n(source, "source_pages").join(n(candidate, "candidate_pages"), "doc_id", "full_outer")
    mapped = maps.select("doc_id", F.lit(True).alias("mapped")).distinct()
    out = both.join(mapped, "doc_id", "left").where(~F.col("source_pages").eqNullSafe(F.col("candidate_pages")))
    return out.select("doc_id", F.when(F.col("mapped"), "PAGINATION_REFLOWED").otherwise("PAGE_COUNT_MISMATCH").alias("code"))


def body_font_consistency(spans: DataFrame, doc: str, page: str, size: str, chars: str) -> DataFrame:
    """Pages on which too few characters have the document's most common size: below max(24, 20 % of the page)."""
    weights = spans.groupBy(doc, size).agg(F.sum(chars).alias("w"))
    mode = weights.groupBy(doc).agg(F.max_by(size, F.struct("w", size)).alias("mode"))
    near = F.abs(F.col(size) - F.col("mode")) <= 0.25
    p = spans.join(mode, doc).groupBy(doc, page).agg(F.sum(F.when(near, F.col(chars)).otherwise(0)).alias("near"), F.sum(chars).alias("chars"))
    return p.where(F.col("near") < F.greatest(F.lit(24.0), 0.2 * F.col("chars")))


def unused_space(pages: DataFrame, source: DataFrame) -> DataFrame:
    """Bottom blank of a page minus the exact median of its mapped source pages. pages: doc_id, page, bottom_blank, source_pages."""
    mapped = pages.select("doc_id", "page", "bottom_blank", F.explode("source_pages").alias("source_page"))
    s = source.select("doc_id", F.col("page").alias("source_page"), F.col("bottom_blank").alias("source_blank"))
    out = mapped.join(s, ["doc_id", "source_page"]).groupBy("doc_id", "page").agg(F.first("bottom_blank").alias("bottom_blank"), F.median("source_blank").alias("source_blank"))
    return out.withColumn("excess", F.col("bottom_blank") - F.col("source_blank"))


def blank_ratios(blocks: DataFrame, keys: list[str], page_height: Column) -> DataFrame:
    """Blank share above the first and below the last block; the top counts as 0 on a page of fewer than 80 characters."""
    chars = F.sum(F.char_length("text"))
    return blocks.groupBy(*keys).agg(
        F.when(chars < 80, 0.0).otherwise(F.min(F.col("bbox.y0") / page_height)).alias("top_blank"),
        (1 - F.max(F.col("bbox.y1") / page_height)).alias("bottom_blank"),
    )


def line_width_ratio(lines: DataFrame, keys: list[str], page_width: Column) -> DataFrame:
    """Exact median width of lines of 12 characters or more."""
    return lines.where(F.char_length("text") >= 12).groupBy(*keys).agg(F.median(G.width(F.col("bbox")) / page_width).alias("line_width"))


def residual_prose(texts: DataFrame, keys: list[str], text: Column, allowed: Column) -> DataFrame:
    """Runs of Latin prose of 18 characters or more that are neither names nor in the allowed text."""
    from leafmill.functions import text as X

    bare = F.regexp_replace(F.regexp_replace(X.text(text), X.URL, " "), X.DOI, " ")
    runs = F.explode(F.regexp_extract_all(bare, F.lit(r"[A-Za-z][A-Za-z ,;'’-]{17,}"), F.lit(0)))
    r = texts.select(*keys, allowed.alias("_allowed"), F.trim(runs).alias("run"))
    return r.where(~X.is_proper_name(F.col("run")) & ~F.contains(F.lower("_allowed"), F.lower("run"))).drop("_allowed")


def layout_justification(width_retention: Column, bottom_excess: Column, left_blank: Column, right_blank: Column, leading: Column, least_leading: Column) -> Column:
    """Codes of layouts that need a reason."""
    return F.array_compact(
        F.array(
            F.when(width_retention < 0.72, F.lit("WIDTH_COLLAPSE")),
            F.when(F.abs(left_blank - right_blank) > 0.25, F.lit("UNBALANCED_WHITESPACE")),
            F.when(bottom_excess > 0.25, F.lit("UNUSED_SPACE")),
            F.when((leading < least_leading) & (bottom_excess > 0.25), F.lit("COMPRESSED_WITH_UNUSED_SPACE")),
        )
    )
