"""Typed page elements: classification, ids, roles, relations, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import geom as G
from leafmill.functions import text as X

# Element types, their roles, and what may not be lost.
ROLES = {
    "document-title": "document-title",
    "author-block": "author",
    "affiliation": "affiliation",
    "publication-metadata": "publication-metadata",
    "heading": "heading",
    "body": "body",
    "table-note": "table-note",
    "footnote": "footnote",
    "reference-entry": "reference-entry",
    "reference-heading": "heading",
    "header": "page-furniture",
    "footer": "page-furniture",
    "page-number": "page-furniture",
    "watermark": "page-furniture",
    "display-formula": "formula-label",
    "table": "table-cell",
    "vector-figure": "figure-label",
    "raster-figure": "figure-label",
    "chart": "figure-label",
    "screenshot": "figure-label",
}
FURNITURE = ("header", "footer", "page-number", "watermark")
OPTIONAL = (*FURNITURE, "publication-metadata", "inline-formula", "unknown")
VISUAL = ("table", "raster-figure", "vector-figure", "chart", "screenshot")
REFERENCE_HEADINGS = ("references", "bibliography", "参考文献")


def furniture(box: Column, text: Column, page_width: Column, page_height: Column, flagged: Column) -> Column:
    """page-number, header, footer, or null."""
    top, bottom = box["y0"] / page_height, box["y1"] / page_height
    number = F.trim(text).rlike(r"^\s*[-–—\[(]?\s*\d{1,4}\s*[-–—\])]?\s*$")
    narrow = G.width(box) <= 0.12 * page_width
    return F.when(box.isNull() | (F.trim(X.text(text)) == ""), F.lit(None).cast("string")).otherwise(
        F.when(number & narrow & ((top <= 0.15) | (bottom >= 0.85)), "page-number").when(flagged & (top <= 0.08), "header").when(flagged & (bottom >= 0.92), "footer")
    )


def text_role(text: Column, title_zone: Column, first_block: Column, in_visual: Column, likely_heading: Column, bold: Column) -> Column:
    """type and confidence by the first rule that holds. title_zone: in the upper part of the first page; first_block: its first text."""

    def said(kind: str, confidence) -> Column:
        c = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(kind).alias("type"), c.cast("double").alias("confidence"))

    heading = F.least(F.lit(0.97), 0.75 + F.when(bold, 0.1).otherwise(0.0) + F.when(X.clean(text).rlike(X.NUMBERED_HEADING), 0.1).otherwise(0.0))
    return (
        F.when(X.clean(text) == "", said("unknown", 0.3))
        .when(in_visual, said("unknown", 0.9))
        .when(X.is_stamp(text), said("publication-metadata", 0.9))
        .when(title_zone & X.is_affiliation(text), said("affiliation", 0.85))
        .when(title_zone & X.is_author(text), said("author-block", 0.8))
        .when(title_zone & first_block & ~X.is_heading(text), said("document-title", 0.85))
        .when(X.is_heading(text), said("heading", F.bround(heading, 4)))
        .when(likely_heading, said("body", 0.6))
        .otherwise(said("body", 0.9))
    )


def is_likely_heading(max_size: Column, body_size: Column, bold: Column) -> Column:
    return bold | (max_size >= F.greatest(body_size * 1.12, body_size + 0.8))


def is_heading_line(size: Column, body_size: Column, font: Column, body_font: Column) -> Column:
    return (font != body_font) | (F.abs(size - body_size) >= 0.35)


def element_ids(elements: DataFrame, order: list[str]) -> DataFrame:
    """pNNNN-type-NNN, counted by page and type."""
    n = F.row_number().over(Window.partitionBy("doc_id", "page", "type").orderBy(*order))
    return elements.withColumn("element_id", F.format_string("p%04d-%s-%03d", "page", "type", n))


def unit_ids(units: DataFrame, order: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(*order))
    return units.withColumn("unit_id", F.format_string("p%04d-u%04d", "page", n))


def role_of(kind: Column, caption_kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.when(kind == "caption", F.when(caption_kind == "table", "table-title").otherwise("figure-caption")).otherwise(F.coalesce(table[kind], F.lit("unknown")))


def is_required(kind: Column) -> Column:
    return ~kind.isin(list(OPTIONAL))


def type_counts(elements: DataFrame, by: str = "type") -> DataFrame:
    return elements.groupBy(by).agg(F.count("*").alias("n"))


def high_risk_pages(elements: DataFrame) -> DataFrame:
    risky = (F.size("risks") > 0) | F.col("type").isin(*VISUAL, "display-formula", "footnote")
    return elements.where(risky).select("doc_id", "page").distinct()


def low_confidence(elements: DataFrame, floor: float = 0.6) -> DataFrame:
    return elements.where(F.col("confidence") < floor)


def title_candidate(blocks: DataFrame, order: list[Column], zone: Column) -> DataFrame:
    """The topmost block of each first page, then rejected if it lies outside the title zone."""
    top = blocks.where("page = 1").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    return top.where("_n = 1").where(zone).drop("_n")


def carry_forward(rows: DataFrame, by: list[str], order: list, value: Column, name: str) -> DataFrame:
    """The last non-null value at or before each row: section headings, last known states."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def reference_state(elements: DataFrame, order: list) -> DataFrame:
    """Body and metadata after a reference heading are entries, across pages."""
    starts = (F.col("type") == "heading") & F.lower(X.clean(F.col("text"))).isin(list(REFERENCE_HEADINGS))
    w = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.when(starts, 1).otherwise(0)).over(w) == 1
    kind = F.when(starts, "reference-heading").when(seen & F.col("type").isin("body", "publication-metadata"), "reference-entry").otherwise(F.col("type"))
    return elements.withColumn("type", kind)


def context(rows: DataFrame, by: list[str], order: list, text: str, n: int = 2, chars: int = 320) -> DataFrame:
    """The ends of the n texts before and the beginnings of the n after."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = [F.right(F.lag(text, k).over(w), F.lit(chars)) for k in range(n, 0, -1)]
    after = [F.left(F.lead(text, k).over(w), F.lit(chars)) for k in range(1, n + 1)]
    return rows.withColumn("before", F.concat_ws("\n", *before)).withColumn("after", F.concat_ws("\n", *after))


def breaks_before(rows: DataFrame, by: list[str], order: list, kind: Column, text: Column, page: Column) -> DataFrame:
    """Whether a batch may begin here: never right after a heading, after a caption only at a heading, not within a sentence across pages."""
    w = Window.partitionBy(*by).orderBy(*order)
    last_kind, last_text, last_page = F.lag(kind).over(w), F.lag(text).over(w), F.lag(page).over(w)
    open_ = (last_page != page) & ~last_text.rlike(X.SENTENCE_END)
    legal = F.when(last_kind.isNull(), True).when(last_kind == "heading", False).when((last_kind == "caption") & (kind != "heading"), False).otherwise(~F.coalesce(open_, F.lit(False)))
    return rows.withColumn("may_break", legal)


def outline(units: DataFrame) -> DataFrame:
    """Title (a heading if there is one, else the first unit) and abstract excerpt of each document."""
    head = F.min_by("source", F.struct((F.col("kind") != "heading").alias("h"), "ord"))
    body = F.array_sort(F.collect_list(F.when(F.col("kind") == "abstract", F.struct("ord", "source"))))
    return units.groupBy("doc_id").agg(head.alias("title"), F.left(F.array_join(F.transform(body, lambda x: x["source"]), "\n"), F.lit(900)).alias("abstract"))


def texts_of_elements(bindings: DataFrame, units: DataFrame) -> DataFrame:
    """Each element's text: translations, else sources, of its units in order."""
    rows = bindings.join(units, ["doc_id", "unit_id"]).groupBy("doc_id", "element_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", F.coalesce(F.nullif(F.trim("translation"), F.lit("")), F.col("source")).alias("t")))).alias("parts")
    )
    return rows.select("doc_id", "element_id", F.array_join(F.transform("parts", lambda p: p["t"]), " ").alias("text"))
