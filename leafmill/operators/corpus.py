"""Corpus-level profiles, duplicates and repeated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import keys
from leafmill.functions import text as X


def corpus_summary(docs: DataFrame, by: str, size: str) -> DataFrame:
    """Documents, distinct contents and total size by group."""
    return docs.groupBy(by).agg(F.count("*").alias("n_docs"), F.count_distinct("sha256").alias("n_distinct"), F.sum(size).alias("total"))


def mark_duplicates(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, sha256, duplicate_of: the least id with the same content, null for that one.

    A grouped minimum joined back, not a window: a content with very many copies is summed before the shuffle and its
    rows can be split.
    """
    hashed = docs.select(id_col, keys.text_hash(F.col(text_col)).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min(id_col).alias("first_id"))
    out = hashed.join(first, "sha256")
    return out.select(id_col, "sha256", F.when(F.col("first_id") < F.col(id_col), F.col("first_id")).alias("duplicate_of"))


def route(docs: DataFrame, by: str, scan: Column, complex_: Column, form: Column, size: Column) -> DataFrame:
    """The processing route of each group from its share of scanned and complex pages and the number of page sizes."""
    g = docs.groupBy(by).agg(
        F.count("*").alias("n_pages"),
        F.count_if(scan).alias("n_scan"),
        F.count_if(complex_).alias("n_complex"),
        F.count_if(form).alias("n_form"),
        F.count_distinct(size).alias("n_sizes"),
    )
    r = (
        F.when(F.col("n_scan") >= 0.25 * F.col("n_pages"), "scan-custom")
        .when((F.col("n_form") > 0) | (F.col("n_complex") >= 0.4 * F.col("n_pages")), "custom-layout")
        .when((F.col("n_complex") > 0) | (F.col("n_sizes") > 1), "hybrid-complex-pages")
        .otherwise("standard-auto")
    )
    return g.withColumn("route", r)


def is_complex_page(scan_risk: Column, form_risk: Column, images: Column, drawings: Column, blocks: Column) -> Column:
    return scan_risk | form_risk | (images >= 4) | (drawings >= 120) | (blocks >= 45)


def repeated_keys(lines: DataFrame, by: str, page: str, key: Column, least: int = 2, share: float = 0.35) -> DataFrame:
    """Keys (8 characters or more) on at least max(least, ceil(share * pages)) pages of a group."""
    k = lines.select(by, page, key.alias("key"))
    total = k.groupBy(by).agg(F.count_distinct(page).alias("n_pages"))
    hits = k.where(F.char_length("key") >= 8).groupBy(by, "key").agg(F.count_distinct(page).alias("n_hits"))
    return hits.join(total, by).where(F.col("n_hits") >= F.greatest(F.lit(least), F.ceil(F.col("n_pages") * share))).select(by, "key", "n_hits")


def running_values(values: DataFrame, by: str, page: str, value: str, least: int = 4, share: float = 0.6) -> DataFrame:
    """Values on at least max(least, ceil(share * pages)) pages."""
    total = values.groupBy(by).agg(F.count_distinct(page).alias("n_pages"))
    hits = values.groupBy(by, value).agg(F.count_distinct(page).alias("n_hits"))
    return hits.join(total, by).where(F.col("n_hits") >= F.greatest(F.lit(least), F.ceil(F.col("n_pages") * share))).select(by, value, "n_hits")


def weighted_mode(df: DataFrame, by: str, value: str, weight: Column, tie: Column | None = None) -> DataFrame:
    """The value of greatest total weight; ties by `tie` (greatest), else the least value."""
    sums = df.groupBy(by, value).agg(F.sum(weight).alias("weight"), *([F.max(tie).alias("tie")] if tie is not None else []))
    if tie is not None:
        return sums.groupBy(by).agg(F.max_by(value, F.struct("weight", "tie")).alias(value), F.max("weight").alias("weight"))
    return sums.groupBy(by).agg(F.min_by(value, F.struct((-F.col("weight")).alias("w"), F.col(value))).alias(value), F.max("weight").alias("weight"))


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Lower-case words and counts, URLs and words broken at a line end left out."""
    v = F.regexp_replace(F.regexp_replace(X.text(F.col(text_col)), X.URL, " "), r"[\p{L}]+-\s*\n\s*[\p{L}]+", " ")
    words = F.explode(F.regexp_extract_all(F.lower(v), F.lit(r"\p{L}[\p{L}'-]*"), F.lit(0)))
    return docs.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def hyphen_decisions(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """left, right of a broken word: join if the vocabulary has the joined word, keep if the hyphenated one, else uncertain if the left part stands alone."""
    v = words.select("word").distinct()
    out = pairs.withColumn("joined", F.lower(F.concat("left", "right"))).withColumn("hyphenated", F.lower(F.concat_ws("-", "left", "right"))).withColumn("alone", F.lower("left"))
    for name in ("joined", "hyphenated", "alone"):
        out = out.join(v.select(F.col("word").alias(f"_{name}")), F.col(name) == F.col(f"_{name}"), "left")
    decision = F.when(F.col("_joined").isNotNull(), "join").when(F.col("_hyphenated").isNotNull(), "keep").when(F.col("_alone").isNotNull(), "uncertain").otherwise("join")
    return out.select(*pairs.columns, decision.alias("decision"))


def column_signal(blocks: DataFrame, by: list[str], middle: Column, least: int = 240) -> DataFrame:
    """Whether a page has two columns: enough text on either side, each at least 20 % of it, and wide blocks not above 50 %."""
    n = F.char_length(X.clean(F.col("text")))
    left = F.sum(F.when(F.col("bbox.x1") <= middle, n).otherwise(0))
    right = F.sum(F.when(F.col("bbox.x0") >= middle, n).otherwise(0))
    out = blocks.groupBy(*by).agg(left.alias("left_chars"), right.alias("right_chars"), F.sum(n).alias("chars"))
    wide = F.col("chars") - F.col("left_chars") - F.col("right_chars")
    two = (
        (F.col("left_chars") + F.col("right_chars") >= least)
        & (F.col("left_chars") >= 0.2 * F.col("chars"))
        & (F.col("right_chars") >= 0.2 * F.col("chars"))
        & (wide <= 0.5 * F.col("chars"))
    )
    return out.withColumn("wide_chars", wide).withColumn("two_columns", two)


def profile_two_columns(blocks: DataFrame, by: list[str], middle: Column, least: int = 200, share: float = 0.45) -> DataFrame:
    """The profile's own rule, by block centres."""
    n = F.char_length(X.clean(F.col("text")))
    x = (F.col("bbox.x0") + F.col("bbox.x1")) / 2
    out = blocks.groupBy(*by).agg(F.sum(F.when(x < middle, n).otherwise(0)).alias("left_chars"), F.sum(F.when(x >= middle, n).otherwise(0)).alias("right_chars"))
    lesser = F.least("left_chars", "right_chars")
    return out.withColumn("two_columns", (lesser >= least) & (lesser >= share * F.greatest("left_chars", "right_chars")))


def grid_estimate(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Rows: lines; columns: most parts at two or more spaces."""
    lines = F.filter(F.split(X.text(F.col("text")), "\n"), lambda x: F.trim(x) != "")
    parts = F.array_max(F.transform(lines, lambda x: F.size(F.split(F.trim(x), r"\s{2,}"))))
    return blocks.groupBy(*by).agg(F.sum(F.size(lines)).alias("rows"), F.coalesce(F.max(parts), F.lit(0)).alias("columns"))


def font_summary(spans: DataFrame, by: list[str]) -> DataFrame:
    """Median and largest size, whether any span is bold, the distinct font names."""
    return spans.groupBy(*by).agg(
        F.median("size").alias("median_size"),
        F.max("size").alias("max_size"),
        F.bool_or("bold").alias("bold_signal"),
        F.array_sort(F.collect_set("font")).alias("font_names"),
    )


def upper_median(values: Column) -> Column:
    """The middle value, the upper one of two."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def union_box(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")).alias("bbox")
    )


def first_seen(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("_n = 1").drop("_n")
