"""Decision tables: quality modes, strategies, fallback chains, risk weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
COMPLEX_TYPES = ("table", "vector-figure", "chart", "display-formula", "screenshot", "raster-figure")
PRESERVE_ELEMENT = "preserve-element-region"
PRESERVE_PAGE = "preserve-full-source-page"
STRATEGIES = {
    "raster-figure": "preserve-original-image",
    "screenshot": "preserve-original-image",
    "display-formula": "preserve-formula-region",
    "caption": "translate-caption-and-keep-with-figure",
    "footnote": "translate-and-render-as-footnote",
    "reference-entry": "preserve-and-normalize-line-breaks",
    "reference-heading": "preserve-and-normalize-line-breaks",
    "header": "omit-nonsemantic",
    "footer": "omit-nonsemantic",
    "page-number": "omit-nonsemantic",
    "watermark": "omit-nonsemantic",
}
RISK_WEIGHTS = {
    "element-missing": 10.0,
    "geometry-gap": 9.0,
    "caption-split": 7.0,
    "table-page-split": 6.0,
    "table-layout": 5.0,
    "formula-integrity": 5.0,
    "dense-vector-figure": 5.0,
    "required-without-evidence": 4.0,
    "embedded-label-figure": 4.0,
    "drawing-bound-only": 3.0,
    "safe-fallback-region": 3.0,
    "ambiguous-location": 2.0,
    "footnote-placement": 2.0,
    "order-inversion": 1.0,
}
BASELINE_SIGNALS = {"table": "table-layout", "display-formula": "formula-integrity", "footnote": "footnote-placement"}
#: quality mode: full independent review, deep checks, table floor, label floor, element floor, least DPI.
MODES = (
    ("fast", False, False, 0.85, 0.80, 0.70, 300),
    ("balanced", True, False, 0.85, 0.80, 0.70, 300),
    ("precise", True, True, 0.92, 0.88, 0.80, 300),
)


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODES), "quality_mode string, full_review boolean, deep_checks boolean, table_floor double, label_floor double, element_floor double, least_dpi int")


def table_strategy(confidence: Column, rows: Column, columns: Column, unresolved: Column, floor: Column) -> Column:
    sure = (confidence >= floor) & (rows >= 2) & (columns >= 2) & ~unresolved
    return F.when(sure, "structured-table-rebuild").otherwise("preserve-table-region-with-translation-key")


def vector_strategy(labels: Column, confidence: Column, floor: Column) -> Column:
    return F.when((labels > 0) & (confidence >= floor), "preserve-geometry-with-label-overlay").otherwise("preserve-geometry-with-numbered-legend")


def strategy(kind: Column, omitted: Column, table: Column, vector: Column) -> Column:
    plain = F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair])
    return F.when(omitted, "omit-nonsemantic").when(kind == "table", table).when(kind.isin("vector-figure", "chart"), vector).otherwise(F.coalesce(plain[kind], F.lit("translate-and-reflow")))


def fallback_levels(kind: Column, primary: Column) -> Column:
    """Three levels for complex types, one for text."""
    chain = F.array_distinct(F.array(primary, F.lit(PRESERVE_ELEMENT), F.lit(PRESERVE_PAGE)))
    return F.when((primary != "omit-nonsemantic") & kind.isin(list(COMPLEX_TYPES)), chain).otherwise(F.array(primary))


def next_level(levels: Column, current: Column) -> Column:
    """The level after the current one; of an unknown one the second; null at the end."""
    at = F.array_position(levels, current)
    return F.when(at > 0, F.get(levels, at.cast("int"))).otherwise(F.get(levels, F.lit(1)))


def may_force(levels: Column, current: Column, forced: Column) -> Column:
    """A forced strategy must lie further down the chain."""
    return (F.array_position(levels, forced) > 0) & (F.array_position(levels, forced) > F.array_position(levels, current))


def render_plan(elements: DataFrame, mode: DataFrame) -> DataFrame:
    """Strategy, levels, status and reason code of each element. mode: one row of `modes`.

    elements: type, confidence, rows, columns, unresolved, labels, label_confidence, omit_code.
    """
    e = elements.crossJoin(F.broadcast(mode))  # one row
    omitted = F.col("omit_code").isNotNull()
    table = table_strategy(F.col("confidence"), F.col("rows"), F.col("columns"), F.col("unresolved"), F.col("table_floor"))
    vector = vector_strategy(F.col("labels"), F.col("label_confidence"), F.col("label_floor"))
    e = e.withColumn("strategy", strategy(F.col("type"), omitted, table, vector))
    e = e.withColumn("fallback_levels", fallback_levels(F.col("type"), F.col("strategy")))
    e = e.withColumn("status", F.when(F.col("strategy") == "omit-nonsemantic", "omitted").otherwise("ready"))
    e = e.withColumn("fallback", next_level(F.col("fallback_levels"), F.col("strategy")))
    return e.withColumn("low_confidence", F.col("confidence") < F.col("element_floor")).drop(*mode.columns)


def plan_completeness(plan: DataFrame, by: str) -> DataFrame:
    return plan.groupBy(by).agg(
        F.count_if("required").alias("required"),
        F.count_if(F.col("required") & (F.col("status") == "ready")).alias("planned"),
        F.count_if(F.col("required") & (F.col("status") == "omitted")).alias("omitted"),
        F.count_if(F.col("required") & ~F.col("status").isin("ready", "omitted")).alias("unresolved"),
    ).withColumn("complete", (F.col("unresolved") == 0) & (F.col("required") == F.col("planned") + F.col("omitted")))


def risk_scores(signals: DataFrame, by: list[str], weights: dict[str, float] = RISK_WEIGHTS) -> DataFrame:
    """Sum of weights and the distinct elements of each page."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return signals.groupBy(*by).agg(F.round(F.sum(F.coalesce(table[F.col("code")], F.lit(0.0))), 2).alias("score"), F.count_distinct("element_id").alias("n_elements"))


def build_gate(blocking: Column, missing_fonts: Column, plan_complete: Column) -> Column:
    return F.when(missing_fonts > 0, "BLOCKED_FONTS").when(~plan_complete, "BLOCKED_PLAN").when(blocking > 0, "BLOCKED_INPUT").otherwise("READY")


def repair_action(method: Column, located: Column, required: Column, split_caption: Column, levels: Column, strategy_: Column) -> Column:
    """The one repair round: what is lost goes a level down, a split caption is kept together, the rest is left alone."""
    return (
        F.when(required & ~located & next_level(levels, strategy_).isNotNull(), "force-fallback")
        .when(required & ~located, "hand-over")
        .when(split_caption, "keep-together")
        .when(method == "lower-bound", "review")
        .otherwise("none")
    )
