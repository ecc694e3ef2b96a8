"""Figures and tables of a page, from its drawings and blocks.

drawings: doc_id, page, drawing_no, bbox. blocks: doc_id, page, block_id, ord, bbox, text. pages: doc_id, page, width, height.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import geom as G
from leafmill.functions import text as X
from leafmill.operators import binding, boxes, corpus, ordering

# Gaps, thicknesses and least sizes in points, confidences.
GAP, LINE, LEAST_DRAWINGS, LEAST_SHARE = 14.0, 2.5, 6, 0.02
RULE_WIDTH, X_SLACK, CAPTION_WITHIN = 40.0, 6.0, 60.0
RULED, CAPTIONED, THREE_LINES, COLUMNS, MOST, CAPTION_ONLY = 0.72, 0.15, 0.08, 0.05, 0.97, 0.45
TABLE = r"(?i)^\s*(?:table|tab\.|表)\s*([0-9IVXivx]+)\b"
PAGE = ["doc_id", "page"]


def vector_figures(drawings: DataFrame, pages: DataFrame, gap: float = GAP, least: int = LEAST_DRAWINGS, share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, page, figure_no (least drawing), bbox, n_drawings, n_solid, area_ratio, confidence: clusters of drawings that are many, large and not all lines."""
    d = drawings.where("bbox is not null")
    c = d.join(ordering.cluster_boxes(d, gap), [*PAGE, "drawing_no"])
    solid = F.least(G.width(F.col("bbox")), G.height(F.col("bbox"))) > LINE
    box = F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")).alias("bbox")
    f = c.groupBy(*PAGE, F.col("cluster").alias("figure_no")).agg(box, F.count("*").alias("n_drawings"), F.count_if(solid).alias("n_solid"))
    page_area = F.greatest(F.coalesce("width", F.lit(0.0)) * F.coalesce("height", F.lit(0.0)), F.lit(1.0))
    f = f.join(pages, PAGE).withColumn("_ratio", G.area(F.col("bbox")) / page_area)
    f = f.where((F.col("n_drawings") >= least) & (F.col("_ratio") >= share) & (F.col("n_solid") > 0))
    sure = F.least(F.lit(0.99), 0.6 + F.least("n_drawings", F.lit(60)) / 200.0 + F.least(F.col("_ratio"), F.lit(0.5)) * 0.5)
    return f.select(*PAGE, "figure_no", "bbox", "n_drawings", "n_solid", F.round("_ratio", 4).alias("area_ratio"), F.round(sure, 4).alias("confidence"))


def grow(figures: DataFrame, labels: DataFrame, gap: float = 0.0) -> DataFrame:
    """doc_id, page, region, bbox, n_figures, n_labels: figures grown to a fixpoint. A region takes in every label and region that its box, grown by `gap`, meets.

    figures: doc_id, page, bbox; labels: doc_id, page, bbox. Equal boxes of a page are summed first. What regions take in never leaves their page, so one shuffle
    brings a page together and the rounds run on whole batches of pages; the result does not depend on the order of rows. A label that no region meets stays out.
    """
    parts = figures.select(*PAGE, "bbox", F.lit(1).alias("f"), F.lit(0).alias("l")).unionByName(labels.select(*PAGE, "bbox", F.lit(0).alias("f"), F.lit(1).alias("l"))).where("bbox is not null")
    same = parts.groupBy(*PAGE, "bbox").agg(F.sum("f").cast("long").alias("f"), F.sum("l").cast("long").alias("l"))
    pages = same.groupBy(*PAGE).agg(F.collect_list(F.struct("bbox", "f", "l")).alias("_rows")).where(F.exists("_rows", lambda r: r["f"] > 0))
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, group = ordering._groups(batch)
            count = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("f", "l")]
            group, box, f, n = boxes.grown(group, boxes.sides(flat.field("bbox")), *count, gap)
            kept = f > 0
            keys = [batch.column(c).take(pa.array(group[kept])) for c in PAGE]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, box[:, kept]), pa.array(f[kept]), pa.array(n[kept])], [*PAGE, *boxes.SIDES, "n_figures", "n_labels"])

    out = pages.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in PAGE) + ", x0 double, y0 double, x1 double, y1 double, n_figures long, n_labels long")
    return out.select(*PAGE, F.concat_ws(":", *[F.bround(F.col(k), 2) for k in boxes.SIDES]).alias("region"), F.struct(*boxes.SIDES).alias("bbox"), "n_figures", "n_labels")


def rules(drawings: DataFrame) -> DataFrame:
    """Thin, wide drawings."""
    return drawings.where((G.height(F.col("bbox")) <= LINE) & (G.width(F.col("bbox")) >= RULE_WIDTH))


def tables(blocks: DataFrame, drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, bbox, n_rules, rows, columns, block_ids, caption_block_id, signals, confidence.

    Two rules or more of one width with text between them are a table; a caption that no such region lies under is one, too, with a confidence of 0.45.
    """
    r = ordering.rule_groups(rules(drawings)).join(drawings, [*PAGE, "drawing_no"])
    box = F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")).alias("bbox")
    region = r.groupBy(*PAGE, "rule_group").agg(box, F.count("*").alias("n_rules"))
    b = blocks.where("bbox is not null")
    x, y = (F.col("b.bbox.x0") + F.col("b.bbox.x1")) / 2, (F.col("b.bbox.y0") + F.col("b.bbox.y1")) / 2
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in PAGE] + [y.between(F.col("a.bbox.y0"), F.col("a.bbox.y1")), x.between(F.col("a.bbox.x0") - X_SLACK, F.col("a.bbox.x1") + X_SLACK)]
    inside = region.alias("a").join(b.alias("b"), on).select("a.doc_id", "a.page", "a.rule_group", "b.block_id", "b.ord", F.col("b.bbox.y0").alias("y0"), "b.text")
    grid = corpus.grid_estimate(inside.withColumn("text", F.when(F.trim(X.text(F.col("text"))) == "", " ").otherwise(F.col("text"))), [*PAGE, "rule_group"])
    empty = inside.groupBy(*PAGE, "rule_group").agg(F.array_sort(F.collect_list(F.struct("y0", "ord", "block_id"))).alias("own"), F.count_if(F.trim(X.text(F.col("text"))) == "").alias("blank"))
    captions = b.where(F.trim(X.text(F.col("text"))).rlike(TABLE))
    above = binding.caption_above(region.select(*PAGE, F.concat_ws(":", "page", "rule_group").alias("region"), "bbox"), captions.withColumnRenamed("block_id", "caption_block_id"), "region", "caption_block_id", CAPTION_WITHIN)
    t = region.join(empty, [*PAGE, "rule_group"]).join(grid, [*PAGE, "rule_group"], "left").withColumn("region", F.concat_ws(":", "page", "rule_group")).join(above, ["doc_id", "region"], "left")
    t = t.withColumn("rows", F.coalesce("rows", F.lit(0)) + F.col("blank")).withColumn("columns", F.coalesce("columns", F.lit(0)))
    tests = [("table-caption", F.col("caption_block_id").isNotNull(), CAPTIONED), ("three-line-table", F.col("n_rules") >= 3, THREE_LINES), ("multi-column-text", F.col("columns") >= 2, COLUMNS)]
    sure = F.lit(RULED)
    for _, when, more in tests:
        sure = sure + F.when(when, more).otherwise(0.0)
    signals = F.array_compact(F.array(F.lit("horizontal-rules"), *[F.when(when, name) for name, when, _ in tests]))
    ruled = t.select(*PAGE, "bbox", "n_rules", F.col("rows").cast("long").alias("rows"), F.col("columns").cast("long").alias("columns"), F.transform("own", lambda o: o["block_id"]).alias("block_ids"), "caption_block_id", signals.alias("signals"), F.round(F.least(sure, F.lit(MOST)), 4).alias("confidence"))
    near = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in PAGE] + [F.col("a.bbox.y1").between(F.col("b.bbox.y0") - CAPTION_WITHIN, F.col("b.bbox.y1"))]
    alone = captions.alias("a").join(ruled.alias("b"), on=near, how="left_anti")
    zero = F.lit(0).cast("long")
    only = alone.select(*PAGE, "bbox", zero.alias("n_rules"), zero.alias("rows"), zero.alias("columns"), F.array("block_id").alias("block_ids"), F.col("block_id").alias("caption_block_id"), F.array(F.lit("table-caption-only")).alias("signals"), F.lit(CAPTION_ONLY).alias("confidence"))
    return ruled.unionByName(only)


def _project(spans: list[tuple[float, float]], gap: float) -> list[tuple[float, float]]:
    """Stretches of an axis that the spans cover, joined where less than `gap` is between them."""
    out: list[list[float]] = []
    for lo, hi in sorted(spans):
        if out and lo - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _lanes(span: tuple[float, float], lanes: list[tuple[float, float]]) -> tuple[int, int]:
    """The first lane that a span meets (a middle lies in the other) and how many; else the nearest."""
    mid = (span[0] + span[1]) / 2
    met = [k for k, (lo, hi) in enumerate(lanes) if span[0] <= (lo + hi) / 2 <= span[1] or lo <= mid <= hi]
    if not met:
        met = [min(range(len(lanes)), key=lambda k: (max(lanes[k][0] - span[1], span[0] - lanes[k][1]), k))]
    return met[0], met[-1] - met[0] + 1


@functools.lru_cache(4096)
def _lattice(boxes: tuple[tuple[float, float, float, float], ...], row_gap: float, column_gap: float, tall: float) -> list[tuple[int, int, int, int, bool]]:
    """Regions of one layout recur, so the last ones are remembered."""
    heights = sorted(b[3] - b[1] for b in boxes)
    most = tall * heights[len(heights) // 2]
    down = _project([(b[1], b[3]) for b in boxes if b[3] - b[1] <= most], -row_gap)
    rows = [_lanes((b[1], b[3]), down) for b in boxes]
    by_row: dict[int, list[tuple[float, float]]] = {}
    for b, (k, n) in zip(boxes, rows, strict=True):
        for r in range(k, k + n):
            by_row.setdefault(r, []).append((b[0], b[2]))
    by_row = {r: sorted(own) for r, own in by_row.items() if len(own) > 1}  # one box alone is never apart

    def spans(b: tuple, k: int, n: int) -> bool:
        """Whether the box lies over two boxes of another row that are apart."""
        for r, own in by_row.items():
            under = [x for x in own if x[0] < b[2] and x[1] > b[0]] if not k <= r < k + n else []
            if any(y[0] - x[1] >= column_gap for x, y in zip(under, under[1:], strict=False)):
                return True
        return False

    wide = [spans(b, k, n) for b, (k, n) in zip(boxes, rows, strict=True)]
    across = _project([(b[0], b[2]) for b, w in zip(boxes, wide, strict=True) if not w], column_gap) or _project([(b[0], b[2]) for b in boxes], column_gap)
    columns = [_lanes((b[0], b[2]), across) for b in boxes]
    spanning = {k for (k, _), (_, n) in zip(rows, columns, strict=True) if n > 1}
    first = next((k for k in range(len(down)) if k not in spanning), len(down)) if 0 in spanning else 0
    return [(k, n, c, m, k <= first) for (k, n), (c, m) in zip(rows, columns, strict=True)]


def lattice(cells: DataFrame, row_gap: float = 4.0, column_gap: float = 6.0, tall: float = 1.8) -> DataFrame:
    """ord, row_no, row_span, column_no, column_span, header of the text boxes of each table region: a lattice with spanning cells.

    cells: doc_id, page, region, ord, bbox. Rows are stretches of y that boxes of usual height (up to `tall` medians) cover; columns stretches of x that boxes cover
    which do not lie over two separate boxes of another row; every box spans the lanes that it meets. Header rows go down to the first row
    without a spanning cell if the first one has such a cell, else the first row is the header. Regions are small groups and share batches; null boxes are left out.
    """

    def region(rows: list[tuple]) -> list[tuple]:
        return _lattice(tuple(b for _, b in rows), row_gap, column_gap, tall)

    added = "row_no int, row_span int, column_no int, column_span int, header boolean"
    return ordering._each(cells.where("bbox is not null"), ["doc_id", "page", "region"], ["bbox"], "ord", region, added)
