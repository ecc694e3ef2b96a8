"""Footnotes of a page: their separator, their blocks, their entries, and which marker in the body each entry belongs to.

blocks: doc_id, page, block_id, bbox, text, font_size, furniture. drawings: doc_id, page, bbox. pages: doc_id, page, width, height.
Everything but the matching is columns and grouped sums over (doc_id, page).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import geom as G
from leafmill.functions import text as X

# What a separator looks like, where notes begin, how small and how marked they are.
THICK, WIDE, ZONE, SMALLER, SLACK, PROSE = 2.5, 0.45, 0.60, 0.92, 4.0, 80
MARK = r"^\s*(?:[\d]{1,2}|[*†‡§]|[⁰-⁹]{1,2})\s+\S"
ENTRY = r"^\s*\(?(\d{1,3})\)?[.)]?\s+"
PAGE = ["doc_id", "page"]


def separators(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, bbox: the topmost thin, short line in the lower part of a page; of equals the least box."""
    d = drawings.where("bbox is not null").join(pages, PAGE)
    size = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, 1.0).otherwise(F.col(c))
    fits = (G.height(F.col("bbox")) <= THICK) & (G.width(F.col("bbox")) / size("width") <= WIDE) & (F.col("bbox.y0") / size("height") >= ZONE)
    return d.where(fits).groupBy(*PAGE).agg(F.min(F.struct("bbox.y0", "bbox.x0", "bbox.x1", "bbox.y1", "bbox")).alias("m")).select(*PAGE, "m.bbox")


def detect(blocks: DataFrame, drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, block_id, bbox, text, marked, has_separator, font_size, body_size, confidence: blocks in the note zone that are marked or smaller than the body (both, without a separator).

    The body size is the one with most characters in prose above the zone, the larger of equals. Null boxes, blank texts and furniture are no notes.
    """
    zone = pages.join(separators(drawings, pages).withColumnRenamed("bbox", "line"), PAGE, "left")
    top = F.coalesce(F.col("line.y1"), F.when(F.coalesce("height", F.lit(0.0)) == 0, 1.0).otherwise(F.col("height")) * ZONE)
    b = blocks.where(~F.coalesce("furniture", F.lit(False)) & F.col("bbox").isNotNull()).join(zone.select(*PAGE, top.alias("top"), F.col("line").isNotNull().alias("has_separator")), PAGE)
    size = F.coalesce("font_size", F.lit(0.0))
    prose = b.where((F.col("bbox.y1") <= F.col("top")) & (F.char_length("text") >= PROSE) & (size > 0))
    sizes = prose.groupBy(*PAGE, size.alias("s")).agg(F.sum(F.char_length("text")).alias("n"))
    body = sizes.groupBy(*PAGE).agg(F.max_by("s", F.struct("n", "s")).alias("body_size"))
    n = b.where((F.col("bbox.y1") > F.col("top")) & (F.col("bbox.y0") >= F.col("top") - SLACK)).join(body, PAGE, "left")
    n = n.withColumn("text", F.trim(X.text(F.col("text")))).withColumn("body_size", F.coalesce("body_size", F.lit(0.0))).withColumn("font_size", size)
    n = n.withColumn("marked", F.col("text").rlike(MARK))
    small = (F.col("body_size") > 0) & (F.col("font_size") > 0) & (F.col("font_size") <= F.col("body_size") * SMALLER)
    notes = n.where((F.col("text") != "") & F.when(F.col("has_separator"), F.col("marked") | small).otherwise(F.col("marked") & small))
    sure = 0.6 + F.when(F.col("marked"), 0.2).otherwise(0.0) + F.when(F.col("has_separator"), 0.15).otherwise(0.0)
    return notes.select(*PAGE, "block_id", "bbox", "text", "marked", "has_separator", "font_size", "body_size", F.round(F.least(sure, F.lit(0.95)), 4).alias("confidence"))


def entries(notes: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, entry, marker, body: numbered entries of each text, with the lines that follow them; lines before the first number belong to none.

    A text is cut where it stands: rows are neither sent nor sorted. `by` is a key of `notes`.
    """
    lines = F.transform(F.split(F.regexp_replace(X.text(F.col(text)), "\r\n|\r", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    rows = notes.select(*by, F.filter(lines, lambda x: x != "").alias("_lines"))
    rows = rows.withColumn("_marks", F.transform("_lines", lambda x: F.regexp_extract(x, ENTRY, 1)))
    rows = rows.withColumn("_starts", F.filter(F.transform("_marks", lambda m, i: F.when(m != "", i + 1)), lambda i: i.isNotNull())).where(F.size("_starts") > 0)

    def one(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), F.size("_lines") + 1)
        own = F.transform(F.slice("_lines", start, end - start), lambda x, i: F.when(i == 0, F.trim(F.regexp_replace(x, ENTRY, ""))).otherwise(x))
        return F.struct((k + 1).cast("long").alias("entry"), F.element_at("_marks", start).alias("marker"), F.trim(F.array_join(own, " ")).alias("body"))

    return rows.select(*by, F.explode(F.transform("_starts", one)).alias("e")).select(*by, "e.entry", "e.marker", "e.body")


def match(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest order-preserving matching of equal labels; of several the one that takes the earliest of `a`, then of `b`, first."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m and best[i][j]:
        k = next((k for k in range(j, m) if a[i] == b[k] and best[i + 1][k + 1] + 1 == best[i][j]), None)
        if k is not None:
            out.append((i, k))
            j = k + 1
        i += 1
    return out


def _bound(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from leafmill.operators import footnotes

    for batch in batches:
        pairs = []
        for a, b in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True):
            a, b = a or [], b or []
            met = footnotes.match([x["label"] for x in a], [x["label"] for x in b])
            left, right = {i for i, _ in met}, {k for _, k in met}
            pairs.append([(a[i]["ord"], b[k]["ord"], a[i]["label"]) for i, k in met] + [(x["ord"], None, x["label"]) for i, x in enumerate(a) if i not in left] + [(None, x["ord"], x["label"]) for k, x in enumerate(b) if k not in right])
        kind = pa.list_(pa.struct([("marker_ord", pa.int64()), ("entry_ord", pa.int64()), ("label", pa.string())]))
        rows = [[dict(zip(("marker_ord", "entry_ord", "label"), p, strict=True)) for p in own] for own in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), pa.array(rows, kind)], ["doc_id", "page", "pairs"])


def bind_markers(markers: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, page, marker_ord, entry_ord, label: markers in a page's body and entries in its notes, in order; a null on either side is a marker without an entry, or the reverse.

    Both sides: doc_id, page, ord (long), label. A page is matched as a whole, many pages in a batch; null labels take no part.
    """
    side = lambda df, name: df.where("label is not null").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), F.col("label").cast("string").alias("label")))).alias(name))
    both = side(markers, "_a").join(side(notes, "_b"), PAGE, "full")
    types = dict(both.dtypes)
    out = both.mapInArrow(_bound, f"doc_id {types['doc_id']}, page {types['page']}, pairs array<struct<marker_ord: long, entry_ord: long, label: string>>")
    return out.select(*PAGE, F.inline("pairs"))
