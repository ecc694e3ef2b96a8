"""Source units: segments of blocks, chunks, skeletons, overrides, references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as X


def segments(lines: DataFrame, heading: Column) -> DataFrame:
    """Splits each block into its leading heading lines and the rest. lines: doc_id, page, block_id, line_no, text."""
    flagged = lines.withColumn("_h", heading)
    key = ["doc_id", "page", "block_id"]
    first_body = F.min(F.when(~F.col("_h"), F.col("line_no"))).over(Window.partitionBy(*key))
    part = F.when(first_body.isNull() | (F.col("line_no") < first_body), "heading").otherwise("body")
    marked = flagged.withColumn("segment", part)
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    out = marked.groupBy(*key, "segment").agg(rows.alias("rows"))
    return out.select(*key, "segment", X.join_lines(F.transform("rows", lambda r: r["text"])).alias("text"))


def units(blocks: DataFrame, most: int = 900) -> DataFrame:
    """Units of at most `most` characters in reading order: pNNNN-uNNNN. blocks: doc_id, page, position, block_id, kind, text."""
    c = blocks.select("doc_id", "page", "position", "block_id", "kind", F.posexplode(X.chunks(X.dehyphenate(F.col("text")), most)).alias("part", "source"))
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("position", "part"))
    return c.withColumn("unit_id", F.format_string("p%04d-u%04d", "page", n))


def skeleton(units_: DataFrame, roles: DataFrame) -> DataFrame:
    """Units with role, kind, anchors and flags, and empty targets."""
    out = units_.join(roles.select("doc_id", "unit_id", "role"), ["doc_id", "unit_id"], "left")
    kind = F.coalesce(F.when(F.col("role").isin("heading", "document-title"), "heading").when(F.col("role") == "reference-entry", "reference"), F.col("kind"))
    return out.withColumn("kind", kind).withColumn("anchors", X.required_anchors(F.col("source"))).withColumn("review_flags", X.review_flags(F.col("source"))).withColumn("translation", F.lit(None).cast("string"))


def reference_entries(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lines of a reference section as entries: a new one at [n], (n) or n."""
    marks = F.regexp_extract("text", r"^\s*(?:\[(\d+)\]|\((\d+)\)|(\d+)\.)\s", 0) != ""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = lines.withColumn("entry", F.sum(F.when(marks, 1).otherwise(0)).over(w))
    rows = F.array_sort(F.collect_list(F.struct(order, "text")))
    out = e.where("entry > 0").groupBy(*keys, "entry").agg(rows.alias("rows"))
    return out.select(*keys, "entry", X.join_lines(F.transform("rows", lambda r: r["text"])).alias("text"), F.get(F.regexp_extract_all(F.get(F.col("rows"), F.lit(0))["text"], F.lit(r"\d+"), F.lit(0)), F.lit(0)).cast("int").alias("number"))


def trim_tail(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Reference lines up to acknowledgements, appendices and the like."""
    ends = F.lower(X.clean(F.col("text"))).rlike(r"^(?:acknowledge?ments?|appendix|author contributions?|funding|conflicts? of interest|致谢|附录)\b")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_end", F.max(F.when(ends, 1).otherwise(0)).over(w)).where("_end = 0").drop("_end")


def reference_problems(source: DataFrame, output: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose output entries are not numbered 1..n, or lack a URL of the source. Columns: key, number, text."""
    nums = output.groupBy(key).agg(F.array_sort(F.collect_list("number")).alias("nums"))
    gap = nums.where(F.col("nums") != F.sequence(F.lit(1), F.size("nums"))).select(key, F.lit("NUMBERS_NOT_CONTIGUOUS").alias("code"))
    want = source.select(key, F.explode(X.urls(F.col("text"))).alias("url")).distinct()
    have = output.select(key, F.explode(X.urls(F.col("text"))).alias("url")).distinct()
    return gap.unionByName(want.join(have, [key, "url"], "left_anti").select(key, F.lit("URL_BROKEN").alias("code")).distinct())


def strip_blocks(text: Column, blocks: Column) -> Column:
    """A page's text without the retained blocks, longest first."""
    ordered = F.array_sort(blocks, lambda a, b: F.char_length(b) - F.char_length(a))
    return F.aggregate(ordered, X.text(text), lambda acc, b: F.when(b == "", acc).otherwise(F.replace(acc, b, F.lit(" "))))


def merge_elements(elements: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges: a kept element takes the union of boxes and blocks of the others, which go; edges are not rewired. merges: doc_id, keep_id, drop_id."""
    all_ = merges.select("doc_id", "keep_id", F.col("drop_id").alias("element_id")).unionByName(merges.select("doc_id", "keep_id", F.col("keep_id").alias("element_id"))).distinct()
    joined = elements.join(all_, ["doc_id", "element_id"], "left").withColumn("_to", F.coalesce("keep_id", "element_id"))
    box = F.struct(*[f(f"bbox.{k}").alias(k) for f, k in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    grouped = joined.groupBy("doc_id", "_to").agg(box.alias("bbox"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("block_ids")))).alias("block_ids"))
    kept = elements.drop("bbox", "block_ids").withColumnRenamed("element_id", "_to")
    return kept.join(grouped, ["doc_id", "_to"]).withColumnRenamed("_to", "element_id").select(elements.columns)


def split_elements(elements: DataFrame, splits: DataFrame) -> DataFrame:
    """Split children get -partNN ids and their own boxes. splits: doc_id, element_id, boxes (array)."""
    s = elements.join(splits, ["doc_id", "element_id"]).select(elements.columns + [F.posexplode("boxes").alias("_n", "_box")])
    parts = s.withColumn("element_id", F.format_string("%s-part%02d", "element_id", F.col("_n") + 1)).withColumn("bbox", F.col("_box")).select(elements.columns)
    rest = elements.join(splits.select("doc_id", "element_id"), ["doc_id", "element_id"], "left_anti")
    return rest.select(elements.columns).unionByName(parts)


def override_problems(overrides: DataFrame, elements: DataFrame) -> DataFrame:
    """Overrides of unknown elements or with an unknown action."""
    bad = overrides.where(~F.col("action").isin("retype", "split", "merge", "move", "link", "unlink", "omit")).select("doc_id", "element_id", F.lit("UNKNOWN_ACTION").alias("code"))
    lost = overrides.join(elements.select("doc_id", "element_id"), ["doc_id", "element_id"], "left_anti").select("doc_id", "element_id", F.lit("UNKNOWN_ELEMENT").alias("code"))
    return bad.unionByName(lost)


def table_grid(cells: DataFrame, row_gap: float = 4.0, column_gap: float = 6.0, ragged: float = 0.34) -> DataFrame:
    """Row and column numbers of the text boxes of a table region: rows by gaps in y, columns by gaps in the x projection; too ragged a table has none.

    cells: doc_id, page, region, ord, bbox. A region is one task.
    """

    def region(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)

        def lanes(lo: list[float], hi: list[float], gap: float) -> list[int]:
            out, at, end = [0] * len(lo), -1, float("-inf")
            for i in sorted(range(len(lo)), key=lambda i: lo[i]):
                if lo[i] - end > gap:
                    at += 1
                end = max(end, hi[i])
                out[i] = at
            return out

        rows = lanes([b["y0"] for b in pdf["bbox"]], [b["y1"] for b in pdf["bbox"]], -row_gap)
        cols = lanes([b["x0"] for b in pdf["bbox"]], [b["x1"] for b in pdf["bbox"]], column_gap)
        full = max(cols) + 1
        filled = pd.Series(cols).groupby(pd.Series(rows)).nunique()
        pdf["row_no"], pdf["column_no"] = rows, cols
        pdf = pdf[["doc_id", "page", "region", "ord", "row_no", "column_no"]]
        return pdf if (filled < full).mean() <= ragged else pdf.iloc[:0]

    schema = ", ".join(f"{c} {t}" for c, t in cells.select("doc_id", "page", "region", "ord").dtypes) + ", row_no int, column_no int"
    return cells.groupBy("doc_id", "page", "region").applyInPandas(region, schema)


def table_problems(confidence: Column, rows: Column, columns: Column, numbers_mapped: Column, merged_known: Column, caption: Column, floor: float = 0.85) -> Column:
    """What keeps a table from a structured rebuild; empty if nothing does."""
    return F.array_compact(
        F.array(
            F.when(confidence < floor, F.lit("confidence")),
            F.when(rows < 2, F.lit("rows")),
            F.when(columns < 2, F.lit("columns")),
            F.when(~numbers_mapped, F.lit("numbers")),
            F.when(~merged_known, F.lit("merged-cells")),
            F.when(~caption, F.lit("caption")),
        )
    )


def greedy_coverage(pages: DataFrame, least: float = 0.85) -> DataFrame:
    """Share of each page's text that its units cover; of several places a unit takes the one with least already covered.

    pages: doc_id, page, text, units (array of texts in order). Order matters within a page, so a page is one step.
    """

    def page(batches):
        for pdf in batches:
            out = []
            for text, units_ in zip(pdf["text"], pdf["units"], strict=True):
                text = text or ""
                used = bytearray(len(text))
                for u in units_ if units_ is not None else []:
                    if not u:
                        continue
                    spots, at = [], text.find(u)
                    while at >= 0:
                        spots.append(at)
                        at = text.find(u, at + 1)
                    if spots:
                        best = min(spots, key=lambda s: (sum(used[s : s + len(u)]), s))
                        used[best : best + len(u)] = b"\x01" * len(u)
                out.append(sum(used) / len(text) if text else 1.0)
            pdf["coverage"] = out
            yield pdf[["doc_id", "page", "coverage"]]

    schema = ", ".join(f"{c} {t}" for c, t in pages.select("doc_id", "page").dtypes) + ", coverage double"
    return pages.select("doc_id", "page", "text", "units").mapInPandas(page, schema).withColumn("covered", F.col("coverage") >= least)
