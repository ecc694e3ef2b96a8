"""Text that goes on over pages, and chains of any length ranked by pointer jumping.

units: doc_id, unit_id, ord, page, bbox, kind, source, target. pages: doc_id, page, width, height. `continuations` has at most one pair for two
neighbouring pages; `rank` turns any successor table into chains in about log2(longest) rounds of one join
each, so that no task holds a chain or a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.session import cut

# Where a bottom note begins and what it looks like; what ends a paragraph; where a page's text must end and begin.
NOTE_TOP, LOW, HIGH = 0.72, 0.68, 0.25
NOTE = r"^(?:\d{1,3}|[*†‡])(?:\s|https?://)"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
PARAGRAPH_END = r"""[.!?。！？][”’"']?$"""


def ends_paragraph(c: Column) -> Column:
    """Whether a text ends with a full stop, question or exclamation mark, perhaps quoted, before any note numbers."""
    return F.regexp_replace(F.rtrim(X.text(c)), rf"(?:\s*(?:\d{{1,3}}|[{SUPERSCRIPTS}]+))+$", "").rlike(PARAGRAPH_END)


def is_bottom_note(bbox: Column, source: Column, height: Column) -> Column:
    return F.coalesce((bbox["y0"] >= height * NOTE_TOP) & F.trim(X.text(source)).rlike(NOTE), F.lit(False))


def continues(a: str, b: str, aw: Column, ah: Column, bw: Column, bh: Column) -> Column:
    """Whether the text of unit `a`, last on its page, goes on in unit `b`, first on the next. Null boxes never do."""
    p, q = F.col(f"{a}.bbox"), F.col(f"{b}.bbox")
    pw, qw = p["x1"] - p["x0"], q["x1"] - q["x0"]
    slack = F.greatest(F.lit(28.0), F.least(aw, bw) * 0.06)
    overlap = F.least(p["x1"], q["x1"]) - F.greatest(p["x0"], q["x0"])
    column = (overlap >= F.least(pw, qw) * 0.45) & (F.abs(p["x0"] - q["x0"]) <= slack)
    wrap = (p["x0"] >= aw * 0.45) & (q["x0"] <= bw * 0.25) & (F.abs(pw - qw) <= F.greatest(F.lit(28.0), F.least(pw, qw) * 0.18))
    size = lambda u, c: F.char_length(F.trim(X.text(F.col(f"{u}.{c}"))))
    said = (size(a, "source") >= 12) & (size(b, "source") >= 4) & (size(a, "target") >= 4) & (size(b, "target") >= 2)
    open_ = ~ends_paragraph(F.trim(F.col(f"{a}.source"))) & ~ends_paragraph(F.trim(F.col(f"{a}.target")))
    whole = (pw > 0) & (qw > 0) & (p["y1"] > p["y0"]) & (q["y1"] > q["y0"])
    return F.coalesce(whole & (p["y1"] >= ah * LOW) & (q["y0"] <= bh * HIGH) & (column | wrap) & said & open_, F.lit(False))


def continuations(units: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, unit_id, next_id: the last body unit of a page goes on in the first of the next; only bottom notes may follow the one, nothing but they is skipped for the other."""
    u = units.join(pages, ["doc_id", "page"])
    u = u.withColumn("_note", is_bottom_note(F.col("bbox"), F.col("source"), F.col("height"))).where("not _note")
    row = F.struct("unit_id", "bbox", F.lower(X.text(F.col("kind"))).alias("kind"), "source", "target", "width", "height")
    ends = u.groupBy("doc_id", "page").agg(F.max_by(row, F.struct("ord", "unit_id")).alias("tail"), F.min_by(row, F.struct("ord", "unit_id")).alias("head"))
    nxt = ends.select("doc_id", (F.col("page") - 1).alias("page"), F.col("head").alias("b"))
    pairs = ends.select("doc_id", "page", F.col("tail").alias("a")).join(nxt, ["doc_id", "page"]).where("a.kind = 'body' and b.kind = 'body'")
    met = continues("a", "b", F.col("a.width"), F.col("a.height"), F.col("b.width"), F.col("b.height"))
    return pairs.where(met).select("doc_id", F.col("a.unit_id").alias("unit_id"), F.col("b.unit_id").alias("next_id"))


def rank(edges: DataFrame, by: list[str], node: str, successor: str) -> DataFrame:
    """by, node, head, at: every node that has an edge, the first of its chain and its place from 0; on a ring both are null.

    A node has one successor and one predecessor at most. Each round doubles how far back a pointer reaches; a node is done when it
    points to a head. What is not done after more rounds than nodes could need lies on a ring.
    """
    e = edges.where(F.col(node).isNotNull() & F.col(successor).isNotNull()).select(*by, F.col(node).alias("_p"), F.col(successor).alias("_n"))
    back = e.select(*by, F.col("_n").alias("_n"), F.col("_p").alias("_to"))
    nodes = e.select(*by, F.col("_p").alias("_n")).unionByName(e.select(*by, "_n")).distinct()
    state = cut(nodes.join(back, [*by, "_n"], "left").select(*by, "_n", F.coalesce("_to", "_n").alias("_to"), F.when(F.col("_to").isNull(), 0).otherwise(1).cast("long").alias("_d"), F.col("_to").isNull().alias("_done")))
    open_ = state.where("not _done").count()
    rounds = max(1, open_).bit_length() + 1
    while open_ and rounds:
        rounds -= 1
        at = state.select(*by, F.col("_n").alias("_to"), F.col("_to").alias("_to2"), F.col("_d").alias("_d2"), F.col("_done").alias("_done2"))
        moved = state.where("not _done").join(at, [*by, "_to"]).select(*by, "_n", F.col("_to2").alias("_to"), (F.col("_d") + F.col("_d2")).alias("_d"), F.col("_done2").alias("_done"))
        state = cut(state.where("_done").unionByName(moved))
        open_ = state.where("not _done").count()
    return state.select(*by, F.col("_n").alias(node), F.when(F.col("_done"), F.col("_to")).alias("head"), F.when(F.col("_done"), F.col("_d")).alias("at"))
