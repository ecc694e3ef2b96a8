"""Payloads that replace runs of units: which units a payload covers, and the sequence with each run spliced out for it.

units: doc_id, unit_id, ord, page, bbox, kind, token (content letters of the target), keep_reason. items: doc_id, item_id, ord, status, pages,
regions (array of page and bbox), token, method, anchor_id. (doc_id, unit_id) and (doc_id, item_id) are keys; any value may be null.
Runs are islands of a window in reading order; nothing is folded in Python but the coverage of one text by another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import arrow as A

# Least letters of a unit and of a group, least coverage, methods whose payload stands for a whole span.
UNIT_CHARS, GROUP_CHARS, COVERAGE = 20, 20, 0.90
SPAN_METHODS = ("structured-table-rebuild", "semantic-grid-rebuild")


def within(part: Column, whole: Column) -> Column:
    """Coverage by containment alone: 1 or 0."""
    return F.when((part != "") & F.contains(whole, part), 1.0).otherwise(0.0)


def replaced(units: DataFrame, items: DataFrame, coverage: Callable[[Column, Column], Column] | None = None, unit_chars: int = UNIT_CHARS, group_chars: int = GROUP_CHARS, least: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, unit_id: units that each ready item replaces.

    coverage: share of a unit's token in the payload; by default that of matching blocks, decided no further than `least` needs.
    A unit is a seed if its centre lies in a source region of the item or its text, long enough, is covered by the payload. A run of covered units
    with a seed, a table or a caption among them is replaced whole; between the first and last replaced unit of a page short parts
    of the payload go too. With a span method and an anchor on the page everything from the anchor on goes that has no reason to stay.
    """
    i = items.where("status = 'ready'").select("doc_id", "item_id", F.explode(F.array_distinct(F.coalesce("pages", F.array().cast("array<int>")))).alias("page"), "regions", F.coalesce("token", F.lit("")).alias("payload"), F.coalesce("method", F.lit("")).alias("method"), "anchor_id")
    u = units.select("doc_id", "page", "unit_id", "ord", "bbox", F.lower(F.coalesce("kind", F.lit(""))).alias("kind"), F.coalesce("token", F.lit("")).alias("token"), (F.trim(F.coalesce("keep_reason", F.lit(""))) != "").alias("stays"))
    r = u.join(i, ["doc_id", "page"])
    x, y = (F.col("bbox.x0") + F.col("bbox.x1")) / 2, (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    held = F.exists("regions", lambda g: (g["page"] == F.col("page")) & x.between(g["bbox"]["x0"], g["bbox"]["x1"]) & y.between(g["bbox"]["y0"], g["bbox"]["y1"]))
    r = r.withColumn("held", F.coalesce(held, F.lit(False))).withColumn("size", F.char_length("token"))
    some = F.char_length("payload") >= group_chars
    enough = coverage(F.col("token"), F.col("payload")) >= least if coverage else A.covered(F.col("token"), F.col("payload"), least)
    r = r.withColumn("covered", F.coalesce((F.col("token") != "") & enough, F.lit(False)))
    r = r.withColumn("seed", F.col("held") | (F.col("covered") & (F.col("size") >= unit_chars) & (F.char_length("payload") >= unit_chars)))
    page = Window.partitionBy("doc_id", "item_id", "page")
    order = page.orderBy("ord", "unit_id")
    run = Window.partitionBy("doc_id", "item_id", "page", "run")
    r = r.withColumn("run", F.sum(F.when(F.col("covered"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    mine = F.when(F.col("covered"), F.col("seed") | F.contains("kind", F.lit("table")) | F.contains("kind", F.lit("caption"))).otherwise(False)
    r = r.withColumn("whole", F.col("covered") & F.max(mine).over(run) & (F.sum(F.when(F.col("covered"), F.col("size")).otherwise(0)).over(run) >= group_chars))
    at = F.row_number().over(order)
    r = r.withColumn("at", at).withColumn("anchor", F.min(F.when(F.col("unit_id") == F.col("anchor_id"), F.col("at"))).over(page))
    span = F.col("anchor").isNotNull() & F.col("method").isin(*SPAN_METHODS)
    r = r.withColumn("span", span).withColumn("taken", (F.col("seed") | F.col("whole")) & ~(span & (F.col("at") < F.col("anchor")) & ~F.col("held")))
    first, last = F.min(F.when(F.col("taken"), F.col("at"))).over(page), F.max(F.when(F.col("taken"), F.col("at"))).over(page)
    r = r.withColumn("last", last).withColumn("first", F.when(F.col("span"), F.col("anchor")).otherwise(first))
    inner = F.col("at").between(F.col("first"), F.col("last"))
    more = inner & ((F.col("span") & ~F.col("stays")) | ((F.col("size") >= 2) & F.contains("payload", "token")))
    on_page = r.where(F.when(some, F.col("taken") | F.coalesce(more, F.lit(False))).otherwise(F.col("seed"))).select("doc_id", "item_id", "unit_id")
    # a source region may lie on a page that the item does not name
    far = items.where("status = 'ready'").select("doc_id", "item_id", F.explode("regions").alias("g")).select("doc_id", "item_id", F.col("g.page").alias("page"), F.col("g.bbox").alias("box"), F.lit(True).alias("far"))
    known = i.select("doc_id", "item_id", "page")
    hit = u.join(far.join(known, ["doc_id", "item_id", "page"], "left_anti"), ["doc_id", "page"]).where(x.between(F.col("box.x0"), F.col("box.x1")) & y.between(F.col("box.y0"), F.col("box.y1")))
    return on_page.unionByName(hit.select("doc_id", "item_id", "unit_id")).distinct()


def sequence(units: DataFrame, items: DataFrame, taken: DataFrame) -> DataFrame:
    """doc_id, position, source (`unit` or `payload`), id, n_replaced: units in order, each placed item before its anchor or else before its first replaced unit.

    Units and items keep their ids and relative order; of items at one place the least `ord` comes first. Items without a place are left to `problems`.
    """
    out = taken.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))
    places = units.select("doc_id", "unit_id", F.col("ord").alias("at"))
    first = taken.join(places, ["doc_id", "unit_id"]).groupBy("doc_id", "item_id").agg(F.min(F.struct("at", "unit_id")).alias("first"))
    anchors = items.join(places.select("doc_id", F.col("unit_id").alias("anchor_id"), F.struct("at", F.col("unit_id")).alias("anchor")), ["doc_id", "anchor_id"], "left")
    ready = anchors.where("status = 'ready'").join(first, ["doc_id", "item_id"], "left").join(out, ["doc_id", "item_id"], "left")
    ready = ready.withColumn("place", F.coalesce("anchor", "first")).where("place is not null")
    id_type = "string"
    pay = ready.select("doc_id", F.col("place.at").alias("at"), F.col("place.unit_id").cast(id_type).alias("near"), F.lit(0).alias("tier"), F.col("ord").cast("long").alias("nth"), F.lit("payload").alias("source"), F.col("item_id").cast(id_type).alias("id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_replaced"))
    kept = units.join(taken.select("doc_id", "unit_id").distinct(), ["doc_id", "unit_id"], "left_anti")
    own = kept.select("doc_id", F.col("ord").alias("at"), F.col("unit_id").cast(id_type).alias("near"), F.lit(1).alias("tier"), F.lit(0).cast("long").alias("nth"), F.lit("unit").alias("source"), F.col("unit_id").cast(id_type).alias("id"), F.lit(0).cast("long").alias("n_replaced"))
    rows = pay.unionByName(own)
    order = Window.partitionBy("doc_id").orderBy("at", "near", "tier", "nth", "id")
    return rows.select("doc_id", F.row_number().over(order).alias("position"), "source", "id", "n_replaced")


def problems(units: DataFrame, items: DataFrame, taken: DataFrame) -> DataFrame:
    """doc_id, id, code: units that several items replace (overlap), items whose interval runs into an earlier one's (interleaved), items without a place (orphan), anchors that no unit has (anchor-missing)."""
    ready = items.where("status = 'ready'")
    text = lambda c: F.col(c).cast("string").alias("id")
    twice = taken.groupBy("doc_id", "unit_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", text("unit_id"), F.lit("overlap").alias("code"))
    spans = taken.join(units.select("doc_id", "unit_id", F.col("ord").alias("at")), ["doc_id", "unit_id"]).groupBy("doc_id", "item_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    before = Window.partitionBy("doc_id").orderBy("lo", "hi", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    crossed = spans.withColumn("upto", F.max("hi").over(before)).where(F.col("upto") >= F.col("lo")).select("doc_id", text("item_id"), F.lit("interleaved").alias("code"))
    ids = units.select("doc_id", F.col("unit_id").alias("anchor_id"))
    lost = ready.where("anchor_id is not null").join(ids, ["doc_id", "anchor_id"], "left_anti")
    none = ready.join(ready.join(ids, ["doc_id", "anchor_id"], "left_semi").select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti").join(spans, ["doc_id", "item_id"], "left_anti")
    return twice.unionByName(crossed).unionByName(none.select("doc_id", text("item_id"), F.lit("orphan").alias("code"))).unionByName(lost.select("doc_id", text("item_id"), F.lit("anchor-missing").alias("code")))
