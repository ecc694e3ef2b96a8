"""Registered queries over records: boxes, events, vectors and keys, with their DuckDB counterparts.

Boxes are laid out from `lineitem` by a fixed rule that both sides share: a page for each order, a block for each line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import arrow as A
from leafmill.functions import geom as G
from leafmill.operators import binding, corpus, elements, gates, ordering, reconcile
from leafmill.plans import policy
from leafmill.session import ship, table
from leafmill.streaming import ledger


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, page, block_id, ord, bbox, kind: lines of an order are blocks of a page; a row's key is unique within its page."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_discount", "l_returnflag").distinct()
    x, y = F.col("l_quantity") * 8, F.col("l_linenumber") * 60.0 + F.col("l_tax") * 500
    w, h = 40 + F.col("l_discount") * 1500, 20 + (F.col("l_suppkey") % 40).cast("double")
    return li.select(
        F.lit(0).alias("doc_id"),
        F.col("l_orderkey").alias("page"),
        F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int")).alias("block_id"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("long").alias("ord"),
        G.box(x, y, x + w, y + h).alias("bbox"),
        F.col("l_returnflag").alias("kind"),
    )


_BLOCKS = """b AS (SELECT DISTINCT 0 AS doc_id, l_orderkey AS page, concat_ws('-', l_partkey, l_suppkey, l_linenumber, l_quantity::INT) AS block_id,
  (l_linenumber * 1000000 + l_partkey)::BIGINT AS ord, l_quantity * 8 AS x0, l_linenumber * 60.0::DOUBLE + l_tax * 500 AS y0,
  l_quantity * 8 + (40 + l_discount * 1500) AS x1, l_linenumber * 60.0::DOUBLE + l_tax * 500 + (20 + (l_suppkey % 40)::DOUBLE) AS y1, l_returnflag AS kind FROM lineitem),
ba AS (SELECT *, greatest(0, x1 - x0) * greatest(0, y1 - y0) AS area FROM b)"""
_OVER = "greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0)) * greatest(0, least(p.y1, q.y1) - greatest(p.y0, q.y0))"
_DIST = "sqrt(pow(greatest(p.x0 - q.x1, q.x0 - p.x1, 0), 2) + pow(greatest(p.y0 - q.y1, q.y0 - p.y1, 0), 2))"


def _of(b: DataFrame, kind: str, name: str) -> DataFrame:
    return b.where(F.col("kind") == kind).withColumnRenamed("block_id", name)


def overlap_bind(spark, d):
    b = _blocks(spark, d)
    return binding.bind_by_overlap(_of(b, "R", "unit_id"), _of(b, "N", "element_id"), "unit_id", "element_id", 0.25).select("unit_id", "element_id").groupBy("unit_id").agg(F.count("*").alias("n"), F.min("element_id").alias("first"))


def box_pairs(spark, d):
    return ordering.pair_overlaps(_blocks(spark, d), ["page"], 0.35).select("page", "first", "second", F.round("share", 6).alias("share"))


def nearest_boxes(spark, d):
    b = _blocks(spark, d)
    return binding.nearest(_of(b, "R", "caption"), _of(b, "N", "visual"), "caption", "visual").groupBy("page").agg(F.count("*").alias("n"), F.round(F.min("distance"), 6).alias("nearest"))


def caption_above(spark, d):
    b = _blocks(spark, d)
    return binding.caption_above(_of(b, "N", "region"), _of(b, "R", "caption"), "region", "caption").groupBy("doc_id").agg(F.count("*").alias("n"))


def centre_inside(spark, d):
    b = _blocks(spark, d)
    return binding.inside(_of(b, "R", "id"), _of(b, "N", "id2")).groupBy("page").agg(F.count("*").alias("n"))


def covered_boxes(spark, d):
    b = _blocks(spark, d)
    return binding.covered(_of(b, "A", "id"), _of(b, "N", "id2"), 0.3).groupBy("doc_id").agg(F.count("*").alias("n"))


def uncovered_boxes(spark, d):
    b = _blocks(spark, d)
    return binding.outside(_of(b, "A", "id"), _of(b, "N", "id2")).groupBy("doc_id").agg(F.count("*").alias("n"))


def union_boxes(spark, d):
    return corpus.union_box(_blocks(spark, d), ["page"]).select("page", F.round("bbox.x0", 6).alias("x0"), F.round("bbox.y0", 6).alias("y0"), F.round("bbox.x1", 6).alias("x1"), F.round("bbox.y1", 6).alias("y1"))


def union_area(spark, d):
    ship(spark)
    g = _blocks(spark, d).groupBy("page").agg(F.collect_list("bbox").alias("boxes"))
    return g.select("page", F.round(A.union_area("boxes"), 3).alias("area"))


def cluster_boxes(spark, d):
    b = _blocks(spark, d).withColumn("drawing_no", F.col("ord") * 10)
    b = b.groupBy("doc_id", "page", "drawing_no").agg(G.box(*[F.min(f"bbox.{k}") for k in ("x0", "y0", "x1", "y1")]).alias("bbox"))
    return ordering.cluster_boxes(b).groupBy("page").agg(F.count_distinct("cluster").alias("n_clusters"))


def layout_order(spark, d):
    wide = G.width(F.col("bbox")) >= 180
    out = ordering.layout_order(_blocks(spark, d), ["page"], wide, F.when(F.col("bbox.x1") <= 300, 0).when(F.col("bbox.x0") >= 300, 1).otherwise(2))
    return out.select("page", "block_id", "zone", "position")


def element_ids(spark, d):
    b = _blocks(spark, d).withColumn("type", F.lower("kind"))
    return elements.element_ids(b, ["ord", "block_id"]).select("page", "block_id", "element_id")


def furniture_classes(spark, d):
    b = _blocks(spark, d)
    c = elements.furniture(F.col("bbox"), F.concat(F.lit("- "), (F.col("ord") % 100).cast("string"), F.lit(" -")), F.lit(900.0), F.lit(500.0), F.col("kind") == "A")
    return b.select(c.alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def weighted_size_mode(spark, d):
    b = _blocks(spark, d).select("page", F.round(G.height(F.col("bbox"))).cast("long").alias("size"), F.round(G.width(F.col("bbox"))).cast("long").alias("w"))
    return corpus.weighted_mode(b, "page", "size", F.col("w"), F.col("size"))


def type_tally(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "lineitem").select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return gates.tally(o, "o_orderstatus", F.col("l_orderkey").isNotNull(), F.col("o_totalprice") > 50000)


def set_reconciliation(spark, d):
    p = reconcile.presence({"ordered": table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "lined": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))}, ["k"])
    return p.groupBy("ordered", "lined").agg(F.count("*").alias("n"))


def round_diff(spark, d):
    """Customers with orders that are not open, before; with orders that are not filled, after."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return reconcile.compare_rounds(o.where("o_orderstatus <> 'O'").select("id"), o.where("o_orderstatus <> 'F'").select("id"), ["id"])


def duplicate_ids(spark, d):
    return reconcile.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def batch_results(spark, d):
    """Orders as units; each line is a result, returned ones under an id that no unit has."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"))
    li = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")).alias("unit_id"))
    return reconcile.batch_results(o, li).groupBy("code").agg(F.count("*").alias("n"))


def render_contract(spark, d):
    o = table(spark, d, "orders")
    source = o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 100000).alias("required"))
    plan = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    cand = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_returnflag") != "R").alias("located"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("omit_reason"))
    return reconcile.contract(source, plan, cand, ["F"]).groupBy("code").agg(F.count("*").alias("n"))


def plan_execution(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return reconcile.execution(o, li.select("l_orderkey").distinct(), o, o.where("o_totalprice < 0"))


def visual_gate(spark, d):
    ev = table(spark, d, "events")
    req = ev.select(F.col("user_id").alias("page"), F.col("event_type").alias("element_id"), F.lit("check").alias("code"))
    named = F.when(F.col("value") > 9, "other").otherwise(F.col("event_type"))
    given = ev.select(F.col("user_id").alias("page"), named.alias("element_id"), F.lit("check").alias("code"), F.when(F.col("value") > 5, "pass").otherwise("fail").alias("answer"))
    return reconcile.answer_problems(req, given, ["page", "element_id", "code"]).groupBy("problem").agg(F.count("*").alias("n"))


def followup_pages(spark, d):
    """Pages of one block of kind R have changed; their neighbours and pages of their types follow."""
    pages = _blocks(spark, d).groupBy("doc_id", "page").agg(F.min("kind").alias("type"), F.count("*").alias("n"))
    changed = pages.where("n = 1 and type = 'R'").select("doc_id", "page")
    pages = pages.drop("n")
    out = reconcile.followup_pages(changed, pages)
    return out.agg(F.count("*").alias("n"), F.min("page").alias("lo"), F.max("page").alias("hi"))


def merge_terms(spark, d):
    """Brands and their first type as known terms; types and their first brand, and brands of large parts with their last type, as new ones."""
    p = table(spark, d, "part")
    old = p.groupBy(F.col("p_brand").alias("source")).agg(F.min("p_type").alias("target"))
    new = p.groupBy(F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.col("p_type")).alias("source")).agg(F.max(F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_brand"))).alias("target"))
    return reconcile.merge_terms(old, new)


def carry_forward(spark, d):
    ev = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", F.col("event_id"))
    return elements.carry_forward(ev, ["user_id"], ["ts", "event_id"], kind, "last_seen").select("event_id", "last_seen")


def gap_islands(spark, d):
    ev = table(spark, d, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return ordering.islands(ev, ["user_id"], ["s", "event_id"], F.col("s"), F.col("s"), 3600).groupBy("user_id").agg((F.max("island")).alias("n_islands"))


def risk_rank_budget(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("score"))
    return ordering.rank_with_budget(s, [], [F.desc("score"), "user_id"], 6).select("user_id", "rank", "selected")


def risk_scores(spark, d):
    kinds = list(policy.RISK_WEIGHTS)[:5]
    ev = table(spark, d, "events").withColumn("code", F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("event_id") % 5).cast("int"))).withColumn("element_id", F.col("event_type"))
    return policy.risk_scores(ev, ["user_id"])


def inversion_count(spark, d):
    ship(spark)
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return ordering.inversions(li, ["l_orderkey"], "l_linenumber", "l_shipdate")


def union_length(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1970-01-01")).alias("s"))
    return ordering.union_length(o, ["o_custkey"], F.col("s"), F.col("s") + 90)


def metric_summary(spark, d):
    ev = table(spark, d, "events")
    modes = ev.select("event_type").distinct().unionByName(spark.range(1).select(F.lit("never").alias("event_type")))
    return gates.metric_summary(ev, modes, "event_type", F.col("event_id") % 2 == 0, F.col("value") > 5, F.col("value"))


def newest_files(spark, d):
    o = table(spark, d, "orders")
    out = ordering.newest(o, "o_orderstatus", [F.desc("o_orderdate"), F.desc("o_orderkey")], 100, F.col("o_orderpriority").startswith("1"))
    return out.groupBy("o_orderstatus").agg(F.count_if("prune").alias("n_pruned"))


def compare_runs(spark, d):
    ev = table(spark, d, "events")
    half = lambda k: ev.where(F.col("event_id") % 2 == k).groupBy("event_type").agg(F.count("*").alias("n"))
    return gates.compare_runs(half(0), half(1), "event_type", "n")


def fallback_plan(spark, d):
    p = table(spark, d, "part")
    kinds = ["table", "chart", "body", "footnote", "display-formula", "header"]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 6).cast("int"))
    e = p.select(
        "p_partkey", kind.alias("type"), (F.col("p_size") / 50.0).alias("confidence"), (F.col("p_size") % 4).alias("rows"), (F.col("p_size") % 3).alias("columns"), F.lit(False).alias("unresolved"),
        (F.col("p_partkey") % 3).alias("labels"), (F.col("p_size") / 50.0).alias("label_confidence"), F.when(F.col("p_partkey") % 13 == 0, "furniture").alias("omit_code"),
    )
    out = policy.render_plan(e, policy.modes(spark).where("quality_mode = 'balanced'"))
    return out.select("p_partkey", "strategy", F.size("fallback_levels").alias("n_levels"), "fallback", "status", "low_confidence")


def nearest_bind(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    ship(spark)
    return binding.fingerprint_nearest(v, v, "label", 0.118, 0.12).select("id", "nearest")


def first_by_key(spark, d):
    return corpus.first_seen(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


def anchor_cascade(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    li = table(spark, d, "lineitem")
    by = lambda flag: li.where(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_linenumber").alias("page"))
    return binding.cascade(o, [("A", by("A")), ("R", by("R")), ("N", by("N"))], "id", "page")


def streaming_window(spark, d):
    return ledger.windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        overlap_bind, box_pairs, nearest_boxes, caption_above, centre_inside, covered_boxes, uncovered_boxes, union_boxes, union_area, cluster_boxes,
        layout_order, element_ids, furniture_classes, weighted_size_mode, type_tally, set_reconciliation, round_diff, duplicate_ids, batch_results,
        render_contract, plan_execution, visual_gate, followup_pages, merge_terms, carry_forward, gap_islands, risk_rank_budget, risk_scores,
        inversion_count, union_length, metric_summary, newest_files, compare_runs, fallback_plan, nearest_bind, first_by_key, anchor_cascade, streaming_window,
    )
}

ORACLES = {
    "overlap_bind": f"""WITH {_BLOCKS}, m AS (SELECT p.block_id AS unit_id, q.block_id AS e, {_OVER} / p.area AS s, q.ord, p.page FROM ba p JOIN ba q ON p.page = q.page AND p.kind = 'R' AND q.kind = 'N' AND {_OVER} / p.area >= 0.25),
        g AS (SELECT unit_id, doc, e FROM (SELECT unit_id, 0 AS doc, e, row_number() OVER (PARTITION BY unit_id ORDER BY s DESC, ord DESC) AS r FROM m) WHERE r = 1) SELECT unit_id, count(*) AS n, min(e) AS "first" FROM g GROUP BY unit_id""",
    "box_pairs": f"""WITH {_BLOCKS} SELECT p.page, p.ord AS "first", q.ord AS second, round({_OVER} / least(p.area, q.area), 6) AS share FROM ba p JOIN ba q ON p.page = q.page AND p.ord < q.ord AND {_OVER} / least(p.area, q.area) >= 0.35""",
    "nearest_boxes": f"""WITH {_BLOCKS}, m AS (SELECT p.page, p.block_id, min({_DIST}) AS dist FROM ba p JOIN ba q ON p.page = q.page AND p.kind = 'R' AND q.kind = 'N' GROUP BY 1, 2) SELECT page, count(*) AS n, round(min(dist), 6) AS nearest FROM m WHERE dist <= 90 GROUP BY page""",
    "caption_above": f"""WITH {_BLOCKS} SELECT 0 AS doc_id, count(DISTINCT p.block_id) AS n FROM ba p JOIN ba q ON p.page = q.page AND p.kind = 'N' AND q.kind = 'R' AND p.y0 - q.y1 BETWEEN 0 AND 60""",
    "centre_inside": f"""WITH {_BLOCKS} SELECT page, count(*) AS n FROM ba p WHERE kind = 'R' AND EXISTS (SELECT 1 FROM ba q WHERE q.page = p.page AND q.kind = 'N' AND (p.x0 + p.x1) / 2 BETWEEN q.x0 AND q.x1 AND (p.y0 + p.y1) / 2 BETWEEN q.y0 AND q.y1) GROUP BY page""",
    "covered_boxes": f"""WITH {_BLOCKS} SELECT 0 AS doc_id, count(*) AS n FROM ba p WHERE kind = 'A' AND EXISTS (SELECT 1 FROM ba q WHERE q.page = p.page AND q.kind = 'N' AND {_OVER} / p.area >= 0.3)""",
    "uncovered_boxes": f"""WITH {_BLOCKS} SELECT 0 AS doc_id, count(*) AS n FROM ba p WHERE kind = 'A' AND NOT EXISTS (SELECT 1 FROM ba q WHERE q.page = p.page AND q.kind = 'N' AND ({_OVER} / p.area >= 0.5
        OR ((p.x0 + p.x1) / 2 BETWEEN q.x0 AND q.x1 AND (p.y0 + p.y1) / 2 BETWEEN q.y0 AND q.y1)))""",
    "union_boxes": f"WITH {_BLOCKS} SELECT page, round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1 FROM b GROUP BY page",
    "union_area": f"""WITH {_BLOCKS}, e AS (SELECT page, x0 AS x FROM b UNION SELECT page, x1 FROM b), s AS (SELECT page, x AS lo, lead(x) OVER (PARTITION BY page ORDER BY x) AS hi FROM e),
        i AS (SELECT DISTINCT s.page, lo, hi, y0, y1 FROM s JOIN b ON b.page = s.page AND b.x0 <= lo AND b.x1 >= hi WHERE hi IS NOT NULL), r AS (SELECT *, max(y1) OVER (PARTITION BY page, lo ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM i)
        SELECT page, round(sum((hi - lo) * greatest(0, y1 - greatest(y0, coalesce(upto, y0)))), 3) AS area FROM r GROUP BY page""",
    "layout_order": f"""WITH {_BLOCKS}, w AS (SELECT *, x1 - x0 >= 180 AS wide, CASE WHEN x1 <= 300 THEN 0 WHEN x0 >= 300 THEN 1 ELSE 2 END AS side FROM b),
        z AS (SELECT *, coalesce(sum(wide::INT) OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, x0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS zone FROM w)
        SELECT page, block_id, zone, row_number() OVER (PARTITION BY page ORDER BY zone, CASE WHEN wide THEN 3 ELSE side END, y0, x0, ord) AS position FROM z""",
    "element_ids": f"""WITH {_BLOCKS} SELECT page, block_id, printf('p%04d-%s-%03d', page, lower(kind), row_number() OVER (PARTITION BY page, kind ORDER BY ord, block_id)) AS element_id FROM b""",
    "furniture_classes": f"""WITH {_BLOCKS} SELECT CASE WHEN x1 - x0 <= 0.12 * 900 AND (y0 / 500 <= 0.15 OR y1 / 500 >= 0.85) THEN 'page-number' WHEN kind = 'A' AND y0 / 500 <= 0.08 THEN 'header' WHEN kind = 'A' AND y1 / 500 >= 0.92 THEN 'footer' END AS class, count(*) AS n FROM b GROUP BY 1""",
    "weighted_size_mode": f"""WITH {_BLOCKS}, s AS (SELECT page, round(y1 - y0)::BIGINT AS size, sum(round(x1 - x0)::BIGINT)::BIGINT AS weight FROM b GROUP BY 1, 2) SELECT page, size, weight FROM s QUALIFY row_number() OVER (PARTITION BY page ORDER BY weight DESC, size DESC) = 1""",
    "type_tally": """WITH o AS (SELECT o_orderstatus, o_totalprice > 50000 AS req, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS loc FROM orders)
        SELECT o_orderstatus, count(*) AS source, count(*) FILTER (loc) AS located, count(*) FILTER (req) AS required, count(*) FILTER (req AND NOT loc) AS missing_required, count(*) FILTER (loc) / count(*) AS coverage FROM o GROUP BY 1""",
    "set_reconciliation": """WITH k AS (SELECT o_orderkey AS k, 1 AS a, 0 AS b FROM orders UNION ALL SELECT l_orderkey, 0, 1 FROM lineitem), g AS (SELECT k, max(a) = 1 AS ordered, max(b) = 1 AS lined FROM k GROUP BY k) SELECT ordered, lined, count(*) AS n FROM g GROUP BY 1, 2""",
    "round_diff": """WITH g AS (SELECT o_custkey AS id, bool_or(o_orderstatus <> 'O') AS a, bool_or(o_orderstatus <> 'F') AS b FROM orders GROUP BY 1)
        SELECT id, CASE WHEN a AND b THEN 'still' WHEN a THEN 'fixed' ELSE 'regression' END AS fate FROM g""",
    "duplicate_ids": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "batch_results": """WITH e AS (SELECT DISTINCT o_orderkey AS u FROM orders), r AS (SELECT CASE WHEN l_returnflag = 'R' THEN -l_orderkey - 1 ELSE l_orderkey END AS u, count(*) AS n FROM lineitem GROUP BY 1),
        j AS (SELECT CASE WHEN r.u IS NULL THEN 'missing' WHEN e.u IS NULL THEN 'foreign' WHEN n > 1 THEN 'duplicate' END AS code FROM e FULL JOIN r ON e.u = r.u) SELECT code, count(*) AS n FROM j WHERE code IS NOT NULL GROUP BY 1""",
    "render_contract": """WITH s AS (SELECT o_orderkey AS id, o_totalprice > 100000 AS req FROM orders), p AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'),
        c AS (SELECT l_orderkey AS id, l_returnflag <> 'R' AS loc, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS why FROM lineitem), f AS (
        SELECT DISTINCT 'UNSOURCED_PLAN' AS code, id FROM p WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT DISTINCT 'UNPLANNED', id FROM s WHERE req AND id NOT IN (SELECT id FROM p)
        UNION ALL SELECT DISTINCT 'UNKNOWN_CANDIDATE', id FROM c WHERE id NOT IN (SELECT id FROM s)
        UNION ALL SELECT DISTINCT 'MISSING', id FROM s WHERE req AND id NOT IN (SELECT id FROM c WHERE loc) AND id NOT IN (SELECT id FROM c WHERE why = 'F')
        UNION ALL SELECT 'DUPLICATE', id FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'ILLEGAL_OMISSION', id FROM c WHERE why <> 'F') SELECT code, count(*) AS n FROM f GROUP BY code""",
    "plan_execution": """WITH a AS (SELECT (SELECT count(*) FROM orders) AS planned, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS applied, (SELECT count(*) FROM orders) AS document, 0::BIGINT AS pending) SELECT *, planned = applied AND applied = document AND pending = 0 AS agrees FROM a""",
    "visual_gate": """WITH r AS (SELECT DISTINCT user_id, event_type FROM events), g AS (SELECT user_id, CASE WHEN value > 9 THEN 'other' ELSE event_type END AS event_type, count(*) AS n, bool_and(value > 5) AS ok FROM events GROUP BY 1, 2),
        j AS (SELECT CASE WHEN n IS NULL THEN 'incomplete' WHEN r.user_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' WHEN NOT ok THEN 'fail' END AS problem FROM r FULL JOIN g ON r.user_id = g.user_id AND r.event_type = g.event_type) SELECT problem, count(*) AS n FROM j GROUP BY 1""",
    "followup_pages": f"""WITH {_BLOCKS}, p AS (SELECT page, min(kind) AS type, count(*) AS n FROM b GROUP BY 1), c AS (SELECT page FROM p WHERE n = 1 AND type = 'R'), n AS (SELECT page - 1 AS page FROM c UNION SELECT page FROM c UNION SELECT page + 1 FROM c UNION SELECT page FROM p WHERE type IN (SELECT type FROM p WHERE n = 1 AND type = 'R'))
        SELECT count(*) AS n, min(page) AS lo, max(page) AS hi FROM n WHERE page IN (SELECT page FROM p)""",
    "merge_terms": """WITH o AS (SELECT p_brand AS source, min(p_type) AS target FROM part GROUP BY 1), n AS (SELECT CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS source, max(CASE WHEN p_size > 25 THEN p_type ELSE p_brand END) AS target FROM part GROUP BY 1)
        SELECT coalesce(n.source, o.source) AS source, coalesce(n.target, o.target) AS target FROM o FULL JOIN n ON o.source = n.source""",
    "carry_forward": """WITH e AS (SELECT *, CASE WHEN event_type = 'click' THEN event_id END AS k FROM events) SELECT event_id, last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_seen FROM e""",
    "gap_islands": """WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s FROM events), n AS (SELECT user_id, CASE WHEN lag(s) OVER w IS NULL OR s - lag(s) OVER w > 3600 THEN 1 ELSE 0 END AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)) SELECT user_id, sum(x)::BIGINT AS n_islands FROM n GROUP BY 1""",
    "risk_rank_budget": """WITH s AS (SELECT user_id, round(sum(value), 2) AS score FROM events GROUP BY 1), r AS (SELECT user_id, row_number() OVER (ORDER BY score DESC, user_id) AS rank FROM s) SELECT *, rank <= 6 AS selected FROM r""",
    "risk_scores": """WITH w(k, x) AS (VALUES (0, 10.0), (1, 9.0), (2, 7.0), (3, 6.0), (4, 5.0)) SELECT user_id, round(sum(x)::DOUBLE, 2) AS score, count(DISTINCT event_type) AS n_elements FROM events JOIN w ON event_id % 5 = k GROUP BY user_id""",
    "inversion_count": """SELECT a.l_orderkey, count(*) AS comparable, count(*) FILTER (a.l_shipdate > b.l_shipdate) AS discordant FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_shipdate <> b.l_shipdate GROUP BY 1""",
    "union_length": """WITH o AS (SELECT o_custkey, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS s FROM orders), r AS (SELECT *, max(s + 90) OVER (PARTITION BY o_custkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM o),
        i AS (SELECT *, sum(CASE WHEN upto IS NULL OR s > upto THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM r), g AS (SELECT o_custkey, k, max(s + 90) - min(s) AS l FROM i GROUP BY 1, 2) SELECT o_custkey, sum(l)::BIGINT AS length, count(*) AS n_islands FROM g GROUP BY 1""",
    "metric_summary": """WITH m AS (SELECT DISTINCT event_type FROM events UNION ALL SELECT 'never'), g AS (SELECT event_type, count(*) AS n_events, count(*) FILTER (event_id % 2 = 0) AS runs, count(*) FILTER (event_id % 2 = 0 AND value > 5) AS passes, median(value) FILTER (event_id % 2 = 0) AS median_seconds FROM events GROUP BY 1)
        SELECT event_type, coalesce(n_events, 0) AS n_events, coalesce(runs, 0) AS runs, coalesce(passes, 0) AS passes, median_seconds, CASE WHEN runs > 0 THEN passes / runs END AS pass_rate FROM m LEFT JOIN g USING (event_type)""",
    "newest_files": """WITH o AS (SELECT *, starts_with(o_orderpriority, '1') AS safe FROM orders), r AS (SELECT o_orderstatus, NOT safe AND row_number() OVER (PARTITION BY o_orderstatus, safe ORDER BY o_orderdate DESC, o_orderkey DESC) > 100 AS prune FROM o) SELECT o_orderstatus, count(*) FILTER (prune) AS n_pruned FROM r GROUP BY 1""",
    "compare_runs": """WITH g AS (SELECT event_type, count(*) FILTER (event_id % 2 = 0) AS before, count(*) FILTER (event_id % 2 = 1) AS after FROM events GROUP BY 1) SELECT *, (after - before) / before * 100 AS percent FROM g""",
    "fallback_plan": """WITH p AS (SELECT p_partkey, (['table', 'chart', 'body', 'footnote', 'display-formula', 'header'])[(p_partkey % 6)::INT + 1] AS type, p_size / 50.0::DOUBLE AS conf, p_size % 4 AS r, p_size % 3 AS c, p_partkey % 3 AS labels, p_partkey % 13 = 0 AS omit FROM part),
        s AS (SELECT *, CASE WHEN omit OR type = 'header' THEN 'omit-nonsemantic' WHEN type = 'table' THEN CASE WHEN conf >= 0.85::DOUBLE AND r >= 2 AND c >= 2 THEN 'structured-table-rebuild' ELSE 'preserve-table-region-with-translation-key' END
        WHEN type = 'chart' THEN CASE WHEN labels > 0 AND conf >= 0.8::DOUBLE THEN 'preserve-geometry-with-label-overlay' ELSE 'preserve-geometry-with-numbered-legend' END
        WHEN type = 'footnote' THEN 'translate-and-render-as-footnote' WHEN type = 'display-formula' THEN 'preserve-formula-region' ELSE 'translate-and-reflow' END AS strategy FROM p)
        SELECT p_partkey, strategy, CASE WHEN strategy <> 'omit-nonsemantic' AND type IN ('table', 'chart', 'display-formula') THEN 3 ELSE 1 END AS n_levels,
        CASE WHEN strategy <> 'omit-nonsemantic' AND type IN ('table', 'chart', 'display-formula') THEN 'preserve-element-region' END AS fallback, CASE WHEN strategy = 'omit-nonsemantic' THEN 'omitted' ELSE 'ready' END AS status, conf < 0.7::DOUBLE AS low_confidence FROM s""",
    "nearest_bind": """WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: pow(x - list_avg(v), 2))) / len(v)) AS s FROM v),
        p AS (SELECT a.id, b.id AS other, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) / len(a.v) AS d FROM c a JOIN c b ON a.label = b.label AND a.id <> b.id WHERE a.s >= 0.12 AND b.s >= 0.12)
        SELECT id, arg_min(other, d) AS nearest FROM p GROUP BY 1 HAVING min(d) <= 0.118""",
    "cluster_boxes": f"""WITH RECURSIVE {_BLOCKS}, d AS (SELECT page, ord, min(x0) AS x0, min(y0) AS y0, min(x1) AS x1, min(y1) AS y1, count(*) AS n FROM b GROUP BY 1, 2),
        j AS (SELECT p.page, p.ord AS a, q.ord AS c FROM d p JOIN d q ON p.page = q.page AND p.x0 - 14 <= q.x1 AND p.x1 + 14 >= q.x0 AND p.y0 - 14 <= q.y1 AND p.y1 + 14 >= q.y0),
        z AS (SELECT page, a, c FROM j UNION SELECT z.page, z.a, j.c FROM z JOIN j ON z.page = j.page AND z.c = j.a), g AS (SELECT page, a, min(c) AS m FROM z GROUP BY 1, 2) SELECT page, count(DISTINCT m) AS n_clusters FROM g GROUP BY 1""",
    "first_by_key": "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1",
    "anchor_cascade": """WITH m AS (SELECT l_orderkey AS id, min(l_linenumber) FILTER (l_returnflag = 'A') AS a, min(l_linenumber) FILTER (l_returnflag = 'R') AS r, min(l_linenumber) FILTER (l_returnflag = 'N') AS n FROM lineitem GROUP BY 1)
        SELECT o_orderkey AS id, coalesce(a, r, n) AS page, CASE WHEN a IS NOT NULL THEN 'A' WHEN r IS NOT NULL THEN 'R' WHEN n IS NOT NULL THEN 'N' ELSE 'none' END AS method FROM orders LEFT JOIN m ON m.id = o_orderkey""",
    "streaming_window": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
}
