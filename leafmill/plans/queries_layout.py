"""Registered queries over pages laid out from given tables: payloads, chains, notes, figures and tables, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import geom as G
from leafmill.operators import chains, detect, footnotes, splice
from leafmill.session import cut, ship, table


def _payloads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents as units, eight to a page; two pages of three have a payload made of the lines 2 to 5 of the page."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))
    k = F.col("k")
    units = lines.select(
        "doc_id",
        k.alias("unit_id"),
        k.alias("ord"),
        (F.floor(k / 8) + 1).cast("int").alias("page"),
        G.box(F.lit(0.0), (k % 8 * 10).cast("double"), F.lit(100.0), (k % 8 * 10 + 8).cast("double")).alias("bbox"),
        F.when(k % 8 == 2, "table-row").otherwise("body").alias("kind"),
        F.regexp_replace(F.lower("line"), "[^a-z0-9]", "").alias("token"),
        F.when((k + F.col("doc_id")) % 11 == 0, "name").alias("keep_reason"),
    )
    s = F.col("doc_id") + F.col("page")
    rows = F.array_sort(F.collect_list(F.when((F.col("ord") % 8).between(2, 5), F.struct("ord", "token"))))
    items = units.groupBy("doc_id", "page").agg(F.concat_ws("", F.transform(rows, lambda x: x["token"])).alias("token"), F.min("ord").alias("top"))
    items = items.where(s % 3 != 0).select(
        "doc_id",
        F.concat(F.lit("p"), F.col("page")).alias("item_id"),
        F.col("page").alias("ord"),
        F.when(s % 7 == 0, "draft").otherwise("ready").alias("status"),
        F.array("page").alias("pages"),
        F.when(s % 2 == 0, F.array(F.struct(F.when(s % 4 == 0, F.col("page")).otherwise(F.col("page") + 1).alias("page"), G.box(F.lit(0.0), F.lit(30.0), F.lit(100.0), F.lit(48.0)).alias("bbox")))).alias("regions"),
        "token",
        F.when(s % 5 < 3, "structured-table-rebuild").otherwise("manual").alias("method"),
        F.when(s % 5 == 1, F.col("top") + 3).when(s % 5 == 4, F.lit(-1)).alias("anchor_id"),
    )
    return units, items


def payload_units(spark, d):
    units, items = _payloads(spark, d)
    return splice.replaced(units, items, splice.within).select("doc_id", "item_id", F.col("unit_id").cast("long").alias("unit_id"))


def payload_sequence(spark, d):
    units, items = _payloads(spark, d)
    taken = cut(splice.replaced(units, items, splice.within))
    return splice.sequence(units, items, taken).withColumn("position", F.col("position").cast("long"))


def payload_problems(spark, d):
    units, items = _payloads(spark, d)
    return splice.problems(units, items, cut(splice.replaced(units, items, splice.within)))


def payload_coverage(spark, d):
    """The same with the coverage of matching blocks, which also finds lines that the payload holds in pieces."""
    ship(spark)
    units, items = _payloads(spark, d)
    return splice.replaced(units, items).groupBy("doc_id").agg(F.count("*").alias("n"))


def _flow(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders of a customer as pages of a document, lines as units: two columns, texts and places from the given numbers."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"))
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min(F.col("l_quantity").cast("int")).alias("q"))
    wide, low = F.when(F.col("s") % 3 == 0, 300.0).otherwise(0.0), F.when(F.col("q") % 3 == 0, 10.0).otherwise(640.0)
    ends = F.element_at(F.array(F.lit(" and goes on"), F.lit(" and goes on 12"), F.lit("."), F.lit(' ends?" 3'), F.lit(" short")), (F.col("p") % 5 + 1).cast("int"))
    body = F.concat(F.lit("Some words of unit "), F.col("p"), ends)
    units = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "doc_id",
        F.concat_ws("-", "o_orderkey", "l_linenumber").alias("unit_id"),
        F.col("l_linenumber").alias("ord"),
        "page",
        G.box(wide, low, wide + 250 + F.col("q") % 4 * 10, low + 100).alias("bbox"),
        F.when(F.col("s") % 7 == 0, "heading").otherwise("body").alias("kind"),
        F.when((F.col("q") % 5 == 0) & (F.col("l_linenumber") > 1), F.concat(F.lit("12 note "), F.col("p"))).otherwise(body).alias("source"),
        F.concat(F.lit("target "), F.col("p")).alias("target"),
    )
    return units, o.select("doc_id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


def page_continuations(spark, d):
    return chains.continuations(*_flow(spark, d))


def continuation_chains(spark, d):
    return chains.rank(chains.continuations(*_flow(spark, d)), ["doc_id"], "unit_id", "next_id")


def customer_chains(spark, d):
    """Each order of a customer and the one after it: chains as long as customers have orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(w).alias("next"))
    return chains.rank(edges, ["o_custkey"], "o_orderkey", "next")


def _sheets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """blocks, drawings, pages: an order is a page, its lines are blocks, and each line has a thin drawing and a solid one."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min(F.col("l_quantity").cast("int")).alias("q"))
    key = [(F.col("l_orderkey") % 5).cast("int").alias("doc_id"), F.col("l_orderkey").alias("page")]
    n, p, s, q = (F.col(c) for c in ("l_linenumber", "p", "s", "q"))
    y = (n * 90 + p % 50).cast("double")
    body = F.concat(F.lit("Block "), p, F.lit(" with text  and more of it"), F.when(p % 2 == 0, F.lit(", long enough to count as prose of the page, whatever it says there")).otherwise(""))
    text = F.when(p % 7 == 0, F.concat(F.lit("Table "), n, F.lit(" of parts"))).when(p % 3 == 0, F.concat(n, F.lit(" note on part "), p, F.lit("\n"), n + 1, F.lit(". another\nthat goes on"))).otherwise(body)
    blocks = li.select(*key, n.alias("block_id"), n.alias("ord"), G.box(F.lit(50.0) + q % 3 * 5, y, F.lit(300.0) + q % 3 * 5, y + 30).alias("bbox"), text.alias("text"), F.when(q % 4 == 0, 7.0).otherwise(10.0).alias("font_size"), (s % 17 == 0).alias("furniture"))
    rule = li.where("l_linenumber <= 2").select(*key, (n * 10).cast("long").alias("drawing_no"), G.box(F.lit(50.0), F.lit(100.0) + n * 100 + s % 3 * 60, F.lit(300.0) + p % 2 * 100, F.lit(101.0) + n * 100 + s % 3 * 60).alias("bbox"))
    short = li.where("l_linenumber > 2").select(*key, (n * 10).cast("long").alias("drawing_no"), G.box(F.lit(50.0), F.lit(420.0) + q * 4, F.lit(50.0) + p % 20 * 2, F.lit(421.0) + q * 4).alias("bbox"))
    solid = li.select(*key, (n * 10 + 1).cast("long").alias("drawing_no"), G.box(F.lit(350.0) + p % 200, F.lit(100.0) + s % 10 * 40, F.lit(410.0) + p % 200, F.lit(160.0) + s % 10 * 40).alias("bbox"))
    return blocks, rule.unionByName(short).unionByName(solid), li.select(*key).distinct().select("doc_id", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


def footnote_blocks(spark, d):
    out = footnotes.detect(*_sheets(spark, d))
    return out.select("page", "block_id", "marked", "has_separator", "font_size", "body_size", "confidence")


def footnote_entries(spark, d):
    blocks, _, _ = _sheets(spark, d)
    return footnotes.entries(blocks, ["page", "block_id"])


def footnote_markers(spark, d):
    """Numbers in body blocks of a page against the entries of its notes, in order."""
    blocks, _, _ = _sheets(spark, d)
    ship(spark)
    found = footnotes.entries(blocks, ["doc_id", "page", "block_id"]).select("doc_id", "page", (F.col("block_id") * 100 + F.col("entry")).alias("ord"), F.col("marker").alias("label"))
    markers = blocks.where("text not like '%note%'").select("doc_id", "page", "ord", (F.col("ord") + 1).cast("string").alias("label"))
    out = footnotes.bind_markers(markers, found)
    return out.groupBy("doc_id", "page").agg(F.count_if(F.col("marker_ord").isNotNull() & F.col("entry_ord").isNotNull()).alias("n_bound"), F.count_if(F.col("entry_ord").isNull()).alias("n_orphans"), F.count_if(F.col("marker_ord").isNull()).alias("n_missing"))


def vector_figures(spark, d):
    _, drawings, pages = _sheets(spark, d)
    ship(spark)
    out = detect.vector_figures(drawings, pages, least=3)
    return out.select("page", "figure_no", "n_drawings", "n_solid", "area_ratio", "confidence", F.col("bbox.x0").alias("x0"), F.col("bbox.y1").alias("y1"))


def grown_figures(spark, d):
    """Clusters of drawings with the text blocks that their boxes take in, to a fixpoint."""
    blocks, drawings, pages = _sheets(spark, d)
    ship(spark)
    figures = detect.vector_figures(drawings, pages, least=2, share=0.0)
    return detect.grow(figures, blocks.select("doc_id", "page", "bbox"), 30.0).select("page", "n_figures", "n_labels", F.round("bbox.x0", 3).alias("x0"), F.round("bbox.y0", 3).alias("y0"))


def page_tables(spark, d):
    blocks, drawings, pages = _sheets(spark, d)
    out = detect.tables(blocks, drawings, pages)
    return out.select("page", "n_rules", "rows", "columns", F.array_join(F.col("block_ids").cast("array<string>"), ",").alias("block_ids"), F.col("caption_block_id").cast("long").alias("caption_block_id"), F.array_join("signals", ",").alias("signals"), "confidence")


def table_lattice(spark, d):
    """Blocks of a page as cells of a table with spans."""
    blocks, _, _ = _sheets(spark, d)
    ship(spark)
    cells = blocks.select("doc_id", "page", F.lit(0).alias("region"), "ord", G.box(F.col("ord") % 3 * 100.0, F.floor(F.col("ord") / 3) * 30.0, F.col("ord") % 3 * 100.0 + F.when(F.col("ord") == 3, 280.0).otherwise(80.0), F.floor(F.col("ord") / 3) * 30.0 + 20).alias("bbox"))
    return detect.lattice(cells).groupBy("page").agg(F.max("row_no").alias("rows"), F.max("column_no").alias("columns"), F.count_if(F.col("column_span") > 1).alias("n_spans"), F.count_if("header").alias("n_header"))


QUERIES = {f.__name__: f for f in (footnote_blocks, footnote_entries, footnote_markers, vector_figures, grown_figures, page_tables, table_lattice, page_continuations, continuation_chains, customer_chains, payload_units, payload_sequence, payload_problems, payload_coverage)}

_PAY = r"""u AS MATERIALIZED (SELECT doc_id, (i - 1)::BIGINT AS k, (i - 1) // 8 + 1 AS page, (i - 1) % 8 AS r, regexp_replace(lower(line), '[^a-z0-9]', '', 'g') AS t, (i - 1 + doc_id) % 11 = 0 AS stays
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
  it AS MATERIALIZED (SELECT doc_id, page, 'p' || page AS item_id, coalesce(string_agg(t, '' ORDER BY k) FILTER (r BETWEEN 2 AND 5), '') AS p, doc_id + page AS s, CASE WHEN (doc_id + page) % 5 = 1 THEN min(k) + 3 WHEN (doc_id + page) % 5 = 4 THEN -1 END AS anchor FROM u GROUP BY 1, 2 HAVING (doc_id + page) % 3 <> 0 AND (doc_id + page) % 7 <> 0),
  r0 AS (SELECT u.doc_id, item_id, u.page, k, r, t, stays, p, s, anchor, s % 5 < 3 AS m, s % 4 = 0 AND r * 10 + 4 BETWEEN 30 AND 48 AS held, t <> '' AND contains(p, t) AS covered FROM u JOIN it ON u.doc_id = it.doc_id AND u.page = it.page),
  r1 AS (SELECT *, held OR covered AND length(t) >= 20 AND length(p) >= 20 AS seed, sum(CASE WHEN covered THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, item_id ORDER BY k) AS run FROM r0),
  r2 AS (SELECT *, covered AND max(CASE WHEN covered AND (seed OR r = 2) THEN 1 ELSE 0 END) OVER w = 1 AND sum(CASE WHEN covered THEN length(t) ELSE 0 END) OVER w >= 20 AS whole, m AND max(CASE WHEN k = anchor THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id) = 1 AS span FROM r1 WINDOW w AS (PARTITION BY doc_id, item_id, run)),
  r3 AS (SELECT *, (seed OR whole) AND NOT (span AND k < anchor AND NOT held) AS taken FROM r2),
  r4 AS (SELECT *, max(CASE WHEN taken THEN k END) OVER w AS hi, CASE WHEN span THEN anchor ELSE min(CASE WHEN taken THEN k END) OVER w END AS lo FROM r3 WINDOW w AS (PARTITION BY doc_id, item_id)),
  tk AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, k FROM (SELECT doc_id, item_id, k FROM r4 WHERE CASE WHEN length(p) >= 20 THEN taken OR coalesce(k BETWEEN lo AND hi AND (span AND NOT stays OR length(t) >= 2 AND contains(p, t)), false) ELSE seed END
    UNION ALL SELECT u.doc_id, it.item_id, u.k FROM it JOIN u ON u.doc_id = it.doc_id AND u.page = it.page + 1 AND it.s % 2 = 0 AND it.s % 4 <> 0 AND u.r * 10 + 4 BETWEEN 30 AND 48))"""
_SPANS = "sp AS (SELECT doc_id, item_id, min(k) AS lo, max(k) AS hi, count(*) AS n FROM tk GROUP BY 1, 2), pl AS (SELECT it.*, sp.lo, sp.hi, sp.n, EXISTS (SELECT 1 FROM u WHERE u.doc_id = it.doc_id AND u.k = anchor) AS here FROM it LEFT JOIN sp USING (doc_id, item_id))"

_FLOW = r"""o AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders),
  li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity::INT) AS q FROM lineitem GROUP BY 1, 2),
  un AS (SELECT doc_id, page, concat_ws('-', o_orderkey, l_linenumber) AS id, l_linenumber AS ord, CASE WHEN s % 3 = 0 THEN 300 ELSE 0 END AS x0, CASE WHEN s % 3 = 0 THEN 300 ELSE 0 END + 250 + q % 4 * 10 AS x1, CASE WHEN q % 3 = 0 THEN 10 ELSE 640 END AS y0, s % 7 <> 0 AS body,
    CASE WHEN q % 5 = 0 AND l_linenumber > 1 THEN '12 note ' || p ELSE 'Some words of unit ' || p || [' and goes on', ' and goes on 12', '.', ' ends?" 3', ' short'][p % 5 + 1] END AS t, q % 5 = 0 AND l_linenumber > 1 AND q % 3 <> 0 AS note FROM o JOIN li ON o_orderkey = l_orderkey),
  en AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord, id) AS up, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord DESC, id DESC) AS down FROM un WHERE NOT note),
  ct AS (SELECT a.doc_id, a.id AS unit_id, b.id AS next_id FROM en a JOIN en b ON a.doc_id = b.doc_id AND b.page = a.page + 1 AND a.down = 1 AND b.up = 1 AND a.body AND b.body AND a.y0 + 100 >= 792 * 0.68 AND b.y0 <= 198
    AND ((least(a.x1, b.x1) - greatest(a.x0, b.x0) >= least(a.x1 - a.x0, b.x1 - b.x0) * 0.45 AND abs(a.x0 - b.x0) <= greatest(28, 612 * 0.06))
      OR (a.x0 >= 612 * 0.45 AND b.x0 <= 612 * 0.25 AND abs(a.x1 - a.x0 - b.x1 + b.x0) <= greatest(28, least(a.x1 - a.x0, b.x1 - b.x0) * 0.18)))
    AND length(a.t) >= 12 AND length(b.t) >= 4 AND NOT regexp_matches(regexp_replace(a.t, '(?:\s*(?:\d{1,3}))+$', ''), '[.!?][”’"'']?$'))"""

_SHEET = r"""sh AS MATERIALIZED (SELECT l_orderkey AS page, l_linenumber::BIGINT AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity::INT) AS q FROM lineitem GROUP BY 1, 2),
  bl AS MATERIALIZED (SELECT *, 50 + q % 3 * 5 AS x0, 300 + q % 3 * 5 AS x1, n * 90 + p % 50 AS y0, n * 90 + p % 50 + 30 AS y1, CASE WHEN q % 4 = 0 THEN 7 ELSE 10 END AS fs, s % 17 = 0 AS fur,
    CASE WHEN p % 7 = 0 THEN 'Table ' || n || ' of parts' WHEN p % 3 = 0 THEN n || ' note on part ' || p || chr(10) || (n + 1) || '. another' || chr(10) || 'that goes on'
      ELSE 'Block ' || p || ' with text  and more of it' || CASE WHEN p % 2 = 0 THEN ', long enough to count as prose of the page, whatever it says there' ELSE '' END END AS t FROM sh),
  dw AS MATERIALIZED (SELECT page, n * 10 AS no, 50 AS x0, 300 + p % 2 * 100 AS x1, 100 + n * 100 + s % 3 * 60 AS y0, 101 + n * 100 + s % 3 * 60 AS y1 FROM sh WHERE n <= 2
    UNION ALL SELECT page, n * 10, 50, 50 + p % 20 * 2, 420 + q * 4, 421 + q * 4 FROM sh WHERE n > 2 UNION ALL SELECT page, n * 10 + 1, 350 + p % 200, 410 + p % 200, 100 + s % 10 * 40, 160 + s % 10 * 40 FROM sh)"""

ORACLES = {
    "footnote_blocks": f"""WITH {_SHEET}, sp AS (SELECT page, min_by(y1, [y0, x0, x1]) AS y1 FROM dw WHERE y1 - y0 <= 2.5 AND (x1 - x0) / 612 <= 0.45 AND y0 / 792 >= 0.6 GROUP BY 1),
        z AS (SELECT bl.*, coalesce(sp.y1, 792 * 0.6) AS top, sp.y1 IS NOT NULL AS sep FROM bl LEFT JOIN sp USING (page) WHERE NOT fur),
        bs AS (SELECT page, max_by(fs, [w, fs]) AS body FROM (SELECT page, fs, sum(length(t)) AS w FROM z WHERE y1 <= top AND length(t) >= 80 GROUP BY 1, 2) GROUP BY 1),
        m AS (SELECT z.*, coalesce(body, 0) AS body, regexp_matches(t, '^\\s*(?:[\\d]{{1,2}}|[*†‡§]|[⁰-⁹]{{1,2}})\\s+\\S') AS mk FROM z LEFT JOIN bs USING (page) WHERE y1 > top AND y0 >= top - 4)
        SELECT page, n AS block_id, mk AS marked, sep AS has_separator, fs::DOUBLE AS font_size, body::DOUBLE AS body_size, round(0.6 + CASE WHEN mk THEN 0.2 ELSE 0 END + CASE WHEN sep THEN 0.15 ELSE 0 END, 4)::DOUBLE AS confidence FROM m
        WHERE CASE WHEN sep THEN mk OR body > 0 AND fs <= body * 0.92 ELSE mk AND body > 0 AND fs <= body * 0.92 END""",
    "footnote_entries": f"""WITH {_SHEET} SELECT page, n AS block_id, 1 AS entry, n::VARCHAR AS marker, 'note on part ' || p AS body FROM bl WHERE p % 3 = 0 AND p % 7 <> 0 UNION ALL SELECT page, n, 2, (n + 1)::VARCHAR, 'another that goes on' FROM bl WHERE p % 3 = 0 AND p % 7 <> 0""",
    "vector_figures": f"""WITH RECURSIVE {_SHEET}, j AS (SELECT a.page, a.no AS a, b.no AS c FROM dw a JOIN dw b ON a.page = b.page AND a.x0 - 14 <= b.x1 AND a.x1 + 14 >= b.x0 AND a.y0 - 14 <= b.y1 AND a.y1 + 14 >= b.y0),
        z AS (SELECT page, a, c FROM j UNION SELECT z.page, z.a, j.c FROM z JOIN j ON z.page = j.page AND z.c = j.a), g AS (SELECT page, a, min(c) AS m FROM z GROUP BY 1, 2),
        f AS (SELECT g.page, m, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, count(*) AS n, count(*) FILTER (least(x1 - x0, y1 - y0) > 2.5) AS solid FROM g JOIN dw ON g.page = dw.page AND g.a = dw.no GROUP BY 1, 2),
        r AS (SELECT *, ((x1 - x0) * (y1 - y0))::DOUBLE / (612 * 792) AS ratio FROM f)
        SELECT page, m AS figure_no, n AS n_drawings, solid AS n_solid, round(ratio, 4) AS area_ratio, round(least(0.99, 0.6 + least(n, 60) / 200 + least(ratio, 0.5) * 0.5), 4)::DOUBLE AS confidence, x0::DOUBLE AS x0, y1::DOUBLE AS y1 FROM r WHERE n >= 3 AND ratio >= 0.02 AND solid > 0""",
    "page_tables": f"""WITH {_SHEET}, ru AS (SELECT a.page, least(a.x0, b.x0) AS x0, greatest(a.x1, b.x1) AS x1, least(a.y0, b.y0) AS y0, greatest(a.y1, b.y1) AS y1 FROM dw a JOIN dw b ON a.page = b.page AND a.no = 10 AND b.no = 20 AND abs(a.x1 - b.x1) <= 6 AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 260),
        ins AS (SELECT ru.page, list(n::VARCHAR ORDER BY bl.y0, n) AS ids, sum(len(string_split(t, chr(10)))) AS rows_, max(CASE WHEN t LIKE 'Block%' THEN 2 ELSE 1 END) AS cols FROM ru JOIN bl ON ru.page = bl.page AND (bl.y0 + bl.y1) / 2 BETWEEN ru.y0 AND ru.y1 AND (bl.x0 + bl.x1) / 2 BETWEEN ru.x0 - 6 AND ru.x1 + 6 GROUP BY 1),
        cp AS (SELECT ru.page, min_by(n, [ru.y0 - bl.y1, -n]) AS c FROM ru JOIN bl ON ru.page = bl.page AND p % 7 = 0 AND ru.y0 - bl.y1 BETWEEN 0 AND 60 GROUP BY 1)
        SELECT page, 2::BIGINT AS n_rules, rows_::BIGINT AS rows, cols::BIGINT AS columns, array_to_string(ids, ',') AS block_ids, c AS caption_block_id, 'horizontal-rules' || CASE WHEN c IS NOT NULL THEN ',table-caption' ELSE '' END || CASE WHEN cols >= 2 THEN ',multi-column-text' ELSE '' END AS signals,
          round(least(0.97, 0.72 + CASE WHEN c IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN cols >= 2 THEN 0.05 ELSE 0 END), 4)::DOUBLE AS confidence FROM ins LEFT JOIN cp USING (page)
        UNION ALL SELECT page, 0, 0, 0, n::VARCHAR, n, 'table-caption-only', 0.45 FROM bl WHERE p % 7 = 0 AND NOT EXISTS (SELECT 1 FROM ru JOIN ins USING (page) WHERE ru.page = bl.page AND bl.y1 BETWEEN ru.y0 - 60 AND ru.y1)""",
    "page_continuations": f"WITH {_FLOW} SELECT * FROM ct",
    "continuation_chains": f"""WITH RECURSIVE {_FLOW}, ch AS (SELECT doc_id, unit_id, unit_id AS head, 0::BIGINT AS pos FROM ct WHERE NOT EXISTS (SELECT 1 FROM ct c WHERE c.doc_id = ct.doc_id AND c.next_id = ct.unit_id)
        UNION ALL SELECT ch.doc_id, ct.next_id, head, pos + 1 FROM ch JOIN ct ON ct.doc_id = ch.doc_id AND ct.unit_id = ch.unit_id) SELECT doc_id, unit_id, head, pos AS "at" FROM ch""",
    "customer_chains": """SELECT o_custkey, o_orderkey, first_value(o_orderkey) OVER w AS head, row_number() OVER w - 1 AS "at" FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "payload_units": f"WITH {_PAY} SELECT doc_id, item_id, k AS unit_id FROM tk",
    "payload_sequence": f"""WITH {_PAY}, {_SPANS}, z AS (SELECT doc_id, CASE WHEN here THEN anchor ELSE lo END AS at_, 0 AS tier, page AS nth, 'payload' AS source, item_id AS id, coalesce(n, 0) AS n_replaced FROM pl WHERE here OR lo IS NOT NULL
        UNION ALL SELECT doc_id, k, 1, 0, 'unit', k::VARCHAR, 0 FROM u WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.doc_id = u.doc_id AND tk.k = u.k)) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY at_, tier, nth, id) AS position, source, id, n_replaced FROM z""",
    "payload_problems": f"""WITH {_PAY}, {_SPANS} SELECT doc_id, k::VARCHAR AS id, 'overlap' AS code FROM tk GROUP BY 1, 2 HAVING count(*) > 1
        UNION ALL SELECT doc_id, item_id, 'interleaved' FROM (SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM sp) WHERE upto >= lo
        UNION ALL SELECT doc_id, item_id, 'orphan' FROM pl WHERE NOT here AND lo IS NULL UNION ALL SELECT doc_id, item_id, 'anchor-missing' FROM pl WHERE anchor IS NOT NULL AND NOT here""",
}
