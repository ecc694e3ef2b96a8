"""Registered queries that place elements of documents in a candidate, with their DuckDB counterparts.

The lines of a document are its elements, eight to a page; its candidate has the same lines six to a page, of which some
went missing. By its number a line is an image (its bytes), running text, a drawing with words in it, or a grey region.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import geom as G
from leafmill.operators import mapping, needles
from leafmill.session import ship, table

_GRID = 4


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "line"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """elements, pages, images."""
    lines = _lines(spark, d)
    k, line = F.col("k"), F.col("line")
    n = F.char_length(line)
    kind, y = k % 5, (k % 8 * 10).cast("double")
    grey = F.when(n >= _GRID * _GRID, F.transform(F.sequence(F.lit(1), F.lit(_GRID * _GRID)), lambda i: F.ascii(F.substr(line, i, F.lit(1)))))
    elements = lines.select(
        "doc_id",
        k.alias("element_id"),
        k.alias("ord"),
        F.element_at(F.array(*map(F.lit, ("raster-figure", "body", "vector-figure", "table", "body"))), kind + 1).alias("type"),
        (F.floor(k / 8) + 1).cast("int").alias("page"),
        G.box(F.lit(0.0), y, F.lit(100.0), y + F.when(kind == 3, 30.0).otherwise(8.0)).alias("bbox"),
        (k % 3 != 0).alias("required"),
        F.when((kind == 0) & (n > 0), F.encode(line, "UTF-8")).alias("content"),
        F.when(kind.isin(1, 4), line).alias("text"),
        F.when(kind == 2, line).alias("region_text"),
        F.when(kind == 3, grey).alias("fingerprint"),
        F.when(kind == 2, k % 4).alias("n_drawings"),
    )
    page = (F.floor(k / 6) + 1).cast("int")
    kept = (n + k) % 7 != 0
    pages = lines.groupBy("doc_id", page.alias("page")).agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(kept & ~kind.isin(0, 3), F.struct("k", "line")))), lambda x: x["line"])).alias("text"),
        F.sum(F.when((kind == 2) & kept, k % 4).otherwise(0)).cast("int").alias("n_drawings"),
    )
    images = lines.where((kind.isin(0, 3)) & (n % 4 != 0)).select(
        "doc_id",
        page.alias("page"),
        k.alias("ord"),
        G.box(F.lit(0.0), (k % 6 * 10).cast("double"), F.lit(100.0), (k % 6 * 10 + 8).cast("double")).alias("bbox"),
        F.when(kind == 0, F.encode(line, "UTF-8")).alias("content"),
        F.when(kind == 3, F.transform(grey, lambda x: x + k % 3 * 5)).alias("fingerprint"),
    )
    return elements, pages, images


def _map(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return mapping.build(*_sides(spark, d), grid=_GRID)


def element_map(spark, d):
    out = _map(spark, d)
    return out.select("doc_id", F.col("element_id").cast("long").alias("element_id"), F.array_join("candidate_pages", ",").alias("pages"), "method", "confidence", "required", F.col("candidate_drawings").cast("long").alias("drawings"), "geometry_ok", F.round("candidate_bbox.y0", 3).alias("y0"))


def mapping_problems(spark, d):
    return mapping.verify(_map(spark, d)).select("doc_id", F.col("element_id").cast("long").alias("element_id"), "code")


def mapping_summary(spark, d):
    return mapping.summary(_map(spark, d))


def settled_pages(spark, d):
    """How many elements the order of pages settles, round by round."""
    rows = mapping.settled(_map(spark, d))
    return rows.groupBy("doc_id", "settled_round").agg(F.count("*").alias("n"), F.sum("settled_page").alias("pages")).withColumn("settled_round", F.col("settled_round").cast("long"))


def mapping_drifted(spark, d):
    """A stored mapping (here made before lines of odd documents moved a page on) against the mapping as it is now."""
    elements, pages, images = _sides(spark, d)
    ship(spark)
    moved = lambda df: df.withColumn("page", F.col("page") + (F.col("doc_id") % 2).cast("int"))
    now = mapping.build(elements, pages, images, grid=_GRID)
    stored = mapping.build(elements, moved(pages), moved(images), grid=_GRID)
    return mapping.differences(stored, now).groupBy("doc_id", "field").agg(F.count("*").alias("n"))


def benchmark_passages(spark, d):
    """Documents that hold the first sixty characters of a benchmark item, or a short word of it."""
    ship(spark)
    docs = table(spark, d, "documents").where("text is not null")
    items = table(spark, d, "benchmark").select(F.explode(F.array(F.substring("text", 1, 60), F.substring("text", 3, 10), F.substring("text", 5, 3))).alias("needle"))
    hits = needles.find(docs, ["doc_id"], F.col("text"), items)
    return hits.groupBy("needle").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first"))


QUERIES = {f.__name__: f for f in (element_map, mapping_problems, mapping_summary, settled_pages, mapping_drifted, benchmark_passages)}

_MAP = r"""l AS MATERIALIZED (SELECT doc_id, (i - 1)::BIGINT AS k, line, length(line) AS n, (i - 1) % 5 AS kind, (i - 1) // 6 + 1 AS cp, (length(line) + i - 1) % 7 <> 0 AS kept
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
  g AS MATERIALIZED (SELECT doc_id, k, cp, n, CASE WHEN n >= 16 THEN list_transform(range(1, 17), lambda i: unicode(substr(line, i, 1))) END AS v FROM l WHERE kind = 3),
  pg AS MATERIALIZED (SELECT doc_id, cp AS page, regexp_replace(coalesce(string_agg(line, ' ' ORDER BY k) FILTER (kept AND kind NOT IN (0, 3)), ''), '[\s\x00-\x1f\x7f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g') AS t,
    coalesce(sum(k % 4) FILTER (kind = 2 AND kept), 0)::BIGINT AS nd FROM l GROUP BY 1, 2),
  dg AS (SELECT e.doc_id, e.k, list_sort(list(DISTINCT c.cp)) AS pages, min_by((c.k % 6 * 10)::DOUBLE, c.k) AS y0 FROM l e JOIN l c ON e.doc_id = c.doc_id AND e.line = c.line AND e.kind = 0 AND c.kind = 0 AND c.n % 4 <> 0 AND e.n > 0 GROUP BY 1, 2),
  pt AS (SELECT doc_id, k, regexp_replace(line, '[\s\x00-\x1f\x7f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g') AS t FROM l WHERE kind IN (1, 4)),
  pr AS (SELECT doc_id, k, i AS nth, substr(t, (24 * i + 1)::INT, 24) AS w FROM (SELECT *, unnest(range(0, 6)) AS i FROM pt) WHERE length(substr(t, (24 * i + 1)::INT, 24)) >= 2),
  ph AS (SELECT pr.doc_id, pr.k, pr.nth, list_sort(list(DISTINCT pg.page)) AS pages FROM pr JOIN pg ON pr.doc_id = pg.doc_id AND contains(pg.t, pr.w) GROUP BY 1, 2, 3),
  tx AS (SELECT doc_id, k, coalesce(min_by(pages, nth) FILTER (len(pages) = 1), min_by(pages, nth)) AS pages FROM ph GROUP BY 1, 2),
  gc AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: pow(x - list_avg(v), 2))) / 16) AS c FROM g WHERE v IS NOT NULL),
  gp AS (SELECT a.doc_id, a.k, b.cp, b.k AS bk, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2] - b.k % 3 * 5))) / 16 AS d FROM gc a JOIN gc b ON a.doc_id = b.doc_id AND b.n % 4 <> 0 WHERE a.c >= 6),
  px AS (SELECT doc_id, k, [min_by(cp, [d, cp, bk])] AS pages, min_by((bk % 6 * 10)::DOUBLE, [d, cp, bk]) AS y0 FROM gp WHERE d <= 8 GROUP BY 1, 2),
  an AS (SELECT doc_id, k, unnest(f[1:12]) AS w FROM (SELECT doc_id, k, list_filter(f0, lambda x, i: list_position(f0, x) = i) AS f FROM (
    SELECT doc_id, k, list_filter(list_transform(regexp_extract_all(line, '[0-9]+(?:\s*[x×]\s*[0-9]+)?|[A-Za-z]{3,}'), lambda x: regexp_replace(x, '\s', '', 'g')), lambda x: length(x) >= 2) AS f0 FROM l WHERE kind = 2))),
  ac AS (SELECT an.doc_id, an.k, pg.page, count(*) AS n FROM an JOIN pg ON an.doc_id = pg.doc_id AND contains(pg.t, an.w) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
  ax AS (SELECT doc_id, k, list_sort(list(page)) AS pages FROM (SELECT *, max(n) OVER (PARTITION BY doc_id, k) AS m FROM ac) WHERE n = m GROUP BY 1, 2),
  dr AS (SELECT l.doc_id, l.k, list_sort(list(pg.page)) AS pages FROM l JOIN pg ON l.doc_id = pg.doc_id AND l.kind = 2 AND l.k % 4 > 0 AND pg.nd >= l.k % 4 GROUP BY 1, 2),
  m0 AS (SELECT l.doc_id, l.k, l.kind, l.line, l.n, CASE WHEN l.kind = 2 THEN l.k % 4 ELSE 0 END AS sd, l.k % 8 * 10 AS top, l.k // 8 + 1 AS sp, l.k % 3 <> 0 AS req, coalesce(dg.pages, tx.pages, px.pages, ax.pages, dr.pages, []) AS pages, coalesce(dg.y0, px.y0) AS y0,
    CASE WHEN dg.k IS NOT NULL THEN 'image-digest' WHEN tx.k IS NOT NULL THEN 'text-search' WHEN px.k IS NOT NULL THEN 'region-pixels' WHEN ax.k IS NOT NULL THEN 'text-anchor' WHEN dr.k IS NOT NULL THEN 'drawing-count-lower-bound'
      WHEN l.kind = 2 AND l.k % 4 > 0 OR l.kind = 0 AND l.n > 0 OR EXISTS (SELECT 1 FROM pr WHERE pr.doc_id = l.doc_id AND pr.k = l.k) OR EXISTS (SELECT 1 FROM an WHERE an.doc_id = l.doc_id AND an.k = l.k) THEN 'not-found' ELSE 'no-locatable-evidence' END AS method
    FROM l LEFT JOIN dg USING (doc_id, k) LEFT JOIN tx USING (doc_id, k) LEFT JOIN px USING (doc_id, k) LEFT JOIN ax USING (doc_id, k) LEFT JOIN dr USING (doc_id, k)),
  m1 AS MATERIALIZED (SELECT m0.*, coalesce((SELECT max(nd) FROM pg WHERE pg.doc_id = m0.doc_id AND list_contains(m0.pages, pg.page)), 0)::BIGINT AS drawings,
    CASE method WHEN 'image-digest' THEN 1 WHEN 'text-search' THEN round(1 / len(pages), 2) WHEN 'region-pixels' THEN 1 WHEN 'text-anchor' THEN CASE WHEN len(pages) = 1 THEN 0.75 ELSE 0.45 END WHEN 'drawing-count-lower-bound' THEN 0.3 ELSE 0 END::DOUBLE AS confidence,
    req AND NOT (method = 'no-locatable-evidence' AND kind IN (1, 4) AND trim(line) <> '') AS required FROM m0),
  hs AS (SELECT e.doc_id, e.k, min_by(h.pages, h.k) AS pages, min_by(h.y0, h.k) AS y0 FROM m1 e JOIN m1 h ON e.doc_id = h.doc_id AND e.sp = h.sp AND h.method = 'region-pixels'
    AND (len(e.pages) = 0 OR e.method IN ('not-found', 'no-locatable-evidence', 'text-search', 'text-anchor')) AND e.top + CASE WHEN e.kind = 3 THEN 15 ELSE 4 END BETWEEN h.top AND h.top + 30 GROUP BY 1, 2),
  mp AS MATERIALIZED (SELECT m1.doc_id, m1.k AS element_id, kind, sp, required, drawings, coalesce(hs.pages, m1.pages) AS pages, CASE WHEN hs.k IS NOT NULL THEN hs.y0 ELSE m1.y0 END AS y0, CASE WHEN hs.k IS NOT NULL THEN 'inside-preserved-region' ELSE method END AS method,
    CASE WHEN hs.k IS NOT NULL THEN 0.9 ELSE confidence END AS confidence, CASE WHEN method = 'region-pixels' THEN true WHEN sd > 0 THEN drawings >= sd END AS geometry_ok, sd FROM m1 LEFT JOIN hs USING (doc_id, k))"""

ORACLES = {
    "element_map": f"WITH {_MAP} SELECT doc_id, element_id, array_to_string(pages, ',') AS pages, method, confidence, required, drawings, geometry_ok, y0 FROM mp",
    "mapping_problems": f"""WITH {_MAP} SELECT doc_id, element_id, unnest(list_filter([CASE WHEN len(pages) = 0 AND required THEN 'missing-required' END, CASE WHEN len(pages) > 1 THEN 'ambiguous' END,
        CASE WHEN len(pages) > 0 AND required AND method = 'drawing-count-lower-bound' THEN 'drawings-only' END, CASE WHEN len(pages) > 0 AND geometry_ok = false THEN 'geometry-missing' END,
        CASE WHEN method = 'no-locatable-evidence' AND required THEN 'required-without-evidence' END], lambda x: x IS NOT NULL)) AS code FROM mp
        UNION ALL SELECT DISTINCT doc_id, NULL::BIGINT, 'visual-missing' FROM mp WHERE kind IN (0, 2, 3) AND len(pages) = 0""",
    "mapping_summary": f"""WITH {_MAP} SELECT doc_id, count(*) AS n_elements, count_if(len(pages) > 0)::BIGINT AS n_located, count_if(len(pages) = 0)::BIGINT AS n_missing, count_if(len(pages) = 0 AND required)::BIGINT AS n_missing_required, count_if(len(pages) = 0 AND required) = 0 AS complete FROM mp GROUP BY 1""",
    "mapping_drifted": f"WITH {_MAP} SELECT doc_id, 'candidate_pages' AS field, count(*) AS n FROM mp WHERE doc_id % 2 = 1 AND len(pages) > 0 GROUP BY 1",
    "benchmark_passages": """WITH n AS (SELECT DISTINCT needle FROM (SELECT unnest([substr(text, 1, 60), substr(text, 3, 10), substr(text, 5, 3)]) AS needle FROM benchmark) WHERE needle <> '')
        SELECT needle, count(*) AS n_docs, min(doc_id) AS "first" FROM n JOIN documents ON contains(text, needle) GROUP BY 1""",
}
