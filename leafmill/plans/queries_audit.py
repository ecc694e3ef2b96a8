"""Registered queries of the audit and of layout operators, with their DuckDB counterparts.

Units are turns of conversations: their translation replaces letters by Han characters, more or fewer by a fixed rule that both sides share.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import geom as G
from leafmill.functions import text as X
from leafmill.operators import audit, binding, cache, corpus, elements, gates, ordering, qa
from leafmill.plans.queries_records import _BLOCKS, _OVER, _blocks, _of
from leafmill.session import ship, table


def _units(spark, d):
    """doc_id, batch, unit_id, page, ord, kind, role, source, translation, keep_code, keep_reason, in_references, kept_terms, cross_language."""
    n = F.col("conv_id") * 100 + F.col("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", n.alias("n")).where("conv_id is not null and turn is not null")
    han = lambda letters: F.translate("text", letters, "的一是不了在人有我他"[: len(letters)])
    said = (
        F.when(F.col("n") % 11 == 0, F.lit(""))
        .when(F.col("n") % 13 == 0, F.col("text"))
        .when(F.col("n") % 17 == 0, han("e"))
        .otherwise(han("etaoinshrl"))
    )
    code = F.when(F.col("n") % 22 == 0, "bibliography-entry").when(F.col("n") % 33 == 0, "acronym").when(F.col("n") % 29 == 0, "citation")
    return c.select(
        F.floor(F.col("conv_id") / 5).alias("doc_id"),
        F.when(F.col("conv_id") % 5 != 4, F.col("conv_id")).alias("batch"),
        F.col("n").alias("unit_id"),
        F.col("turn").alias("page"),
        F.col("conv_id").alias("ord"),
        F.when((F.col("n") % 44 == 0) | ((F.floor(F.col("conv_id") / 5) % 9 == 2) & (F.col("turn") % 2 == 0)), "reference").otherwise(F.col("role")).alias("kind"),
        F.lit(None).cast("string").alias("role"),
        F.col("text").alias("source"),
        said.alias("translation"),
        code.alias("keep_code"),
        F.when(F.col("n") % 55 == 0, "as agreed").alias("keep_reason"),
        F.lit(False).alias("in_references"),
        F.array().cast("array<string>").alias("kept_terms"),
        (F.floor(F.col("conv_id") / 5) % 7 != 3).alias("cross_language"),
    )


def _same():
    return F.col("source") == F.col("translation")


def unit_audit(spark, d):
    v = audit.verdicts(_units(spark, d), "han", _same())
    return v.select("doc_id", "unit_id", "state", F.get("problems", F.lit(0)).alias("problem"), "chars", "target", "residual")


def level_audit(spark, d):
    e = audit.evaluation(audit.verdicts(_units(spark, d), "han", _same()))
    return e.select("level", "doc_id", "batch", "n_units", "translated", "kept", "invalid", F.round("ratio", 9).alias("ratio"), F.round("kept_ratio", 9).alias("kept_ratio"), F.array_join("problems", ",").alias("problems"))


def coverage_audit(spark, d):
    c = audit.coverage(audit.verdicts(_units(spark, d), "han", _same()))
    return c.select("doc_id", "units", "claimed_translated", "claimed_kept", "translated", "kept", "invalid", "complete", "note", F.array_join("problem_codes", ",").alias("problem_codes"))


def reference_pages(spark, d):
    return audit.reference_pages(_units(spark, d))


def paginate(spark, d):
    b = _blocks(spark, d).select(
        F.col("page").alias("doc_id"),
        F.row_number().over(_by_page()).alias("ord"),
        F.when(F.col("kind") == "R", "g").alias("group_id"),
        F.round(G.height(F.col("bbox")) + F.when(F.col("kind") == "A", 30).otherwise(0), 3).alias("height"),
        (F.col("ord") % 2 == 0).alias("splittable"),
        (F.col("ord") % 5 == 0).alias("footnote"),
    )
    return ordering.paginate(b, 70.0)


def _by_page():
    from pyspark.sql import Window

    return Window.partitionBy("page").orderBy("ord", "block_id")


def full_binding(spark, d):
    b = _blocks(spark, d)
    key = F.array((F.col("ord") % 1000000).cast("string"))
    units = b.where("kind <> 'N'").select("doc_id", "page", F.col("block_id").alias("unit_id"), "bbox", F.array((F.col("ord") % 40).cast("string")).alias("block_ids"))
    e = b.where("kind = 'N'").select("doc_id", "page", F.col("block_id").alias("element_id"), "ord", "bbox", F.transform(key, lambda x: (x.cast("int") % 40).cast("string")).alias("block_ids"))
    return binding.bind(units, e).groupBy("match").agg(F.count("*").alias("n"), F.count("element_id").alias("n_elements"))


def column_signal(spark, d):
    b = _blocks(spark, d).withColumn("text", F.repeat(F.lit("x"), (F.col("ord") % 300).cast("int")))
    return corpus.column_signal(b, ["page"], F.lit(250.0)).select("page", "left_chars", "right_chars", "wide_chars", "chars", "two_columns")


def profile_columns(spark, d):
    b = _blocks(spark, d).withColumn("text", F.repeat(F.lit("x"), (F.col("ord") % 300).cast("int")))
    return corpus.profile_two_columns(b, ["page"], F.lit(250.0)).select("page", "left_chars", "right_chars", "two_columns")


def cluster_boxes_sizes(spark, d):
    b = _blocks(spark, d).groupBy("doc_id", "page", F.col("ord").alias("drawing_no")).agg(F.min("bbox").alias("bbox"))
    return ordering.cluster_boxes(b).select("page", "drawing_no", "cluster")


def page_findings(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    m = o.select(
        k.alias("page"), (k % 700).alias("chars"), (k % 10 / 10.0).alias("bold_share"), (k % 97 == 0).alias("has_marker"), (k % 2 == 0).alias("has_map"), (k % 5 / 20.0).alias("size_delta"), (k % 3).alias("images"),
        (k % 400).alias("target_chars"), F.lit(50).alias("least_target_chars"), (k % 7 == 0).alias("whole_reference"), (k % 4 + 7.0).alias("body_size"), F.lit(8.0).alias("least_body_size"), (k % 6).alias("low_body_spans"),
        (k % 7 == 0).alias("is_reference"), (k % 8 == 0).alias("is_complex"), (k % 9 == 0).alias("is_table"), (k % 30).alias("low_table_chars"), (k % 14).alias("longest_low_table_span"), (1 + k % 6 / 10.0).alias("leading"),
        F.lit(1.15).alias("least_leading_exception"), F.lit(1.35).alias("least_leading"), (k % 2 == 1).alias("leading_documented"), (k % 4).alias("leading_samples"), (k % 3).alias("outlier_gaps"), (k % 10).alias("widest_gap"),
        (k % 12 == 0).alias("sparse"), (k % 24 == 0).alias("has_retained"), (k % 36 == 0).alias("before_break"), F.when(k % 5 > 0, k % 5 / 4.0).alias("width_retention"), (k % 4 / 10.0).alias("width_loss"), (k % 3).alias("orphan_lines"),
    )
    return qa.findings(m, ["page"]).groupBy("code", "severity").agg(F.count("*").alias("n"), F.sum("page").alias("pages"))


def body_font_pages(spark, d):
    li = table(spark, d, "lineitem").select(F.lit(1).alias("doc"), F.col("l_orderkey").alias("page"), (F.col("l_quantity") % 4).cast("double").alias("size"), F.col("l_suppkey").alias("chars"))
    return qa.body_font_consistency(li, "doc", "page", "size", "chars").select("page", "near", "chars")


def stage_totals(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"), F.when(F.col("event_id") % 9 == 0, "failed").alias("error"))
    return gates.stage_totals(e).select("stage", "calls", F.round("total", 4).alias("total"), "errors")


def repair_tasks(spark, d):
    e = table(spark, d, "events")
    t = gates.repair_tasks(e, ["user_id"], F.col("event_type"), F.col("event_id") % 5)
    return t.select("user_id", "priority", F.array_join("actions", ",").alias("actions"), "n_flags")


def reference_state(spark, d):
    c = table(spark, d, "conversations")
    heads = F.when(F.col("turn") == F.col("conv_id") % 4, F.lit(" References ")).otherwise(F.col("text"))
    kind = F.when(F.col("turn") == F.col("conv_id") % 4, "heading").when(F.col("role") == "assistant", "body").otherwise("table")
    e = c.select(F.col("conv_id").alias("doc_id"), "turn", heads.alias("text"), kind.alias("type"))
    return elements.reference_state(e, ["turn"]).select("doc_id", "turn", "type")


def title_candidate(spark, d):
    b = _blocks(spark, d).select(F.col("page").alias("doc_id"), F.lit(1).alias("page"), "block_id", "bbox", "ord")
    return elements.title_candidate(b, [F.col("bbox.y0"), F.col("ord"), F.col("block_id")], F.col("bbox.y0") < 75).select("doc_id", "block_id")


def table_notes(spark, d):
    t = F.col("text")
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Note. "), t)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Fig. 3 "), t)).otherwise(F.concat(F.lit(" TABLE IV "), t)).alias("text"))
    t = F.col("text")
    return docs.select("doc_id", X.is_table_note(t).alias("note"), X.caption_kind(t).alias("kind"), X.caption_label(t).alias("label"))


def blank_ratios(spark, d):
    b = _blocks(spark, d).withColumn("text", F.repeat(F.lit("x"), (F.col("ord") % 60).cast("int")))
    r = qa.blank_ratios(b, ["page"], F.lit(600.0))
    return r.select("page", F.round("top_blank", 6).alias("top_blank"), F.round("bottom_blank", 6).alias("bottom_blank"))


def visual_rebuilds(spark, d):
    p = table(spark, d, "part")
    kinds = ["vector-rebuild", "structured-table-rebuild", "image-text-localization", "other"]
    k = F.col("p_partkey")
    bad = audit.visual_rebuild_problem(F.get(F.array(*[F.lit(x) for x in kinds]), (k % 4).cast("int")), F.col("p_size") * 3, k % 9, k % 2, k % 11 == 0)
    return p.select("p_partkey", bad.alias("problem"))


def _cache_keys(spark, d, terms="t"):
    c = table(spark, d, "conversations").where("conv_id is not null and turn is not null")
    made = c.select("conv_id").distinct().select("conv_id", F.when(F.col("conv_id") % 2 == 0, "zh").otherwise("ja").alias("target_language"), F.sha2(F.lit(terms), 256).alias("terminology_sha256"), F.when(F.col("conv_id") % 3 == 0, "m").alias("model"), F.lit(None).cast("string").alias("prompt_version"), F.lit(None).cast("string").alias("strategy_version"))
    return cache.batch_keys(c, ["conv_id"], ["turn"], "turn", "role", made)


def batch_cache_keys(spark, d):
    return _cache_keys(spark, d)


def cache_rounds(spark, d):
    """A cache written for every fifth batch, again for every tenth, without every fifteenth, then asked for all."""
    k = _cache_keys(spark, d)
    rows = lambda n, name, at: k.where(F.col("conv_id") % n == 0).select("cache_key", F.lit(name).alias("results"), F.lit(at).alias("written"))
    kept = cache.drop(cache.put(rows(5, "first", 1), rows(10, "second", 2)), rows(15, "", 0))
    return cache.lookup(k, kept).select("conv_id", "hit", "results")


def audited_pages(spark, d):
    """Lengths of pages as the audit counts them: references apart, translations against sources."""
    p = audit.page_audit(_units(spark, d), F.lit("en"), F.lit("zh"))
    return p.select("doc_id", "page", "reference_page", "source_chars", "translation_chars", "ratio", F.array_contains(F.flatten(F.array(F.col("flags"))), "DOI_LOSS").alias("lost_doi"))


def drifted_pages(spark, d):
    """Parts of a supplier's lines by line number as anchors of pages; what the page after has is shifted for half of the suppliers."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page"), (F.col("l_partkey") % 60).cast("string").alias("a"))
    near = li.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("page") + 1).otherwise(F.col("page")).alias("page"), "a")
    anchors = li.groupBy("doc_id", "page").agg(F.collect_set("a").alias("anchors"))
    held = near.groupBy("doc_id", "page").agg(F.collect_set("a").alias("target_anchors"))
    both = anchors.join(held, ["doc_id", "page"], "full")
    none = F.array().cast("array<string>")
    return audit.mapping_drift(both.withColumn("anchors", F.coalesce("anchors", none)).withColumn("target_anchors", F.coalesce("target_anchors", none)))


def audit_states(spark, d):
    """Documents as audited pages of their sources: short ones are flagged for repair."""
    docs = table(spark, d, "documents")
    flags = F.when(F.col("n_chars") < 400, F.array(F.lit("SEVERE_TRANSLATION_COMPRESSION"))).when(F.col("lang") == "de", F.array(F.lit("URL_LOSS"))).otherwise(F.array().cast("array<string>"))
    pages = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), flags.alias("flags"), F.coalesce("n_chars", F.lit(0)).alias("source_chars"), F.round(F.col("n_chars") / 3000, 3).alias("ratio"), (F.col("lang") == "es").alias("reference_page"))
    return audit.audit_status(pages.withColumn("reference_page", F.coalesce("reference_page", F.lit(False))))


QUERIES = {
    f.__name__: f
    for f in (
        audited_pages, drifted_pages, audit_states,
        unit_audit, level_audit, coverage_audit, reference_pages, paginate, full_binding, column_signal, profile_columns, cluster_boxes_sizes, page_findings, body_font_pages,
        stage_totals, repair_tasks, reference_state, title_candidate, table_notes, blank_ratios, visual_rebuilds, batch_cache_keys, cache_rounds,
    )
}

_L = "[A-Za-zÀ-ÖØ-öø-ÿ]"
# Words between marks, so that neighbours do not share the separator that both must have.
_AUDIT = rf"""c AS (SELECT conv_id, turn, role, text, conv_id * 100 + turn AS n FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
  u AS (SELECT conv_id // 5 AS doc_id, CASE WHEN conv_id % 5 <> 4 THEN conv_id END AS batch, n AS unit_id, turn AS page, lower(CASE WHEN n % 44 = 0 OR ((conv_id // 5) % 9 = 2 AND turn % 2 = 0) THEN 'reference' ELSE role END) AS kind, trim(text) AS source,
    trim(CASE WHEN n % 11 = 0 THEN '' WHEN n % 13 = 0 THEN text WHEN n % 17 = 0 THEN translate(text, 'e', '的') ELSE translate(text, 'etaoinshrl', '的一是不了在人有我他') END) AS said,
    CASE WHEN n % 22 = 0 THEN 'bibliography-entry' WHEN n % 33 = 0 THEN 'acronym' WHEN n % 29 = 0 THEN 'citation' ELSE '' END AS code, n % 55 = 0 AS reason, (conv_id // 5) % 7 <> 3 AS crossing, text = CASE WHEN n % 11 = 0 THEN '' WHEN n % 13 = 0 THEN text WHEN n % 17 = 0 THEN translate(text, 'e', '的') ELSE translate(text, 'etaoinshrl', '的一是不了在人有我他') END AS same FROM c),
  s AS (SELECT *, list_transform([source, said], lambda t: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '(?i)https?://[^\s<>"'']+', ' ', 'g'), '(?i)\b10\.\d{{4,9}}/[-._;()/:A-Z0-9]+\b', ' ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', ' ', 'g'),
    '(?i)arxiv\s*:\s*(?:[a-z-]+(?:\.[A-Z]{{2}})?/)?\d{{4}}\.?\d{{4,5}}(?:v\d+)?', ' ', 'g'), '\[[^\]]{{0,40}}\]', ' ', 'g'), '([^A-Za-z0-9-])', chr(1) || '\1' || chr(1), 'g'), '(^|\x01)[A-Z][A-Z0-9-]{{1,12}}($|\x01)', ' ', 'g')) AS bare FROM u),
  m AS (SELECT *, len(list_filter(regexp_extract_all(replace(bare[1], chr(1), ''), '{_L}(?:{_L}|[''-])*'), lambda w: length(w) >= 3)) >= 3 AS prose, len(regexp_extract_all(bare[2], '{_L}')) AS x,
    len(regexp_extract_all(said, '[\x{{3400}}-\x{{9fff}}]')) AS t, len(regexp_extract_all(source, '[\p{{L}}\p{{N}}_]')) AS chars, starts_with(kind, 'reference') AS form FROM s),
  p AS (SELECT *, CASE WHEN said <> '' AND (code <> '' OR reason) THEN 'TRANSLATION_AND_KEEP_SOURCE_CONFLICT' WHEN said <> '' THEN CASE WHEN NOT crossing OR NOT regexp_matches(source, '\p{{L}}') THEN NULL WHEN same THEN 'TRANSLATION_EQUALS_SOURCE'
    WHEN NOT prose OR form THEN NULL WHEN t = 0 THEN 'TARGET_LANGUAGE_ABSENT' WHEN t / (t + x) < 0.5 THEN 'TARGET_LANGUAGE_RATIO_LOW' END
    WHEN code = 'bibliography-entry' THEN CASE WHEN NOT form THEN 'KEEP_SOURCE_CODE_NOT_ALLOWED_FOR_UNIT' END
    WHEN code = 'acronym' THEN CASE WHEN NOT regexp_matches(source, '^[A-Z0-9][A-Z0-9\-/&.]{{0,23}}$') THEN 'KEEP_SOURCE_CODE_NOT_ALLOWED_FOR_UNIT' END
    WHEN code = 'citation' THEN CASE WHEN length(source) > 60 OR NOT regexp_matches(source, '^(?:\[[\d\s,;–-]+\]|\([^()]*(?:19|20)\d{{2}}[a-z]?[^()]*\))$') THEN 'KEEP_SOURCE_CODE_NOT_ALLOWED_FOR_UNIT' END
    WHEN reason THEN 'KEEP_SOURCE_CODE_MISSING' ELSE 'UNIT_NOT_TRANSLATED' END AS problem FROM m),
  v AS (SELECT *, CASE WHEN problem IS NOT NULL THEN 'invalid' WHEN said <> '' THEN 'translated' ELSE 'kept-source' END AS state FROM p),
  w AS (SELECT *, CASE WHEN state = 'translated' AND NOT form AND crossing THEN t END AS target, CASE WHEN state = 'translated' AND NOT form AND crossing THEN x END AS residual FROM v),
  g AS (SELECT doc_id, batch, grouping(batch) AS top, count(*) AS n_units, count(*) FILTER (state = 'translated') AS translated, count(*) FILTER (state = 'kept-source') AS kept, count(*) FILTER (state = 'invalid') AS invalid,
    sum(target) / nullif(sum(target) + sum(residual), 0) AS ratio, coalesce(coalesce(sum(chars) FILTER (state = 'kept-source'), 0) / nullif(sum(chars), 0), 0) AS kept_ratio FROM w GROUP BY GROUPING SETS ((doc_id, batch), (doc_id))),
  e AS (SELECT CASE WHEN top = 1 THEN 'document' ELSE 'batch' END AS level, *, concat_ws(',', CASE WHEN ratio < CASE WHEN top = 1 THEN 0.8 ELSE 0.7 END THEN CASE WHEN top = 1 THEN 'DOCUMENT' ELSE 'BATCH' END || '_TARGET_LANGUAGE_RATIO_LOW' END,
    CASE WHEN top = 1 AND kept_ratio > 0.5 THEN 'DOCUMENT_KEEP_SOURCE_RATIO_HIGH' END) AS problems FROM g WHERE top = 1 OR batch IS NOT NULL)"""

_PAGE_METRICS = """m AS (SELECT o_orderkey AS page, o_orderkey AS k FROM orders),
  f AS (SELECT page, unnest(list_filter([
    CASE WHEN k % 700 >= 200 AND k % 10 / 10.0::DOUBLE > 0.6 THEN 'REFERENCE_FONT_TOO_BOLD:H' END, CASE WHEN k % 97 = 0 THEN 'VISIBLE_SOURCE_PAGE_MARKER:H' END, CASE WHEN k % 2 <> 0 AND k % 5 / 20.0::DOUBLE > 0.1 THEN 'PAGE_SIZE_MISMATCH:H' END,
    CASE WHEN k % 700 = 0 AND k % 3 = 0 THEN 'BLANK_PAGES:H' END, CASE WHEN k % 400 < 50 AND k % 7 <> 0 THEN 'TARGET_TEXT_MISSING:H' END, CASE WHEN (k % 4 + 7 < 8 OR k % 6 > 0) AND k % 7 <> 0 AND k % 8 <> 0 THEN 'BODY_FONT_BELOW_MINIMUM:H' END,
    CASE WHEN k % 30 >= 24 OR k % 14 >= 12 THEN 'TABLE_FONT_BELOW_MINIMUM:H' END, CASE WHEN k % 6 <= 1 AND k % 7 <> 0 AND k % 9 <> 0 AND k % 8 <> 0 THEN 'LEADING_BELOW_HARD_MINIMUM:H' END,
    CASE WHEN k % 6 IN (2, 3) AND k % 2 = 0 AND k % 7 <> 0 AND k % 9 <> 0 AND k % 8 <> 0 THEN 'LEADING_EXCEPTION_NOT_DOCUMENTED:H' END, CASE WHEN k % 4 = 0 AND k % 700 >= 300 THEN 'LEADING_REQUIRES_VISUAL_CHECK:R' END,
    CASE WHEN k % 3 >= 2 OR k % 10 >= 8 THEN 'PARAGRAPH_GAP_INFLATION:H' END, CASE WHEN k % 12 = 0 AND k % 24 <> 0 AND k % 36 <> 0 THEN 'SPARSE_PAGE_REQUIRES_JUSTIFICATION:R' END,
    CASE WHEN k % 400 >= 120 AND k % 5 BETWEEN 1 AND 2 AND k % 4 >= 2 THEN 'BODY_WIDTH_COLLAPSE_VS_SOURCE:H' END, CASE WHEN k % 3 > 0 AND k % 7 <> 0 AND k % 9 <> 0 THEN 'ORPHAN_SINGLE_HAN_LINE:H' END], lambda x: x IS NOT NULL)) AS code FROM m)"""

ORACLES = {
    "audited_pages": f"""WITH {_AUDIT}, ent AS (SELECT *, starts_with(kind, 'reference') OR starts_with(kind, 'bibliography') OR (said = '' AND code = 'bibliography-entry') AS entry FROM w),
        pgs AS (SELECT doc_id, page, coalesce(sum(chars), 0) AS n, coalesce(sum(chars) FILTER (entry), 0) AS k, coalesce(sum(chars) FILTER (NOT entry), 0) AS s, coalesce(sum(len(regexp_extract_all(said, '[\\p{{L}}\\p{{N}}_]'))) FILTER (NOT entry AND said <> ''), 0) AS t FROM ent GROUP BY 1, 2)
        SELECT doc_id, page, n > 0 AND k / n >= 0.9 AS reference_page, s::BIGINT AS source_chars, t::BIGINT AS translation_chars, CASE WHEN s > 0 THEN round(t / s, 3) END AS ratio, false AS lost_doi FROM pgs""",
    "drifted_pages": """WITH a AS (SELECT DISTINCT l_suppkey AS d, l_linenumber::BIGINT AS p, l_partkey % 60 AS x FROM lineitem), t AS (SELECT DISTINCT d, CASE WHEN d % 2 = 0 THEN p + 1 ELSE p END AS p, x FROM a),
        k AS (SELECT d, p FROM a UNION SELECT d, p FROM t), s AS (SELECT k.d, k.p, q.p AS at_, (SELECT count(*) FROM a JOIN t ON a.d = t.d AND a.x = t.x WHERE a.d = k.d AND a.p = k.p AND t.p = q.p) AS n FROM k JOIN k q ON k.d = q.d AND abs(k.p - q.p) <= 1),
        g AS (SELECT d, p, coalesce(max(n) FILTER (at_ = p), 0) AS score, max(n) FILTER (at_ <> p) AS bn, min_by(at_, [-n, at_]) FILTER (at_ <> p) AS b FROM s GROUP BY 1, 2)
        SELECT d AS doc_id, p AS page, score, b AS neighbour, bn AS neighbour_score FROM g WHERE bn >= score + 3 AND bn >= greatest(5.0, score * 1.5)""",
    "audit_states": """SELECT source AS doc_id, count(*) AS n_pages, count_if(coalesce(n_chars < 400, false) OR coalesce(lang = 'de', false))::BIGINT AS n_flagged, count_if(coalesce(n_chars < 400, false))::BIGINT AS n_repair,
        median(CASE WHEN NOT coalesce(lang = 'es', false) AND n_chars >= 600 AND round(n_chars / 3000, 3) > 0 THEN round(n_chars / 3000, 3) END) AS median_ratio FROM documents GROUP BY 1""",
    "unit_audit": f"WITH {_AUDIT} SELECT doc_id, unit_id, state, problem, chars, target, residual FROM w",
    "level_audit": f"WITH {_AUDIT} SELECT level, doc_id, batch, n_units, translated, kept, invalid, round(ratio, 9) AS ratio, round(kept_ratio, 9) AS kept_ratio, problems FROM e",
    "coverage_audit": f"""WITH {_AUDIT}, q AS (SELECT doc_id, problem AS code FROM w WHERE problem IS NOT NULL UNION SELECT doc_id, unnest(string_split(problems, ',')) FROM e WHERE problems <> ''),
        z AS (SELECT doc_id, string_agg(code, ',' ORDER BY code) AS codes, bool_or(starts_with(code, 'BATCH') OR starts_with(code, 'DOCUMENT')) AS bad FROM q GROUP BY 1), k AS (SELECT doc_id, count(*) AS units, count(*) FILTER (said <> '') AS ct, count(*) FILTER (said = '' AND (code <> '' OR reason)) AS ck FROM w GROUP BY 1)
        SELECT k.doc_id, units, ct AS claimed_translated, ck AS claimed_kept, translated, kept, invalid, invalid = 0 AND NOT coalesce(bad, false) AS complete, CASE WHEN invalid = 0 AND NOT coalesce(bad, false) THEN 'complete' ELSE 'invalid' END AS note, coalesce(codes, '') AS problem_codes
        FROM k JOIN e ON e.doc_id = k.doc_id AND level = 'document' LEFT JOIN z ON z.doc_id = k.doc_id""",
    "reference_pages": f"""WITH {_AUDIT} SELECT doc_id, page FROM w GROUP BY 1, 2 HAVING sum(chars) > 0 AND coalesce(sum(chars) FILTER (starts_with(kind, 'reference') OR starts_with(kind, 'bibliography') OR (said = '' AND code = 'bibliography-entry')), 0) / sum(chars) >= 0.9""",
    "paginate": f"""WITH RECURSIVE {_BLOCKS}, r AS (SELECT page AS doc_id, row_number() OVER (PARTITION BY page ORDER BY ord, block_id) AS ord, kind = 'R' AND ord % 5 <> 0 AS grp, round(y1 - y0 + CASE WHEN kind = 'A' THEN 30 ELSE 0 END, 3) AS h, ord % 2 = 0 AS splits, ord % 5 = 0 AS foot FROM b),
        t AS (SELECT *, CASE WHEN grp THEN sum(h) OVER (PARTITION BY doc_id, grp) ELSE h END AS need, grp AND row_number() OVER (PARTITION BY doc_id, grp ORDER BY ord) > 1 AS follows FROM r),
        x AS (SELECT doc_id, 0::BIGINT AS ord, 1 AS page, 70.0::DOUBLE AS free, NULL::INT AS gpage FROM (SELECT DISTINCT doc_id FROM r)
          UNION ALL SELECT t.doc_id, t.ord, np, CASE WHEN foot OR follows THEN x.free WHEN np > x.page THEN 70 - need ELSE x.free - need END, CASE WHEN grp AND NOT follows THEN np ELSE x.gpage END
          FROM x JOIN t ON t.doc_id = x.doc_id AND t.ord = x.ord + 1, LATERAL (SELECT CASE WHEN foot OR follows THEN x.page WHEN need > 70 AND (grp OR NOT splits) THEN x.page WHEN need > x.free THEN x.page + 1 ELSE x.page END AS np))
        SELECT t.doc_id, t.ord, (CASE WHEN follows THEN gpage ELSE page END)::INT AS out_page, CASE WHEN foot THEN 'footer' ELSE 'body' END AS area, CASE WHEN foot THEN NULL WHEN need > 70 AND grp THEN 'GROUP_HIGHER_THAN_PAGE' WHEN need > 70 AND NOT splits THEN 'BLOCK_HIGHER_THAN_PAGE' END AS problem
        FROM t JOIN x ON x.doc_id = t.doc_id AND x.ord = t.ord""",
    "full_binding": f"""WITH {_BLOCKS}, u AS (SELECT DISTINCT block_id AS unit_id FROM b WHERE kind <> 'N'), k AS (SELECT DISTINCT p.block_id AS unit_id FROM b p JOIN b q ON p.page = q.page AND p.kind <> 'N' AND q.kind = 'N' AND p.ord % 40 = q.ord % 1000000 % 40),
        o AS (SELECT DISTINCT p.block_id AS unit_id FROM ba p JOIN ba q ON p.page = q.page AND p.kind <> 'N' AND q.kind = 'N' AND p.area > 0 AND {_OVER} / p.area >= 0.55 WHERE p.block_id NOT IN (SELECT unit_id FROM k)),
        a AS (SELECT 'block' AS match, true AS has FROM k UNION ALL SELECT 'overlap', true FROM o UNION ALL SELECT 'orphan', false FROM b WHERE kind <> 'N' AND block_id NOT IN (SELECT unit_id FROM k) AND block_id NOT IN (SELECT unit_id FROM o))
        SELECT match, count(*) AS n, count(*) FILTER (has) AS n_elements FROM a GROUP BY 1""",
    "column_signal": f"""WITH {_BLOCKS}, g AS (SELECT page, coalesce(sum(ord % 300) FILTER (x1 <= 250), 0) AS l, coalesce(sum(ord % 300) FILTER (x0 >= 250), 0) AS r, sum(ord % 300) AS n FROM b GROUP BY 1)
        SELECT page, l::BIGINT AS left_chars, r::BIGINT AS right_chars, (n - l - r)::BIGINT AS wide_chars, n::BIGINT AS chars, l + r >= 240 AND l >= 0.2 * n AND r >= 0.2 * n AND n - l - r <= 0.5 * n AS two_columns FROM g""",
    "profile_columns": f"""WITH {_BLOCKS}, g AS (SELECT page, coalesce(sum(ord % 300) FILTER ((x0 + x1) / 2 < 250), 0) AS l, coalesce(sum(ord % 300) FILTER ((x0 + x1) / 2 >= 250), 0) AS r FROM b GROUP BY 1)
        SELECT page, l::BIGINT AS left_chars, r::BIGINT AS right_chars, least(l, r) >= 200 AND least(l, r) >= 0.45 * greatest(l, r) AS two_columns FROM g""",
    "cluster_boxes_sizes": f"""WITH RECURSIVE {_BLOCKS}, d AS (SELECT page, ord, arg_min(x0, (x0, y0, x1, y1)) AS x0, arg_min(y0, (x0, y0, x1, y1)) AS y0, arg_min(x1, (x0, y0, x1, y1)) AS x1, arg_min(y1, (x0, y0, x1, y1)) AS y1 FROM b GROUP BY 1, 2),
        j AS (SELECT p.page, p.ord AS a, q.ord AS c FROM d p JOIN d q ON p.page = q.page AND p.x0 - 14 <= q.x1 AND p.x1 + 14 >= q.x0 AND p.y0 - 14 <= q.y1 AND p.y1 + 14 >= q.y0),
        z AS (SELECT page, a, c FROM j UNION SELECT z.page, z.a, j.c FROM z JOIN j ON z.page = j.page AND z.c = j.a) SELECT page, a AS drawing_no, min(c) AS "cluster" FROM z GROUP BY 1, 2""",
    "page_findings": f"WITH {_PAGE_METRICS} SELECT split_part(code, ':', 1) AS code, split_part(code, ':', 2) AS severity, count(*) AS n, sum(page)::BIGINT AS pages FROM f GROUP BY 1, 2",
    "body_font_pages": """WITH s AS (SELECT l_orderkey AS page, (l_quantity % 4)::DOUBLE AS size, l_suppkey AS chars FROM lineitem), k AS (SELECT size FROM s GROUP BY 1 ORDER BY sum(chars) DESC, size DESC LIMIT 1),
        g AS (SELECT page, coalesce(sum(chars) FILTER (abs(s.size - k.size) <= 0.25), 0) AS near, sum(chars) AS chars FROM s, k GROUP BY 1) SELECT page, near::BIGINT AS near, chars::BIGINT AS chars FROM g WHERE near < greatest(24, 0.2 * chars)""",
    "stage_totals": "SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS total, count(*) FILTER (event_id % 9 = 0) AS errors FROM events GROUP BY 1",
    "repair_tasks": "SELECT user_id, min(event_id % 5) AS priority, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS actions, count(*) AS n_flags FROM events GROUP BY 1",
    "reference_state": """WITH c AS (SELECT *, turn = conv_id % 4 AS head FROM conversations), s AS (SELECT *, bool_or(head) OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM c)
        SELECT conv_id AS doc_id, turn, CASE WHEN head THEN 'reference-heading' WHEN role = 'assistant' THEN CASE WHEN seen THEN 'reference-entry' ELSE 'body' END ELSE 'table' END AS type FROM s""",
    "title_candidate": f"WITH {_BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, ord, block_id) AS n FROM b) SELECT page AS doc_id, block_id FROM r WHERE n = 1 AND y0 < 75",
    "table_notes": """SELECT doc_id, doc_id % 3 = 0 AS note, CASE doc_id % 3 WHEN 1 THEN 'figure' WHEN 2 THEN 'table' END AS kind, CASE doc_id % 3 WHEN 1 THEN '3' WHEN 2 THEN 'IV' END AS label FROM documents""",
    "blank_ratios": f"WITH {_BLOCKS} SELECT page, round(CASE WHEN sum(ord % 60) < 80 THEN 0.0::DOUBLE ELSE min(y0 / 600) END, 6) AS top_blank, round(1 - max(y1 / 600), 6) AS bottom_blank FROM b GROUP BY 1",
    "batch_cache_keys": """WITH h AS (SELECT conv_id, count(*) AS n_units, string_agg('"' || sha256('{"id": "' || turn || '", "source": "' || coalesce(role, '') || '"}') || '"', ', ' ORDER BY turn) AS hashes FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1)
        SELECT conv_id, n_units, sha256('{"cache_schema_version": "1.0", "model": "' || CASE WHEN conv_id % 3 = 0 THEN 'm' ELSE '' END || '", "prompt_version": "batch-prompt-v1", "strategy_version": "batched-units-v1", "target_language": "'
        || CASE WHEN conv_id % 2 = 0 THEN 'zh' ELSE 'ja' END || '", "terminology_sha256": "' || sha256('t') || '", "unit_hashes": [' || hashes || ']}') AS cache_key FROM h""",
    "cache_rounds": """WITH h AS (SELECT conv_id, conv_id % 3 = 0 AS m, conv_id % 2 = 0 AS z, string_agg(turn || ':' || coalesce(role, ''), ',' ORDER BY turn) AS s FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1),
        g AS (SELECT m, z, s, bool_or(conv_id % 5 = 0) AS five, bool_or(conv_id % 10 = 0) AS ten, bool_or(conv_id % 15 = 0) AS gone FROM h GROUP BY ALL)
        SELECT conv_id, five AND NOT gone AS hit, CASE WHEN NOT five OR gone THEN NULL WHEN ten THEN 'second' ELSE 'first' END AS results FROM h JOIN g USING (m, z, s)""",
    "visual_rebuilds": """SELECT p_partkey, p_partkey % 11 <> 0 AND p_partkey % 2 = 0 AND CASE p_partkey % 4 WHEN 0 THEN p_partkey % 9 < greatest(4, least(12, round_even(p_size * 3 * 0.1::DOUBLE, 0))) WHEN 1 THEN p_partkey % 9 < 3 WHEN 2 THEN p_partkey % 9 < 4 ELSE false END AS problem FROM part""",
}
