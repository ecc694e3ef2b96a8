"""Registered queries over texts, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import arrow as A
from leafmill.functions import keys
from leafmill.functions import text as X
from leafmill.operators import audit, binding, corpus, elements, gates, ordering, reconcile
from leafmill.session import ship, table

WORDS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def corpus_summary(spark, d):
    docs = _docs(spark, d).select("source", "n_chars", keys.text_hash(F.col("text")).alias("sha256"), X.language_estimate(F.col("text")).alias("estimate"))
    return docs.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_distinct("sha256").alias("n_distinct"), F.sum("n_chars").alias("total"), F.count_if(F.col("estimate") == "und-Latn").alias("n_latin")
    )


def exact_dedup(spark, d):
    return corpus.mark_duplicates(_docs(spark, d), "doc_id")


def script_counts(spark, d):
    return _docs(spark, d).select("doc_id", X.script_counts(F.col("text")).alias("s")).select("doc_id", "s.*")


def language_estimate(spark, d):
    return _docs(spark, d).groupBy("lang", X.language_estimate(F.col("text")).alias("estimate")).agg(F.count("*").alias("n"))


def route_by_source(spark, d):
    docs = _docs(spark, d)
    lines = F.size(F.split("text", "\n"))
    return corpus.route(docs, "source", F.col("n_chars") < 100, (F.col("n_chars") > 12000) | (lines > 20), F.lit(False), F.lit(1)).select("source", "n_pages", "n_scan", "n_complex", "route")


def quality_join(spark, d):
    j = _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count("*").alias("n_docs"), F.count("quality").alias("n_labelled"), F.sum("toxic").alias("n_toxic"))


def email_acronym_anchors(spark, d):
    docs = _docs(spark, d)
    rows = lambda kind, c: docs.select("doc_id", F.lit(kind).alias("kind"), F.explode(c).alias("anchor"))
    return rows("email", X.emails(F.col("text"))).unionByName(rows("caps", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9_])[A-Z]{3,}(?![A-Za-z0-9_])"), F.lit(0))))))


def url_anchors(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id",
        F.regexp_extract(u, r"^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1).alias("path"),
        F.regexp_replace(u, r"[.,;:)\]]+$", "").alias("stripped"),
    )


def href_anchors(spark, d):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(hrefs).alias("pos", "href"))


def statistic_anchors(spark, d):
    return _docs(spark, d).select("doc_id", X.statistics(F.col("text")).alias("v")).where(F.size("v") > 0).select("doc_id", F.size("v").alias("n_values"), F.array_join("v", " ").alias("vals"))


def acronym_anchors(spark, d):
    return _docs(spark, d).select("doc_id", X.acronyms(F.col("text")).alias("a"), X.present_acronyms(F.col("text")).alias("p")).select("doc_id", F.size("a").alias("n_required"), F.size("p").alias("n_present")).where("n_present > 0")


def _pairs(spark, d):
    """Documents that begin alike: each with the least id of the same 24 first characters."""
    docs = _docs(spark, d).select("doc_id", "text", F.left("text", F.lit(24)).alias("k"))
    first = docs.groupBy("k").agg(F.min("doc_id").alias("a_id"))
    p = docs.join(first, "k").where("doc_id > a_id").select("a_id", F.col("doc_id").alias("b_id"), F.col("text").alias("b"))
    return p.join(docs.select(F.col("doc_id").alias("a_id"), F.col("text").alias("a")), "a_id").select("a_id", "b_id", "a", "b")


_PAIRS_SQL = """
f AS (SELECT left(text, 24) AS k, min(doc_id) AS a_id FROM documents GROUP BY 1),
p AS (SELECT f.a_id, b.doc_id AS b_id, a.text AS a, b.text AS b FROM f JOIN documents b ON left(b.text, 24) = f.k AND b.doc_id > f.a_id JOIN documents a ON a.doc_id = f.a_id)
"""


def missing_anchors(spark, d):
    n = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[0-9]+"), F.lit(0)))
    p = _pairs(spark, d).select("a_id", "b_id", reconcile.missing_values(n(F.col("a")), n(F.col("b"))).alias("lost"))
    return p.select("a_id", "b_id", F.size("lost").alias("n_lost"), F.array_join("lost", " ").alias("lost"))


def length_ratio_flags(spark, d):
    a, b = X.content_length(F.col("a")), X.content_length(F.col("b"))
    p = _pairs(spark, d).select("a_id", "b_id", a.alias("a_len"), b.alias("b_len"))
    flag = gates.compression_flag(F.lit("body"), F.col("a_len"), F.col("b_len") / F.greatest("a_len", F.lit(1)), F.lit(0.45), F.lit(0.60))
    return p.select("a_id", "b_id", "a_len", "b_len", flag.alias("flag"))


def sentence_retention(spark, d):
    s = lambda c: X.sentence_count(F.col(c), r"[.!?]+\s|\n+")
    return _pairs(spark, d).select("a_id", "b_id", s("a").alias("a_sentences"), s("b").alias("b_sentences"))


def review_flags(spark, d):
    flags = X.review_flags(F.col("text"), F.col("source"), F.col("lang"))
    return _docs(spark, d).select("doc_id", F.array_join(flags, ",").alias("flags"))


def repeated_lines(spark, d):
    lines = _docs(spark, d).select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return corpus.repeated_keys(lines, "source", "doc_id", F.left(F.regexp_replace(F.lower(F.trim("line")), r"[0-9]+", "#"), F.lit(180)), 2, 0.0)


def running_values(spark, d):
    words = _docs(spark, d).select("lang", "doc_id", F.explode(F.array_distinct(F.split("text", "[ \n]+"))).alias("word"))
    return corpus.running_values(words.where("word <> ''"), "lang", "doc_id", "word")


def weighted_mode(spark, d):
    return corpus.weighted_mode(_docs(spark, d), "source", "lang", F.col("n_chars"))


def vocabulary(spark, d):
    return corpus.vocabulary(_docs(spark, d))


def context_window(spark, d):
    c = elements.context(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text")
    return c.select("conv_id", "turn", "before", "after")


def batch_assignment(spark, d):
    return ordering.assign(table(spark, d, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "worker")


def break_rules(spark, d):
    c = table(spark, d, "conversations").withColumn("kind", F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", "caption").otherwise("body"))
    out = elements.breaks_before(c, ["conv_id"], ["turn"], F.col("kind"), F.col("text"), F.floor(F.col("turn") / 3))
    return out.select("conv_id", "turn", "may_break")


def contains_join(spark, d):
    b = table(spark, d, "benchmark")
    return binding.contains_probes(b, _docs(spark, d), "item_id", "doc_id")


def anchor_overlap(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.explode(X.region_anchors(F.col("text"))).alias("anchor"))
    return binding.anchor_pages(items, _docs(spark, d), "item_id", "doc_id", 2).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_hits").alias("n_hits"))


TERMS = [("the", "the", ["The"], False), ("Nicht", "nicht", [], True), ("pour", "dans", ["que"], False), ("para", "por", [], False)]


def term_check(spark, d):
    terms = spark.createDataFrame(TERMS, "source string, target string, allowed_variants array<string>, case_sensitive boolean")
    pairs = _pairs(spark, d).select(F.col("b_id").alias("unit_id"), F.col("a").alias("source"), F.col("b").alias("target"))
    return binding.missing_terms(pairs, terms)


def three_level_gate(spark, d):
    t = F.col("text")
    out = gates.three_levels(_docs(spark, d), "source", "lang", F.regexp_count(t, F.lit("[a-z]")), F.regexp_count(t, F.lit("[^a-z\\s]")), F.col("n_chars") < 200, F.col("n_chars"))
    return out.select("level", "document", "batch", "n_units", F.round("ratio", 9).alias("ratio"), F.round("kept_ratio", 9).alias("kept_ratio"), "passes")


def unit_verdicts(spark, d):
    ship(spark)
    p = _pairs(spark, d).select("a_id", "b_id", F.col("a").alias("source"), F.col("b").alias("translation"))
    none = {c: F.lit(None).cast(t) for c, t in (("kind", "string"), ("role", "string"), ("keep_code", "string"), ("keep_reason", "string"), ("in_references", "boolean"), ("kept_terms", "array<string>"), ("cross_language", "boolean"))}
    return audit.verdicts(p.withColumns(none), "latin").select("a_id", "b_id", "state")


def document_decision(spark, d):
    doc = _docs(spark, d)
    flags = doc.select("source", F.when(F.col("n_chars") < 60, "SEVERE").when(F.col("n_chars") > 20000, "LONG").alias("code"))
    return gates.decision(flags, "source", ["SEVERE"]).select("source", "decision", F.array_join("codes", ",").alias("codes"))


def risk_against_median(spark, d):
    out = gates.against_median(_docs(spark, d).select("doc_id", "source", "n_chars"), ["source"], F.col("n_chars"), 50.0, 0.3)
    return out.select("doc_id", "source", "median", "low")


def chunk_text(spark, d):
    c = _docs(spark, d).select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("pos", "chunk"))
    return c.select("doc_id", "pos", F.char_length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("sha256"))


def pack_batches(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.char_length("text").alias("chars"), F.lit(True).alias("may_break"), (F.col("role") == "user").alias("is_heading"))
    return ordering.pack(c, "conv_id", 3, 2000, 2, 500)


def _seams(spark, d):
    """Turns whose text repeats the end of the turn before on two of three turns; of these the source repeats it too on every second."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("last", F.right(F.coalesce(F.lag("text").over(w), F.lit("")), (F.col("turn") * 5 + 9).cast("int")))
    repeats = F.when(F.col("turn") % 3 == 0, F.lit("")).otherwise(F.col("last"))
    return c.select(
        "conv_id",
        "turn",
        F.concat(repeats, "text").alias("target"),
        F.when(F.col("turn") % 2 == 0, F.concat(repeats, "text")).otherwise(F.concat(F.col("turn").cast("string"), "text")).alias("source"),
        F.floor(F.col("turn") / 2).alias("page"),
        F.when(F.col("turn") % 7 == 4, "Reference").otherwise(F.col("role")).alias("kind"),
    )


def adjacent_overlap(spark, d):
    ship(spark)
    return ordering.adjacent_overlaps(_seams(spark, d), ["conv_id"], ["turn"], "target", "source", "page", "kind").select("conv_id", "turn", "overlap")


def fuzzy_match(spark, d):
    ship(spark)
    return _pairs(spark, d).select("a_id", "b_id", A.fuzzy_match(F.col("a"), F.col("b")).alias("matches"))


def text_keys(spark, d):
    return _docs(spark, d).select("doc_id", keys.text_hash(F.col("text")).alias("sha256"), F.char_length(X.content_token(F.col("text"))).alias("n_content"), F.sha2(X.furniture_key(F.col("text")), 256).alias("furniture"))


def prose_predicates(spark, d):
    t = F.col("text")
    return _docs(spark, d).select(
        "doc_id", X.is_prose(t).alias("prose"), X.has_letters(t).alias("letters"), X.is_heading(t).alias("heading"), X.is_substantive(t).alias("substantive"), X.is_formula(t).alias("formula"), X.is_author(t).alias("author"), X.is_stamp(t).alias("stamp")
    )


def placeholder_scan(spark, d):
    return _docs(spark, d).select("lang", F.size(X.placeholders(F.col("text"))).alias("n"), X.suspicious(F.col("text")).alias("s")).groupBy("lang").agg(F.sum("n").alias("n_placeholders"), F.sum("s.soft_hyphens").alias("n_soft_hyphens"), F.sum("s.ligatures").alias("n_ligatures"))


def ordered_text_hash(spark, d):
    return keys.ordered_hash(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.concat_ws(":", "role", "text"))


def outline(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", "abstract").otherwise("body").alias("kind"), F.col("text").alias("source"))
    return elements.outline(c).select("doc_id", "title", "abstract")


def adjacent_lengths(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumn("reply", F.lead("text").over(w)).withColumn("r", F.lead("role").over(w)).where("role = 'user' and r = 'assistant'")
    return c.select("conv_id", "turn", X.content_length(F.col("text")).alias("asked"), X.content_length(F.col("reply")).alias("said"))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_summary, exact_dedup, script_counts, language_estimate, route_by_source, quality_join, email_acronym_anchors, url_anchors, href_anchors,
        statistic_anchors, acronym_anchors, missing_anchors, length_ratio_flags, sentence_retention, review_flags, repeated_lines, running_values, weighted_mode,
        vocabulary, context_window, batch_assignment, break_rules, contains_join, anchor_overlap, term_check, three_level_gate, unit_verdicts,
        document_decision, risk_against_median, chunk_text, pack_batches, adjacent_overlap, fuzzy_match, text_keys, prose_predicates, placeholder_scan,
        ordered_text_hash, outline, adjacent_lengths,
    )
}

_L = "[A-Za-zÀ-ÖØ-öø-ÿ]"
ORACLES = {
    "corpus_summary": f"""SELECT source, count(*) AS n_docs, count(DISTINCT sha256(text)) AS n_distinct, sum(n_chars)::BIGINT AS total,
        count(*) FILTER (regexp_matches(text, '{_L}')) AS n_latin FROM documents GROUP BY source""",
    "exact_dedup": """SELECT doc_id, sha256(text) AS sha256, CASE WHEN min(doc_id) OVER (PARTITION BY sha256(text)) < doc_id THEN min(doc_id) OVER (PARTITION BY sha256(text)) END AS duplicate_of FROM documents""",
    "script_counts": f"""SELECT doc_id, len(regexp_extract_all(text, '[\\x{{3400}}-\\x{{9fff}}]')) AS han, len(regexp_extract_all(text, '[\\x{{3040}}-\\x{{30ff}}\\x{{31f0}}-\\x{{31ff}}]')) AS kana,
        len(regexp_extract_all(text, '[\\x{{ac00}}-\\x{{d7af}}\\x{{1100}}-\\x{{11ff}}]')) AS hangul, len(regexp_extract_all(text, '{_L}')) AS latin, len(regexp_extract_all(text, '[0-9]')) AS digits FROM documents""",
    "language_estimate": f"""SELECT lang, CASE WHEN regexp_matches(text, '{_L}') THEN 'und-Latn' ELSE 'und' END AS estimate, count(*) AS n FROM documents GROUP BY 1, 2""",
    "route_by_source": """WITH g AS (SELECT source, count(*) AS n_pages, count(*) FILTER (n_chars < 100) AS n_scan, count(*) FILTER (n_chars > 12000 OR len(string_split(text, chr(10))) > 20) AS n_complex FROM documents GROUP BY source)
        SELECT *, CASE WHEN n_scan >= 0.25 * n_pages THEN 'scan-custom' WHEN n_complex >= 0.4 * n_pages THEN 'custom-layout' WHEN n_complex > 0 THEN 'hybrid-complex-pages' ELSE 'standard-auto' END AS route FROM g""",
    "quality_join": "SELECT lang, count(*) AS n_docs, count(quality) AS n_labelled, sum(toxic)::BIGINT AS n_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "email_acronym_anchors": r"""SELECT doc_id, 'email' AS kind, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))) AS anchor FROM documents
        UNION ALL SELECT doc_id, 'caps', unnest(list_distinct(regexp_extract_all(text, '\b[A-Z]{3,}\b'))) FROM documents""",
    "url_anchors": r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, regexp_replace(url, '[.,;:)\]]+$', '') AS stripped FROM pages""",
    "href_anchors": """WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS x FROM pages) SELECT page_id, unnest(range(len(x))) AS pos, unnest(x) AS href FROM h""",
    "acronym_anchors": r"""WITH m AS (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(text, '([^A-Za-z0-9-])', chr(1) || '\1' || chr(1), 'g'), '(?:^|\x01)([A-Z][A-Z0-9-]{1,12})(?:$|\x01)', 1), lambda x: x NOT IN ('AND', 'ARTICLE', 'AUTHOR',
        'AUTHORS', 'BY', 'CONCLUSIONS', 'CONTRIBUTIONS', 'FOUNDATION', 'FUNDING', 'LITERATURE', 'METHOD', 'METHODS', 'OPEN', 'RESEARCH', 'RESULTS', 'REVIEW', 'STATEMENT', 'THEORY')) AS x FROM documents),
        u AS (SELECT doc_id, x, list_distinct(x) AS y FROM m)
        SELECT doc_id, len(list_filter(y, lambda a: length(a) <= 8 AND (regexp_matches(a, '[0-9-]') OR len(list_filter(x, lambda b: b = a)) >= 2)))::INT AS n_required, len(y)::INT AS n_present FROM u WHERE len(y) > 0""",
    "missing_anchors": f"""WITH {_PAIRS_SQL}, q AS (SELECT a_id, b_id, list_sort(list_filter(list_distinct(regexp_extract_all(a, '[0-9]+')), lambda v: NOT list_contains(regexp_extract_all(b, '[0-9]+'), v))) AS lost FROM p)
        SELECT a_id, b_id, len(lost) AS n_lost, array_to_string(lost, ' ') AS lost FROM q""",
    "length_ratio_flags": f"""WITH {_PAIRS_SQL}, q AS (SELECT a_id, b_id, len(regexp_extract_all(a, '[\\p{{L}}\\p{{N}}_]')) AS a_len, len(regexp_extract_all(b, '[\\p{{L}}\\p{{N}}_]')) AS b_len FROM p)
        SELECT *, CASE WHEN a_len < 30 THEN NULL WHEN b_len / greatest(a_len, 1) < 0.45 THEN 'SEVERE_TRANSLATION_COMPRESSION' WHEN a_len >= 120 AND b_len / greatest(a_len, 1) < 0.6 THEN 'POSSIBLE_SUMMARY_OR_OMISSION' END AS flag FROM q""",
    "sentence_retention": f"""WITH {_PAIRS_SQL} SELECT a_id, b_id, len(list_filter(regexp_split_to_array(a, '[.!?]+\\s|\\n+'), lambda x: len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]')) >= 8)) AS a_sentences,
        len(list_filter(regexp_split_to_array(b, '[.!?]+\\s|\\n+'), lambda x: len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]')) >= 8)) AS b_sentences FROM p""",
    "review_flags": r"""WITH b(family, words) AS (VALUES
        ('en', 'not|no|without|neither|nor|may|might|could|suggest|suggests|suggested|appear|appears|appeared|likely|associate|associated|associates|correlate|correlated|correlation|predict|predicts|predicted|prediction|cause|caused|causal|effect|result in|results in|resulted in|lead to|leads to|leading to|limitation|limitations'),
        ('fr', '(?:ne|pas|sans|peut|pourrait|suggère|suggere|semble|associ|corrél|correl|prédict|predict|caus|effet|limite)[\p{L}\p{N}_]*'),
        ('de', '(?:nicht|kein|ohne|kann|könnte|konnte|deutet|scheint|assozi|korrel|vorhers|ursäch|ursach|effekt|grenze)[\p{L}\p{N}_]*'),
        ('es', '(?:no|sin|puede|podría|podria|sugiere|parece|asoci|correl|predic|caus|efecto|limitación|limitacion)[\p{L}\p{N}_]*')),
        d AS (SELECT *, CASE WHEN starts_with(lower(lang), 'zh') THEN 'zh' WHEN lower(lang[1:2]) IN ('fr', 'de', 'es') THEN lower(lang[1:2]) ELSE 'en' END AS family FROM documents)
        SELECT doc_id, array_to_string(list_filter([
        CASE WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:' || words || ')(?:$|[^\p{L}\p{N}_])') THEN 'semantic-boundary' END,
        CASE WHEN lower(source) IN ('abstract', 'result', 'discussion', 'conclusion') OR regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:abstract|result|results|discussion|limitation|limitations|conclusion|conclusions)(?:$|[^\p{L}\p{N}_])|摘要|结果|讨论|局限|结论') THEN 'semantic-high-risk' END,
        CASE WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:(?:sample|participant|respondent|subject|subjects|patient|patients|mean|median|standard deviation|confidence interval|effect size|odds ratio|hazard ratio|cronbach|regression|anova|chi[- ]?square)(?:$|[^\p{L}\p{N}_])|[NP]\s*[=:]\s*\d|p\s*[<=>≤≥]\s*0?\.\d|(?:SD|SE|CI|OR|HR|RR)\s*[=:]\s*[-+]?\d)|\d\s*%') THEN 'statistics-or-sample' END,
        CASE WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(?:scale|questionnaire|inventory|instrument|measure|item|subscale|likert|reverse[- ]?scor|scored?|scores|scoring|cronbach(?:''s)? alpha|reliability|validity)(?:$|[^\p{L}\p{N}_])') THEN 'instrument-item-or-scoring' END], lambda x: x IS NOT NULL), ',') AS flags
        FROM d LEFT JOIN b USING (family)""",
    "repeated_lines": """WITH l AS (SELECT source, doc_id, left(regexp_replace(lower(trim(unnest(string_split(text, chr(10))))), '[0-9]+', '#', 'g'), 180) AS key FROM documents)
        SELECT source, key, count(DISTINCT doc_id) AS n_hits FROM l WHERE length(key) >= 8 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 2""",
    "running_values": """WITH w AS (SELECT lang, doc_id, unnest(list_distinct(regexp_split_to_array(text, '[ \\n]+'))) AS word FROM documents), t AS (SELECT lang, count(DISTINCT doc_id) AS n FROM w WHERE word <> '' GROUP BY 1)
        SELECT w.lang, word, count(DISTINCT doc_id) AS n_hits FROM w JOIN t USING (lang) WHERE word <> '' GROUP BY w.lang, word, n HAVING count(DISTINCT doc_id) >= greatest(4, ceil(0.6 * n))""",
    "weighted_mode": """WITH s AS (SELECT source, lang, sum(n_chars)::BIGINT AS weight FROM documents GROUP BY 1, 2) SELECT source, lang, weight FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight DESC, lang) = 1""",
    "vocabulary": r"""WITH v AS (SELECT regexp_replace(regexp_replace(text, '(?i)https?://[^\s<>"'']+', ' ', 'g'), '\p{L}+-\s*\n\s*\p{L}+', ' ', 'g') AS t FROM documents), w AS (SELECT unnest(regexp_extract_all(lower(t), '\p{L}[\p{L}''-]*')) AS word FROM v)
        SELECT word, count(*) AS n FROM w GROUP BY word""",
    "context_window": """SELECT conv_id, turn, concat_ws(chr(10), right(lag(text, 2) OVER w, 320), right(lag(text, 1) OVER w, 320)) AS before, concat_ws(chr(10), left(lead(text, 1) OVER w, 320), left(lead(text, 2) OVER w, 320)) AS after
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "batch_assignment": "SELECT conv_id, turn, ntile(5) OVER (PARTITION BY conv_id ORDER BY turn) AS worker FROM conversations",
    "break_rules": r"""WITH c AS (SELECT *, CASE role WHEN 'system' THEN 'heading' WHEN 'user' THEN 'caption' ELSE 'body' END AS kind, turn // 3 AS page FROM conversations),
        l AS (SELECT *, lag(kind) OVER w AS k, lag(text) OVER w AS t, lag(page) OVER w AS p FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, CASE WHEN k IS NULL THEN true WHEN k = 'heading' THEN false WHEN k = 'caption' AND kind <> 'heading' THEN false ELSE NOT (p <> page AND NOT regexp_matches(t, '[.。!！?？;；]\s*$')) END AS may_break FROM l""",
    "contains_join": r"""WITH b AS (SELECT item_id, regexp_replace(text, '[\s\x00-\x1f\x7f]+', '', 'g') AS t FROM benchmark),
        q AS (SELECT item_id, unnest(list_filter(list_transform(range(least(6, (length(t) + 23) // 24)), lambda i: substr(t, i * 24 + 1, 24)), lambda x: length(x) >= 2)) AS probe FROM b),
        q2 AS (SELECT DISTINCT * FROM q), p AS (SELECT DISTINCT probe FROM q2), d AS (SELECT doc_id, regexp_replace(text, '[\s\x00-\x1f\x7f]+', '', 'g') AS t FROM documents),
        h AS (SELECT probe, doc_id FROM p JOIN d ON contains(d.t, probe))
        SELECT item_id, doc_id, count(DISTINCT probe) AS n_probes FROM q2 JOIN h USING (probe) GROUP BY 1, 2""",
    "anchor_overlap": r"""WITH i AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[0-9]+(?:\s*[x×]\s*[0-9]+)?|[A-Za-z]{3,}'), lambda v: regexp_replace(v, '\s+', '', 'g')), lambda v: length(v) >= 2) AS x FROM benchmark),
        i1 AS (SELECT item_id, unnest(x) AS anchor, unnest(range(len(x))) AS pos FROM i),
        i2 AS (SELECT item_id, anchor, min(pos) AS pos FROM i1 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY min(pos)) <= 12),
        p AS (SELECT DISTINCT anchor FROM i2), d AS (SELECT doc_id, regexp_replace(text, '[\s\x00-\x1f\x7f]+', '', 'g') AS t FROM documents),
        a AS (SELECT doc_id, anchor FROM p JOIN d ON contains(d.t, anchor)),
        h AS (SELECT item_id, doc_id, count(*) AS n FROM i2 JOIN a USING (anchor) GROUP BY 1, 2 HAVING count(*) >= 2), m AS (SELECT item_id, max(n) AS n FROM h GROUP BY 1)
        SELECT item_id, count(*) AS n_docs, max(n) AS n_hits FROM h JOIN m USING (item_id, n) GROUP BY item_id""",
    "term_check": f"""WITH {_PAIRS_SQL}, t(source, target, variants, cs) AS (VALUES ('the', 'the', ['The'], false), ('Nicht', 'nicht', []::VARCHAR[], true), ('pour', 'dans', ['que'], false), ('para', 'por', []::VARCHAR[], false))
        SELECT b_id AS unit_id, t.source AS term FROM p JOIN t ON contains(CASE WHEN cs THEN a ELSE lower(a) END, CASE WHEN cs THEN t.source ELSE lower(t.source) END)
        AND len(list_filter(list_concat([t.target], variants), lambda v: contains(CASE WHEN cs THEN b ELSE lower(b) END, CASE WHEN cs THEN v ELSE lower(v) END))) = 0""",
    "three_level_gate": r"""WITH r AS (SELECT source, lang, len(regexp_extract_all(text, '[a-z]')) AS t, len(regexp_extract_all(text, '[^a-z\s]')) AS x, CASE WHEN n_chars < 200 THEN n_chars ELSE 0 END AS k, n_chars AS c FROM documents),
        g AS (SELECT source, lang, grouping(lang) AS top, count(*) AS n_units, sum(t) AS t, sum(x) AS x, sum(k) AS k, sum(c) AS c FROM r GROUP BY GROUPING SETS ((source, lang), (source)))
        SELECT CASE WHEN top = 1 THEN 'document' ELSE 'batch' END AS level, source AS document, lang AS batch, n_units, round(t / (t + x), 9) AS ratio, round(k / c, 9) AS kept_ratio,
        t / (t + x) >= CASE WHEN top = 1 THEN 0.8 ELSE 0.7 END AND (top = 0 OR k / c <= 0.5) AS passes FROM g""",
    "document_decision": """WITH f AS (SELECT source, CASE WHEN n_chars < 60 THEN 'SEVERE' WHEN n_chars > 20000 THEN 'LONG' END AS code FROM documents)
        SELECT source, CASE WHEN count(*) FILTER (code = 'SEVERE') > 0 THEN 'NEEDS_REPAIR' WHEN count(code) > 0 THEN 'REVIEW' ELSE 'READY' END AS decision, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes FROM f GROUP BY source""",
    "risk_against_median": """WITH m AS (SELECT source, median(n_chars)::DOUBLE AS median FROM documents GROUP BY source) SELECT doc_id, source, median, n_chars < greatest(50.0, median * 0.3::DOUBLE) AS low FROM documents JOIN m USING (source)""",
    "pack_batches": """WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS chars, role = 'user' AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
        r AS (SELECT conv_id, turn AS ord, i, 0 AS batch, 1 AS n, chars::BIGINT AS c FROM c WHERE i = 1 UNION ALL
        SELECT c.conv_id, c.turn, c.i, CASE WHEN f THEN r.batch + 1 ELSE r.batch END, CASE WHEN f THEN 1 ELSE r.n + 1 END, CASE WHEN f THEN c.chars ELSE r.c + c.chars END
        FROM r JOIN c ON c.conv_id = r.conv_id AND c.i = r.i + 1, LATERAL (SELECT r.n >= 3 OR r.c + c.chars > 2000 OR (c.head AND r.n >= 2 AND r.c >= 500) AS f))
        SELECT conv_id, ord, batch FROM r""",
    "adjacent_overlap": r"""WITH l AS (SELECT *, right(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), (turn * 5 + 9)::INT) AS last FROM conversations),
        c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE last END || text AS target, CASE WHEN turn % 2 = 0 THEN CASE WHEN turn % 3 = 0 THEN '' ELSE last END ELSE turn::VARCHAR END || text AS source,
        turn // 2 AS page, turn % 7 = 4 OR lower(role) IN ('reference', 'references', 'bibliography') AS entry FROM l),
        n AS (SELECT conv_id, turn, page, entry, regexp_replace(strip_accents(target), '[^\p{L}\p{N}]', '', 'g') AS b, regexp_replace(strip_accents(source), '[^\p{L}\p{N}]', '', 'g') AS t FROM c),
        w AS (SELECT *, lag(b) OVER v AS a, lag(t) OVER v AS s, lag(page) OVER v AS q, lag(entry) OVER v AS e FROM n WINDOW v AS (PARTITION BY conv_id ORDER BY turn)),
        o AS (SELECT *, coalesce(list_max(list_filter(range(12, least(length(a), length(b)) + 1), lambda k: right(a, k) = left(b, k))), 0) AS overlap FROM w WHERE page - q BETWEEN 0 AND 1 AND NOT entry AND NOT e),
        k AS (SELECT *, least(overlap, length(s), length(t)) AS k FROM o WHERE overlap >= 16 OR (overlap > 0 AND overlap >= 0.35 * least(length(a), length(b))))
        SELECT conv_id, turn, overlap::INT AS overlap FROM k WHERE NOT (k >= 12 AND right(s, k) = left(t, k))""",
    "unit_verdicts": rf"""WITH {_PAIRS_SQL}, q AS (SELECT a_id, b_id, a, b, list_transform([a, b], lambda t: lower(trim(trim(regexp_replace(t, '\s+', ' ', 'g')), ' .,;:!?"''()[]{{}}“”‘’·—–-'))) AS v FROM p)
        SELECT a_id, b_id, CASE WHEN trim(b) = '' OR (regexp_matches(a, '\p{{L}}') AND v[1] = v[2]) THEN 'invalid' ELSE 'translated' END AS state FROM q""",
    "text_keys": r"""SELECT doc_id, sha256(text) AS sha256, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS n_content,
        sha256(left(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[0-9]+', '#', 'g'), 180)) AS furniture FROM documents""",
    "placeholder_scan": r"""SELECT lang, sum(len(list_distinct(regexp_extract_all(text, '\{\{[^{}]{1,80}\}\}'))))::BIGINT AS n_placeholders, sum(len(regexp_extract_all(text, '\x{ad}')))::BIGINT AS n_soft_hyphens,
        sum(len(regexp_extract_all(text, '[\x{fb00}-\x{fb06}]')))::BIGINT AS n_ligatures FROM documents GROUP BY lang""",
    "ordered_text_hash": "SELECT conv_id, sha256(string_agg(role || ':' || text, chr(31) ORDER BY turn)) AS hash FROM conversations GROUP BY conv_id",
    "outline": """SELECT conv_id AS doc_id, arg_min(text, (CASE WHEN role = 'system' THEN 0 ELSE 1 END) * 1000000 + turn) AS title, left(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), ''), 900) AS abstract FROM conversations GROUP BY conv_id""",
    "adjacent_lengths": r"""WITH c AS (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, len(regexp_extract_all(text, '[\p{L}\p{N}_]')) AS asked, len(regexp_extract_all(reply, '[\p{L}\p{N}_]')) AS said FROM c WHERE role = 'user' AND r = 'assistant'""",
}
