"""Column functions over text: normalisation, script counts, anchors, predicates. JVM-side throughout.

Java regular expressions are ASCII for \\w, \\s and \\d unless (?U) is set; where the semantics are Unicode, classes are
written out. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, word lists and limits that results depend on.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
HAN = "\\x{3400}-\\x{9fff}"
KANA = "\\x{3040}-\\x{30ff}\\x{31f0}-\\x{31ff}"
HANGUL = "\\x{ac00}-\\x{d7af}\\x{1100}-\\x{11ff}"
URL = r"(?i)https?://[^\s<>\"']+"
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ARXIV = r"(?i)arxiv\s*:\s*(?:[a-z-]+(?:\.[A-Z]{2})?/)?\d{4}\.?\d{4,5}(?:v\d+)?"
CITATION = r"\[(\d+(?:\s*[-,;]\s*\d+)*)\]"
BRACKETS = r"\[[^\]]{0,40}\]"
ACRONYM = r"(?<![A-Za-z0-9-])[A-Z][A-Z0-9-]{1,12}(?![A-Za-z0-9-])"
ACRONYM_STOP = (
    "AND ARTICLE AUTHOR AUTHORS BY CONCLUSIONS CONTRIBUTIONS FOUNDATION FUNDING LITERATURE METHOD METHODS OPEN RESEARCH RESULTS REVIEW STATEMENT THEORY"
).split()
NUMBER = r"(?:\d+(?:\.\d+)?|\.\d+)"
STATISTIC = rf"(?<![A-Za-z0-9_.])[-+]?(?:{NUMBER}\s*%(?![A-Za-z0-9_])|(?:\d+\.\d+|\.\d+)(?![A-Za-z0-9_.]))"
SIZE_NUMBER = r"(?i)\b(?:n|df)\s*[=:<>]\s*([-+]?\d+)"
BARE_HEADINGS = (
    "abstract",
    "introduction",
    "background",
    "method",
    "methods",
    "materials and methods",
    "results",
    "discussion",
    "conclusion",
    "conclusions",
    "acknowledgement",
    "acknowledgements",
    "acknowlegements",
    "references",
    "bibliography",
    "appendix",
    "摘要",
    "引言",
    "方法",
    "结果",
    "讨论",
    "结论",
    "致谢",
    "参考文献",
)
NUMBERED_HEADING = r"^\s*(?:\d+(?:\.\d+)*\.?|[一二三四五六七八九十]+[、.])\s+\S"
SENTENCE_INSIDE = "[.。!！?？][\\s\"'”’)\\]]"
SENTENCE_END = r"[.。!！?？;；]\s*$"
STAMP = r"(?i)(?:arxiv\s*:\s*\d|doi\s*:\s*10\.|bioRxiv|medRxiv|©|\bISSN\b|\bISBN\b)"
BARE_DOI = r"(?<![\d.])10\.\d{4,9}/\S"
AFFILIATION = r"(?i)(?:university|universit|institute|department|dept\.|laborator|college|hospital|academy|centre|center|school of|faculty|大学|学院|研究所|系)"
FIGURE_CAPTION = r"(?i)^\s*(?:fig(?:ure)?\.?|图)\s*([0-9IVXivx]+)\b"
TABLE_CAPTION = r"(?i)^\s*(?:table|tab\.|表)\s*([0-9IVXivx]+)\b"
MATH = "=+−\\-×÷±∓≈≠≤≥<>∈∉⊂⊃∪∩∑∏∫√∂∇∞→←↔⇒⇔∀∃¬∧∨⊕⊗αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩˆ˜¯′″‴⌊⌋⌈⌉|/\\^_⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"
NAME_PARTICLES = "de del der di du la le van von".split()
LIGATURES = "ﬀﬁﬂﬃﬄﬅﬆ"
SPACE = r"(?U)\s+"
BOUNDARY_WORDS = {
    "en": r"\b(?:not|no|without|neither|nor|may|might|could|suggest(?:s|ed)?|appear(?:s|ed)?|likely|associate(?:d|s)?|correlat(?:e|ed|ion)|predict(?:s|ed|ion)?|caus(?:e|ed|al)|effect|result(?:s|ed)? in|lead(?:s|ing)? to|limitation(?:s)?)\b",
    "zh": "并非|不是|不能|无法|未发现|没有|可能|或许|提示|表明|相关|关联|预测|导致|因果|局限",
    "fr": r"\b(?:ne|pas|sans|peut|pourrait|sugg[eè]re|semble|associ|corr[eé]l|pr[eé]dit|caus|effet|limite)\w*\b",
    "de": r"\b(?:nicht|kein|ohne|kann|k[oö]nnte|deutet|scheint|assozi|korrel|vorhers|urs[aä]ch|effekt|grenze)\w*\b",
    "es": r"\b(?:no|sin|puede|podr[ií]a|sugiere|parece|asoci|correl|predic|caus|efecto|limitaci[oó]n)\w*\b",
}
HIGH_RISK_KINDS = ("abstract", "result", "discussion", "conclusion")
HIGH_RISK_SECTION = r"\b(?:abstract|results?|discussion|limitations?|conclusions?)\b|(?:摘要|结果|讨论|局限|结论)"
STATISTICS_WORDS = (
    r"(?:\b(?:sample|participant|respondent|subjects?|patients?|mean|median|standard deviation|confidence interval|effect size|odds ratio|hazard ratio|cronbach|regression|anova|chi[- ]?square)\b"
    r"|\b[NP]\s*[=:]\s*\d+|\bp\s*(?:[<=>≤≥])\s*0?\.\d+|\b(?:SD|SE|CI|OR|HR|RR)\s*[=:]\s*[-+]?\d|\d+(?:\.\d+)?\s*%)"
)
INSTRUMENT_WORDS = r"\b(?:scale|questionnaire|inventory|instrument|measure|item|subscale|likert|reverse[- ]?scor|score(?:d|s|ing)?|cronbach(?:'s)? alpha|reliability|validity)\b"
REGION_ANCHOR = r"[0-9]+(?:\s*[x×]\s*[0-9]+)?|[A-Za-z]{3,}"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean(c: Column) -> Column:
    """White space collapsed and trimmed (any Unicode white space)."""
    return F.trim(F.regexp_replace(text(c), SPACE, " "))


def furniture_key(c: Column) -> Column:
    """Lower case, digits as #, 180 characters: equal for running heads that differ in a page number."""
    return F.left(F.regexp_replace(F.lower(clean(c)), r"\d+", "#"), F.lit(180))


def script_counts(c: Column) -> Column:
    t = text(c)
    return F.struct(
        count(t, f"[{HAN}]").alias("han"),
        count(t, f"[{KANA}]").alias("kana"),
        count(t, f"[{HANGUL}]").alias("hangul"),
        count(t, f"[{LATIN}]").alias("latin"),
        count(t, r"(?U)\d").alias("digits"),
    )


def target_chars(c: Column, system: str) -> Column:
    s = script_counts(c)
    return {"han": s["han"], "japanese": s["han"] + s["kana"], "hangul": s["hangul"] + s["han"]}.get(system, s["latin"])


def language_estimate(c: Column) -> Column:
    s = script_counts(c)
    return (
        F.when(s["hangul"] > F.greatest(s["han"], s["latin"]), "ko")
        .when(s["kana"] > 20, "ja")
        .when(s["han"] > s["latin"], "zh")
        .when(s["latin"] > 0, "und-Latn")
        .otherwise("und")
    )


def anchor_text(c: Column) -> Column:
    """Minus variants as -, zero-width characters and soft hyphens dropped. NFKC is `functions.arrow.nfkc`."""
    return F.regexp_replace(F.translate(text(c), "−﹣－", "---"), "[​‌‍⁠﻿­]", "")


def content_token(c: Column) -> Column:
    return F.regexp_replace(text(c), r"[^\p{L}\p{N}]", "")


def canonical_number(c: Column) -> Column:
    """0.70 -> 0.7, .07 -> 0.07, -0 -> 0; a percent sign stays."""
    v = F.lower(F.regexp_replace(c, SPACE, ""))
    percent = F.endswith(v, F.lit("%"))
    n = F.regexp_replace(v, "[+%]", "")
    negative = F.startswith(n, F.lit("-"))
    n = F.regexp_replace(n, "^-", "")
    whole = F.regexp_replace(F.substring_index(n, ".", 1), "^0+(?=.)", "")
    part = F.when(F.contains(n, F.lit(".")), F.regexp_replace(F.substring_index(n, ".", -1), "0+$", "")).otherwise("")
    whole = F.when(whole == "", "0").otherwise(whole)
    body = F.when(part == "", whole).otherwise(F.concat_ws(".", whole, part))
    return F.concat(F.when(negative & (body != "0"), "-").otherwise(""), body, F.when(percent, "%").otherwise(""))


def statistics(c: Column) -> Column:
    """Sorted distinct canonical decimals and percentages, and n= / df= integers; percent ranges count both ends as percentages."""
    v = F.regexp_replace(F.regexp_replace(anchor_text(c), URL, " "), DOI, " ")
    v = F.regexp_replace(v, r"(?<![A-Za-z0-9_.])([-+])\s+(?=\d|\.\d)", "$1")
    v = F.regexp_replace(v, rf"([-+]?{NUMBER})\s*[-–—]\s*([-+]?{NUMBER})\s*%", "$1% to $2%")
    v = F.regexp_replace(v, rf"({NUMBER}\s*%?)\s*[-–—]\s*(?=\d|\.\d)", "$1 to ")
    found = F.transform(_all(v, STATISTIC), canonical_number)
    return F.array_sort(F.array_distinct(F.concat(found, _all(v, SIZE_NUMBER, 1))))


def citations(c: Column) -> Column:
    """Numbers in [1, 3-5] as listed; a range is not expanded."""
    groups = _all(text(c), CITATION, 1)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(groups, lambda g: _all(g, r"\d+")))))


def _stop(x: Column) -> Column:
    return ~x.isin(ACRONYM_STOP) & ~x.rlike(r"^\d+$")


def acronyms(c: Column) -> Column:
    """Acronyms a source text commits to: at most 8 characters, and repeated or with a digit or hyphen."""
    all_ = _all(text(c), ACRONYM)
    often = lambda x: F.size(F.filter(all_, lambda y: y == x)) >= 2
    return F.array_sort(F.filter(F.array_distinct(all_), lambda x: _stop(x) & (F.char_length(x) <= 8) & (often(x) | x.rlike(r"[\d-]"))))


def present_acronyms(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(_all(text(c), ACRONYM), _stop)))


def _stripped(c: Column) -> Column:
    return F.transform(c, lambda x: F.regexp_replace(x, r"[.,;:)\]]+$", ""))


def dois(c: Column) -> Column:
    return F.array_sort(F.array_distinct(_stripped(_all(text(c), DOI))))


def urls(c: Column) -> Column:
    return F.array_sort(F.array_distinct(_stripped(_all(text(c), URL))))


def emails(c: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text(c), EMAIL)))


def required_anchors(c: Column) -> Column:
    return F.struct(
        statistics(c).alias("statistics"),
        citations(c).alias("citations"),
        acronyms(c).alias("acronyms"),
        dois(c).alias("dois"),
        urls(c).alias("urls"),
    )


def converted_statistics(source: Column, target: Column) -> Column:
    """Source quantities (thousand, million, billion) whose value the target states in 万 or 亿, within 1e-6."""
    factor = lambda u: F.when(F.lower(u) == "thousand", 1e3).when(F.lower(u) == "million", 1e6).when(F.lower(u) == "billion", 1e9).when(u == "万", 1e4).otherwise(1e8)
    value = lambda x: F.regexp_extract(x, r"[\d.]+", 0).cast("double") * factor(F.regexp_extract(x, r"([A-Za-z]+|万|亿)", 1))
    mine = _all(anchor_text(source), r"(?i)(?<![A-Za-z0-9_.])\d+(?:\.\d+)?\s*(?:thousand|million|billion)\b")
    theirs = F.transform(_all(anchor_text(target), r"(?<![A-Za-z0-9_.])\d+(?:\.\d+)?\s*(?:万|亿)"), value)
    same = lambda x: F.exists(theirs, lambda y: F.abs(y - value(x)) <= 1e-6 * F.greatest(F.abs(y), F.lit(1.0)))
    return F.array_sort(F.array_distinct(F.transform(F.filter(mine, same), lambda x: canonical_number(F.regexp_extract(x, r"[\d.]+", 0)))))


def content_length(c: Column) -> Column:
    """Letters, digits, underscores and Han."""
    return count(text(c), rf"[\p{{L}}\p{{N}}_{HAN}]")


def content_length_strict(c: Column) -> Column:
    """Without white space, punctuation and underscores."""
    return count(text(c), r"[\p{L}\p{N}]")


def sentence_count(c: Column, pattern: str = r"(?<=[.!?])\s+|\n+") -> Column:
    pieces = F.split(text(c), pattern)
    return F.size(F.filter(pieces, lambda x: content_length(x) >= 8))


def year_present(year: Column, target: Column) -> Column:
    """The year, or for a decade such as 1980s the Chinese phrase."""
    plain = F.regexp_replace(F.lower(year), "[’']", "")
    start = F.regexp_extract(plain, r"^((?:18|19|20)\d{2})s$", 1)
    n = start.try_cast("int")
    phrase = F.concat((F.floor(n / 100) + 1).cast("string"), F.lit("世纪"), (n % 100).cast("string"), F.lit("年代"))
    squeezed = F.regexp_replace(text(target), SPACE, "")
    named = F.array_contains(F.transform(_all(text(target), r"(?i)(?:18|19|20)\d{2}(?:['’]?s)?"), lambda x: F.regexp_replace(F.lower(x), "[’']", "")), plain)
    return named | ((start != "") & F.contains(squeezed, phrase))


def suspicious(c: Column) -> Column:
    return F.struct(count(text(c), "­").alias("soft_hyphens"), count(text(c), f"[{LIGATURES}]").alias("ligatures"))


def dehyphenate(c: Column) -> Column:
    """Joins lines; a hyphen before a line break and a lower-case letter goes."""
    joined = F.regexp_replace(text(c), r"(?<=[\p{L}])-\s*\n\s*(?=\p{Ll})", "")
    return clean(joined)


def strip_protected(c: Column) -> Column:
    v = text(c)
    for pattern in (URL, DOI, EMAIL, ARXIV, BRACKETS, ACRONYM):
        v = F.regexp_replace(v, pattern, " ")
    return v


def strip_terms(c: Column, terms: Column) -> Column:
    """Kept terms removed, longest first."""
    ordered = F.array_sort(terms, lambda a, b: F.char_length(b) - F.char_length(a))
    return F.aggregate(ordered, c, lambda acc, term: F.when(term == "", acc).otherwise(F.replace(acc, term, F.lit(" "))))


def residual_letters(c: Column) -> Column:
    return count(strip_protected(c), f"[{LATIN}]")


def target_ratio(c: Column, system: str) -> Column:
    """Target script characters over these and the Latin letters left without protected pieces; null without either."""
    t = target_chars(c, system)
    return F.when(t + residual_letters(c) > 0, t / (t + residual_letters(c)))


def is_prose(c: Column) -> Column:
    return F.size(F.filter(_all(strip_protected(c), f"[{LATIN}][{LATIN}'-]*"), lambda w: F.char_length(w) >= 3)) >= 3


def has_letters(c: Column) -> Column:
    return text(c).rlike(r"\p{L}")


def cross_language(a: Column, b: Column) -> Column:
    base = lambda x: F.lower(F.substring_index(F.substring_index(text(x), "-", 1), "_", 1))
    return (base(a) == "") | (base(b) == "") | (base(a) != base(b))


def is_heading(c: Column) -> Column:
    v = clean(c)
    bare = F.lower(F.btrim(v, F.lit(" :："))).isin(list(BARE_HEADINGS))
    return (v != "") & (F.char_length(v) <= 120) & ~v.rlike(SENTENCE_INSIDE) & (v.rlike(NUMBERED_HEADING) | bare)


def is_stamp(c: Column) -> Column:
    v = clean(c)
    return v.rlike(STAMP) | ((F.char_length(v) <= 200) & v.rlike(BARE_DOI))


def is_affiliation(c: Column) -> Column:
    return clean(c).rlike(AFFILIATION) & ~is_heading(c)


def is_author(c: Column) -> Column:
    v = clean(c)
    words = _all(v, f"[{LATIN}][{LATIN}.'-]*")
    upper = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    shaped = (F.size(words) > 0) & (F.char_length(v) <= 120) & (upper / F.greatest(F.size(words), F.lit(1)) >= 0.7)
    joined = F.contains(v, F.lit(",")) | v.rlike(r"\band\b|、")
    return v.rlike(EMAIL) | (~is_heading(c) & ~is_affiliation(c) & shaped & joined & ~v.rlike(SENTENCE_END))


def is_proper_name(c: Column) -> Column:
    words = _all(text(c), f"[{LATIN}][{LATIN}’'`.-]*")
    named = lambda w: F.lower(w).isin(NAME_PARTICLES) | w.rlike(f"^[A-ZÀ-ÖØ-Þ][{LATIN}’'`.-]*$")
    return F.size(words).between(2, 7) & F.forall(words, named)


def is_substantive(c: Column) -> Column:
    v = clean(c)
    words = count(v, r"[A-Za-z]+(?:['’-][A-Za-z]+)*")
    return (count(v, f"[{HAN}]") >= 80) | (words >= 28) | ((words >= 18) & v.rlike("[.!?。！？][\"'”’)\\]]*$"))


def caption_kind(c: Column) -> Column:
    return F.when(text(c).rlike(FIGURE_CAPTION), "figure").when(text(c).rlike(TABLE_CAPTION), "table")


def caption_label(c: Column) -> Column:
    label = F.coalesce(F.nullif(F.regexp_extract(text(c), FIGURE_CAPTION, 1), F.lit("")), F.nullif(F.regexp_extract(text(c), TABLE_CAPTION, 1), F.lit("")))
    return label


def is_table_note(c: Column) -> Column:
    return text(c).rlike(r"(?i)^\s*(?:note|notes|注)\s*[.:：]")


def math_density(c: Column) -> Column:
    solid = F.regexp_replace(text(c), SPACE, "")
    return F.when(F.char_length(solid) == 0, 0.0).otherwise(count(solid, f"[{MATH}]") / F.char_length(solid))


def is_formula(c: Column) -> Column:
    prose = F.filter(_all(text(c), r"[A-Za-z][A-Za-z'-]{2,}"), lambda w: w != F.upper(w))
    return (F.trim(text(c)) != "") & (F.size(prose) <= 3) & (math_density(c) >= 0.10)


def placeholders(c: Column) -> Column:
    """Template leftovers: {{name}}, without white space."""
    return F.array_distinct(F.transform(_all(text(c), r"\{\{[^{}]{1,80}\}\}"), lambda x: F.regexp_replace(x, SPACE, "")))


def probe_text(c: Column) -> Column:
    """Without white space and ASCII control characters."""
    return F.regexp_replace(text(c), r"(?U)[\s\x00-\x1f\x7f]+", "")


def probes(c: Column, size: int = 24, most: int = 6, least: int = 2) -> Column:
    """Up to `most` windows of `size` characters, end to end; the last may be shorter, but not below `least`."""
    v = probe_text(c)
    n = F.least(F.lit(most), F.ceil(F.char_length(v) / size).cast("int"))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(v, (i - 1) * size + 1, F.lit(size)))
    return F.filter(cut, lambda x: F.char_length(x) >= least)


def region_anchors(c: Column, most: int = 12) -> Column:
    """The first distinct numbers (sizes such as 3 x 3 as one) and Latin words of three letters or more, without white space."""
    found = F.transform(_all(text(c), REGION_ANCHOR), probe_text)
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.char_length(x) >= 2)), 1, most)


def font_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]", "")


def decimals_lost(source: Column, target: Column) -> Column:
    """Decimals of the source that are no substring of the target."""
    return F.filter(F.array_distinct(_all(text(source), r"\d+\.\d+|\.\d+")), lambda n: ~F.contains(text(target), n))


def cell_class(c: Column) -> Column:
    v = F.trim(text(c))
    return F.when(v == "", "blank").when(v.rlike("^(?:[-–—]+|(?i:n/?a)|\\.\\.\\.|…)$"), "missing").otherwise("value")


def numbers_of_spec(c: Column) -> Column:
    """`1-3,7` as numbers; null for a malformed list."""
    parts = F.split(F.regexp_replace(text(c), SPACE, ""), ",")
    ok = text(c).rlike(r"^\s*\d+\s*(?:-\s*\d+\s*)?(?:,\s*\d+\s*(?:-\s*\d+\s*)?)*$")
    first = lambda x: F.substring_index(x, "-", 1).try_cast("int")
    last = lambda x: F.substring_index(x, "-", -1).try_cast("int")
    each = F.transform(parts, lambda x: F.when(first(x) <= last(x), F.sequence(first(x), last(x))).otherwise(F.array().cast("array<int>")))
    return F.when(ok, F.array_sort(F.array_distinct(F.flatten(each))))


def join_lines(lines: Column) -> Column:
    """Lines joined by a space, except within a URL that a line end has cut."""
    glue = lambda acc, x: F.when(acc == "", x).when(acc.rlike(r"https?://\S*[/\-_.=&?]$"), F.concat(acc, x)).otherwise(F.concat(acc, F.lit(" "), x))
    return F.aggregate(F.transform(lines, clean), F.lit(""), glue)


def chunks(c: Column, most: int = 900) -> Column:
    """Sentences packed greedily up to `most` characters; a longer sentence stays whole, text without a sentence end is cut."""
    v = clean(c)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(v) / most).cast("int"), F.lit(1)) - 1), lambda i: F.substr(v, i * most + 1, F.lit(most)))
    sentences = F.filter(F.split(v, r"(?<=[.!?。！？])\s+"), lambda x: x != "")
    fits = lambda acc, s: (F.char_length(acc["open"]) > 0) & (F.char_length(acc["open"]) + 1 + F.char_length(s) <= most)
    step = lambda acc, s: (
        F.when(F.char_length(acc["open"]) == 0, F.struct(acc["done"].alias("done"), s.alias("open")))
        .when(fits(acc, s), F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(" "), s).alias("open")))
        .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), s.alias("open")))
    )
    packed = F.aggregate(
        sentences,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")),
        step,
        lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]),
    )
    return F.when(v == "", F.array().cast("array<string>")).when((F.size(sentences) <= 1) & (F.char_length(v) > most), cut).otherwise(packed)


def language_family(language: Column) -> Column:
    """zh, fr, de or es by the code's beginning, else en."""
    v = F.lower(text(language))
    return F.when(v.startswith("zh"), "zh").when(v.startswith("fr"), "fr").when(v.startswith("de"), "de").when(v.startswith("es"), "es").otherwise("en")


def review_flags(c: Column, kind: Column | None = None, language: Column | None = None) -> Column:
    """Boundary wording of the source language's family, high-risk section (by kind or wording), statistics or samples, instruments."""
    v = text(c)
    said = lambda pattern: v.rlike("(?iU)" + pattern)
    family = language_family(F.lit(None).cast("string") if language is None else language)
    boundary = F.lit(False)
    for name, pattern in BOUNDARY_WORDS.items():
        boundary = boundary | ((family == name) & said(pattern))
    risky = said(HIGH_RISK_SECTION)
    if kind is not None:
        risky = risky | F.lower(text(kind)).isin(*HIGH_RISK_KINDS)
    rules = {"semantic-boundary": boundary, "semantic-high-risk": risky, "statistics-or-sample": said(STATISTICS_WORDS), "instrument-item-or-scoring": said(INSTRUMENT_WORDS)}
    return F.array_compact(F.array(*[F.when(hit, F.lit(k)) for k, hit in rules.items()]))
