"""The audit on inputs of its own: verdicts, levels, coverage, pages."""

from pyspark.sql import functions as F

from leafmill.operators import audit

UNIT = (
    "doc_id int, batch int, unit_id int, page int, ord int, kind string, role string, source string, translation string, keep_code string, keep_reason string, "
    "in_references boolean, kept_terms array<string>, cross_language boolean"
)


def unit(i, source, said=None, *, doc=1, batch=1, page=1, kind="body", code=None, reason=None, cross=True):
    return (doc, batch, i, page, i, kind, None, source, said, code, reason, False, [], cross)


def judged(spark, rows, system="han"):
    return audit.verdicts(spark.createDataFrame(rows, UNIT), system)


def test_verdicts(spark):
    prose = "This sentence has several plain words."
    rows = [
        (unit(1, prose, "这一句话里有几个普通的词。"), None),
        (unit(2, prose, "  “this sentence has several plain words”  "), "TRANSLATION_EQUALS_SOURCE"),
        (unit(3, prose, "these are other words"), "TARGET_LANGUAGE_ABSENT"),
        (unit(4, prose, "这 these are other words"), "TARGET_LANGUAGE_RATIO_LOW"),
        (unit(5, "12 + 30", "12 + 30"), None),
        (unit(6, prose, ""), "UNIT_NOT_TRANSLATED"),
        (unit(7, prose, "好", code="citation"), "TRANSLATION_AND_KEEP_SOURCE_CONFLICT"),
        (unit(8, prose, None, reason="as agreed"), "KEEP_SOURCE_CODE_MISSING"),
        (unit(9, prose, None, code="citation"), "KEEP_SOURCE_CODE_NOT_ALLOWED_FOR_UNIT"),
        (unit(10, "[3, 4]", None, code="citation"), None),
        (unit(11, prose, prose, cross=False), None),
        (unit(12, "Reference to some plain words here", "Reference: some plain words", kind="reference"), None),
        (unit(13, None, None), "UNIT_NOT_TRANSLATED"),
    ]
    got = {r.unit_id: (r.problems, r.state) for r in judged(spark, [r for r, _ in rows]).collect()}
    for row, want in rows:
        assert got[row[2]][0] == ([want] if want else []), row
    assert got[10][1] == "kept-source" and got[1][1] == "translated" and got[6][1] == "invalid"
    assert judged(spark, [unit(1, prose, "other plain words here")], "latin").first().state == "translated"


def test_levels_and_coverage(spark):
    prose = "This sentence has several plain words."
    rows = [unit(1, prose, "这一句话里有几个普通的词"), unit(2, "ABC def", "abcdefghij", batch=2), unit(3, "[3]", None, code="citation", batch=None), unit(1, prose, None, doc=2)]
    v = judged(spark, rows)
    levels = {(r.level, r.doc_id, r.batch): r.problems for r in audit.evaluation(v).collect()}
    assert levels == {("document", 1, None): ["DOCUMENT_TARGET_LANGUAGE_RATIO_LOW"], ("batch", 1, 1): [], ("batch", 1, 2): ["BATCH_TARGET_LANGUAGE_RATIO_LOW"], ("document", 2, None): [], ("batch", 2, 1): []}
    c = {r.doc_id: r for r in audit.coverage(v).collect()}
    assert (c[1].units, c[1].claimed_translated, c[1].claimed_kept, c[1].invalid, c[1].complete, c[1].note) == (3, 2, 1, 0, False, "invalid")
    assert c[2].problem_codes == ["UNIT_NOT_TRANSLATED"] and not c[2].complete
    good = audit.coverage(judged(spark, [unit(1, prose, "这一句话里有几个普通的词")])).first()
    assert good.complete and good.note == "complete" and good.problem_codes == []
    assert audit.coverage(v.limit(0)).count() == 0


def pages(spark, rows, lang="zh", **more):
    df = spark.createDataFrame(rows, UNIT)
    return {r.page: r for r in audit.page_audit(df, F.lit("en"), F.lit(lang), **more).collect()}


def test_compression_and_retention_of_a_page(spark):
    source = "This sentence has several plain words. " * 30
    got = pages(spark, [unit(1, source, "短"), unit(2, source, "字" * 250, page=2), unit(3, source, "这一句话里有几个普通的词。" * 30, page=3), unit(4, source, None, page=5, kind="reference")])
    assert got[1].flags == ["LOW_SENTENCE_RETENTION", "SEVERE_TRANSLATION_COMPRESSION"]
    assert [r.unit_id for r in got[1].unit_issues] == [1]
    assert got[2].ratio == 0.26 and got[2].flags == ["LOW_SENTENCE_RETENTION"]
    assert got[3].flags == [] and got[3].source_sentences == got[3].translation_sentences == 30
    assert got[5].reference_page and got[5].flags == [] and got[5].source_chars == 0


def test_anchor_losses(spark):
    source = "We saw 1.5% and 2.5% and 3.5% and 4.5% and 5.5% and 6.5% at https://example.org/a and 10.1000/xyz in all of it."
    got = pages(spark, [unit(1, source, "我们看到 1.5% 和 2.5% 和 3.5% 和 4.5%，" + "字" * 40), unit(2, "plain", "5.5% 6.5%", page=2), unit(3, source, "我们看到 1.5%，" + "字" * 40, page=7)])
    assert got[1].missing_statistics == [] and got[1].relocated_statistics == ["5.5%", "6.5%"]
    assert got[1].missing_urls == ["https://example.org/a"] and got[1].missing_dois == ["10.1000/xyz"]
    assert got[1].flags == ["ADJACENT_PAGE_ANCHOR_SHIFT", "DOI_LOSS", "URL_LOSS"]
    assert got[7].missing_statistics == ["2.5%", "3.5%", "4.5%", "5.5%", "6.5%"] and "STATISTICAL_ANCHOR_LOSS" in got[7].flags
    assert got[7].unit_issues[0].flags == ["STATISTICAL_ANCHOR_LOSS"]


def test_validated_kept_units_are_not_compressed(spark):
    source = "Plain words that go on for a while, some more of them."
    kept = spark.createDataFrame([(1, 1)], "doc_id int, unit_id int")
    assert pages(spark, [unit(1, source, None)])[1].flags == ["SEVERE_TRANSLATION_COMPRESSION"]
    assert pages(spark, [unit(1, source, None)], kept=kept)[1].flags == []
    status = audit.audit_status(audit.page_audit(spark.createDataFrame([unit(1, source, None)], UNIT), F.lit("en"), F.lit("zh"))).first()
    assert (status.n_pages, status.n_flagged, status.n_repair, status.median_ratio) == (1, 1, 1, None)


def test_mapping_drift(spark):
    a = [str(i) for i in range(12)]
    rows = [(1, 1, a[:6], []), (1, 2, [], a[:6]), (1, 3, a[:6], a[:4]), (2, 1, a[:4], []), (2, 2, [], a[:4])]
    got = audit.mapping_drift(spark.createDataFrame(rows, "doc_id int, page int, anchors array<string>, target_anchors array<string>")).collect()
    assert [(r.doc_id, r.page, r.score, r.neighbour, r.neighbour_score) for r in got] == [(1, 1, 0, 2, 6)]


def test_a_page_audit_searches_each_text_once(spark):
    """Conversions of statistics once stood eleven times in the plan, and each was worked out anew."""
    from leafmill.plans import queries_audit

    pages = audit.page_audit(queries_audit._units(spark, "/root/testdata/sf0.001"), F.lit("en"), F.lit("zh"))
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("thousand|million|billion") <= 2
