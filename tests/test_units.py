from pyspark.sql import functions as F

from leafmill.operators import qa, units

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_findings(spark):
    cols = {"chars": "int", "bold_share": "double", "images": "int"}
    rules = [r for r in qa.RULES if r[0] in ("REFERENCE_FONT_TOO_BOLD", "BLANK_PAGES")]
    df = spark.createDataFrame([(1, 300, 0.7, 0), (2, 0, None, 0), (3, 300, None, 1)], "page int, " + ", ".join(f"{k} {v}" for k, v in cols.items()))
    assert {tuple(r) for r in qa.findings(df, ["page"], rules).collect()} == {(1, "REFERENCE_FONT_TOO_BOLD", "H"), (2, "BLANK_PAGES", "H")}


def test_units_and_segments(spark):
    lines = spark.createDataFrame([(0, 1, 7, 0, "1 Intro"), (0, 1, 7, 1, "Some text that goes"), (0, 1, 7, 2, "on."), (0, 1, 8, 0, "2 End")], "doc_id int, page int, block_id int, line_no int, text string")
    got = {(r.block_id, r.segment): r.text for r in units.segments(lines, F.col("text").rlike(r"^\d ")).collect()}
    assert got == {(7, "heading"): "1 Intro", (7, "body"): "Some text that goes on.", (8, "heading"): "2 End"}
    blocks = spark.createDataFrame([(0, 1, 1, 7, "body", "A sen-\ntence here. Another one."), (0, 1, 2, 8, "body", "")], "doc_id int, page int, position int, block_id int, kind string, text string")
    u = units.units(blocks, 20).orderBy("unit_id").collect()
    assert [(r.unit_id, r.source) for r in u] == [("p0001-u0001", "A sentence here."), ("p0001-u0002", "Another one.")]


def test_references(spark):
    lines = spark.createDataFrame([(0, 1, "[1] First entry"), (0, 2, "goes on https://a.b/"), (0, 3, "c/d"), (0, 4, "[2] Second"), (0, 5, "Acknowledgements"), (0, 6, "thanks")], "doc_id int, n int, text string")
    e = units.reference_entries(units.trim_tail(lines, ["doc_id"], "n"), ["doc_id"], "n").orderBy("entry").collect()
    assert [(r.number, r.text) for r in e] == [(1, "[1] First entry goes on https://a.b/c/d"), (2, "[2] Second")]
    bad = spark.createDataFrame([(0, 1, "x"), (0, 3, "y")], "doc_id int, number int, text string")
    src = spark.createDataFrame([(0, "see https://a.b/c")], "doc_id int, text string")
    assert {r.code for r in units.reference_problems(src, bad).collect()} == {"NUMBERS_NOT_CONTIGUOUS", "URL_BROKEN"}


def test_overrides(spark):
    e = spark.createDataFrame([(0, "a", (0.0, 0.0, 1.0, 1.0), [1]), (0, "b", (5.0, 5.0, 6.0, 6.0), [2]), (0, "c", (7.0, 7.0, 8.0, 8.0), [3])], f"doc_id int, element_id string, bbox {BOX}, block_ids array<int>")
    m = units.merge_elements(e, spark.createDataFrame([(0, "a", "b")], "doc_id int, keep_id string, drop_id string"))
    assert {r.element_id: (r.bbox.x1, r.block_ids) for r in m.collect()} == {"a": (6.0, [1, 2]), "c": (8.0, [3])}
    s = units.split_elements(e, spark.createDataFrame([(0, "a", [(0.0, 0.0, 0.5, 1.0), (0.5, 0.0, 1.0, 1.0)])], f"doc_id int, element_id string, boxes array<{BOX}>"))
    assert sorted(r.element_id for r in s.collect()) == ["a-part01", "a-part02", "b", "c"]


def test_grid_and_coverage(spark):
    cells = [(0, 1, 1, r * 10 + c, (c * 50.0, r * 20.0, c * 50.0 + 30, r * 20.0 + 10)) for r in range(3) for c in range(3)]
    got = units.table_grid(spark.createDataFrame(cells, f"doc_id int, page int, region int, ord int, bbox {BOX}")).collect()
    assert {r.ord: (r.row_no, r.column_no) for r in got} == {r * 10 + c: (r, c) for r in range(3) for c in range(3)}
    pages = spark.createDataFrame([(0, 1, "abab", ["ab", "ab"]), (0, 2, "abcd", ["ab"]), (0, 3, None, None)], "doc_id int, page int, text string, units array<string>")
    assert {r.page: r.coverage for r in units.greedy_coverage(pages).collect()} == {1: 1.0, 2: 0.5, 3: 1.0}
