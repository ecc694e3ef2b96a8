"""Rules on inputs of their own: pagination, seams, substring search, ranking, comparison."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import arrow as A
from leafmill.functions import text as X
from leafmill.operators import binding, ordering


def placed(spark, rows, height=100.0):
    df = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], "doc_id int, ord int, group_id string, height double, splittable boolean, footnote boolean")
    return [(r.out_page, r.area, r.problem) for r in ordering.paginate(df, height).orderBy("ord").collect()]


def test_footnotes_take_nothing_from_the_text(spark):
    got = placed(spark, [(None, 60.0, False, False), (None, 90.0, False, True), (None, 40.0, False, False), (None, 1.0, True, False)])
    assert got == [(1, "body", None), (1, "footer", None), (1, "body", None), (2, "body", None)]


def test_a_group_stands_where_its_first_block_does(spark):
    got = placed(spark, [("g", 30.0, True, False), (None, 50.0, True, False), ("g", 40.0, True, False)])
    assert [p for p, _, _ in got] == [1, 2, 1]
    got = placed(spark, [(None, 60.0, True, False), ("g", 30.0, True, False), ("g", 20.0, True, False), (None, 50.0, True, False)])
    assert [p for p, _, _ in got] == [1, 2, 2, 2]


def test_what_is_higher_than_a_page_stays(spark):
    got = placed(spark, [(None, 10.0, True, False), (None, 150.0, False, False), (None, 5.0, True, False)])
    assert got == [(1, "body", None), (1, "body", "BLOCK_HIGHER_THAN_PAGE"), (2, "body", None)]
    got = placed(spark, [(None, 10.0, True, False), ("g", 80.0, True, False), ("g", 40.0, True, False)])
    assert got == [(1, "body", None)] + [(1, "body", "GROUP_HIGHER_THAN_PAGE")] * 2
    assert placed(spark, [(None, 10.0, True, False), (None, 150.0, True, False)])[1] == (2, "body", None)


def test_seam_is_the_longest(spark):
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in "ab")
        if rng.random() < 0.5:
            b = a[-rng.randint(1, 20) :] + b
        fits = [k for k in range(3, min(len(a), len(b)) + 1) if a[-k:] == b[:k]]
        assert A.seam(a, b, 3) == max(fits, default=0), (a, b)
    assert A.seam("x" * 50_000, "x" * 50_000, 12) == 50_000


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("one two three four five", "a", 1, "body"), ("three four five and then some more words here", "b", 1, "body")], 1),
        ([("one two three four five", "a", 1, "body"), ("three four five and then some more words here", "b", 3, "body")], 0),
        ([("one two three four five", "a", 2, "body"), ("three four five and then some more words here", "b", 1, "body")], 0),
        ([("one two three four five", "a", 1, "References"), ("three four five and then some more words here", "b", 1, "body")], 0),
        ([("one two three four five", "s one three four five", 1, "body"), ("three four five and then", "three four five end", 1, "body")], 0),
        ([("one two three four, five!", "a", 1, "body"), ("Three", "b", 1, "body")], 0),
        ([("x" * 60 + "abcdefghijkl", "a", 1, "body"), ("abcdefghijkl" + "y" * 60, "b", 1, "body")], 0),
    ],
)
def test_adjacent_overlaps(spark, rows, want):
    df = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], "doc int, ord int, target string, source string, page int, kind string")
    assert ordering.adjacent_overlaps(df, ["doc"], ["ord"], "target", "source", "page", "kind").count() == want


def test_comparison_text(spark):
    df = spark.createDataFrame([(" «A­b​  c, D.» ",), ("(Ｆｕｌｌ, half!)",), ("a‍b",), (None,)], "t string")
    assert [r[0] for r in df.select(A.comparison_text("t")).collect()] == ["«ab c, d.»", "full, half", "a‍b", ""]


def test_probes_keep_the_last_window(spark):
    probe = lambda t: spark.createDataFrame([(t,)], "t string").select(X.probes(F.col("t"))).first()[0]
    assert probe("a" * 24 + "b" * 5) == ["a" * 24, "b" * 5]
    assert probe("a" * 24 + "b") == ["a" * 24]
    assert probe("x" * 200) == ["x" * 24] * 6
    assert probe("x") == probe("") == probe(None) == []


def test_anchors_are_found_within_words(spark):
    items = spark.createDataFrame([(1, "1024"), (1, "512"), (1, "256"), (2, "zzz")], "item int, anchor string")
    pages = spark.createDataFrame([(1, "a1024 b512c"), (2, "1 0 24 512 256"), (3, "1024 only"), (4, None)], "page int, text string")
    got = {(r.item, r.page, r.n_hits) for r in binding.anchor_pages(items, pages, "item", "page").collect()}
    assert got == {(1, 2, 3)}


def test_needles_by_automaton_and_by_equality(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(0, 400)))) for i in range(40)] + [(40, None)]
    needles = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    texts = spark.createDataFrame(rows, "id int, t string")
    wanted = spark.createDataFrame([(n,) for n in [*needles, ""]], "needle string")
    want = {(i, n) for i, t in rows for n in needles if n in (t or "")}
    for most in (1_000, 10):
        monkeypatch.setattr(binding, "SMALL", most)
        got = [tuple(r) for r in binding.find_needles(texts, "id", F.col("t"), wanted).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert binding.find_needles(texts, "id", F.col("t"), wanted.limit(0)).count() == 0


def test_rank_over_the_whole_table(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 10007).alias("score")).repartition(7)
    got = ordering.rank_with_budget(df, [], [F.desc("score"), "id"], 10).collect()
    order = sorted(got, key=lambda r: (-r.score, r.id))
    assert [r["rank"] for r in order] == list(range(1, 1001)) and sum(r.selected for r in got) == 10
    assert ordering.rank_with_budget(df.limit(0), [], ["id"], 3).count() == 0


def test_review_flags_by_language_family(spark):
    flags = lambda t, lang, kind=None: spark.createDataFrame([(t, lang, kind)], "t string, l string, k string").select(X.review_flags(F.col("t"), F.col("k"), F.col("l"))).first()[0]
    assert flags("Neither of them is likely", "en") == ["semantic-boundary"]
    assert flags("notable causes", "en") == []
    assert flags("das ist nichts", "de-DE") == ["semantic-boundary"] and flags("das ist nichts", "en") == []
    assert flags("二者可能相关", "zh-Hans") == ["semantic-boundary"]
    assert flags("Cronbach's alpha, SD = 3", None) == ["statistics-or-sample", "instrument-item-or-scoring"]
    assert flags("words", "en", "Abstract") == ["semantic-high-risk"]
    assert flags(None, None) == []
