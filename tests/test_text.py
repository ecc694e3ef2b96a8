from pyspark.sql import functions as F

from leafmill.functions import arrow as A
from leafmill.functions import text as X
from leafmill.operators import gates


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]


def test_statistics(spark):
    assert set(one(spark, "Losses fell by 3.5-17.6% a year, with bounds of 4.1–19.2%.", X.statistics)) == {"3.5%", "4.1%", "17.6%", "19.2%"}
    assert set(one(spark, "beta=0.60; rho=.05; slope=− .42; q=0.003", X.statistics)) == {"0.6", "0.05", "-0.42", "0.003"}
    assert one(spark, None, X.statistics) == []


def test_citations_are_listed_not_expanded(spark):
    assert one(spark, "see [1, 3-5]", X.citations) == ["1", "3", "5"]


def test_acronyms_next_to_chinese(spark):
    assert set(one(spark, "使用ABC-12表格、XQZ清单和TRK-P清单", X.present_acronyms)) == {"ABC-12", "XQZ", "TRK-P"}


def test_canonical_number(spark):
    for value, want in (("0.70", "0.7"), (".07", "0.07"), ("-0", "0"), ("12.50 %", "12.5%"), ("+3", "3"), ("007.10", "7.1")):
        assert one(spark, value, X.canonical_number) == want


def test_headings(spark):
    for value, want in (
        ("1 Introduction", True),
        ("References", True),
        ("Department of Physics, University of X", False),
        ("and the results of this. We then", False),
        ("Figure 3", False),
        ("", False),
    ):
        assert one(spark, value, X.is_heading) is want, value


def test_stamps_authors_names(spark):
    assert one(spark, "arXiv: 2101.00001v2", X.is_stamp)
    assert one(spark, "Ada Lovelace, Alan Turing and Grace Hopper", X.is_author)
    assert not one(spark, "we then went home.", X.is_author)
    assert one(spark, "Ludwig van Beethoven", X.is_proper_name)


def test_language_estimate(spark):
    for value, want in (("hello", "und-Latn"), ("你好世界", "zh"), ("한국어 문장", "ko"), ("12", "und"), ("ひらがなだけのながいぶんしょうをここにかきます", "ja")):
        assert one(spark, value, X.language_estimate) == want


def test_chunks(spark):
    got = one(spark, "Aaa bbb. Ccc ddd. " * 100, lambda c: X.chunks(c, 100))
    assert all(len(x) <= 100 for x in got) and " ".join(got) == ("Aaa bbb. Ccc ddd. " * 100).strip()
    assert one(spark, "x" * 250, lambda c: X.chunks(c, 100)) == ["x" * 100, "x" * 100, "x" * 50]
    assert one(spark, "", X.chunks) == []


def test_spec_and_overlap(spark):
    assert one(spark, "1-3,7", X.numbers_of_spec) == [1, 2, 3, 7]
    assert one(spark, "1-x", X.numbers_of_spec) is None
    df = spark.createDataFrame([("abc the quick brown fox", "the quick brown fox jumps")], "a string, b string")
    assert df.select(A.overlap_length(F.col("a"), F.col("b"))).first()[0] == len("the quick brown fox")


def test_year_present(spark):
    df = spark.createDataFrame([("1980s", "在20世纪80年代"), ("1999", "in 1999."), ("1998", "in 1999.")], "y string, t string")
    assert [r[0] for r in df.select(X.year_present(F.col("y"), F.col("t"))).collect()] == [True, True, False]


def test_compression(spark):
    rows = [("heading", 46, 0.17, None), ("metadata", 80, 0.15, None), ("body", 160, 0.1, "SEVERE_TRANSLATION_COMPRESSION"), ("body", 160, 0.22, "POSSIBLE_SUMMARY_OR_OMISSION")]
    df = spark.createDataFrame(rows, "k string, n int, r double, want string")
    got = df.select(gates.compression_flag(F.col("k"), F.col("n"), F.col("r"), F.lit(0.2), F.lit(0.25)).alias("f"), "want").collect()
    assert all(r.f == r.want for r in got)


def test_keep_source(spark):
    rows = [("person-name", "Ada Lovelace", True), ("acronym", "SBQ-R", True), ("acronym", "a whole sentence", False), ("doi-or-url", "doi: 10.1000/xyz.123", True), ("nonsense", "x", False)]
    df = spark.createDataFrame(rows, "c string, s string, want boolean")
    none = F.lit(None).cast("string")
    got = df.select(gates.keep_source_ok(F.col("c"), F.col("s"), F.lit("body"), none, F.lit(False), F.array().cast("array<string>")).alias("g"), "want").collect()
    assert all(r.g == r.want for r in got), got


def test_alike_equals_sequence_matcher():
    import random
    from difflib import SequenceMatcher

    from leafmill.functions import arrow

    rng = random.Random(3)
    for turn in range(150):
        x = "".join(rng.choice("abcde " if turn % 2 else "ab") for _ in range(rng.randrange(1, 500)))
        y = list(x)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(3)] = rng.choice(["", "z", "ab"])
        y = "".join(y)
        m = SequenceMatcher(None, x, y, autojunk=False)
        assert arrow._longest(x, y) == tuple(m.find_longest_match(0, len(x), 0, len(y)))
        for least in (0.8, 0.96, m.ratio()):
            assert arrow.alike(x, y, least) == (m.ratio() >= least)


def test_fuzzy_match_query_gives_every_pair(spark, monkeypatch):
    from difflib import SequenceMatcher

    from leafmill.plans import queries_text

    head = "The same beginning of every text, more than 24 characters. "
    long = head + " ".join(f"word{i * i % 97}" for i in range(300))
    texts = [long, long, long.replace("word4 ", "other "), head + " ".join(f"thing{i}" for i in range(250)), head[:28], long[:-200]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(queries_text, "_docs", lambda spark, d: docs)
    got = {r.b_id: r.matches for r in queries_text.fuzzy_match(spark, "").collect()}

    def want(x, y):
        short, most = sorted((len(x), len(y)))
        return short >= 30 and short >= 0.9 * most and SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.96

    assert len(long) > 1500 and got == {i: want(texts[0], texts[i]) for i in range(1, 6)}


def test_coverage_is_settled_by_bounds_as_by_all_matching_blocks():
    """A long line against a long payload once took time as the product of their lengths."""
    import random
    import time
    from difflib import SequenceMatcher

    from leafmill.functions import arrow

    rng = random.Random(9)
    some = lambda n, letters="abc": "".join(rng.choice(letters) for _ in range(n))
    pairs = [(some(rng.randint(0, 14)), some(rng.randint(0, 30))) for _ in range(1500)]
    for _ in range(60):
        b = some(300, "abcdefghijkl")
        pairs.append(("".join(c if rng.random() < 0.93 else "z" for c in b[40:200]), b))
    for a, b in pairs:
        share = 0.0 if not a else 1.0 if a in b else sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a)
        assert [arrow.within(a, b, x) for x in (0.5, 0.75, 0.9)] == [share >= x for x in (0.5, 0.75, 0.9)], (a, b)
    a, b = some(30_000, "ab"), some(30_000, "cd") + "ab" * 10
    began = time.process_time()
    assert not arrow.within(a, b, 0.9)
    assert time.process_time() - began < 20
